"""Passages, digests and listed sounds against plain loops."""

import hashlib
import json
from collections import defaultdict

from pyspark.sql import functions as F

from quillspark.operators import passages as P
from quillspark.plans import passages as plans
from quillspark.plans.registry import QUERIES


def compose(parts, limit):
    lines = []
    for raw in parts:
        part = " ".join(raw.split())
        room = limit - sum(len(x) + 1 for x in lines)
        if not part:
            continue
        if room < 40:
            break
        if len(part) > room:
            space = part.rfind(" ", 0, room - 1)
            lines.append(part[: space if space >= room // 2 else room - 1].rstrip(" ,;:–—") + "…")
            break
        lines.append(part)
    return "\n".join(lines)


def test_composed(spark):
    rows = [["one", "", "  two\n three "], ["x" * 50, "word " * 30, "never"], ["a" * 200], ["short " * 12, "y" * 30, "z" * 90], []]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p array<string>").select("i", P.composed(F.col("p"), 100).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [compose(r, 100) for r in rows]


def test_digests(spark, small):
    rows = defaultdict(list)
    for r in plans.built(spark, small).collect():
        rows[r["video"]].append({"kind": r["kind"], "part": r["part"], "text": r["text"]})
    got = {r["video"]: r["digest"] for r in QUERIES["passage_digests"](spark, small).collect()}
    for video, items in rows.items():
        items.sort(key=lambda x: (x["kind"], x["part"], x["text"]))
        assert got.pop(video) == hashlib.sha256(json.dumps(items, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert not got


def test_listed_sounds(spark, small):
    spans = defaultdict(list)
    for r in plans.heard(spark, small).collect():
        spans[r["video"], r["class"], r["family"]].append((r["s"], r["e"]))
    below = defaultdict(set)
    for c, a in plans.PARENTS:
        below[a].add(c)
    want = set()
    for video in {k[0] for k in spans}:
        sounds = {k[1:]: v for k, v in spans.items() if k[0] == video}
        while True:
            kept = {}
            for (c, f), v in sounds.items():
                union = {x for (d, _), w in sounds.items() if d in below[c] for s, e in w for x in (2 * s, 2 * s + 1) if x < 2 * e}
                own = [x for s, e in v for x in (2 * s, 2 * s + 1) if x < 2 * e]
                if sum(x in union for x in own) < 0.8 * len(own):
                    kept[c, f] = len(own) / 2
            listed = [k for fam in ("f", "g") for k in sorted((k for k in kept if k[1] == fam), key=lambda k: (-kept[k], k[0]))[:2]]
            cut = set(kept) - set(listed)
            if not cut:
                break
            sounds = {k: v for k, v in sounds.items() if k not in cut}
        want |= {(video, c, kept[c, f]) for c, f in listed}
    assert {(r["video"], r["class"], r["seconds"]) for r in QUERIES["listed_sounds"](spark, small).collect()} == want

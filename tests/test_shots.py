"""Queries of shots, cues, boxes and passages that no SQL states, against plain loops over all rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.functions import search_words as W
from quillspark.operators import shots as S
from quillspark.plans import search as search_plans
from quillspark.plans import shots as plans
from quillspark.plans.registry import QUERIES, load


def groups(rows, *keys):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys)].append(r)
    return out


def wrapped(text, width=42):
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line] if line else lines


def test_cues(spark, small):
    got = groups(QUERIES["subtitle_cues"](spark, small).collect(), "k")
    for (k,), rows in groups(plans.words(spark, small).collect(), "k").items():
        rows.sort(key=lambda r: (r["s"], r["e"]))
        cues, cur = [], []
        for r in rows:
            if cur:
                end, text = max(x["e"] for x in cur), " ".join(x["t"] for x in cur)
                stop = r["s"] - end > 0.8 or len(wrapped(f"{text} {r['t']}")) > 2 or max(end, r["e"]) - cur[0]["s"] > 7
                stop = stop or cur[-1]["t"][-1] in ".?!…" and end - cur[0]["s"] >= 1 or cur[-1]["t"][-1] in ",;:" and len(text) > 42
                if stop:
                    cues.append(cur)
                    cur = []
            cur.append(r)
        cues.append(cur)
        mine = sorted(got.pop((k,)), key=lambda r: r["no"])
        assert [len(c) for c in cues] == [len(m["line"].split(" ")) for m in mine]
        for i, (c, m) in enumerate(zip(cues, mine, strict=True)):
            assert m["a"] >= (mine[i - 1]["b"] if i else 0) - 1e-9 and m["b"] - m["a"] >= 0.1 - 1e-9
            if i + 1 == len(cues) or cues[i + 1][0]["s"] - m["a"] >= 1:
                assert m["b"] - m["a"] >= 1 - 1e-9
            assert m["a"] >= round(c[0]["s"], 3) - 1e-9
    assert not got


def test_split_shots(spark, small):
    got = groups(QUERIES["split_shots"](spark, small).collect(), "k")
    whole = defaultdict(float)
    for r in load(spark, small, "lineitem").collect():
        whole[r["l_orderkey"]] += r["l_quantity"] * 1.9
    for (k,), rows in got.items():
        rows.sort(key=lambda r: r["part"])
        assert [r["part"] for r in rows] == list(range(1, len(rows) + 1)) and all(r["b"] >= r["a"] for r in rows)
        assert abs(sum(r["b"] - r["a"] for r in rows) - whole.pop(k)) < 1e-2 and max(r["b"] - r["a"] for r in rows) <= 45
    assert not whole


def plain_parts(words, frames):
    """The parts of a recording by plain loops over all words."""
    s, e = min(a for a, _ in words), max(b for _, b in words)
    bounds, count = [s], max(2, round((e - s) / 20)) if e - s > 30 else 1
    for i in range(1, count):
        ideal = s + i * ((e - s) / count)
        near = [t for t in frames if abs(t - ideal) <= 0.25 * ((e - s) / count)]
        cut = min(near, key=lambda t: abs(t - ideal)) if near else ideal
        low, high = bounds[-1] + 4, e - 4 * (count - i)
        inside = [w for w in sorted(words) if w[0] < cut < w[1]][:1]
        edges = [t for w in inside for t in w if low <= t <= high and abs(t - cut) <= 3]
        bounds.append(min(max(min(edges, key=lambda t: abs(t - cut), default=cut), low), high))
    return [*zip(bounds, [*bounds[1:], e], strict=True)]


def test_spoken_shots_equal_plain_loops(spark):
    """Words that overlap, long ones that leave no place, silence, short recordings; some words a row."""
    rng, rows, want = random.Random(5), [], {}
    for k in [None, *range(40)]:
        t, words, frames = rng.random(), [], sorted(rng.uniform(0, 300) for _ in range(rng.choice([0, 3, 30])))
        for _ in range(rng.choice([1, 20, 60, 400])):
            words.append((t, t + rng.choice([0.2, 0.7, 2.5, 9.0])))
            t += rng.choice([0.1, 0.6, 0.6, 4.0])
        want[k], at = plain_parts(words, frames), 0
        while at < len(words):
            n = rng.choice([0, 1, 5, 64])
            rows.append((k, len(rows), [a for a, _ in words[at : at + n]], [b for _, b in words[at : at + n]], None if at else frames))
            at += n
    assert any(len(p) > 10 for p in want.values()) and any(len(p) == 1 for p in want.values())
    df = spark.createDataFrame(rows, "k int, i int, s array<double>, e array<double>, frames array<double>").repartition(5)
    got = groups(S.split_spoken(df, ["k"], "i", "s", "e", "frames").collect(), "k")
    assert {k: [(r["a"], r["b"]) for r in sorted(g, key=lambda r: r["part"])] for (k,), g in got.items()} == want


def test_motion_of_equal_orders_is_equal(spark, tmp_path):
    """The lines of this order lie on a tie, and the class depends on the order in which they are added."""
    lines = [(3, 19.0, 0.07, 0.06), (6, 49.0, 0.01, 0.08), (7, 23.0, 0.02, 0.0)]
    rows = [(k, *line) for k in range(300) for line in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["motion_classes"](spark, str(tmp_path)).groupBy("motion", "stability").count().collect()
    assert [(r["motion"], r["count"]) for r in got] == [("pan_right", 300)]


def test_filled_slots(spark, small):
    rows = {(r["l_orderkey"], r["l_linenumber"], r["l_quantity"], r["l_discount"]) for r in load(spark, small, "lineitem").collect()}
    want = defaultdict(list)
    for k, n, q, d in rows:
        low, high, taken, extra = max(0.15, 0.06 * q), q - max(0.2, 0.06 * q), [q * 0.3, d * 100], []
        for i in range(4):
            t = round(low + (high - low) * i / 3.0, 3)
            if len(taken) < 4 and all(abs(t - x) >= 1 for x in taken):
                taken.append(t)
                extra.append(t)
        want[k, n].append(extra)
    got = groups(QUERIES["filled_slots"](spark, small).collect(), "l_orderkey", "l_linenumber")
    for key, lists in want.items():
        mine = [[float(x) for x in r["extra"].split(",") if x] for r in got[key]]
        assert sorted(map(len, lists)) == sorted({tuple(m): len(m) for m in mine}.values()) or all(any(len(m) == len(w) and all(abs(a - b) < 2e-3 for a, b in zip(m, w, strict=True)) for w in lists) for m in mine)


def test_reading_order(spark, small):
    rows = groups(load(spark, small, "lineitem").collect(), "l_orderkey")
    got = groups(QUERIES["box_reading_order"](spark, small).collect(), "l_orderkey")
    for (k,), lines in rows.items():
        if len({r["l_linenumber"] for r in lines}) < len(lines):
            continue
        order = sorted(((r["l_tax"] * 500, r["l_discount"] * 1000, r["l_linenumber"]) for r in lines), key=lambda b: b[:2])
        if len({b[:2] for b in order}) < len(order):
            continue
        for i in range(len(order) - 1):
            j = i
            while j >= 0 and abs(order[j + 1][0] - order[j][0]) < 10 and order[j + 1][1] < order[j][1]:
                order[j], order[j + 1] = order[j + 1], order[j]
                j -= 1
        assert [b[2] for b in order] == [r["l_linenumber"] for r in sorted(got[k,], key=lambda r: r["place"])]


def test_passages_fit_and_do_not_repeat(spark, small):
    got = groups(QUERIES["chosen_passages"](spark, small).collect(), "lang")
    docs = groups(load(spark, small, "documents").where("text is not null").collect(), "lang")
    for (lang,), rows in docs.items():
        rows = sorted(rows, key=lambda r: (-r["n_chars"], r["doc_id"]))[:40]
        item = [(r["source"] or "", float(r["doc_id"] % 60) if r["doc_id"] % 5 else None, -(-len(r["text"]) // 4)) for r in rows]
        taken, left, rest = [], 20_000, list(range(len(item)))
        while rest and len(taken) < 16:
            best = min(rest, key=lambda i: (i + 4 * sum(item[t][0] == item[i][0] for t in taken), i))
            rest.remove(best)
            v, a, cost = item[best]
            same = [item[t][1] for t in taken if item[t][0] == v]
            if cost > left or any((a is None and b is None) or (a is not None and b is not None and 10 - abs(a - b) >= 5) for b in same):
                continue
            taken.append(best)
            left -= cost
        assert sorted(taken) == sorted(r["rank"] for r in got.pop((lang,)))
    assert not got


@pytest.mark.parametrize("name", ["matched_boxes", "matched_beings"])
def test_matching(spark, small, name):
    got = groups(QUERIES[name](spark, small).collect(), "l_orderkey")
    for (k,), rows in groups(plans.box_pairs(spark, small).collect(), "l_orderkey").items():
        kept, a, b = [], set(), set()
        if name == "matched_boxes":
            for r in sorted(rows, key=lambda r: (r["iou"], r["a"], r["b"]), reverse=True):
                if r["a"] not in a and r["b"] not in b:
                    a.add(r["a"]), b.add(r["b"]), kept.append((r["a"], r["b"]))
        else:
            for x in sorted({(r["a"], r["area"]) for r in rows}, key=lambda x: (-x[1], x[0])):
                free = [r for r in rows if r["a"] == x[0] and r["b"] not in b]
                if x[0] not in a and free:
                    best = min(free, key=lambda r: (-r["iou"], r["b"]))
                    a.add(x[0]), b.add(best["b"]), kept.append((best["a"], best["b"]))
        if len({(r["a"], r["area"]) for r in rows}) == len({r["a"] for r in rows}):
            assert sorted(kept) == sorted((r["a"], r["b"]) for r in got[k,])


def test_caption_groups(spark, small):
    got = groups(QUERIES["caption_groups"](spark, small).collect(), "p_brand")
    for (brand,), rows in groups(load(spark, small, "part").collect(), "p_brand").items():
        found = []
        for r in sorted(rows, key=lambda r: r["p_partkey"]):
            own = set(r["p_name"].lower().split(" "))
            for g in found:
                if len(own & g[1]) / len(own | g[1]) >= 0.5:
                    g[2] += 1
                    break
            else:
                found.append([r["p_partkey"], own, 1])
        assert sorted((f[0], f[2]) for f in found) == sorted((r["first"], r["n"]) for r in got[brand,])


def test_snippets(spark):
    asked = W.Asked(("lavend", "sea"), (("of", "the"),))
    long = "start " * 50 + "the smell of the lavender by the sea was strong, " + "tail " * 80
    rows = [(1, "One line\n\n second LAVENDE field "), (2, long), (3, None), (4, "nothing " * 60), (5, "sea " * 100)]
    got = {r["doc_id"]: r for r in search_plans.snippets(spark.createDataFrame(rows, "doc_id long, text string"), asked).collect()}
    assert got[1]["snippet"] == "One line · second LAVENDE field" and got[1]["marks"] == 1 and got[3]["snippet"] == ""
    assert got[2]["snippet"].startswith("…") and got[2]["snippet"].endswith("…") and "of the lavender by the sea" in got[2]["snippet"] and got[2]["marks"] == 4
    assert got[4]["snippet"].startswith("nothing") and got[4]["snippet"].endswith("nothing…") and got[5]["marks"] == 100
    assert all(len(r["snippet"]) <= 242 for r in got.values())
    every = QUERIES["snippet_texts"]
    assert every


def test_phase_windows(spark, small):
    rows = QUERIES["phase_windows"](spark, small).collect()
    assert rows and all(r["low"] <= r["high"] and 0 <= r["sun_up_s"] <= 3600 and r["sun_up_s"] % 60 == 0 for r in rows)
    for r in rows:
        names = r["phases"].split(">")
        assert len(names) == len(set(names))
        if r["sun_up_s"] == 3600:
            assert r["low"] > -0.833 and set(names) <= {"day", "golden_hour"}
        if r["high"] < -18:
            assert names == ["night"]


def test_sentence_case(spark):
    rows = [("Coucher de Soleil au Lac", []), ("porte de l'Himalaya et Népal", ["HIMALAYAS", "NEPAL"]), ("« le Chat » PowerPoint IA", []), ("12 Mois d'Époque", []), ("iPhone à Hyères", ["Hyeres"]), ("", [])]
    got = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(rows)], "i int, t string, p array<string>").select("i", W.sentence_case(F.col("t"), F.col("p")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == ["Coucher de soleil au lac", "Porte de l'Himalaya et Népal", "« Le chat » PowerPoint IA", "12 mois d'époque", "iPhone à Hyères", ""]
    assert spark.range(1).select(W.recognised_fold(F.lit("ŒUVRE naïve Æ"))).first()[0] == "oeuvre naive ae"

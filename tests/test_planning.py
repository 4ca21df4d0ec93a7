"""Chapters, boundaries, reframing, subjects, nearest places, sun events and colours against plain versions."""

from __future__ import annotations

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import sky
from quillspark.operators import chapters as C
from quillspark.operators import colours, places, reframe, subjects
from quillspark.plans import planning
from quillspark.plans.registry import QUERIES, load


def plain_spread(x, w):
    mean = (x * w[:, None]).sum(0) / w.sum()
    return float((w * ((x - mean) ** 2).sum(1)).sum())


def test_spreads_equal_the_definition():
    rng = np.random.default_rng(1)
    x, w = rng.random((9, 5)), rng.random(9) + 0.1
    got = C.spreads(x, w)
    for i in range(10):
        for j in range(10):
            assert got[i, j] == np.inf if j <= i else abs(got[i, j] - plain_spread(x[i:j], w[i:j])) < 1e-9


def test_terms_weigh_by_rarity():
    x = C.term_vectors([["a", "b", "b"], ["a", "c"], ["a", "b"], []])
    common, rare = 1 / math.log(4), 1 / math.log(3)
    assert np.count_nonzero(x[3]) == 0 and np.allclose(np.linalg.norm(x[:3], axis=1), 1)
    # "a" is in three of four blocks, which is over the share that still tells blocks apart.
    assert np.isclose(x[0].max(), 1.0) and np.isclose(sorted(x[1])[-1], 1.0) and common < rare


def test_chapters_equal_all_cuts(spark, small):
    got = defaultdict(list)
    for r in QUERIES["chapters_spread"](spark, small).collect():
        got[r["conv_id"]].append(r)
    rows = defaultdict(list)
    for r in planning.turns(spark, small).collect():
        rows[r["conv_id"]].append(r)
    for conv, blocks in rows.items():
        blocks.sort(key=lambda r: r["s"])
        n, end = len(blocks), max(blocks[-1]["e"], 0.0)
        x = C.term_vectors([list(b["words"]) for b in blocks])
        w = np.array([min(b["e"] - b["s"], 30.0) + 1 for b in blocks])
        starts = [b["s"] for b in blocks] + [end]
        least = max(20.0, 0.5 * end / 3)
        best = None
        for k in (3, 2, 1):
            fits = [c for c in itertools.combinations(range(1, n), k - 1) for b in [(0, *c, n)] if all(starts[j] - starts[i] >= least for i, j in zip(b, b[1:], strict=False))]
            if fits:
                best = min(sum(plain_spread(x[i:j], w[i:j]) for i, j in zip((0, *c), (*c, n), strict=True)) for c in fits)
                break
        mine = sorted(got.pop(conv), key=lambda r: r["chapter"])
        assert mine[0]["first"] == 0 and mine[-1]["last"] == n - 1 and all(p["last"] + 1 == q["first"] for p, q in zip(mine, mine[1:], strict=False))
        if best is None:
            assert len(mine) == 1
        else:
            assert len(mine) == k and abs(sum(r["spread"] for r in mine) - best) < 1e-6
    assert not got


def plain_best(boxes, places_, size, near=None):
    def inside(b, p):
        area = max(0, b[2] - b[0]) * max(0, b[3] - b[1])
        if not area:
            return 1.0
        return max(0.0, min(b[2], p[0] + size[0]) - max(b[0], p[0])) * max(0.0, min(b[3], p[1] + size[1]) - max(b[1], p[1])) / area

    scored = [(np.mean([inside(b, p) for b in boxes]), min(inside(b, p) for b in boxes), p) for p in places_]
    some = [s for s in scored if s[0] >= max(x[0] for x in scored) - 0.01]
    some = [s for s in some if s[1] >= max(x[1] for x in some) - 0.01]
    near = near or [np.mean([(b[i] + b[i + 2]) / 2 for b in boxes]) - size[i] / 2 for i in (0, 1)]
    return min(some, key=lambda s: (s[2][0] - near[0]) ** 2 + (s[2][1] - near[1]) ** 2)


def test_reframing_equals_whole_searches(spark):
    rng = random.Random(3)
    size, picture, scale = (607.5, 1080.0), (1920.0, 1080.0), 1080 / 607.5
    spots = [(1312.5 * i / 60, 0.0) for i in range(61)]
    rows, plain = [], {}
    for item in range(12):
        at, boxes = sorted(rng.sample(range(20), 8)), []
        x = rng.uniform(0, 1500)
        for t in at:
            x = min(1500.0, max(0.0, x + rng.choice([0, 40, -40, 700, -700])))
            boxes.append((x, 100.0, x + rng.uniform(50, 400), 900.0))
            rows.append((item, float(t), *boxes[-1], 0.0, 20.0))
        runs = []
        for i in range(8):
            if runs and plain_best([boxes[j] for j in [*runs[-1], i]], spots, size)[1] >= 0.8:
                runs[-1].append(i)
            else:
                runs.append([i])
        cuts = [0.0, *[(at[a[-1]] + at[b[0]]) / 2 for a, b in itertools.pairwise(runs)], 20.0]
        parts = [[cuts[i], cuts[i + 1], r] for i, r in enumerate(runs)]
        while len(parts) > 1 and min(b - a for a, b, _ in parts) < 1.5:
            i = min(range(len(parts)), key=lambda i: parts[i][1] - parts[i][0])
            sides = [j for j in (i - 1, i) if 0 <= j < len(parts) - 1]
            j = max(sides, key=lambda j: plain_best([boxes[f] for f in parts[j][2] + parts[j + 1][2]], spots, size)[1])
            parts[j : j + 2] = [[parts[j][0], parts[j + 1][1], parts[j][2] + parts[j + 1][2]]]
        while True:
            out = []
            for _, _, f in parts:
                out.append(plain_best([boxes[i] for i in f], spots, size, out[-1][2] if out else None))
            close = [i for i in range(len(out) - 1) if abs(out[i][2][0] - out[i + 1][2][0]) * scale < 150]
            if not close:
                break
            i = close[0]
            parts[i : i + 2] = [[parts[i][0], parts[i + 1][1], parts[i][2] + parts[i + 1][2]]]
        plain[item] = [(a, b, round(o[2][0], 3), len(f)) for (a, b, f), o in zip(parts, out, strict=True)]
    df = spark.createDataFrame(rows, "item int, t double, x1 double, y1 double, x2 double, y2 double, a double, b double")
    got = defaultdict(list)
    for r in reframe.plan(df, ["item"], "t", ["x1", "y1", "x2", "y2"], picture, size, ["a", "b"], scale=scale).orderBy("item", "piece").collect():
        got[r["item"]].append((r["a"], r["b"], r["x"], r["frames"]))
    assert dict(got) == plain


def test_plans_cover_their_clips(spark, small):
    got = defaultdict(list)
    for r in QUERIES["reframe_plan"](spark, small).orderBy("l_orderkey", "piece").collect():
        got[r["l_orderkey"]].append(r)
    assert len(got) == load(spark, small, "lineitem").select("l_orderkey").distinct().count()
    assert all(p[0]["a"] == 0 and p[-1]["b"] == 16 and all(x["b"] == y["a"] for x, y in itertools.pairwise(p)) for p in got.values())


def iou(p, q):
    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
    both = max(0.0, w) * max(0.0, h)
    return both / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both)


def plain_subjects(rows):
    """By the rules, box by box: the set of (box, category, sources, has a face)."""
    box = lambda r: (r["x1"], r["y1"], r["x2"], r["y2"])
    kin = lambda a, b: a == b or {a, b} <= {"mammal", "bird", "insect", "other_animal"} or {a, b} <= {"person", "body_part"}
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    named = []
    for r in rows:
        if r["source"] == "named" and not any(kin(r["category"], k["category"]) and iou(box(r), box(k)) >= 0.8 for k in named):
            named.append(r)
    boxes, partner = [r for r in rows if r["source"] == "boxes"], {}
    for rule in (lambda v, d: kin(v["category"], d["category"]) and iou(box(v), box(d)) >= 0.5, lambda v, d: v["category"] == "mammal" and d["category"] == "person" and d["score"] >= 0.8 and iou(box(v), box(d)) >= 0.7):
        while free := [(iou(box(v), box(d)), i, j) for i, v in enumerate(named) for j, d in enumerate(boxes) if i not in partner and j not in partner.values() and rule(v, d)]:
            _, i, j = max(free)
            partner[i] = j
    out = []
    for i, v in enumerate(named):
        d = boxes[partner[i]] if i in partner else None
        kind = v["category"]
        if d is not None and kind == "mammal" and d["category"] == "person":
            kind = "person"
        elif d is not None and kind != d["category"] and kind in ("mammal", "bird") and d["score"] >= 0.8:
            kind = d["category"]
        out.append([box(d or v), kind, ["named", "boxes"] if d is not None else ["named"], False])
    for j, d in enumerate(boxes):
        if j not in partner.values() and d["score"] >= 0.5 and (not named or d["category"] == "person" and sum(v["category"] == "person" for v in named) >= 2):
            out.append([box(d), d["category"], ["boxes"], False])
    for f in sorted((r for r in rows if r["source"] == "faces"), key=lambda r: -r["score"]):
        b = box(f)
        if b[2] - b[0] > 0.5:
            continue
        x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        free = [s for s in out if s[1] == "person" and not s[3] and s[0][0] <= x <= s[0][2] and s[0][1] <= y <= s[0][3] and size(s[0]) > size(b)]
        if free:
            s = min(free, key=lambda s: size(s[0]))
            s[2], s[3] = [*s[2], "faces"], True
        elif not named:
            out.append([b, "face", ["faces"], True])
    return sorted((tuple(round(v, 6) for v in b), k, "+".join(s), f) for b, k, s, f in out)


def test_subjects_equal_the_rules(spark, small):
    frames = defaultdict(list)
    for r in planning.detections(spark, small).collect():
        frames[r["l_orderkey"]].append(r)
    got = defaultdict(list)
    for r in QUERIES["fused_subjects"](spark, small).collect():
        got[r["l_orderkey"]].append(r)
    met = 0
    for frame, rows in frames.items():
        rows.sort(key=lambda r: tuple(r["n"]))
        mine = got.pop(frame, [])
        assert sorted((tuple(round(r[c], 6) for c in subjects.BOX), r["category"], r["sources"], r["face"] != "") for r in mine) == plain_subjects(rows)
        if mine:
            assert sum(r["main"] for r in mine) >= 1 and [r["main"] for r in sorted(mine, key=lambda r: r["no"])] == sorted((r["main"] for r in mine), reverse=True)
        met += sum("named+boxes" in r["sources"] for r in mine)
    assert not got and met > 20


@pytest.mark.parametrize("limit", [None, 800.0])
def test_nearest_places_equal_a_full_scan(spark, limit):
    rng = random.Random(5)
    there = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [(200, 90.0, 0.0), (201, -90.0, 10.0), (202, 0.0, 180.0), (203, 0.0, -179.9), (204, None, 1.0)]
    here = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(40)] + [(50, 90.0, 77.0), (51, -89.9, 0.0), (52, 0.1, 179.99), (53, 0.0, -180.0), (54, None, None)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return round(2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h))), 6)

    want = {}
    for p, la, lo in here:
        if la is not None:
            near = sorted((km(la, lo, a, o), q) for q, a, o in there if a is not None)
            want[p] = [q for d, q in near if limit is None or d <= limit][:4]
    got = defaultdict(list)
    out = places.nearest_k(spark.createDataFrame(here, "p int, lat double, lon double"), spark.createDataFrame(there, "q int, p_lat double, p_lon double"), "p", "q", 4, planning._cut(spark), limit, 300.0)
    for r in out.orderBy("p", "rank").collect():
        got[r["p"]].append(r["q"])
    assert dict(got) == {p: q for p, q in want.items() if q}


def test_sun_events_within_a_second(spark):
    """Against a scan by the second, and null on polar days and nights."""
    start = 1_718_841_600.0
    rows = [(i, start + d * 86400 - lon * 240, lat, lon) for i, (d, lat, lon) in enumerate([(0, 45.0, 3.0), (90, -20.0, 140.0), (0, 80.0, 10.0), (180, 80.0, 10.0), (200, 66.0, -30.0)])]
    df = spark.createDataFrame(rows, "i int, s double, lat double, lon double")
    got = {r["i"]: r["x"] for r in df.select("i", sky.sun_crossings(F.col("s"), F.col("lat"), F.col("lon")).alias("x")).collect()}
    every = df.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(86400), F.lit(4)))).select("i", (F.col("s") + F.col("t")).alias("t"), sky.sun(F.col("s") + F.col("t"), F.col("lat"), F.col("lon"))["elevation"].alias("e"))
    seen = defaultdict(list)
    for r in every.collect():
        seen[r["i"]].append((r["t"], r["e"] > sky.SUNRISE))
    for i, steps in seen.items():
        steps.sort()
        for name, up in (("rise", True), ("set", False)):
            found = [(a, b) for (a, x), (b, y) in itertools.pairwise(steps) if x != y and y == up]
            if not found:
                assert got[i][name] is None
            else:
                assert found[-1][0] - 1 <= got[i][name] <= found[-1][1] + 1
    assert got[2]["rise"] is None and got[2]["set"] is None and got[3]["rise"] is None and got[0]["rise"] is not None


def plain_k_means(pixels, k):
    pixels = sorted(map(tuple, pixels))
    away = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c, strict=True))
    mean = tuple(sum(c) / len(pixels) for c in zip(*pixels, strict=True))
    centres = [min(pixels, key=lambda p: away(p, mean))]
    while len(centres) < min(k, len(pixels)):
        centres.append(max(pixels, key=lambda p: min(away(p, c) for c in centres)))
    near = lambda p: min(range(len(centres)), key=lambda i: away(p, centres[i]))
    for _ in range(20):
        own = [[p for p in pixels if near(p) == i] for i in range(len(centres))]
        moved = [tuple(sum(c) / len(o) for c in zip(*o, strict=True)) if o else centres[i] for i, o in enumerate(own)]
        step, centres = max(math.sqrt(away(a, b)) for a, b in zip(moved, centres, strict=True)), moved
        if step < 1:
            break
    return centres, [sum(near(p) == i for p in pixels) for i in range(len(centres))]


def test_k_means_equals_a_plain_one(spark):
    rng = random.Random(8)
    for n, k in ((1, 5), (7, 3), (60, 5), (40, 4)):
        pixels = [tuple(float(rng.randint(0, 255)) for _ in range(3)) for _ in range(n)]
        centres, count = colours.k_means(np.array(pixels), k)
        want, sizes = plain_k_means(pixels, k)
        assert np.allclose(centres, want) and count.tolist() == sizes
        rng.shuffle(pixels)
        assert np.array_equal(colours.k_means(np.array(pixels), k)[0], centres)
    df = spark.createDataFrame([(1, 10.0, 20.0, 30.0)] * 5 + [(1, 200.0, 0.0, 0.0)] * 3 + [(2, None, 1.0, 1.0)], "k int, r double, g double, b double")
    assert [tuple(r) for r in colours.dominant_colours(df, ["k"], ["r", "g", "b"]).collect()] == [(1, 0, "#0a141e", 0.625), (1, 1, "#c80000", 0.375)]


def test_bounds_keep_apart(spark):
    df = spark.createDataFrame([(1, t, s) for t, s in ((10.0, 0.9), (20.0, 0.9), (32.0, 0.8), (50.0, 0.7), (95.0, 1.0), (60.0, None))], "k int, t double, s double")
    got = sorted(r["t"] for r in C.spaced_bounds(df, ["k"], "t", "s", F.lit(100.0), F.lit(3), F.lit(12.0)).collect())
    assert got == [20.0, 32.0, 50.0]


def plain_cut(words, shots, start, end, duration):
    at = lambda t: next((s for s in shots if s[0] <= t < s[1]), shots[-1] if t >= shots[-1][0] else shots[0])
    closing = lambda t: next((s for s in shots if s[0] < t <= s[1]), shots[-1] if t >= shots[-1][0] else shots[0])
    f = at(start)
    if 0 < start - f[0] <= 0.5:
        start = f[0]
    elif 0 < f[1] - start <= 0.5 and f[1] < end - 0.1:
        start = f[1]
    z = closing(end)
    if 0 < z[1] - end <= 0.5:
        end = z[1]
    elif 0 < end - z[0] <= 0.5 and z[0] > start + 0.1:
        end = z[0]
    lo, hi = at(start)[0], closing(end)[1]
    spots = [(max(0.0, words[0][0] - 0.15), 2.0), (max(w[1] for w in words) + 0.15, 2.0)]
    for a, b in itertools.pairwise(words):
        if b[0] >= a[1]:
            spots.append(((a[1] + b[0]) / 2, min(b[0] - a[1], 2.0) + (0.5 if a[2].rstrip().endswith((".", "!", "?", "…")) else 0)))
    inside = lambda t, pad: any(w[0] - pad < t < w[1] + pad for w in words)

    def snap(t, low, high):
        free = [(q - 0.25 * abs(p - t), p) for p, q in spots if low <= p <= high]
        return max(free)[1] if inside(t, 0.08) and free else t

    a = snap(start, max(0.0, lo - 3), min(start + 3, max(lo, hi - 2)))
    a = lo if lo - 0.05 < a < lo and not inside(lo, 0) else a
    pa_ = min(max(a, lo), hi)
    b = snap(end, max(a + 2, min(pa_ + 2, hi), end - 3), min(max(duration, hi), hi + 3))
    b = hi if hi < b < hi + 0.05 and not inside(hi, 0) else b
    return pa_, min(max(b, pa_), hi), a, b, inside(a, 0) or inside(b, 0)


def test_safe_cuts_equal_the_rules(spark, small):
    said, shots = planning.spoken(spark, small)
    words, by_shot = defaultdict(list), defaultdict(list)
    for r in said.collect():
        words[r["conv_id"]].append((r["s"], r["e"], r["text"]))
    for r in shots.collect():
        by_shot[r["conv_id"]].append((r["s"], r["e"]))
    rows = QUERIES["safe_cut_ranges"](spark, small).collect()
    assert len(rows) == 3 * len(words)
    moved = 0
    for r in rows:
        want = plain_cut(sorted(words[r["conv_id"]]), sorted(by_shot[r["conv_id"]]), r["a"], r["b"], r["duration"])
        assert np.allclose([r["picture_in"], r["picture_out"], r["sound_in"], r["sound_out"]], want[:4], atol=1e-6) and r["clipped"] == want[4]
        moved += r["sound_in"] != r["a"]
        assert not r["clipped"] or r["b"] - r["a"] < 4
    assert moved > len(rows) // 4


def test_spoken_shots_are_split_between_words(spark, small):
    said, _ = planning.spoken(spark, small)
    words = defaultdict(list)
    for r in said.collect():
        words[r["conv_id"]].append((r["s"], r["e"]))
    parts = defaultdict(list)
    for r in QUERIES["split_spoken_shots"](spark, small).orderBy("conv_id", "part").collect():
        parts[r["conv_id"]].append((r["a"], r["b"]))
    assert set(parts) == set(words)
    for conv, p in parts.items():
        whole = max(e for _, e in words[conv]) - min(s for s, _ in words[conv])
        assert len(p) == (1 if whole <= 30 else max(2, round(whole / 20))) and all(x[1] == y[0] for x, y in itertools.pairwise(p))
        assert not [t for t, _ in p[1:] if any(s + 1e-3 < t < e - 1e-3 for s, e in words[conv])]


def test_text_windows_equal_the_rules(spark):
    from quillspark.operators import sequences as Q

    rng, rows = random.Random(6), []
    for k in range(6):
        t = 0.0
        for i in range(60):
            d = rng.choice([0.4, 0.8, 2.5, 40.0 if k == 3 and i == 20 else 1.0])
            rows.append((k, t, t + d, f"w{i}" + rng.choice(["", "", "", ".", "?"])))
            t += d + rng.choice([0.0, 0.1, 0.7, 1.5])
    got = defaultdict(list)
    for r in Q.text_windows(spark.createDataFrame(rows, "k int, s double, e double, t string"), ["k"], "s", "e", "t").orderBy("k", "window").collect():
        got[r["k"]].append(r["w_text"].split(" "))
    for k, mine in got.items():
        w = [r[1:] for r in rows if r[0] == k]
        at = 0
        for no, window in enumerate(mine):
            names = [x[2] for x in w]
            assert window == names[at : at + len(window)]
            end = at + len(window)
            full = next((j for j in range(at + 1, len(w)) if w[j][1] - w[at][0] > 30), len(w))
            if full < len(w):
                half = w[at][0] + 15
                low = max([j + 1 for j in range(at + 1, full) if w[j][1] < half], default=at + 1)
                good = [j for j in range(low, full) if w[j][2][-1] in ".?" or w[j + 1][0] - w[j][1] >= 0.6]
                full = max(good) + 1 if good else full
            assert end == full
            if no + 1 < len(mine):
                at = next((j for j in range(at + 1, end) if w[j][0] >= w[end - 1][1] - 5), end)
        assert end == len(w)

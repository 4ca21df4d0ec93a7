"""Every operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing names, empty tables."""

import hashlib
import io
import random
import re
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontam, graph, htmltext, induced, jaccard, linededup, mixing, nearvec, quality, sharding, substrings, warczip

LOW = {i: i + 32 for i in range(65, 91)}
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]


def text(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [text(rng.randint(1, 120)) for _ in range(40)]
    passage, line = text(70), text(14)
    out = [*base, None, "", "   \n\t", "x", "Éa Ω\x0bz", *base[:6], *[base[0]] * 30]
    for b in base[:20]:
        w = b.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w).upper() if len(out) % 2 else " ".join(w))
    out += [f"{text(9)} {passage} {text(9)}" for _ in range(25)]
    out += [f"{text(5)}\n  {line.upper()} \t\n{text(3)}" for _ in range(8)]
    out.append(" ".join(text(40) for _ in range(300)))
    return list(enumerate(out))


def docs_of(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


def test_sharding(spark, texts):
    df = docs_of(spark, [*texts, (None, None), (None, None), (1, "twice"), (1, "twice")]).withColumn("slot", F.lit("clash"))
    got = sharding.shard(df, 7, seed=1, rows_per_task=10)
    rows = got.collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) + 4 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"])
    assert sorted(map(key, rows)) == sorted(map(key, sharding.shard(df.repartition(3), 7, seed=1, rows_per_task=10).collect()))
    assert sorted(map(key, rows)) != sorted(map(key, sharding.shard(df, 7, seed=2, rows_per_task=10).collect()))
    assert sharding.shard(df.limit(0), 3).count() == 0
    assert sorted(r["shard"] for r in sharding.shard(df.limit(2), 5).collect()) == [0, 1]


def test_hypergeometric_law(spark):
    total, good, draws, n = 50, 20, 12, 20000
    u = sharding.unit(sharding.seeded(3, "id"))
    got = Counter(r["x"] for r in spark.range(n).select(sharding.hypergeometric(F.lit(total).cast("long"), F.lit(good).cast("long"), F.lit(draws).cast("long"), u).alias("x")).collect())
    from math import comb

    for k in range(13):
        p = comb(good, k) * comb(total - good, draws - k) / comb(total, draws)
        assert abs(got.get(k, 0) / n - p) < 0.015
    sizes = spark.createDataFrame([(0, 7), (1, 0), (3, 5)], "block long, n long")
    quota = F.array(*[F.lit(x).cast("long") for x in (5, 4, 3)])
    rows = {r["block"]: r["counts"] for r in sharding.communication_matrix(sizes, 4, quota, 9).collect()}
    assert [sum(rows[b]) for b in range(4)] == [7, 0, 0, 5] and [sum(rows[b][s] for b in range(4)) for s in range(3)] == [5, 4, 3]


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, s, r.randint(0, 50)) for i, s in enumerate([None] * 40 + ["a"] * 300 + ["b"] * 60 + ["c"] * 60 + ["d"] * 5)] + [(None, "a", 3), (None, "a", 3), (7, "e", 0)]
    got = mixing.mix(spark.createDataFrame(rows, "id long, source string, size long"), [3, 1, 2], 1.5, 2, seed=4).collect()
    size = defaultdict(int)
    for _, s, n in rows:
        size[s] += n
    names = sorted(x for x in size if x is not None) + [None]
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(names)}
    left, fixed = 1.5 * sum(size.values()), {}
    while True:
        level = left / sum(weight[s] for s in names if s not in fixed)
        over = [s for s in names if s not in fixed and level * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 2.0 * size[s]
        left = 1.5 * sum(size.values()) - sum(fixed.values())
    want = {s: fixed.get(s, level * weight[s]) for s in names}
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for x in got:
        assert abs(x["target"] - want[x["source"]]) < 1e-6 and x["source_size"] == size[x["source"]] and 0 <= x["times"] <= 2
        taken[x["source"]] += x["times"] * x["size"]
    assert all(abs(taken[s] - want[s]) <= 51 for s in names)
    assert mixing.mix(spark.createDataFrame([], "id long, source string, size long"), [1]).count() == 0
    words = spark.createDataFrame([(None,), ("",), (" a\x0bb\n c ",), ("é\u00a0x y",)], "t string").select(mixing.word_count(F.col("t")).alias("n")).collect()
    assert [w["n"] for w in words] == [0, 0, 3, 2]


def test_mixing_beyond_the_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 9 == 0 else "a" if i % 3 else "b", i % 50) for i in range(400)] + [(None, "a", 3)] * 2, "id long, source string, size long")
    want = sorted(map(str, mixing.mix(rows, [3, 1, 2], seed=4).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(str, mixing.mix(rows, [3, 1, 2], seed=4).collect())) == want


def test_quality(spark):
    r = random.Random(3)
    rows = [(i, text(60) if i % 4 else "!! ".join(text(40).upper().split())) for i in range(800)] + [(900, None), (901, ""), (None, "x y"), (902, "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(0))
    labels = spark.createDataFrame([(i, int(bool(i % 4))) for i in range(0, 800, 2)] + [(None, 1), (3, None)], "doc_id long, label int")
    got = {x["key"]: x["score"] for x in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == bool(i % 4) for i in range(1, 800, 2)]) > 0.97
    assert {x["score"] for x in quality.classify(docs.limit(5), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert r


def test_decontamination(spark, texts):
    items = [("b", text(20)), ("a", text(5)), ("c", ""), ("d", None), ("e", "the the the the the the the the the the the the the the"), ("e", text(13))]
    docs = list(texts)
    for i, (_, t) in enumerate(items):
        if t:
            docs += [(1000 + i, f"{text(6)} {t.upper()}, {text(9)}"), (1100 + i, " ".join(t.split()[1:14])), (1200 + i, f"{t} {text(700)} {t}")]
    docs += [(None, items[0][1]), (1000, "same id"), (1000, "same id")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    df = docs_of(spark, docs)
    for clash in ("n_words", "words", "k1", "found", "term", "item_id"):
        df = df.withColumn(clash, F.lit("clash"))
    got = decontam.decontaminate(df, spark.createDataFrame(items, "item_id string, text string"))
    want = []
    for i, t in docs:
        w, hit, found = word.findall((t or "").translate(LOW)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want.append((str(i), str(t), len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    assert sorted((str(r["doc_id"]), str(r["text"]), r["n_words"], r["n_hit"], tuple(r["hit_items"]), r["contaminated"]) for r in got.collect()) == sorted(want)
    assert not any(r["contaminated"] for r in decontam.decontaminate(df, spark.createDataFrame([], "item_id string, text string")).collect())
    assert decontam.decontaminate(df.limit(0), spark.createDataFrame(items, "item_id string, text string")).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b c"), (2, "a b c"), (3, "c b a"), (4, "a x x x b c"), (5, None)], "doc_id long, text string")
    ask = spark.createDataFrame([("p", "a b c")], "phrase_id string, text string")
    assert sorted(r["doc_id"] for r in decontam.proximity_matches(docs, ask, 0).select("doc_id").distinct().collect()) == [2]
    assert sorted(r["doc_id"] for r in decontam.proximity_matches(docs, ask, 1).select("doc_id").distinct().collect()) == [1, 2]


def test_html(spark):
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy, now, please</div><div id=main><h1>Head &amp; more</h1><p>One, two,\n three <b>bold<br>four<p>Second para, with text.</div><div class=comments><p>nice, very nice, indeed, so nice that it is long</p></div><footer>&copy; x</footer>"
    rows = [(1, page, "u"), (2, None, "u"), (3, "", "u"), (4, "<<<>>> & <p", "u"), (5, "<p>" * 3000 + "deep", "u"), (6, page, "u"), (7, "<div>" * 3000 + "<p>long text, long text, long text</p>", None)]
    got = {r["page_id"]: (r["text"], r["n_chars"], r["url"]) for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, html string, url string")).collect()}
    assert got[1] == ("Head & more\nOne, two, three bold four\nSecond para, with text.", 61, "u") and got[6] == got[1]
    assert got[2] == got[3] == ("", 0, "u") and got[5][0] == "deep" and got[7][0] == "long text, long text, long text"
    assert htmltext.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_lines(spark, texts):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    docs = [*texts, (None, "lonely"), (5000, texts[-2][1]), (5000, texts[-2][1])]
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    want = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)], key=lambda v: -1 if v is None else v) != i)]
        want.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = linededup.dedup_lines(docs_of(spark, docs).withColumn("kept", F.lit(1)), batches=3)
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()) == sorted(want)
    assert sum(w[2] for w in want) > 5
    assert linededup.dedup_lines(docs_of(spark, []), batches=2).count() == 0


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize(("k", "num", "den"), [(5, 4, 5), (4, 85, 100), (2, 1, 2)])
def test_jaccard(spark, texts, k, num, den):
    docs = [*texts, (3, "same id other text"), (None, texts[0][1])]
    sets = [shingles(t, k) for _, t in docs]
    group = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = defaultdict(list)
    for (i, _), g in zip(docs, group, strict=True):
        least[g].append(i)
    want = [(str(i), len(s), str(min((x for x in least[g] if x is not None), default=None))) for (i, _), s, g in zip(docs, sets, group, strict=True)]
    got = jaccard.jaccard_components(docs_of(spark, docs), k, num, den)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect()) == sorted(want)
    if k == 5:
        assert jaccard.jaccard_components(docs_of(spark, [])).count() == 0


def test_archives(spark, tmp_path):
    big = "<p>" + "long page, " * 200
    rows = [(1, "http://a/", big), (2, "http://b/é x", big), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "n", big), (7, "u", big + "é"), (2, "http://b/é x", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = warczip.archive_and_read(pages, with_payload=True).collect()
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and h == big and i != 2
        want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", "2" if revisit else "None", None if revisit else raw))
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    assert sorted(((str(r[0]), r[1], r[2], r[3], str(r[4]), None if r[5] is None else bytes(r[5])) for r in ([x[f] for f in fields] for x in got)), key=str) == sorted(want, key=str)
    assert warczip.archive_and_read(pages.limit(0)).count() == 0
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("plain", b"abc")
        z.writestr(zipfile.ZipInfo("second"), b"defg")
    data = out.getvalue()
    found = warczip.directory(lambda at, n: data[at : at + n], len(data))
    assert {k: data[a : a + n] for k, (a, n) in found.items()} == {"plain": b"abc", "second": b"defg"}
    own = warczip.package([(b"WARC/1.1\r\n\r\n", "sha1:x", "u")])
    assert zipfile.ZipFile(io.BytesIO(own)).testzip() is None and set(warczip.directory(lambda at, n: own[at : at + n], len(own))) == {warczip.DATA, warczip.INDEX, "datapackage.json"}
    with pytest.raises(ValueError, match="end of central"):
        warczip.directory(lambda at, n: b"x" * n, 100)


def test_vectors(spark):
    g = np.random.default_rng(1)
    base = g.standard_normal((60, 32))
    v = np.concatenate([base, base[:10], 3 * base[:5], base[:20] + 0.1 * g.standard_normal((20, 32)), base[0] + 0.05 * g.standard_normal((80, 32))])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [1.0]), (904, []), (905, [None] + [1.0] * 31), (None, base[0].tolist()), (906, [1e300] * 32), (907, [1e-300] * 32)]
    unit = [None if x is None or len(x) != 32 or any(y is None or not np.isfinite(y) for y in x) or not any(x) else np.array(x) / np.abs(x).max() for _, x in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    n = len(rows)
    links, group = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and unit[i] @ unit[j] >= 0.95:
                links[i] += 1
                links[j] += 1
                if group[i] != group[j]:
                    group = [group[j] if x == group[i] else x for x in group]
    least = defaultdict(list)
    for (i, _), x in zip(rows, group, strict=True):
        least[x].append(i)
    got = nearvec.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("k", F.lit(1)), 0.95, seed=2).collect()
    by = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in got)
    want = sorted((str(i), links[k], min((x for x in least[group[k]] if x is not None), default=None)) for k, (i, _) in enumerate(rows))
    assert len(got) == n and sum(b[1] for b in by) >= 0.98 * sum(w[1] for w in want)
    assert all(b[1] <= w[1] for b, w in zip(by, want, strict=True)) and np.mean([b == w for b, w in zip(by, want, strict=True)]) > 0.95
    assert nearvec.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_induced_order():
    r = random.Random(4)
    for _ in range(150):
        t = [r.randint(0, r.choice([1, 2, 5, 255])) for _ in range(r.randint(1, 60))] * r.choice([1, 3])
        depth = r.choice([4, 10, 200])
        runs = list(induced.suffixes(np.array(t, np.uint8), 256, depth, r.choice([3, 10**6])))
        place, prefix, b = np.concatenate([x[0] for x in runs]).tolist(), np.concatenate([x[1] for x in runs]).tolist(), bytes(t)
        assert sorted(place) == list(range(len(t)))
        for i in range(1, len(t)):
            x, y = b[place[i - 1] :], b[place[i] :]
            assert x[:depth] >= y[:depth]
            assert prefix[i] == next((k for k in range(min(len(x), len(y), depth)) if x[k] != y[k]), min(len(x), len(y), depth))


@pytest.mark.parametrize("length", [40, 200])
def test_substrings(spark, texts, length):
    docs = [*texts, (None, texts[60][1]), (8000, "ab" * 900), (8001, "é" * 500), (8002, "ab" * 99)]
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    want = []
    for (i, _), b in zip(docs, raw, strict=True):
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                cover[k : k + length] = 1
        spans = int((np.diff(np.concatenate([[0], cover])) == 1).sum())
        want.append((str(i), len(b), int(cover.sum()), spans, bytes(x for x, c in zip(b, cover, strict=False) if not c)))
    got = substrings.dedup_substrings(docs_of(spark, docs), length)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()) == sorted(want)
    assert substrings.dedup_substrings(docs_of(spark, []), length).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100 and got[200] == 150
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0

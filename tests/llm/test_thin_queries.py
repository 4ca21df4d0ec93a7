"""The queries op1 to op10 as registered, over a small folder of tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import queries
from quillspark.llm.htmltext import main_text

LOW = {i: i + 32 for i in range(65, 91)}
r = random.Random(11)
VOCAB = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]


def text(n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(f"q{i}", text(n)) for i, n in enumerate((20, 14, 6, 30))] + [("q9", ""), ("q8", None)]
    base = [text(r.randint(1, 90)) for _ in range(60)]
    passage = text(75)
    texts = [*base, None, "", " \n", *base[:8], *[base[3]] * 12, *(" ".join([*b.split()[:-1], "changed"]) for b in base[:20])]
    texts += [f"{text(5)} {passage} {text(8)}" for _ in range(9)] + [f"{text(30)} {items[0][1].upper()}, {text(10)}", items[1][1], f"{text(3)} {items[2][1]}"]
    docs = [(i, t, r.choice(["en", "de"]), r.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(len(t or "") > 150), 0) for i, t in enumerate(texts) if i % 2]
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate(["<article><h1>T</h1><p>One, two, three.</p></article>", None, "", "<p>" + "long, " * 300, "<p>" + "long, " * 300, "<p>" + "long, " * 300, "<p>short</p>", "<p>short</p>"])]
    g = np.random.default_rng(2)
    v = g.standard_normal((40, 16))
    vectors = [(i, x.astype(np.float32).tolist(), 0) for i, x in enumerate(np.concatenate([v, v[:6] + 0.05 * g.standard_normal((6, 16)), v[:3]]))] + [(90, None, 0), (91, [0.0] * 16, 1)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", items, "item_id string, text string"), ("labels", labels, "doc_id long, quality int, toxic int"),
        ("pages", pages, "page_id long, url string, html string"), ("embeddings", vectors, "vec_id long, embedding array<float>, label int"),
    ):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder, {d[0]: d for d in docs}, dict(items), {p[0]: p for p in pages}, {x[0]: x[1] for x in vectors}


def test_op1(spark, tables):
    folder, docs, *_ = tables
    rows = queries.op1_hypergeometric_sharding(spark, folder).collect()
    assert sorted(x["doc_id"] for x in rows) == sorted(docs) and {x["law"] for x in rows} == {"rows"} and all(x["grown_shard"] is None for x in rows)
    sizes = Counter(x["shard"] for x in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(x["slot"] for x in rows if x["shard"] == s) == list(range(n))
    for x in rows:
        raw = (docs[x["doc_id"]][1] or "").encode()
        assert (x["size"], x["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))


def test_op2(spark, tables):
    folder, docs, *_ = tables
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for i, d in docs.items()}
    total = defaultdict(int)
    for i, d in docs.items():
        total[d[3]] += size[i]
    names = sorted(x for x in total if x is not None) + [None]
    weight, fixed = {s: [3, 1, 2][k % 3] for k, s in enumerate(names)}, {}
    while True:
        level = (1.5 * sum(total.values()) - sum(fixed.values())) / max(1, sum(weight[s] for s in names if s not in fixed))
        over = [s for s in names if s not in fixed and level * weight[s] > 2 * total[s]]
        if not over:
            break
        fixed |= {s: 2.0 * total[s] for s in over}
    taken = defaultdict(int)
    first = queries.op2_water_filling_mix(spark, folder).collect()
    for x in first:
        s = docs[x["doc_id"]][3]
        assert (x["size"], x["source_size"]) == (size[x["doc_id"]], total[s]) and abs(x["target"] - fixed.get(s, level * weight[s])) < 1e-6
        assert 0 <= x["taken"] <= 2 * x["size"]
        taken[s] += x["taken"]
    assert all(abs(taken[s] - fixed.get(s, level * weight[s])) <= max(size.values()) for s in names)
    assert sorted(first) == sorted(queries.op2_water_filling_mix(spark, folder).collect())


def test_op3(spark, tables):
    folder, docs, *_ = tables
    rows = queries.op3_additive_quality(spark, folder).collect()
    assert sorted(x["doc_id"] for x in rows) == sorted(docs)
    for x in rows:
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) and 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3)
    held = [x for x in rows if x["held_out"]]
    assert np.mean([(x["score"] >= 0.5) == (len(docs[x["doc_id"]][1] or "") > 150) for x in held]) > 0.8


def test_op4(spark, tables):
    folder, docs, items, *_ = tables
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = defaultdict(set)
    for i, t in items.items():
        w = word(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    some = 0
    for x in queries.op4_positional_decontamination(spark, folder).collect():
        w, hit, found = word(docs[x["doc_id"]][1]), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        some += bool(hit)
        assert (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    assert some >= 3


def test_op5(spark, tables):
    folder, _, _, pages, _ = tables
    got = {x["page_id"]: (x["url"], x["text"], x["n_chars"]) for x in queries.op5_tree_scored_html(spark, folder).collect()}
    assert got == {i: (u, main_text(h), len(main_text(h))) for i, (_, u, h) in pages.items()} and got[0][1] == "T\nOne, two, three."


def joined(n, linked):
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            if group[i] != group[j] and linked(i, j):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_op7(spark, tables):
    folder, docs, *_ = tables
    ids = sorted(docs)
    sets = []
    for i in ids:
        w = re.findall(r"[^\x20\x09-\x0D]+", (docs[i][1] or "").translate(LOW))
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    group = joined(len(ids), lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    least = {g: min(i for i, x in zip(ids, group, strict=True) if x == g) for g in set(group)}
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in queries.op7_multi_order_jaccard(spark, folder).collect()}
    assert got == {i: (len(s), least[g]) for i, s, g in zip(ids, sets, group, strict=True)} and len(least) < len(ids) - 20


def test_op8(spark, tables):
    folder, _, _, pages, _ = tables
    raw = {i: (h or "").encode() for i, (_, _, h) in pages.items()}
    for x in queries.op8_zip_packaged_warc(spark, folder).collect():
        b = raw[x["page_id"]]
        last = max(i for i, o in raw.items() if o == b)
        revisit = len(b) >= 1000 and last != x["page_id"]
        assert (x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last if revisit else None)


def test_op9(spark, tables):
    folder, _, _, _, vectors = tables
    ids = sorted(vectors)
    unit = [np.array(vectors[i], float) if vectors[i] and any(vectors[i]) else None for i in ids]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    near = lambda a, b: unit[a] is not None and unit[b] is not None and unit[a] @ unit[b] >= 0.95
    group = joined(len(ids), near)
    least = {g: min(i for i, x in zip(ids, group, strict=True) if x == g) for g in set(group)}
    links = [sum(near(a, b) for b in range(len(ids)) if a != b) for a in range(len(ids))]
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in queries.op9_spherical_cap_near_dedup(spark, folder).collect()}
    assert got == {i: (n, least[g], i == least[g]) for i, n, g in zip(ids, links, group, strict=True)}


def test_op10(spark, tables):
    folder, docs, *_ = tables
    raw = {i: (d[1] or "").encode() for i, d in docs.items()}
    seen = Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    some = 0
    for x in queries.op10_induced_suffix_dedup(spark, folder).collect():
        b = raw[x["doc_id"]]
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                cover[k : k + 200] = 1
        kept = bytes(c for c, z in zip(b, cover, strict=False) if not z)
        some += bool(cover.any())
        assert (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) == (len(b), int(cover.sum()), int((np.diff(np.concatenate([[0], cover])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert some > 20

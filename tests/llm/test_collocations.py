"""Collocations and their trie against plain counting."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import collocations as co
from quillspark.llm.queries import op11_hat_trie_collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(docs: list[tuple], longest: int) -> dict:
    """By (lang, words) the number of occurrences."""
    out: Counter = Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            out.update((lang or "und", tuple(ws[i : i + m])) for m in range(1, longest + 1) for i in range(len(ws) - m + 1))
    return out


def plain(docs: list[tuple], longest: int = 3, least: int = 10, top: int = 2000) -> list[tuple]:
    f = counts(docs, longest)
    cands = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    most: dict = {}
    for (lang, p), n in cands.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                most[lang, p[i : i + m]] = max(n, most.get((lang, p[i : i + m]), 0))
    rows = []
    for (lang, p), a in cands.items():
        if 100 * most.get((lang, p), 0) >= 50 * a:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], sum(n for (x, q), n in f.items() if x == lang and len(q) == 1), score))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(out)


DOCS = (
    [("en", "New York City is big. new york city\tIS old, New york"), ("en", None), ("en", ""), (None, "a b c! A B"), ("und", "x y"), ("fr", "Été à Paris; été à paris\x0bÉTÉ à")] * 12
    + [("en", "of the " + w) for w in ("sea", "sky", "sun", "a.b", "étang", "x", "y")] * 9
    + [("de", "ha ha ha ha ha ha ha ha ha ha ha ha ha ha"), ("de", "  \t ,, ..")]
)


def spark_rows(df) -> list[tuple]:
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def test_against_plain_counts(spark) -> None:
    df = spark.createDataFrame(DOCS, "lang string, text string").selectExpr("*", "1 as phrase", "2 as n", "3 as part")
    assert spark_rows(co.collocations(df)) == plain(DOCS)
    assert spark_rows(co.collocations(df, top=3)) == plain(DOCS, top=3)
    assert co.collocations(df.where("false")).count() == 0


def test_small_tries_spill_and_burst(spark, monkeypatch) -> None:
    """Hot words divided at every level, tries of a few entries, and texts cut into small parts give the same rows."""
    real = co.count_runs
    monkeypatch.setattr(co, "count_runs", lambda length, marks, hot: real(length, marks, hot, entries=8, burst=2))
    monkeypatch.setattr(co, "HOT", 20)
    df = spark.createDataFrame(DOCS, "lang string, text string").repartition(5)
    assert spark_rows(co.collocations(df)) == plain(DOCS)


def test_query(spark, tmp_path) -> None:
    docs = [(i, t, lang, "s", 1) for i, (lang, t) in enumerate(DOCS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert spark_rows(op11_hat_trie_collocations(spark, str(tmp_path))) == plain(DOCS)


@pytest.mark.parametrize("length", [1, 2, 3])
def test_trie_keeps_every_count(length: int) -> None:
    draw = np.random.default_rng(3)
    trie, want = co.HatTrie(length, burst=4), Counter()
    for _ in range(20):
        keys = draw.integers(1, 6, (50, length))
        packed = keys @ np.array([1 << (co.BITS * (length - 1 - i)) for i in range(length)])
        want.update(packed.tolist())
        trie.add(*np.unique(packed, return_counts=True))
    assert len(trie) == len(want)
    got = Counter()
    for keep in (len(want) // 2, 0):
        keys, n = trie.spill(keep)
        assert not set(keys.tolist()) & set(got)
        got.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
        assert len(trie) <= keep
    assert got == want


@pytest.mark.parametrize("size", [1, 7, 40])
@pytest.mark.parametrize("length", [1, 2, 3])
def test_segments_hold_each_phrase_once(size: int, length: int) -> None:
    text = b"aa bb cc dd ee ff  gg hh. ii jj ..kk   ll mmmmmmmmmmmmmmmmmmmmmmmmm nn oo pp qq rr ss tt.uu vv ww xx yy zz a b c"
    grams = lambda t: Counter(tuple(ws[i : i + length]) for p in t.split(b".") for ws in [p.split()] for i in range(len(ws) - length + 1))
    got: Counter = Counter()
    for part in co.segments(text, length, size):
        got.update(grams(part))
    assert got == grams(text)


def test_exact_beyond_64_bits(spark) -> None:
    big = 3_000_000_000_000
    one = spark.createDataFrame([("en", "a", big), ("en", "b", big)], "lang string, phrase string, n long")
    two = spark.createDataFrame([("en", "a b", big - 1)], "lang string, phrase string, n long")
    row = co.scored({1: one, 2: two}, 2, 1_000_000).first()
    assert row["score"] == 1_000_000 * (big - 1) ** 2 // big**2


def test_merge_over_batches() -> None:
    rows = [("en", "a", 3), ("fr", "a", 1), ("en", "b", 4), ("en", "b", 4), ("en", "b", 4), ("en", "c", 9)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "phrase", "n"), r, strict=True))]) for r in rows]
    out = [tuple(r.values()) for b in co.merge_runs(4)(iter(batches)) for r in b.to_pylist()]
    assert out == [("en", "b", 12), ("en", "c", 9)]

"""Clashing names, null items, single components, shared hashes, and runs written without a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import decontam, htmltext, linededup, mixing, nearvec, substrings


def clashing(df, names):
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def test_mix_passes_columns_of_its_own_names(spark) -> None:
    base = spark.range(40).select("id", (F.col("id") % 3).cast("string").alias("source"), (F.col("id") + 1).alias("size"))
    names = ["first", "whole", "extra", "cell", "a.b", "t_source", "weight", "__key"]
    out = mixing.mix(clashing(base, names), [3, 1, 2], seed=3)
    assert all(out.columns.count(n) == 1 for n in names)
    assert [r[3:11] for r in out.collect()] == [tuple(range(8))] * 40
    plain = {r["id"]: r["times"] for r in mixing.mix(base, [3, 1, 2], seed=3).collect()}
    assert {r["id"]: r["times"] for r in out.collect()} == plain
    again = mixing.mix(clashing(base, ["target", "source_size", "times"]), [3, 1, 2], seed=3)
    assert again.columns.count("target") == 1 and {r["id"]: r["times"] for r in again.collect()} == plain


def test_pages_and_lines_pass_odd_columns(spark) -> None:
    pages = spark.createDataFrame([("<article><p>x, y</p></article>", 1)], "html string, `a.b` int")
    assert htmltext.extract(pages).collect()[0].asDict() == {"a.b": 1, "text": "x, y", "n_chars": 4}
    docs = clashing(spark.createDataFrame([(i, "x" * 50) for i in range(6)], "doc_id long, text string"), ["__id", "__gone", "__lines", "__text", "__row", "last", "k1", "a`b"])
    rows = linededup.dedup_lines(docs).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in rows} == {**dict.fromkeys(range(5), 1), 5: 0}
    assert all(r["__id"] == 0 and r["last"] == 5 and r["a`b"] == 7 for r in rows)


def test_null_items_hit(spark) -> None:
    words = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, words), (2, "other words")], "doc_id long, text string")
    items = spark.createDataFrame([(None, words), ("b", "w1 w2 w3"), (None, None)], "item_id string, text string")
    rows = {r["doc_id"]: r for r in decontam.decontaminate(docs, items).collect()}
    assert rows[1]["n_hit"] == 14 and rows[1]["contaminated"] and rows[1]["hit_items"] == ["b", None]
    assert rows[2]["n_hit"] == 0 and not rows[2]["contaminated"]


def test_single_components_need_their_sign(spark) -> None:
    rows = [(i, [float(i % 7 - 3)]) for i in range(3000)]
    out = {r["vec_id"]: r for r in nearvec.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    signs = {s: [i for i, v in rows if np.sign(v[0]) == s] for s in (-1, 0, 1)}
    for s, ids in signs.items():
        assert all(out[i]["n_links"] == (len(ids) - 1 if s else 0) and out[i]["component_id"] == (min(ids) if s else i) for i in ids)


def test_one_component_code_is_small() -> None:
    filters = nearvec.Filters(1_000_000_000, 1, 0.95, 1)
    assert len(filters.codes) <= 2 and all(c.b == 2 for c in filters.codes) and filters.recall == 1.0


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch) -> None:
    """All texts get one first hash: the answer stays that of whole texts."""
    real = substrings.seeded
    monkeypatch.setattr(substrings, "seeded", lambda seed, *cols: F.lit(7).cast("long") if seed == 6 else real(seed, *cols))
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdefghij"), 300)) for _ in range(4)]
    rows = [(i, t) for i, t in enumerate([*texts, texts[0], None, "short"])]
    out = {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0: 300, 1: 0, 2: 0, 3: 0, 4: 300, 5: 0, 6: 0}


def test_lines_are_wrong_without_any_join(spark, monkeypatch) -> None:
    """A batch that is written as it is, with no join, makes the smallest batch's document the keeper."""
    docs = spark.createDataFrame([(i, "a long line that every one of the documents holds, here") for i in range(40)], "doc_id long, text string")
    dropped = lambda: {r["doc_id"] for r in linededup.dedup_lines(docs).collect() if r["n_dropped"]}
    assert dropped() == set(range(39))

    def add(self, batch):
        self.schema = batch.select(*linededup.KEY, "n", "last").schema
        self._write(batch, 0)
        self.compact()

    monkeypatch.setattr(linededup.LineRuns, "add", add)
    assert dropped() != set(range(39))

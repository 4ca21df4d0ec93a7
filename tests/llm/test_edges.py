"""Defined edge cases: many equal rows in sharding, stages on empty tables, nulls and clashing names, very long texts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, quality, sharding, stages, warczip


def test_sharding_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 50)
    monkeypatch.setattr(sharding, "COMMON", 10)
    df = spark.createDataFrame([(1, "same")] * 700 + [(i, f"t{i % 40}") for i in range(300)] + [(None, None)] * 60, "doc_id long, text string").withColumn("__row", F.lit("clash"))
    rows = sharding.shard(df, 6, seed=3, rows_per_task=40).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in df.collect())
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    # Equal rows are dealt as evenly as others: none of the six shards is without, or full of them.
    equal = Counter(r["shard"] for r in rows if r["text"] == "same")
    assert len(equal) == 6 and max(equal.values()) < 1.5 * 700 / 6


@pytest.mark.parametrize("stage", [stages.keep_quality, stages.keep_one_of_each_group, stages.drop_contaminated, stages.mix_sources])
def test_stages_on_empty_tables_and_odd_columns(spark, small, stage):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("words", F.lit("x")).withColumn("score", F.lit(1))
    out = stage(spark, docs, small)
    assert out.columns == docs.columns
    assert set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
    empty = stage(spark, docs.limit(0), small)
    assert empty.columns == docs.columns and empty.count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "yarn")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            common.scratch_dir(spark)


def test_very_long_texts(spark):
    long = "word and more words, " * 300_000
    docs = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    got = {r["key"]: r["score"] for r in quality.classify(docs, spark.createDataFrame([(2, 1)], "doc_id long, label int")).collect()}
    assert set(got) == {1, 2}
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long)], "page_id long, url string, html string")
    rows = {r["page_id"]: (r["record_type"], r["payload_bytes"]) for r in warczip.archive_and_read(pages).collect()}
    assert rows == {1: ("revisit", len(long)), 2: ("response", len(long))}


def test_sample_of_labels_is_bounded(spark, monkeypatch):
    rows = [(i, f"text {i} " * (1 + i % 5)) for i in range(400)]
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(x)) or fit(x, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, label int")
    quality.classify(docs, labels, sample_rows=100).count()
    assert seen == [100]

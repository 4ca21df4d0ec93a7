"""The pipeline's stages against what their operators' verdicts say, and op6 against its SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from quillspark.llm import queries
from quillspark.llm.common import cut, load


def test_stages(spark, small):
    docs = load(spark, small, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "sharding"]
    before = set(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, small), "test-stage")
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert set(ids) <= before and ids
        if name == "quality_classifier":
            verdict = {r["doc_id"] for r in queries.op3_additive_quality(spark, small).where("predicted = 1").collect()}
            assert set(ids) == verdict
        if name != "sharding":
            assert out.columns == docs.columns
        if name in ("ngram_jaccard_join", "benchmark_decontamination"):
            assert len(ids) == len(set(ids))
        if name == "mixing":
            assert max(ids.count(i) for i in set(ids)) <= 2
        before, docs = set(ids), out
    sizes = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and all(rows[r["doc_id"]] == r["text"] for r in docs.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, small).select(*names).collect())) == sorted(cursor.fetchall())


def test_run_leaves_its_result_only(spark, small):
    """Of all that the stages write, only the last result stays in the shared folder."""
    from quillspark.llm import common

    given = []
    with common.lent(spark) as paths:
        out = corpus_pipeline.run(spark, small)
        given, paths[:] = list(paths), []
    there = [p for p in given if os.path.exists(p.removeprefix("file:"))]
    assert len(given) > 20 and len(there) == 1 and out.count() > 0
    common.delete(spark, there)
    assert not os.path.exists(there[0].removeprefix("file:"))

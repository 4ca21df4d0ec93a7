"""Levelled runs: what a batch adds depends on the anti-join, and the largest id keeps a line whatever the batches."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import linededup


def batches(spark):
    rows = [[(1, 1, 2, 90), (2, 2, 1, 95)], [(1, 1, 3, 80), (3, 3, 1, 85)], [(1, 1, 1, 70), (2, 2, 5, 75), (3, 3, 1, 60)]]
    return [spark.createDataFrame(x, "k1 long, k2 long, n long, last long") for x in rows]


@pytest.mark.parametrize("fanout", [2, 5])
def test_a_key_has_its_keeper_in_one_run(spark, fanout):
    runs = linededup.LineRuns(spark, fanout)
    for b in batches(spark):
        runs.add(b)
    rows = runs.read().collect()
    assert sum(r["last"] is not None for r in rows) == 3
    total = {r["k1"]: (r["n"], r["last"]) for r in linededup.LineRuns.merged(runs.read()).collect()}
    assert total == {1: (6, 90), 2: (6, 95), 3: (2, 85)}
    if fanout == 2:
        assert [len(x) for x in runs.levels] == [1, 1]


def test_counts_are_wrong_without_the_anti_join(spark, monkeypatch):
    kind = type(spark.range(1))
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None: self if how == "left_anti" else join(self, other, on, how))
    runs = linededup.LineRuns(spark, 5)
    for b in batches(spark):
        runs.add(b)
    assert {r["k1"]: r["n"] for r in linededup.LineRuns.merged(runs.read()).collect()} != {1: 6, 2: 6, 3: 2}


def test_many_lines_and_text_ids(spark):
    line = lambda i: f"line {i} of a long boilerplate that all of them hold"
    docs = [(f"d{i}", "\n".join(line(j) for j in range(400))) for i in range(5)] + [(None, line(1)), ("d9", line(2))]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id string, text string"), batches=3).collect()}
    assert got == {**{f"d{i}": (400, 400) for i in range(4)}, "d4": (400, 1), None: (1, 1), "d9": (1, 0)}
    assert linededup.dedup_lines(spark.createDataFrame(docs, "doc_id string, text string").withColumn("k1", F.lit("clash")).withColumn("n_lines", F.lit(1))).where("k1 = 'clash'").count() == 7

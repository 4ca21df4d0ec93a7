"""Runs of sorted rows: whole keys from batches of any size, and no call of Python for each key."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import shots as S
from quillspark.operators.runs import folded, whole_runs
from quillspark.plans.registry import QUERIES


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100])
def test_runs_are_whole(size):
    keys = [None, None, 1.0, 2.0, 2.0, 2.0, 2.0, 3.0, float("nan"), float("nan")]
    table = pa.table({"k": pa.array(keys), "v": list(range(len(keys)))})
    got, held = [], []
    for part, starts in whole_runs(table.to_batches(max_chunksize=size), ["k"]):
        v, ends = part.column("v").to_pylist(), [*starts[1:], part.num_rows]
        got += [v[a:b] for a, b in zip(starts, ends, strict=True)]
        held.append(part.num_rows)
    assert got == [[0, 1], [2], [3, 4, 5, 6], [7], [8, 9]]
    assert max(held) <= 4 + size


def test_keys_without_order_of_arrival(spark):
    rows = [(None, 3, "a"), (1, 2, "x"), (1, None, "z"), (None, 1, "b"), (1, 1, "y")]
    df = spark.createDataFrame(rows, "k int, i int, t string").repartition(3)
    got = folded(df, ["k"], lambda g: [("".join(g["t"]), len(g["t"]))], "all string, n int", ["i"]).collect()
    assert {(r["k"], r["all"], r["n"]) for r in got} == {(None, "ba", 2), (1, "yxz", 3)}
    assert folded(df.where("false"), ["k"], lambda g: [("", 0)], "all string, n int", ["i"]).collect() == []


def test_key_larger_than_a_batch(spark):
    df = spark.range(25_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 1.0).alias("s"), (F.col("id") + 1.0).alias("e"))
    got = S.merge_short(df, ["k"], "s", "e").groupBy("k").agg(F.sum("pieces").alias("n"), F.max("b").alias("b")).collect()
    assert {(r["k"], r["n"], r["b"]) for r in got} == {(0, 12_500, 24_999.0), (1, 12_500, 25_000.0)}


@pytest.mark.parametrize("name", ["merged_blocks", "flow_synthesis", "split_shots", "subtitle_cues"])
def test_many_small_keys_are_no_groups_of_python(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


@pytest.mark.parametrize("name", ["box_reading_order", "matched_boxes", "matched_beings"])
def test_boxes_are_no_groups_of_python(spark, small, name):
    test_many_small_keys_are_no_groups_of_python(spark, small, name)


@pytest.mark.parametrize("name", ["fused_subjects", "reframe_plan"])
def test_frames_are_no_groups_of_python(spark, small, name):
    test_many_small_keys_are_no_groups_of_python(spark, small, name)


def test_means_of_spans_do_not_depend_on_the_order_of_rows(spark):
    from quillspark.operators import sounds as A

    rows = [("v", i, "c", (i * 37 % 101) / 100.0) for i in range(200)]
    spans = spark.createDataFrame([("v", 0, 0.0, 40.0), ("v", 1, 40.0, 97.0)], "video string, span int, a double, b double")
    got = []
    for each in (rows, rows[::-1], rows[::3] + rows[1::3] + rows[2::3]):
        scores = spark.createDataFrame(each, "video string, frame int, class string, score double").coalesce(1)
        got.append(sorted((r["span"], r["mean"]) for r in A.span_means(scores, spans).collect()))
    assert got[0] == got[1] == got[2]


def test_many_points_and_places_of_one_position(spark):
    """Pairs that are made do not grow with how many points and places share a position."""
    from quillspark.operators import places

    here = spark.range(300).select("id", (F.col("id") % 3 * 10.0).alias("lat"), F.lit(5.0).alias("lon"))
    there = spark.range(400).select(F.col("id").alias("p"), (F.col("id") % 4 * 10.0).alias("p_lat"), F.lit(5.0).alias("p_lon"))
    written = []

    def write(df):
        written.append(df.localCheckpoint())
        return written[-1]

    got = places.nearest_k(here, there, "id", "p", 2, write, 500.0).collect()
    assert {(r["id"], r["rank"], r["p"], r["km"]) for r in got} == {(i, r, i % 3 + 4 * (r - 1), 0.0) for i in range(300) for r in (1, 2)}
    assert max(df.count() for df in written) <= 8

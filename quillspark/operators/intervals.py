"""Joins on time: as-of, nearest, point in interval, overlap, difference.

Rows meet on the key and, for ranges, on a bucket of time, so that Spark joins by hash or sort and never by nested loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Rows of left with the values of the latest right row of their key at or before them, else null.

    One union, one sort, no join: right rows come before left ones of the same time.
    """
    kind = right.select(F.struct(*values).alias("v")).schema["v"].dataType
    a = left.select(*keys, at, F.struct(*left.columns).alias("__row"), F.lit(None).cast(kind).alias("__v"), F.lit(1).alias("__side"))
    b = right.select(*keys, at, F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(*values).alias("__v"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = a.unionByName(b).withColumn("__got", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return filled.select("__row.*", *[F.col(f"__got.{v}").alias(v) for v in values])


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, tolerance: float | int) -> DataFrame:
    """Rows of left with the value and distance of the nearest right row of their key within the tolerance; the earlier of two."""
    b = right.select(*keys, F.col(at).alias("__at"), F.col(value))
    before = asof_backward(left, b.withColumn(at, F.col("__at")).withColumnRenamed(value, "__v1").withColumnRenamed("__at", "__t1"), keys, at, ["__v1", "__t1"])
    flip = lambda df: df.withColumn(at, -F.col(at))
    after = asof_backward(flip(before), flip(b.withColumn(at, F.col("__at"))).withColumnRenamed(value, "__v2").withColumnRenamed("__at", "__t2"), keys, at, ["__v2", "__t2"])
    both = flip(after).withColumn("__d1", F.col(at) - F.col("__t1")).withColumn("__d2", F.col("__t2") - F.col(at))
    first = F.col("__d1").isNotNull() & (F.col("__d2").isNull() | (F.col("__d1") <= F.col("__d2")))
    both = both.withColumn("distance", F.when(first, F.col("__d1")).otherwise(F.col("__d2"))).withColumn(value, F.when(first, F.col("__v1")).otherwise(F.col("__v2")))
    ok = F.col("distance") <= tolerance
    return both.withColumns({value: F.when(ok, F.col(value)), "distance": F.when(ok, F.col("distance"))}).drop("__v1", "__t1", "__v2", "__t2", "__d1", "__d2")


def _bucketed(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    return df.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def point_in_interval(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with each half-open span of their key that holds them."""
    p = points.withColumn("__bucket", F.floor(F.col(at) / width))
    return p.join(_bucketed(spans, start, end, width), [*keys, "__bucket"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__bucket")


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of spans of a key that overlap, with `overlap`; each pair once, in the bucket where the overlap starts.

    Both sides are sorted and neither is broadcast: Spark takes a side to be as small as it was before rows were exploded.
    """
    x, y = _bucketed(a, *a_span, width), _bucketed(b, *b_span, width).hint("merge")
    low, high = F.greatest(a_span[0], b_span[0]), F.least(a_span[1], b_span[1])
    met = x.join(y, [*keys, "__bucket"]).where((high > low) & (F.floor(low / width) == F.col("__bucket")))
    return met.withColumn("overlap", high - low).drop("__bucket")


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str, least: float | int = 0) -> DataFrame:
    """The parts of a's spans (disjoint in a key) that no span of b covers, of at least `least`.

    A sweep over the ends of both: after each end, how many spans of a and b are open.
    """
    ends = lambda df, side: df.select(*keys, F.col(start).alias("__t"), F.lit(side).alias("__a"), F.lit(1 - side).alias("__b")).unionByName(df.select(*keys, F.col(end).alias("__t"), F.lit(-side).alias("__a"), F.lit(side - 1).alias("__b")))
    steps = ends(a, 1).unionByName(ends(b, 0)).groupBy(*keys, "__t").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    w = Window.partitionBy(*keys).orderBy("__t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    state = steps.withColumn("__on", (F.sum("__a").over(run) > 0) & (F.sum("__b").over(run) == 0)).withColumn(end, F.lead("__t").over(w))
    pieces = state.where("__on").select(*keys, F.col("__t").alias(start), end)
    from .sequences import merge_spans

    return merge_spans(pieces, keys, start, end).where(F.col(end) - F.col(start) >= least).drop("parts")

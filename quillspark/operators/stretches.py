"""Rows of one key in time order, and the stretches they fall in: windows and bucketed joins with the columns as parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlaps


def low_before(df: DataFrame, keys: Sequence[str], at: str, value: str, reach: int, below: float, name: str = "low") -> DataFrame:
    """df with `name`: did the value fall under `below` in the `reach` before a row, the row itself included?"""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-reach, 0)
    return df.withColumn(name, F.min(value).over(w) < below)


def said_in_blocks(words: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str], text: str, length: float, most: int | None = None) -> DataFrame:
    """(keys, block, said): words by the block of `length` that holds their middle, in order; the first `most` blocks."""
    rows = words.withColumn("block", F.floor((F.col(start) + F.col(end)) / 2 / length))
    rows = rows if most is None else rows.where(F.col("block") < most)
    said = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda x: x["__t"])
    return rows.groupBy(*keys, "block").agg(F.array_join(said, " ").alias("said"))


def middles_within(words: DataFrame, spans: DataFrame, keys: Sequence[str], start: str, end: str, a: str, z: str, width: float) -> DataFrame:
    """Words whose middle lies in a span [a, z] of their key, each once; both are dealt to buckets of `width`."""
    dealt = spans.select(*keys, F.col(a).alias("__a"), F.col(z).alias("__z")).withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__a") / width), F.floor(F.col("__z") / width))))
    middle = (F.col(start) + F.col(end)) / 2
    met = words.withColumn("__cell", F.floor(middle / width)).join(dealt, [*keys, "__cell"]).where((middle >= F.col("__a")) & (middle <= F.col("__z")))
    return met.select(*words.columns).distinct()


def in_force(points: DataFrame, starts: DataFrame, keys: Sequence[str], at: str, since: str, name: str) -> DataFrame:
    """points with `name` of the last of starts (keys, since, name) at or before them; one union and one sort."""
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    left = points.select(*keys, F.col(at).alias("__t"), row.alias("__row"))
    right = starts.select(*keys, F.col(since).alias("__t"), F.col(name).alias("__name"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("__name", F.last("__name", ignorenulls=True).over(w)).where(F.col("__row").isNotNull()).select("__row.*", F.col("__name").alias(name))


def contents(ranges: DataFrame, pieces: DataFrame, keys: Sequence[str], range_id: str, span: tuple[str, str], piece: str, piece_span: tuple[str, str], width: int) -> DataFrame:
    """(keys, range_id, last, n): the last of the pieces that a range touches, and how many."""
    met = overlaps(ranges.select(*keys, range_id, *span), pieces.select(*keys, piece, *piece_span), keys, span, piece_span, width)
    return met.groupBy(*keys, range_id).agg(F.max(piece).alias("last"), F.count(F.lit(1)).alias("n"))


def group_times(groups: DataFrame, blocks: DataFrame, keys: Sequence[str], first: str, last: str, no: str, start: str, end: str) -> DataFrame:
    """groups, which name their first and last block, with the start of the one and the end of the other."""
    out = groups.join(blocks.select(*keys, F.col(no).alias(first), F.col(start)), [*keys, first])
    return out.join(blocks.select(*keys, F.col(no).alias(last), F.col(end)), [*keys, last])


def most_salient(df: DataFrame, keys: Sequence[str], score: str, order: str, seconds: str, most: int = 8, share: int = 3) -> DataFrame:
    """The best rows of each key: one a minute of its seconds, at most `most` and one of `share` rows, at least one. Scores count to six digits, ties by `order`."""
    whole = Window.partitionBy(*keys)
    minutes = F.greatest(F.lit(1), F.floor(F.sum(seconds).over(whole) / 60 + 0.5))
    count = F.greatest(F.lit(1), F.least(F.lit(most), minutes, F.floor(F.count(F.lit(1)).over(whole) / share)))
    ranked = df.withColumns({"__c": count, "__r": F.row_number().over(whole.orderBy(F.desc(F.round(score, 6)), order))})
    return ranked.where("__r <= __c").drop("__c", "__r")


def evenly(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: int, ends: bool) -> DataFrame:
    """At most `count` rows of each key, evenly spread. `ends`: the first and the last are among them; else the first is, and none is at the end."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    n = F.col("__n")
    slots = F.lit(float(count - 1)) if ends else F.least(n, F.lit(count)).cast("double")
    places = F.transform(F.sequence(F.lit(0), (F.lit(count) if ends else F.least(n, F.lit(count)).cast("int")) - 1), lambda j: F.bround(j * (n - 1 if ends else n) / slots).cast("long"))
    return rows.where(F.array_contains(places, F.col("__i").cast("long"))).drop("__i", "__n")


def crossing_times(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, value: str, level: float, name: str) -> DataFrame:
    """Rows by which the value has crossed `level` since the row before, with the time on the line between the two."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v, v0, t0 = F.col(value), F.col("__v"), F.col("__t")
    rows = df.withColumns({"__v": F.lag(value).over(w), "__t": F.lag(at).over(w)}).where(((v0 < level) & (v >= level)) | ((v0 >= level) & (v < level)))
    return rows.withColumn(name, t0 + (level - v0) / (v - v0) * (F.col(at) - t0)).drop("__v", "__t")


def best_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, length: int, digits: int = 6) -> DataFrame:
    """The last row of each key's `length` rows in a row with the greatest mean, the earliest among equals, with `mean`; keys of fewer rows have none."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - length, 0)
    rows = df.withColumns({"mean": F.round(F.avg(value).over(w), digits), "__n": F.count(F.lit(1)).over(w)}).where(F.col("__n") == length)
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("mean"), *order))).where("__r = 1").drop("__n", "__r")


def used_files(clips: DataFrame, timeline: str, file: str, place: str, sound: Column) -> DataFrame:
    """(timeline, file, place, uses): a timeline's files in order of their first clip; uses on picture tracks count before those on sound tracks."""
    g = clips.withColumn("__sound", sound).groupBy(timeline, file).agg(F.min(place).alias("__first"), F.sum((~F.col("__sound")).cast("long")).alias("__v"), F.sum(F.col("__sound").cast("long")).alias("__a"))
    w = Window.partitionBy(timeline).orderBy("__first", file)
    return g.select(timeline, file, F.row_number().over(w).alias("place"), F.when(F.col("__v") > 0, F.col("__v")).otherwise(F.col("__a")).alias("uses"))


def deepest_root(files: DataFrame, roots: DataFrame, key: str, path: str, root: str) -> DataFrame:
    """(key, root): the deepest root folder that holds a file: a file's own prefixes meet the roots."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    met = files.select(key, F.explode(prefixes).alias(root)).join(roots.select(root).distinct(), root)
    return met.groupBy(key).agg(F.max_by(root, F.length(root)).alias(root))


def ledger_actions(ledger: DataFrame, files: DataFrame, key: str, written: str, holds: str) -> DataFrame:
    """(key, action): create where no file is there, replace while it holds what was written to it, else conflict."""
    action = F.when(F.col(holds).isNull(), "create").when(F.col(holds) == F.col(written), "replace").otherwise("conflict")
    return ledger.select(key, written).join(files.select(key, holds), key, "left").select(key, action.alias("action"))


def under_root(df: DataFrame, root: str, relative: str, above: str) -> DataFrame:
    """df with roots below the folder `above` moved up to it: their relative paths get the part in between."""
    inside = F.startswith(root, F.lit(f"{above}/"))
    between = F.substring(root, len(above) + 2, 1 << 20)
    return df.withColumns({relative: F.when(inside, F.concat(between, F.lit("/"), F.col(relative))).otherwise(F.col(relative)), root: F.when(inside, F.lit(above)).otherwise(F.col(root))})

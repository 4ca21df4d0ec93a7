"""Mixing sources to target weights by capped water-filling.

Targets: every source gets its weight's part of the total; a source above `max_epochs` times its size is clamped
there and its excess is dealt again by weight, until none is above. The fixed point of that loop has a closed
form: with the sources in order of cap / weight, the first k are clamped, where k is the least number for which the
level (total - caps of the first k) / (weights of the rest) is not above the next one's cap / weight. So one
sort of the per-source table replaces the rounds.

Sampling: a source of rate r takes each of its rows floor(r) times, and the rows that come first in a seeded order,
as many as bring the words taken nearest to the target, once more. The order is the md5 of seed and id, so reruns
agree. A threshold a source is found in two steps, so that no source is sorted in one task: sums by the first three
hex digits of the md5 show the one of 4096 cells that the threshold falls in, and only that cell's rows are sorted.

Scale: only ids and sizes are moved. The per-source table has one row a source; it is measured and broadcast up to
BROADCAST_BYTES, and beyond that joined by source and salt, so that a hot source's rows never meet in one task.
Sources are taken to be named corpora (up to some hundred thousand), whose table one task can sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, seeded

#: Names of sources, and ROW_BYTES for the other columns of each.
BROADCAST_BYTES, ROW_BYTES = 20_000_000, 100
SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs outside the six ASCII white-space characters; null has none."""
    one = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(one, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def water_fill(totals: DataFrame, weights: list[int], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size long) to (source, source_size, weight, target double).

    weights repeat over the sources in code-point order, null last; share: the total of the targets as a part of all sizes.
    """
    rank = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy(F.lit(1))
    w = totals.withColumn("weight", F.get(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(rank) - 1) % len(weights)).cast("int")).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({
        "clamped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "total": F.sum("source_size").over(every) * F.lit(float(share)),
    })
    level = (F.col("total") - F.col("clamped")) / F.col("open")
    w = w.withColumn("level", level).withColumn("holds", level * F.col("weight") <= F.col("cap"))
    w = w.withColumn("at", F.min(F.when(F.col("holds"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("level").alias("level")))).over(every)["level"])
    target = F.when(F.col("at").isNull() | (F.col("at") * F.col("weight") > F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("at") * F.col("weight"))
    return w.select("source", "source_size", "weight", target.alias("target"))


def with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (source, __key, ...) with the columns of their source's row of targets (t_source, ...)."""
    held = targets.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("t_source"), F.lit(0)) + ROW_BYTES), F.lit(0))).first()[0]
    same = F.col("source").eqNullSafe(F.col("t_source"))
    if held <= BROADCAST_BYTES:
        return rows.join(F.broadcast(targets), same).drop("t_source")
    salted = targets.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__salt", F.pmod(seeded(5, "__key"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted.hint("shuffle_hash"), (F.col("__salt") == F.col("t_salt")) & same).drop("t_source", "t_salt", "__salt")


def mix(sizes: DataFrame, weights: list[int], share: float = 1.5, max_epochs: int = 2, seed: int = 0) -> DataFrame:
    """(id, source, size) to (id, source, size, source_size, target, times): how often each row is taken.

    Further columns of sizes are passed through, whatever their names; those that carry the new names are replaced.
    Rows of null source form one source, which comes last. Rows of size 0 are taken as their place in the order
    says and cost nothing; a source whose rows are all of size 0 has target 0 and takes nothing. Ties of the order
    (repeated ids) are broken by size; rows equal in both are interchangeable. An empty table gives an empty result.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    added = ("source_size", "target", "times")
    more = [F.col(f"`{c.replace('`', '``')}`") for c in sizes.columns if c not in ("id", "source", "size", *added)]
    rows = cut(sizes.select("id", "source", F.col("size").cast("long").alias("size"), (F.struct(*more) if more else F.lit(0)).alias("__more_columns")), "mix-sizes").withColumn("__key", key)
    cell = F.substring("__key", 1, 3)
    cells = rows.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("size"))
    targets = water_fill(cells.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(rate).cast("long")).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    # The cell in which the words of the rows before it reach `extra`, and the words before that cell.
    running = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = cells.withColumn("end", F.sum("size").over(running))
    same = lambda a, b: a.eqNullSafe(b)
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", "whole", "extra")
    crossing = ends.join(t, same(F.col("source"), F.col("t_source"))).where(F.col("end") > F.col("extra"))
    crossing = crossing.groupBy("t_source").agg(F.min(F.struct("cell", (F.col("end") - F.col("size")).alias("start"))).alias("first"))
    t = t.join(crossing.withColumnRenamed("t_source", "c_source"), same(F.col("t_source"), F.col("c_source")), "left").drop("c_source")
    marked = with_targets(rows, cut(t, "mix-targets"))
    edge = F.col("first.cell")
    order = Window.partitionBy("source").orderBy("__key", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.where(cell == edge).withColumn("__before", F.col("first.start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    inside = inside.withColumn("__more", (F.col("__before") + F.col("size") / F.lit(2.0) < F.col("extra")).cast("long"))
    outside = marked.where(edge.isNull() | (cell != edge)).withColumn("__before", F.lit(None).cast("long"))
    outside = outside.withColumn("__more", (edge.isNull() & (F.col("extra") > 0) | F.coalesce(cell < edge, F.lit(False))).cast("long"))
    both = inside.select(*outside.columns).unionByName(outside)
    return both.select("id", "source", "size", *(["__more_columns.*"] if more else []), "source_size", "target", F.least(F.col("whole") + F.col("__more"), F.lit(max_epochs)).cast("long").alias("times"))

"""Uniform sharding with exact shard sizes, by a hypergeometric communication matrix.

Rows are dealt to blocks by a hash. How many rows of each block go to each shard is drawn from the
multivariate hypergeometric law (the law that a uniform shuffle of all rows follows), so that shard sizes
are exact. Each block is permuted and cut by its row of the matrix, rows move to their shard, and each
shard is permuted again. Only DataFrame functions are used.

The matrix is drawn by halving: a node holds a range of blocks and its rows of each shard; the share of its
left half is drawn shard after shard, and the rest is the right half's. After log2(blocks) levels each node is
one block. Nodes of a level are independent rows, and each level is written before the next, so that the plan
stays small.

Rows are permuted as keys (two hashes of the whole row and a number among equal rows); a row's other columns
move once, to meet its place. Rows equal in every column are interchangeable, so their numbers spread over blocks.

Scale: the state of the top node is `blocks` longs (at most 65536) and one long a shard. A block and a cell of
a shard hold about `rows_per_task` rows each, whatever the number of shards. Rows with more than
max(COPIES, rows / COMMON) equals are one row with copies: there are at most COMMON of them, which are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hashable, seeded, unit

MAX_BLOCKS = 1 << 16
COPIES, COMMON, SALTS = 1000, 100_000, 64


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` rows out of `total` are among the `good` ones, by inversion of u in [0, 1).

    The law is summed from 12 standard deviations below the mode to 12 above it, each weight from the one before; what
    lies beyond weighs under 1e-30.
    """
    n, k, m = (c.cast("double") for c in (total, good, draws))
    low, high = F.greatest(F.lit(0).cast("long"), draws + good - total), F.least(draws, good)
    mode = F.floor((m + 1) * (k + 1) / (n + 2)).cast("long")
    share = k / F.greatest(n, F.lit(1.0))
    width = F.ceil(12 * F.sqrt(F.greatest(F.lit(0.0), m * share * (1 - share)))).cast("long") + 12
    span = F.sequence(F.greatest(low, mode - width), F.least(high, mode + width))
    ratio = lambda x: (k - x) * (m - x) / ((x + 1).cast("double") * (n - k - m + x + 1))
    grown = lambda s, x: F.struct((s["p"] * ratio(x)).alias("p"), (s["sum"] + s["p"]).alias("sum"))
    all_of_it = F.aggregate(span, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum")), grown, lambda s: s["sum"])
    found = lambda s, x: F.struct(
        (s["p"] * ratio(x)).alias("p"),
        (s["left"] - s["p"]).alias("left"),
        F.when(s["left"] > 0, x).otherwise(s["at"]).alias("at"),
    )
    begin = F.struct(F.lit(1.0).alias("p"), (u * all_of_it).alias("left"), F.element_at(span, 1).alias("at"))
    return F.aggregate(span, begin, found, lambda s: s["at"])


def _draw(level: Column, seed: int) -> Callable[[Column, Column], Column]:
    """A fold over shards: what is left of the node's rows and of its left half's, and the draws so far."""

    def draw(s: Column, shard: Column) -> Column:
        u = unit(seeded(seed, level, F.col("block"), shard["s"]))
        drawn = F.transform(F.array(hypergeometric(s["total"], s["good"], shard["m"], u)), lambda x: F.struct((s["total"] - shard["m"]).alias("total"), (s["good"] - x).alias("good"), F.concat(s["out"], F.array(x)).alias("out")))
        return F.get(drawn, F.lit(0))

    return draw


def communication_matrix(sizes: DataFrame, blocks: int, shard_sizes: Column, seed: int) -> DataFrame:
    """(block, counts): counts[s] rows of the block go to shard s.

    sizes: (block long, n long), at most one row for each of `blocks` (a power of two) blocks; missing ones are empty.
    shard_sizes: array<bigint> over (total), summing to the total.
    """
    spark = sizes.sparkSession
    every = spark.range(blocks).withColumnRenamed("id", "block").join(sizes, "block", "left")
    top = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", F.coalesce("n", F.lit(0)).cast("long").alias("n")))), lambda x: x["n"]).alias("sizes"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))
    nodes = cut(top.select(F.lit(0).cast("long").alias("block"), "sizes", shard_sizes.alias("counts")), "shard-matrix")
    width = blocks
    while width > 1:
        width //= 2
        left = F.slice("sizes", 1, width)
        total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
        good = F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x)

        pairs = F.transform("counts", lambda m, i: F.struct(m.alias("m"), i.alias("s")))
        begin = F.struct(total.alias("total"), good.alias("good"), F.array().cast("array<bigint>").alias("out"))
        nodes = nodes.withColumn("lefts", F.aggregate(pairs, begin, _draw(F.lit(width), seed), lambda s: s["out"]))
        halves = F.array(
            F.struct(F.col("block"), left.alias("sizes"), F.col("lefts").alias("counts")),
            F.struct((F.col("block") + width).alias("block"), F.slice("sizes", width + 1, width).alias("sizes"), F.zip_with("counts", "lefts", lambda a, b: a - b).alias("counts")),
        )
        nodes = cut(nodes.select(F.inline(halves)), "shard-matrix")
    return nodes.select("block", "counts")


def places(kinds: DataFrame, rows: int, shards: int, seed: int, rows_per_task: int, names: tuple[str, str]) -> DataFrame:
    """(__a, __b, shard, slot), a row for each of the n rows of a kind (__a, __b, n); `rows` is the sum of n."""
    shard_name, slot_name = names
    blocks = min(MAX_BLOCKS, 1 << max(2, math.ceil(math.log2(max(1, rows / rows_per_task)))))
    cells = max(1, math.ceil(rows / shards / rows_per_task))
    number = lambda low, n: F.explode(F.sequence(low, F.least(low + COPIES, n) - 1))
    few = kinds.where(F.col("n") <= COPIES).select("__a", "__b", number(F.lit(0).cast("long"), F.col("n")).alias("__i"))
    # The numbers of a row with many equals are made in several tasks.
    some = kinds.where(F.col("n") > COPIES).select("__a", "__b", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("__low"))
    many = some.repartition("__a", "__low").select("__a", "__b", number(F.col("__low"), F.col("n")).alias("__i"))
    dealt = few.unionByName(many).withColumn("__p", seeded(seed, "__a", "__b", "__i")).withColumn("__block", F.pmod(F.col("__p"), F.lit(blocks)))
    dealt = cut(dealt, "shard-keys")
    sizes = dealt.groupBy(F.col("__block").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    quota = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), lambda s: F.floor(F.col("total") / shards).cast("long") + (s < F.col("total") % shards).cast("long"))
    ends = communication_matrix(sizes, blocks, quota, seed + 2).select(
        F.col("block").alias("__block"),
        F.aggregate("counts", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))))).alias("__ends"),
    )
    within = Window.partitionBy("__block").orderBy(seeded(seed + 1, "__p"), "__a", "__b", "__i")
    placed = dealt.withColumn("__at", F.row_number().over(within) - 1).join(ends, "__block")
    placed = placed.withColumn(shard_name, F.size(F.filter("__ends", lambda e: e <= F.col("__at"))).cast("int"))
    placed = placed.withColumn("__c", seeded(seed + 3, "__p")).withColumn("__cell", F.pmod(F.shiftrightunsigned("__c", 20), F.lit(cells)).cast("int"))
    placed = cut(placed.select("__a", "__b", "__i", shard_name, "__c", "__cell"), "shard-places")
    before = Window.partitionBy(shard_name).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(shard_name, "__cell").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    order = Window.partitionBy(shard_name, "__cell").orderBy("__c", "__a", "__b", "__i")
    ranked = placed.withColumn("__rank", F.row_number().over(order) - 1).join(starts, [shard_name, "__cell"])
    return ranked.select("__a", "__b", shard_name, (F.col("__start") + F.col("__rank")).cast("long").alias(slot_name))


def shard(df: DataFrame, shards: int, seed: int = 0, rows_per_task: int = 20_000, names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """All rows of df with `shard` (int, 0 to shards - 1) and `slot` (long, gapless from 0 in each shard).

    A uniform shuffle: every assignment of rows to slots is equally likely over seeds, and shard sizes differ by
    one at most (the first shards get the rows left over). The same rows and seed give the same result, in
    whatever order or partitions they come. Repeated rows are dealt as separate rows. Nulls are values like
    others. Columns that carry the new names are replaced. An empty table gives an empty result; fewer rows
    than shards leave the last shards empty. df is read twice and must give the same rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    df = df.drop(*names)
    own = hashable(df)
    hashes = [seeded(seed, *own).alias("__a"), seeded(seed + 1, *own).alias("__b")]
    kinds = cut(df.select(*hashes).groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("n")), "shard-kinds")
    rows = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(COPIES, rows // COMMON)
    common = kinds.where(F.col("n") > most).select("__a", "__b")
    place = cut(places(kinds, rows, shards, seed, rows_per_task, names), "shard-slots")
    plain = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
    # Equal rows stand side by side after the exchange, and each takes one of their places.
    keyed = df.select(F.struct(*plain).alias("__row"), *hashes)
    some = common.isEmpty()
    lists = place if some else place.join(F.broadcast(common), ["__a", "__b"], "left_anti")
    lists = lists.groupBy("__a", "__b").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("__places"))
    single = keyed if some else keyed.join(F.broadcast(common), ["__a", "__b"], "left_anti")
    numbered = single.withColumn("__i", F.row_number().over(Window.partitionBy("__a", "__b").orderBy(F.lit(0))))
    out = numbered.join(lists, ["__a", "__b"]).select("__row", F.element_at("__places", F.col("__i")).alias("__place"))
    if not some:
        kept = keyed.join(F.broadcast(common), ["__a", "__b"]).groupBy("__a", "__b").agg(F.first("__row").alias("__row"))
        spread = place.join(F.broadcast(common), ["__a", "__b"]).withColumn("__salt", F.pmod(F.col(names[1]), F.lit(SALTS)).cast("int"))
        kept = kept.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.unionByName(spread.join(kept, ["__a", "__b", "__salt"]).select("__row", F.struct(*names).alias("__place")))
    return out.select("__row.*", "__place.*")

"""Merkle manifest of a dataset, verified by a recursive query that climbs from every leaf.

Each row is a leaf: the digest of its columns. Leaves of a group ascend by key; every `fanout` consecutive nodes are
digested into one of the next level until one is left, the group's subroot, and subroots are built likewise into the
root. All levels are stored as node rows: the digests of a node's children, and its place in its parent.

Verification is one recursive query over these rows: it ascends per leaf, and each step appends the siblings of its
level and folds the leaf's digest, as it is or as recomputed from a tampered row, into the parent's.

Scale: leaves are numbered by ranges of (group, key) and counts of the ranges, so that a large group is in many tasks.
A node row is joined by the block of BLOCK leaves that climb to it; nodes above several blocks are repeated for each,
which adds a row a level and block, so that no join key has more than BLOCK leaves, not even the root's. Digests
are kept as 32 bytes. Siblings move once, in the rows that the steps append.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK = 4096
#: About so many leaves are in one range.
RANGE_ROWS = 25_000
TOP = ""


def sha256(text: Column) -> Column:
    """SHA-256 of UTF-8 text as 32 bytes."""
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def hexed(b: Column) -> Column:
    return F.lower(F.hex(b))


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns one after another: `-` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    texts = [c.cast("string") for c in columns]
    return sha256(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with pos, gapless from 0 by `order` in each tree, and size, the rows of the tree; written.

    Rows equal in the order are told apart by a drawn number, which is written before it is used.
    """
    drawn = cut(rows.withColumn("__tie", F.rand(7)), "merkle-rows")
    keys = [tree, *order, "__tie"]
    dealt = drawn.repartitionByRange(max(1, math.ceil(drawn.count() / RANGE_ROWS)), *keys).withColumn("__range", F.spark_partition_id())
    dealt = cut(dealt, "merkle-ranges")
    ranges = dealt.groupBy(tree, "__range").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy(tree)
    ranges = ranges.withColumns({"__before": F.sum("__n").over(every.orderBy("__range")) - F.col("__n"), "size": F.sum("__n").over(every)}).drop("__n")
    at = F.row_number().over(Window.partitionBy(tree, "__range").orderBy(*order, "__tie")) - 1
    placed = dealt.withColumn("__at", at).join(ranges, [tree, "__range"])
    return cut(placed.withColumn("pos", F.col("__before") + F.col("__at")).drop("__tie", "__range", "__before", "__at"), "merkle-leaves")


def count_at(size: Column, fanout: int, level: int) -> Column:
    """Nodes of a level over `size` leaves."""
    return F.floor((size + (fanout**level - 1)) / F.lit(fanout**level)).cast("long")


def height(size: Column, fanout: int) -> Column:
    """Levels above the leaves."""
    return F.size(F.filter(F.array(*[F.lit(fanout**i) for i in range(int(62 / math.log2(fanout)))]), lambda p: p < size))


def levels(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """Node rows by level from 1: (tree, size, level, pos, kids, hash); leaves: (tree, size, pos, hash). Each is written."""
    most = leaves.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    below, out, level = leaves.select("tree", "size", "pos", "hash"), [], 0
    while fanout**level < most:
        open_ = below.where(count_at(F.col("size"), fanout, level) > 1)
        level += 1
        runs = open_.groupBy("tree", "size", F.expr(f"pos div {fanout}").alias("pos")).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("at"), "hash"))).alias("run"))
        kids = F.aggregate("run", F.lit(b"").cast("binary"), lambda a, k: F.concat(a, k["hash"]))
        made = runs.select("tree", "size", F.lit(level).alias("level"), "pos", kids.alias("kids"))
        below = cut(made.withColumn("hash", sha256(hexed(F.col("kids")))), "merkle-level")
        out.append(below)
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _blocks(first: Column, last: Column) -> Column:
    """The blocks of the leaves from first to last."""
    return F.explode(F.sequence(F.expr("0L") + F.floor(first / BLOCK), F.floor(last / BLOCK))).alias("block")


def build(leaves: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame]:
    """The tree over leaves (tree, size, pos, hash): the leaves with their place in their parent, and the node rows.

    Leaves get (block, up, slot, subroot, root); node rows are (tree, block, step, pos, kids, up, slot, subroot, root), one for
    each block below: `up` is the parent's pos at the next step, `slot` the place among its children. subroot and
    root are given where a node is one.
    """
    own = levels(leaves, fanout)
    lone = leaves.where("size = 1").select("tree", "size", "hash")
    subroots = _union([lone, *(x.where(count_at(F.col("size"), fanout, i + 1) == 1).select("tree", "size", "hash") for i, x in enumerate(own))])
    top = numbered(subroots.select(F.col("tree").alias("name"), F.col("size").alias("leaves"), F.lit(TOP).alias("tree"), "hash"), "tree", ["name"])
    above = levels(top, fanout)
    trees = top.select(F.col("name").alias("tree"), F.col("leaves").alias("size"), F.col("pos").alias("rank"), F.col("size").alias("trees"), height(F.col("leaves"), fanout).alias("height"))

    def linked(nodes: DataFrame, last: Callable[[Column], Column], level: int) -> DataFrame:
        """Nodes (tree, size, pos, hash) of a tree's level with up, slot, subroot and root."""
        inner = nodes.where(last(F.col("size")) > 1).withColumns({"up": F.expr(f"pos div {fanout}"), "slot": F.expr(f"cast(pos % {fanout} as int)"), "subroot": F.lit(None).cast("binary"), "root": F.lit(None).cast("binary")})
        ends = nodes.where(last(F.col("size")) == 1).join(trees.select("tree", "rank", "trees"), "tree")
        more = F.col("trees") > 1
        ends = ends.withColumns({"up": F.when(more, F.expr(f"rank div {fanout}")), "slot": F.when(more, F.expr(f"cast(rank % {fanout} as int)")), "subroot": F.col("hash"), "root": F.when(~more, F.col("hash"))}).drop("rank", "trees")
        return inner.unionByName(ends)

    started = linked(leaves, lambda n: n, 0).withColumn("block", F.expr(f"pos div {BLOCK}"))
    rungs = []
    for i, nodes in enumerate(own):
        span = fanout ** (i + 1)
        some = linked(nodes, lambda n, i=i: count_at(n, fanout, i + 1), i + 1)
        rungs.append(some.select("tree", _blocks(F.col("pos") * span, F.least((F.col("pos") + 1) * span, F.col("size")) - 1), F.lit(i + 1).alias("step"), "pos", "kids", "up", "slot", "subroot", "root"))
    for i, nodes in enumerate(above):
        more = count_at(F.col("size"), fanout, i + 1) > 1
        node = nodes.select("pos", "kids", F.when(more, F.expr(f"pos div {fanout}")).alias("up"), F.when(more, F.expr(f"cast(pos % {fanout} as int)")).alias("slot"), F.lit(None).cast("binary").alias("subroot"), F.when(~more, F.col("hash")).alias("root"))
        below = trees.select("tree", "size", (F.col("height") + i + 1).alias("step"), F.expr(f"rank div {fanout ** (i + 1)}").alias("pos")).join(node, "pos")
        rungs.append(below.select("tree", _blocks(F.lit(0), F.col("size") - 1), "step", "pos", "kids", "up", "slot", "subroot", "root"))
    if not rungs:
        rungs = [started.select("tree", "block", F.lit(0).alias("step"), "pos", F.col("hash").alias("kids"), "up", "slot", "subroot", "root").where(F.lit(False))]
    return cut(started, "merkle-started"), cut(_union(rungs), "merkle-nodes")


CLIMB = """
WITH RECURSIVE climb AS (
  SELECT tree, block, pos AS leaf, 0 AS step, up, slot, coalesce(tampered, hash) AS folded, CAST(NULL AS BINARY) AS siblings, subroot, root, key, hash FROM {leaves}
  UNION ALL
  SELECT c.tree, c.block, c.leaf, c.step + 1, n.up, n.slot,
         unhex(sha2(encode(lower(hex(concat(substring(n.kids, 1, 32 * c.slot), c.folded, substring(n.kids, 32 * c.slot + 33)))), 'UTF-8'), 256)),
         concat(substring(n.kids, 1, 32 * c.slot), substring(n.kids, 32 * c.slot + 33)), n.subroot, n.root, NULL, CAST(NULL AS BINARY)
  FROM climb c JOIN {nodes} n ON n.tree = c.tree AND n.block = c.block AND n.step = c.step + 1 AND n.pos = c.up
)
SELECT * FROM climb
"""


def climb(started: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each leaf and step: what was folded so far, and the siblings met there. Written."""
    spark, limit = started.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    # The query makes leaves x levels rows, however many that are.
    spark.conf.set(limit, -1)
    try:
        return cut(spark.sql(CLIMB, leaves=started, nodes=nodes), "merkle-climb")
    finally:
        if before is None:
            spark.conf.unset(limit)
        else:
            spark.conf.set(limit, before)


def verified(rows: DataFrame, fanout: int = 8) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each of rows (key, group, hash, tampered); digests in hex.

    hash: a row's digest (32 bytes); tampered: the digest to verify in its place, null for the same. Leaves of a group
    ascend by key, nulls first, and by digest among equal keys; groups ascend by the bytes of their name, null
    first. proof_sha256 is of all siblings up to the root (of the empty text for a lone leaf). Repeated rows are
    leaves of their own. An empty table gives an empty result. Other columns are not read.
    """
    tree = F.when(F.col("group").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("group").cast("string")))
    leaves = numbered(rows.select("key", tree.alias("tree"), "hash", "tampered"), "tree", ["key", "hash"])
    steps = climb(*build(leaves, fanout))
    each = steps.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("step", "folded", "siblings", "key", "hash"))).alias("path"), F.max("subroot").alias("subroot"), F.max("root").alias("root"))
    siblings = F.aggregate("path", F.lit(b"").cast("binary"), lambda a, s: F.concat(a, F.coalesce(s["siblings"], F.lit(b"").cast("binary"))))
    first, last = F.element_at("path", 1), F.element_at("path", -1)
    out = each.select(first["key"].alias("key"), hexed(first["hash"]).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), hexed(sha256(hexed(siblings))).alias("proof_sha256"), hexed(last["folded"]).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Line dedup with levelled sorted runs of line hashes.

Lines are keyed by 128 bits of their trimmed, lower-cased form. Batches of documents are taken from the largest ids
down: a batch's line counts are merge-anti-joined with the runs so far. What no run holds is fresh: the document that
keeps the line is in this batch, and the key is added with it. Of keys that are known only the count is added. So a key
has its keeper in one run. The batch's run joins level 0; when a level has `fanout` runs they are merged into one of the
next level, so that a batch meets few runs and a line's counts are rewritten a logarithmic number of times. At the end
all runs are merged, and lines of enough documents go from all of them but the keeper.

Scale: counts are combined on the map side before a shuffle, so a line that a third of all documents hold is one
row a task. The join of lines to repeated keys is salted by document. Only documents' texts that lose a line are
rebuilt; runs live in the shared folder, sorted by key within their files. Batches are split at quantiles of at most
SAMPLE ids, which decide their sizes only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, scratch_path, seeded, unit

SPACES = " \t\n\x0b\x0c\r"
SALTS = 16
SAMPLE = 2000
KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(key: Column) -> Column:
    return F.struct(seeded(1, key).alias("k1"), seeded(2, key).alias("k2"))


@dataclass
class LineRuns:
    """Runs (k1, k2, n, last): in how many documents a line was seen and, in the run that met it first, the largest id there."""

    spark: SparkSession
    fanout: int = 2
    levels: list[list[str]] = field(default_factory=list)

    def _write(self, run: DataFrame, level: int) -> None:
        path = scratch_path(self.spark, f"line-run-{level}")
        run.select(*KEY, "n", "last").sortWithinPartitions(*KEY).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def read(self) -> DataFrame | None:
        """All runs together; a key has a row for each run that holds it."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else None

    @staticmethod
    def merged(runs: DataFrame) -> DataFrame:
        """One row a key. Only the run that met a key first has its keeper: the anti-join alone decides which one that is."""
        return runs.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("last").alias("last"))

    def add(self, batch: DataFrame) -> None:
        """Takes a batch (k1, k2, n, last; one row a key) of smaller ids than all before."""
        self.schema = batch.select(*KEY, "n", "last").schema
        before = self.read()
        if before is not None:
            held = before.select(*KEY).hint("merge")
            fresh = batch.join(held, KEY, "left_anti").select(*KEY, "n", "last")
            known = batch.join(held, KEY, "left_semi").select(*KEY, "n", F.lit(None).cast(self.schema["last"].dataType).alias("last"))
            batch = fresh.unionByName(known)
        self._write(batch, 0)
        self.compact()

    def compact(self) -> None:
        """Merges every level that has `fanout` runs into one run of the next."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                paths, self.levels[level] = self.levels[level], []
                self._write(self.merged(self.spark.read.schema(self.schema).parquet(*paths)), level + 1)
            level += 1


def batch_of(docs: DataFrame, batches: int) -> Column:
    """The batch of a doc_id of docs, 0 for the largest ids; null ids are in the last one."""
    ids = docs.select("doc_id").where("doc_id is not null")
    share = SAMPLE / max(1, ids.count())
    some = sorted({r[0] for r in ids.where(unit(seeded(3, "doc_id")) < share).limit(SAMPLE).collect()}, reverse=True)
    bounds = [some[i * len(some) // batches] for i in range(1, batches)] if some else []
    kind = docs.schema["doc_id"].dataType
    below = [F.coalesce(F.col("doc_id") < F.lit(x).cast(kind), F.lit(True)).cast("int") for x in bounds]
    return reduce(Column.__add__, below, F.lit(0))


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """The long lines of docs (doc_id, k1, k2; one row a document and key) and the keys of at least min_docs documents (k1, k2, last)."""
    spark = docs.sparkSession
    each = docs.select("doc_id", F.explode(lines(F.col("text"))).alias("line")).select("doc_id", line_key(F.col("line")).alias("key"))
    each = each.where(F.length("key") >= min_chars).select("doc_id", key_hash(F.col("key")).alias("k")).select("doc_id", "k.*").distinct()
    path = scratch_path(spark, "line-keys")
    each.withColumn("batch", batch_of(docs, batches)).write.partitionBy("batch").parquet(path)
    kept = spark.read.schema(each.schema.add("batch", "integer")).parquet(path)
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(kept.where(F.col("batch") == b).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")))
    return kept.drop("batch"), LineRuns.merged(runs.read()).where(F.col("n") >= min_docs).select(*KEY, "last")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2, names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept")) -> DataFrame:
    """Rows of docs (doc_id, text, ...) with the number of lines, of dropped lines, and the kept text.

    A line goes if its key (trimmed of ASCII white space, A-Z lower-cased) has at least min_chars code points and is
    in at least min_docs documents, unless the row's doc_id is the largest with that key. Rows that share a doc_id,
    null included, count as one document; null is below all other ids. Null and empty texts have one empty line.
    Columns that carry the new names are replaced. An empty table gives an empty result.
    """
    docs = docs.drop(*names)
    own = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    held, repeated = repeated_lines(docs.select("doc_id", "text"), min_chars, min_docs, batches, fanout)
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = held.withColumn("salt", F.pmod(seeded(4, "doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*KEY, "salt"])
    gone = hit.where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy(F.col("doc_id").alias("__gone_id")).agg(F.collect_set(F.struct(*KEY)).alias("__gone"))
    packed = docs.select(F.struct(*own).alias("__row"), F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    rows = packed.join(gone, F.col("__id").eqNullSafe(F.col("__gone_id")), "left").withColumn("__lines", lines(F.col("__text")))
    # The keys that go are dealt to cells, so that a text of many lines does not look through all of them for each.
    cells = F.ceil(F.sqrt(F.size("__lines"))).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), cells - 1), lambda c: F.filter("__gone", lambda k: F.pmod(k["k1"], cells) == c))
    rows = rows.withColumn("__cells", F.when(F.col("__gone").isNotNull(), dealt))
    found = lambda k: F.array_contains(F.get("__cells", F.pmod(k["k1"], cells).cast("int")), k)
    stays = lambda x: ~((F.length(line_key(x)) >= min_chars) & found(key_hash(line_key(x))))
    rows = rows.withColumn("__kept", F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(F.filter("__lines", stays)))
    return rows.select("__row.*", F.size("__lines").cast("long").alias(names[0]), (F.size("__lines") - F.size("__kept")).cast("long").alias(names[1]), F.array_join("__kept", "\n").alias(names[2]))

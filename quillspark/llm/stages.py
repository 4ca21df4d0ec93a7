"""The stages of the corpus pipeline: each calls one operator on all rows it gets and acts on its verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import decontam, jaccard, mixing, quality, queries, sharding
from .common import cut, load, seeded

THRESHOLD = 0.3


#: What stands for a row in the verdicts: its id and two hashes of its text. Rows equal in these have equal verdicts.
KEY = ["__null", "__id", "__h", "__g"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__null": F.col("doc_id").isNull(), "__id": F.col("doc_id"), "__h": seeded(21, "text"), "__g": seeded(22, "text")})


def _joined(docs: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """docs with the other columns of verdicts, which has a row for each key at most."""
    right = verdicts.withColumnsRenamed({k: f"{k}_v" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_v")) for k in keys])
    return docs.join(right, same).drop(*[f"{k}_v" for k in keys])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores at THRESHOLD or more; each row is judged by its own text.

    Null and empty texts have a score like others. Rows that share an id, null included, are judged one by one; labels of
    their id count for each of them. An empty table gives an empty result. Columns other than doc_id and text pass
    through, whatever their names.
    """
    rows = _keyed(docs)
    known = load(spark, sf_dir, "labels").where(~queries.held_out()).select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    feats = cut(quality.features(rows.select(F.struct(*KEY).alias("row"), "text"), "row"), "quality-features")
    model = quality.train(feats.select(F.col("key.__id").alias("key"), "features"), known, seed=17)
    good = quality.score(feats, model).where(F.col("score") >= THRESHOLD)
    return _joined(rows, good.select("key.*").distinct(), KEY).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that similarity links join, one of the smallest id (five words, similarity 0.8).

    Null ids come last. Texts without words, null ones too, are linked with nothing, so all their rows stay. Of rows equal
    in id and text the least of their other columns stays. An empty table gives an empty result.
    """
    rows = _keyed(docs)
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    some = rows.where(words)
    groups = jaccard.jaccard_components(some.select(F.struct(*KEY).alias("doc_id"), "text"))
    least = _joined(some, groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id.*").distinct(), KEY)
    # Rows of one id and text are one group: the least of their other columns stays.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = least.groupBy(*KEY).agg(F.min(F.struct(F.lit(0).alias("__0"), *others)).alias("__row"), F.min("text").alias("text"))
    one = one.select(F.col("__id").alias("doc_id"), "text", *[F.col("__row")[c].alias(c) for c in others]).select(*docs.columns)
    return one.unionByName(rows.where(~words).select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold too little of the benchmark to count as contaminated.

    Null and empty texts are clean; repeated rows and rows that share an id are judged by their own text. An empty table,
    or an empty benchmark, drops nothing.
    """
    return decontam.decontaminate(docs, load(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; of rows equal in id, source and text, the first in order of the other columns take the more.

    Rows of null source form one source. Texts without words cost nothing and are taken as their place in the order says;
    a source without words gives no rows. An empty table gives an empty result.
    """
    keys = [*KEY, "source"]
    rows = _keyed(docs)
    sizes = rows.select(F.col("doc_id").alias("id"), "source", mixing.word_count(F.col("text")).alias("size"), *KEY)
    taken = mixing.mix(sizes, queries.MIX_WEIGHTS, seed=17).groupBy(*keys).agg(F.sum("times").alias("__sum"), F.count(F.lit(1)).alias("__n")).where("__sum > 0")
    taken = taken.select(*keys, F.floor(F.col("__sum") / F.col("__n")).alias("__each"), (F.col("__sum") % F.col("__n")).alias("__rest"))
    marked = _joined(rows, taken, keys)
    even = marked.where("__rest = 0").select(*docs.columns, F.col("__each").alias("__times"))
    # Equal rows, some of which are taken once more: counted first, so that they never meet in one task.
    kinds = marked.where("__rest > 0").groupBy(*docs.columns, *KEY, "__each", "__rest").agg(F.count(F.lit(1)).alias("__count"))
    before = F.coalesce(F.sum("__count").over(Window.partitionBy(*keys).orderBy(*[c for c in docs.columns if c not in ("doc_id", "text", "source")], F.lit(0)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    odd = kinds.withColumn("__more", F.greatest(F.lit(0), F.least(F.col("__rest") - before, F.col("__count"))))
    odd = odd.select(*docs.columns, (F.col("__each") * F.col("__count") + F.col("__more")).alias("__times"))
    return even.unionByName(odd).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__times").cast("int")))).select(*docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot; columns of these names are replaced. An empty table gives an empty result."""
    return sharding.shard(docs, queries.SHARDS, seed=17)

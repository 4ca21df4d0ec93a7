"""Relational building blocks: filters, greatest per group, fair and two-phase top-k, facets, roll-ups, diffs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold


@dataclass(frozen=True)
class Filter:
    """What a listing can be asked for; a field that is None is not applied, and absent data excludes a row."""

    any_of: tuple[str, Sequence] | None = None
    equals: tuple[str, object] | None = None
    at_least: tuple[str, float] | None = None
    between: tuple[str, object, object] | None = None
    contains: tuple[Sequence[str], str] | None = None
    path_prefix: tuple[str, str] | None = None
    word_starts: tuple[str, Sequence[str]] | None = None
    flag: tuple[str, bool] | None = None

    def predicate(self) -> Column:
        out = F.lit(True)
        for f in fields(self):
            asked = getattr(self, f.name)
            if asked is not None:
                out = out & getattr(self, f"_{f.name}")(*asked)
        return out

    def _any_of(self, c: str, values: Sequence) -> Column:
        return F.col(c).isin(list(values))

    def _equals(self, c: str, value: object) -> Column:
        return F.col(c) == F.lit(value)

    def _at_least(self, c: str, value: float) -> Column:
        return F.col(c) >= value

    def _between(self, c: str, low: object, high: object) -> Column:
        return F.col(c).between(low, high)

    def _contains(self, columns: Sequence[str], text: str) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | F.contains(fold(F.col(c)), fold(F.lit(text)))
        return F.coalesce(out, F.lit(False))

    def _path_prefix(self, c: str, prefix: str) -> Column:
        return F.lower(F.col(c)).startswith(F.lower(F.lit(prefix)))

    def _word_starts(self, c: str, keys: Sequence[str]) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & F.exists(F.split(fold(F.col(c)), r"[^\p{L}\p{N}]+"), _starts(k))
        return out

    def _flag(self, c: str, value: bool) -> Column:
        return F.col(c) == value


def _starts(key: str) -> Callable[[Column], Column]:
    return lambda word: word.startswith(key)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ties: bool = False) -> DataFrame:
    """The first row of each key in the order; with `ties` all that share its place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", (F.rank() if ties else F.row_number()).over(w)).where("__r = 1").drop("__r")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def round_robin(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """k rows, one from each group in turn: the best of all, then the second best of all, ..."""
    w = Window.partitionBy(*keys).orderBy(*order)
    # No group gives more than k rows, so the final sort sees groups x k rows and keeps k by a bounded heap.
    ranked = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= k)
    return ranked.orderBy("turn", *order).limit(k)


def two_phase(df: DataFrame, strength: Sequence[Column], k: int, then: Sequence[Column]) -> DataFrame:
    """The k strongest rows, in another order."""
    return df.orderBy(*strength).limit(k).orderBy(*then)


def facet_counts(df: DataFrame, column: str, limit: int, label: str = "value") -> DataFrame:
    """Most frequent values; ties by folded label."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(label)).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), fold(F.col(label).cast("string")), label).limit(limit)


def path_rollup(df: DataFrame, path: Column, separator: str = "/") -> DataFrame:
    """(folder, direct, total): rows in each folder itself and below it."""
    parts = F.split(path, separator)
    folders = F.transform(F.sequence(F.lit(1), F.size("__p")), lambda i: F.struct(F.array_join(F.slice("__p", 1, i), separator).alias("folder"), (i == F.size("__p")).cast("long").alias("own")))
    each = df.withColumn("__p", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).select(F.inline(folders))
    return each.groupBy("folder").agg(F.sum("own").alias("direct"), F.count(F.lit(1)).alias("total"))


def mode(df: DataFrame, keys: Sequence[str], column: str, weight: str) -> DataFrame:
    """Each key's most frequent value; ties by total weight, then by value."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(weight), 2).alias("weight"))
    return latest(counts, keys, [F.desc("n"), F.desc("weight"), F.asc(column)])


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, state): new, changed, unchanged or gone, by one full outer join."""
    a, b = old.select(key, F.col(mark).alias("__old"), F.lit(1).alias("__a")), new.select(key, F.col(mark).alias("__new"), F.lit(1).alias("__b"))
    state = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "gone").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def longest_prefix(df: DataFrame, path: str, prefixes: DataFrame, prefix: str, separator: str = "/") -> DataFrame:
    """Rows with the longest given prefix of their path: an equi join on the path's own prefixes."""
    parts = F.split(F.col(path), separator)
    own = df.withColumn("__all", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator)))
    met = own.select(path, F.explode("__all").alias(prefix)).distinct().join(prefixes.select(prefix).distinct(), prefix)
    best = met.groupBy(path).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return own.drop("__all").join(best, path, "left")


def dedupe_folded(df: DataFrame, column: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each folded value."""
    return latest(df.withColumn("__k", fold(F.col(column))), ["__k"], order).drop("__k")


def wanted(sources: DataFrame, known: DataFrame, languages: tuple[str, str] = ("fr", "en")) -> DataFrame:
    """(key, target, pass, text): what sources (text, language) still need beside known (text, target, answer).

    First pass: each text in the other language, in both where its own is not one of the two. Second pass: a text that
    is known to come back unchanged, in its own language. An entry that both passes ask for is in the first. Texts meet
    by their hash; null texts ask for nothing.
    """
    a, b = languages
    key = F.sha2("text", 256)
    have = known.where("text is not null").groupBy(key.alias("key"), "target").agg(F.bool_or(F.col("answer") == F.col("text")).alias("same"))
    rows = sources.where("text is not null").groupBy(key.alias("key"), F.when(F.col("language").isin(a, b), F.col("language")).alias("own")).agg(F.first("text").alias("text"))
    targets = F.when(F.col("own") == a, F.array(F.lit(b))).when(F.col("own") == b, F.array(F.lit(a))).otherwise(F.array(F.lit(a), F.lit(b)))
    asked = rows.withColumn("target", F.explode(targets)).join(have, ["key", "target"], "left")
    first = asked.where("same is null").select("key", "target", F.lit(1).alias("pass"), "text")
    second = asked.where("same and own is not null").select("key", F.col("own").alias("target"), F.lit(2).alias("pass"), "text").join(have, ["key", "target"], "left_anti")
    return first.unionByName(second).groupBy("key", "target").agg(F.min("pass").alias("pass"), F.first("text").alias("text"))

"""Hybrid retrieval: postings, BM25, cosine, rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def bm25(docs: DataFrame, key: str, text: str, terms: Sequence[str]) -> DataFrame:
    """(key, score) of the documents that hold a term; a term that ends in * matches beginnings.

    Statistics are over all documents. One pass counts the terms of each document; nothing but counts is shuffled.
    """
    counted = docs.select(key, tokens(F.col(text)).alias("__t"))
    match = lambda term: (lambda t: t.startswith(term[:-1])) if term.endswith("*") else (lambda t: t == term)
    freq = F.array(*[F.size(F.filter("__t", match(t))) for t in terms])
    rows = counted.select(key, F.size("__t").alias("__len"), freq.alias("__tf"))
    stats = rows.agg(F.count(F.lit(1)).alias("__n"), F.avg("__len").alias("__avg"), *[F.sum((F.col("__tf")[i] > 0).cast("long")).alias(f"__df{i}") for i in range(len(terms))])
    part = F.lit(0.0)
    for i in range(len(terms)):
        n, tf = F.col(f"__df{i}"), F.col("__tf")[i]
        idf = F.greatest(F.log((F.col("__n") - n + 0.5) / (n + 0.5)), F.lit(IDF_FLOOR))
        part = part + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    held = rows.where(F.exists("__tf", lambda x: x > 0))
    # The statistics are one row.
    return held.join(F.broadcast(stats)).select(key, part.alias("score"))


def phrase(docs: DataFrame, key: str, text: str, words: Sequence[str]) -> DataFrame:
    """Documents in whose tokens the words stand one after another."""
    needle = " " + " ".join(words) + " "
    return docs.where(F.contains(F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), " "), F.lit(" ")), F.lit(needle))).select(key)


def unit_vector(v: Column, dims: int | None = None) -> Column:
    """The first `dims` components in double precision, of length 1; null for a zero vector."""
    cut = F.transform(F.slice(v, 1, dims) if dims else v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(cut, lambda x: x / norm))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similar(vectors: DataFrame, key: str, vector: str, of: int, least: float = -1.0) -> DataFrame:
    """(key, similarity) to the vector of one key, itself left out; the one row is broadcast."""
    probe = vectors.where(F.col(key) == of).select(F.col(vector).alias("__q")).limit(1)
    return vectors.where(F.col(key) != of).join(F.broadcast(probe)).select(key, cosine(F.col(vector), F.col("__q")).alias("similarity")).where(F.col("similarity") >= least)


def ranked(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best rows with their rank from 1; the sort is a bounded heap, the ranking sees k rows."""
    best = df.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def rank_fusion(lists: Sequence[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, score, lists): sum of 1 / (k + rank) over the lists (key, rank) that hold the key."""
    parts = [x.select(key, "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("list").alias("list"), F.count(F.lit(1)).alias("lists"))

"""The question flow: retrieve passages by words and vectors, choose what fits, number the lines, and read an answer's citations.

Writing the answer is somebody else's: its text comes in as a column. Retrieval leaves `most` passages, so what follows
works on a few rows, which are the only ones whose texts are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval as S
from .facts import citations
from .search_index import WordIndex, search
from .shots import choose_passages

# Fixed values.
MOST, LISTED, LINE_CHARS, NO_ANSWER = 40, 200, 320, "NO_ANSWER"


def retrieved(index: WordIndex, query: str, key: str, vectors: DataFrame | None = None, probe: Sequence[float] | None = None, least: float = 0.3, most: int = MOST) -> DataFrame:
    """(key, rank, lists): the passages that words and vectors find, fused by rank, from 0.

    vectors: (key, vector). Without vectors or without a probe the words alone count.
    """
    near = lambda df, score: S.ranked(df.withColumn("near", F.round(score, 9)), "near", key, LISTED).select(key, "rank")
    lists = [near(search(index, query, key), "score")]
    if vectors is not None and probe is not None:
        alike = vectors.select(key, S.cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in probe])).alias("similarity"))
        lists.append(near(alike.where(F.col("similarity") >= least), "similarity"))
    fused = S.rank_fusion(lists, key).withColumn("near", F.round("score", 9))
    best = fused.orderBy(F.desc("near"), "list", key).limit(most)
    # At most `most` rows are ordered.
    order = F.array_sort(F.collect_list(F.struct((-F.col("near")).alias("n"), "list", F.col(key).alias("k"), "lists")))
    return best.agg(order.alias("all")).select(F.posexplode("all").alias("rank", "x")).select(F.col("x.k").alias(key), F.col("rank").cast("long").alias("rank"), "x.lists")


def clock_span(a: Column, b: Column) -> Column:
    """M:SS or M:SS–M:SS; null without a start."""
    one = lambda t: F.concat(F.floor(F.greatest(t, F.lit(0.0)) / 60).cast("string"), F.lit(":"), F.lpad((F.floor(F.greatest(t, F.lit(0.0))) % 60).cast("string"), 2, "0"))
    start, end = one(a), one(F.coalesce(b, a))
    return F.when(start == end, start).otherwise(F.concat(start, F.lit("–"), end))


def line(video: Column, kind: Column, a: Column, b: Column, text: Column, limit: int = LINE_CHARS) -> Column:
    """A passage on one cleaned line: video — kind[, time]: text."""
    head = F.concat(T.clean_untrusted(video), F.lit(" — "), kind, F.coalesce(F.concat(F.lit(", "), clock_span(a, b)), F.lit("")))
    return F.concat(head, F.lit(": "), T.cut_words(T.clean_untrusted(text), limit))


def context(found: DataFrame, passages: DataFrame, key: str, budget: int) -> DataFrame:
    """(number, key, line, tokens): the retrieved passages that are read, numbered from 1 in the order they are told.

    found: as retrieved() gives; passages: (key, video, kind, family, a, b, text), of which only the found ones are read on.
    """
    rows = passages.join(F.broadcast(found), key)
    rows = rows.withColumn("line", line(F.col("video"), F.col("kind"), F.col("a"), F.col("b"), F.col("text"))).withColumn("tokens", T.token_estimate(F.col("line")))
    slim = rows.select(F.lit(0).alias("question"), "rank", "video", "family", "a", "b", "tokens")
    told = choose_passages(slim, ["question"], budget).select("rank", (F.col("place") + 1).alias("number"))
    return rows.join(F.broadcast(told), "rank").select("number", key, "line", "tokens")


def read_answers(answers: DataFrame, text: str, passages: int) -> DataFrame:
    """answers with `text` in one form of citations, cited (numbers of real passages in order), dropped, and status: answered, no_answer or uncited."""
    marker = rf"(?i)^\s*\**{NO_ANSWER}\**\s*[:：.\-–—]?\s*"
    none = F.col(text).rlike(marker)
    read = answers.withColumn("__none", F.coalesce(none, F.lit(False))).withColumn("__c", citations(F.regexp_replace(F.coalesce(text, F.lit("")), marker, ""), passages))
    status = F.when(F.size("__c.cited") > 0, "answered").when(F.col("__none"), "no_answer").otherwise("uncited")
    return read.withColumns({text: F.col("__c.text"), "cited": F.col("__c.cited"), "dropped": F.col("__c.dropped"), "status": status}).drop("__none", "__c")

"""Queries of transcript, caption and framing rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import transcripts as X
from .registry import load, query

_FOLD = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT conv_id, turn, length(text) AS n, {_FOLD.format('text')} AS t, {_FOLD.format('lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text)')} AS b FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN -(n % 23) / 20.0::DOUBLE < -0.8 THEN 'low_logprob' END AS a, CASE WHEN (n % 11) / 10.0::DOUBLE < 0.5 THEN 'low_word_probability' END AS w,
CASE WHEN t <> '' AND (t = b OR (len(string_split(t, ' ')) >= 3 AND contains(' ' || b || ' ', ' ' || t || ' '))) THEN 'repeat' END AS s, CASE WHEN turn % 6 >= 4 AND 1 + (n % 10) / 5.0::DOUBLE > 2.2 THEN 'fallback_loop' END AS f FROM p)
SELECT conv_id, turn, concat_ws(',', a, w, s, f) AS reasons FROM r""")
def suspect_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    temperature = F.when(F.col("turn") % 6 >= 4, 0.8).otherwise(0.0)
    reasons = X.suspect_reasons(F.col("text"), F.col("before"), -(n % 23) / 20.0, (n % 11) / 10.0, temperature, 1 + (n % 10) / 5.0)
    return load(spark, sf_dir, "conversations").withColumn("before", before).select("conv_id", "turn", F.array_join(reasons, ",").alias("reasons"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_discount * 400 AS s, l_discount * 400 + l_tax * 200 AS e, l_quantity AS q,
coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS base FROM lineitem)
SELECT l_orderkey, l_linenumber, round(base + greatest(0, s), 6) AS s, round(base + least(e, q), 6) AS e FROM c WHERE s < q AND e > s""")
def placed_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = load(spark, sf_dir, "lineitem").withColumns({"s": F.col("l_discount") * 400, "e": F.col("l_discount") * 400 + F.col("l_tax") * 200})
    out = X.placed(cues, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "s", "e", "l_quantity")
    return out.select("l_orderkey", "l_linenumber", F.round("s", 6).alias("s"), F.round("e", 6).alias("e"))


@query()
def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.wrapped(F.col("text")), "\n").alias("lines"))


@query()
def framing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct((F.col("l_discount") * 5).alias("x1"), (F.col("l_tax") * 5).alias("y1"), (F.col("l_discount") * 5 + F.col("l_quantity") / 100).alias("x2"), (F.col("l_tax") * 5 + F.col("l_quantity") / 80).alias("y2"))
    return X.crop_runs(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box")), ["l_orderkey"], "l_linenumber", "box", 0.6, 0.7)

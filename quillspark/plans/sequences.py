"""Queries over ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequences as Q
from ..operators import stretches as St
from .registry import load, query

US = "epoch_us(ts)"
_HYST = "SELECT user_id, event_id, epoch_us(ts) AS us, coalesce(last_value(CASE WHEN value >= 70 THEN TRUE WHEN value < 40 THEN FALSE END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), FALSE) AS state FROM events"


def us() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", us().alias("us"))


@query(f"""WITH h AS ({_HYST}), c AS (SELECT *, CASE WHEN state <> lag(state) OVER (PARTITION BY user_id ORDER BY us, event_id) THEN 1 ELSE 0 END AS ch FROM h), r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM r WHERE state GROUP BY user_id, run""")
def hysteresis_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.runs(Q.hysteresis(samples(spark, sf_dir), ["user_id"], ["us", "event_id"], "value", 70, 40), ["user_id"], ["us", "event_id"], "state")
    return rows.where("state").groupBy("user_id", "run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n")).drop("run")


@query("""WITH x AS (SELECT event_id, value, coalesce(lag(value) OVER w, value) AS a, coalesce(lead(value) OVER w, value) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, list_sort([a, value, b])[2] AS median FROM x""")
def median3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.median3(samples(spark, sf_dir), ["user_id"], ["us", "event_id"], "value").select("event_id", "median")


_SPANS = "SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + (value * 60000000)::BIGINT AS e FROM events"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rounded to whole microseconds as SQL does.
    return samples(spark, sf_dir).select("user_id", F.col("us").alias("s"), (F.col("us") + F.bround(F.col("value") * 60000000).cast("long")).alias("e"))


def _merge_sql(gap: int, strict: bool) -> str:
    return f"""WITH x AS ({_SPANS}), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x),
g AS (SELECT *, sum(CASE WHEN s - p {'>=' if strict else '>'} {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS parts FROM g GROUP BY user_id, g"""


@query(_merge_sql(600_000_000, False))
def islands_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.merge_spans(spans(spark, sf_dir), ["user_id"], "s", "e", 600_000_000)


@query(_merge_sql(3_600_000_000, True))
def sections_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.merge_spans(spans(spark, sf_dir), ["user_id"], "s", "e", 3_600_000_000, strict=True)


@query("""WITH m AS (SELECT event_id, value, greatest(coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0), 1) AS m FROM events)
SELECT event_id FROM m WHERE value >= 18 AND (value >= 95 OR value >= 3 * m)""")
def cut_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.cut_candidates(samples(spark, sf_dir), ["user_id"], ["us", "event_id"], "value", sure=95).select("event_id")


_CANDIDATES = """m AS (SELECT user_id, event_id, epoch_us(ts) AS us, value, greatest(coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0), 1) AS m FROM events),
c AS (SELECT DISTINCT user_id, us FROM m WHERE value >= 18 AND (value >= 95 OR value >= 3 * m)), o AS (SELECT user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM c)"""


@query(f"""WITH RECURSIVE {_CANDIDATES}, r AS (SELECT user_id, us, i, us AS kept FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.us, o.i, CASE WHEN o.us - r.kept >= 21600000000 THEN o.us ELSE r.kept END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT DISTINCT user_id, kept AS us FROM r""")
def cuts_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.cut_candidates(samples(spark, sf_dir), ["user_id"], ["us", "event_id"], "value", sure=95)
    return Q.min_gap(rows, ["user_id"], "us", 6 * 3600 * 1_000_000)


@query()
def hamming_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Q.simhash(load(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", "code")
    return Q.hamming_thin(docs, ["source"], "doc_id", "code").select("doc_id", "source")


@query("SELECT event_id, epoch_us(ts) AS start_us, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), epoch_us(ts) + 60000000) AS end_us FROM events")
def lead_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return samples(spark, sf_dir).select("event_id", F.col("us").alias("start_us"), F.coalesce(F.lead("us").over(w), F.col("us") + 60000000).alias("end_us"))


@query("SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS at FROM lineitem")
def cumulative_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0)).alias("at"))


@query("SELECT user_id, (epoch_us(ts) // 21600000000)::BIGINT AS bucket, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL")
def tumbling_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / 21600000000).alias("bucket")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, (epoch_us(ts) // 86400000000)::BIGINT AS day, round(10 * log10(avg(pow(10.0::DOUBLE, value / 10))), 6) AS level FROM events GROUP BY ALL")
def energy_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / 86400000000).alias("day")).agg(F.round(10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("value") / 10))), 6).alias("level"))


@query("""SELECT event_id, round((lead(value) OVER w - lag(value) OVER w) / ((lead(epoch_us(ts)) OVER w - lag(epoch_us(ts)) OVER w) / 1000000.0::DOUBLE), 6) AS rate FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def central_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    span = (F.lead("us").over(w) - F.lag("us").over(w)) / 1e6
    return samples(spark, sf_dir).select("event_id", F.round(F.when(span != 0, (F.lead("value").over(w) - F.lag("value").over(w)) / span), 6).alias("rate"))


@query("""WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS us, value, lag(value) OVER w AS v0, lag(epoch_us(ts)) OVER w AS u0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round(u0 + (50.0::DOUBLE - v0) / (value - v0) * (us - u0), 0)::BIGINT AS crossing_us FROM p WHERE (v0 < 50 AND value >= 50) OR (v0 >= 50 AND value < 50)""")
def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = St.crossing_times(samples(spark, sf_dir), ["user_id"], ["us", "event_id"], "us", "value", 50.0, "at")
    return rows.select("user_id", "event_id", F.round("at", 0).cast("long").alias("crossing_us"))


@query("""WITH m AS (SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n, epoch_us(ts) AS us FROM events)
SELECT user_id, event_id, mean FROM m WHERE n = 10 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY mean DESC, us, event_id) = 1""")
def best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return St.best_run(samples(spark, sf_dir), ["user_id"], ["us", "event_id"], "value", 10).select("user_id", "event_id", "mean")


@query("""WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT DISTINCT user_id, (round_even(j * (n - 1) / 4.0::DOUBLE, 0))::BIGINT AS i FROM x, (SELECT unnest([0, 1, 2, 3, 4]) AS j)) SELECT x.user_id, x.event_id FROM x JOIN k ON k.user_id = x.user_id AND k.i = x.i""")
def even_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows a key, evenly spread, first and last included."""
    return St.evenly(samples(spark, sf_dir), ["user_id"], ["us", "event_id"], 5, ends=True).select("user_id", "event_id")


@query()
def transcript_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 10.0).alias("s"), (F.col("turn") * 10.0 + 9.0).alias("e"), "text")
    return Q.text_windows(turns, ["conv_id"], "s", "e", "text")


@query()
def chapters_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("size"))
    return Q.segment_optimally(turns, ["conv_id"], "turn", "size", parts=3)

"""Queries of the event log: tail, coalescing, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import load, query


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 200")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where("event_id > 100").orderBy("event_id").limit(200).select("event_id", "user_id", "event_type")


@query("SELECT user_id, (epoch_us(ts) // 3600000000)::BIGINT AS slot, max(event_id) AS event_id, count(*) AS merged FROM events GROUP BY ALL")
def progress_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000)
    return load(spark, sf_dir, "events").groupBy("user_id", slot.alias("slot")).agg(F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("merged"))


@query("""WITH f AS (SELECT user_id, event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT event_type AS state, count(*) AS users FROM f GROUP BY event_type""")
def status_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = R.latest(load(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.groupBy(F.col("event_type").alias("state")).agg(F.count(F.lit(1)).alias("users"))


@query("SELECT count(*) AS n, max(event_id) AS last FROM events")
def cache_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))

"""The event log as a stream: tail, latest progress, windows with late data, incremental index keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_key


def tail(spark: SparkSession, folder: str, schema: str, after: int = -1, files: int = 8) -> DataFrame:
    """Events that arrive in a folder, beyond a cursor; the checkpoint keeps the place between runs."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).where(F.col("event_id") > after)


def windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means a window and type; rows later than the watermark are dropped, windows are given once closed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def latest_progress(events: DataFrame) -> DataFrame:
    """The last event of each user so far (complete or update mode)."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("last")).select("user_id", "last.*")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark, for senders that repeat themselves."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def changed(batch: DataFrame, known: DataFrame, key: str, *parts: str) -> DataFrame:
    """Rows of a batch whose content key is not the known one (key, content)."""
    marked = batch.withColumn("content", content_key(*[F.col(p) for p in parts]))
    return marked.join(known.select(key, F.col("content").alias("__known")), key, "left").where(~F.col("content").eqNullSafe(F.col("__known"))).drop("__known")


def run_once(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Everything that is there now, batch by batch, exactly once by batch id."""
    query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

"""Writers: partition replacement, upsert, pruning, subtitle and CSV text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock, csv_field


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces exactly the partitions that df holds rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows with new ones in their place or added: a full outer join on the keys, new values first."""
    joined = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    there = F.lit(False)
    for k in keys:
        there = there | F.col(f"n.{k}").isNotNull()
    return joined.select(*[F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns])


def pruned(log: DataFrame, key: str, keep: int) -> DataFrame:
    """The last `keep` rows by key; the bound is found by a heap of `keep` ids."""
    low = log.select(key).orderBy(F.desc(key)).limit(keep).agg(F.min(key).alias("__low"))
    return log.join(F.broadcast(low)).where(F.col(key) >= F.col("__low")).drop("__low")


def srt(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, document): numbered subtitle text of each key; one key's cues are one file and so one value."""
    stamp = lambda c: F.replace(clock(F.col(c)), F.lit("."), F.lit(","))
    numbered = cues.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("start_s", "end_s")))
    block = F.concat(F.col("__n").cast("string"), F.lit("\n"), stamp("start_s"), F.lit(" --> "), stamp("end_s"), F.lit("\n"), F.replace(F.col("text"), F.lit("-->"), F.lit("->")))
    return numbered.groupBy(*keys).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", block.alias("b")))), lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("document"))


def csv_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One guarded line a row: ; as separator, decimal commas, yes and no."""
    def field(name: str) -> Column:
        kind = df.schema[name].dataType.simpleString()
        c = F.col(name)
        if kind == "boolean":
            return F.when(c, "yes").when(~c, "no").otherwise("")
        if kind in ("double", "float") or kind.startswith("decimal"):
            return F.coalesce(F.replace(c.cast("string"), F.lit("."), F.lit(",")), F.lit(""))
        return F.coalesce(csv_field(c.cast("string")), F.lit(""))

    return df.select(F.concat_ws(";", *[field(c) for c in columns]).alias("value"))



def replace_if_present(df: DataFrame, path: str, by: Sequence[str], parent: str) -> DataFrame:
    """Replaces the sub-partitions of df whose parent is in the table already; returns the rows that were written."""
    there = df.sparkSession.read.parquet(path).select(parent).distinct()
    kept = df.join(there, parent, "left_semi")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return kept


def updated(base: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Rows of base with the columns of values (key, ...) in place of their own where values has the key."""
    names = [c for c in values.columns if c != key]
    marked = values.select(key, *[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("__there"))
    joined = base.join(marked, key, "left")
    return joined.select(*[F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in base.columns])


def webvtt(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, document): WebVTT text of each key's cues."""
    stamp = lambda c: clock(F.col(c))
    safe = F.replace(F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("-->"), F.lit("->")), F.lit("\n\n"), F.lit("\n"))
    block = F.concat(stamp("start_s"), F.lit(" --> "), stamp("end_s"), F.lit("\n"), safe)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "end_s", block.alias("b")))), lambda x: x["b"]), "\n\n")
    return cues.groupBy(*keys).agg(F.concat(F.lit("WEBVTT\n\n"), text, F.lit("\n")).alias("document"))


def timeline_documents(clips: DataFrame, key: str, fps: float) -> DataFrame:
    """(key, document): clips (key, place, file, start, end) as OpenTimelineIO JSON, one track in order of place."""
    span = lambda a, n: F.struct(F.lit("TimeRange.1").alias("OTIO_SCHEMA"), F.struct(F.lit("RationalTime.1").alias("OTIO_SCHEMA"), F.lit(fps).alias("rate"), a.cast("double").alias("value")).alias("start_time"), F.struct(F.lit("RationalTime.1").alias("OTIO_SCHEMA"), F.lit(fps).alias("rate"), n.cast("double").alias("value")).alias("duration"))
    media = F.struct(F.lit("ExternalReference.1").alias("OTIO_SCHEMA"), F.col("file").alias("target_url"))
    clip = F.struct(F.col("place"), F.struct(F.lit("Clip.2").alias("OTIO_SCHEMA"), F.regexp_extract("file", "([^/]+)$", 1).alias("name"), span(F.col("start"), F.col("end") - F.col("start")).alias("source_range"), media.alias("media_reference")).alias("clip"))
    rows = clips.groupBy(key).agg(F.array_sort(F.collect_list(clip)).alias("all"))
    track = F.struct(F.lit("Track.1").alias("OTIO_SCHEMA"), F.lit("Video").alias("kind"), F.transform("all", lambda x: x["clip"]).alias("children"))
    stack = F.struct(F.lit("Stack.1").alias("OTIO_SCHEMA"), F.array(track).alias("children"))
    return rows.select(key, F.to_json(F.struct(F.lit("Timeline.1").alias("OTIO_SCHEMA"), F.col(key).cast("string").alias("name"), stack.alias("tracks"))).alias("document"))


def packed_vectors(df: DataFrame, vector: str) -> DataFrame:
    """df with its vectors (array of floats) as little-endian bytes, four a component; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(vector)
            blobs = [None if v is None else np.asarray(v, "<f4").tobytes() for v in batch.column(i).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()) if j == i else c for j, c in enumerate(batch.columns)], batch.schema.names)

    schema = df.withColumn(vector, F.lit(None).cast("binary")).schema
    return df.mapInArrow(run, schema)


def unpacked_vectors(df: DataFrame, vector: str) -> DataFrame:
    """df with packed vectors as arrays of floats again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(vector)
            lists = [None if b is None else np.frombuffer(b, "<f4").tolist() for b in batch.column(i).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.float32())) if j == i else c for j, c in enumerate(batch.columns)], batch.schema.names)

    schema = df.withColumn(vector, F.lit(None).cast("array<float>")).schema
    return df.mapInArrow(run, schema)

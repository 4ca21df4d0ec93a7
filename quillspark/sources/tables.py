"""Readers: tables, media facts, telemetry, nested time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"no table {name}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a primary key; raises if there is none."""
    found = df.where(F.col(key) == value).limit(1)
    if found.isEmpty():
        raise LookupError(f"{key} = {value}")
    return found


def media_files(spark: SparkSession, root: str, extensions: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    """(path, modificationTime, length) of files below root; hidden folders and paths that match an exclusion are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]) & ~F.col("path").rlike(r"/\.[^/]+/"))
    for pattern in excluded:
        files = files.where(~F.col("path").rlike(pattern))
    return files


def frame_rate(text: Column) -> Column:
    """30000/1001 or 25 as a number; null for none or a zero denominator."""
    top, bottom = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)", 1), F.regexp_extract(text, r"/(\d+)$", 1)
    low = F.when(bottom == "", F.lit(1.0)).otherwise(F.expr("cast(1.0 as double)") * F.try_to_number(F.when(bottom == "", F.lit("1")).otherwise(bottom), F.lit("999999999")).cast("double"))
    return F.when((top != "") & (low != 0), top.cast("double") / low)


def probe(spark: SparkSession, path: str) -> DataFrame:
    """Container facts of probe JSON documents, one a line: numbers arrive as strings."""
    schema = "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,tags:map<string,string>>>, format struct<filename:string,duration:string,size:string>"
    raw = spark.read.schema(schema).json(path)
    video = F.get(F.filter("streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    rate, nominal = frame_rate(video["avg_frame_rate"]), frame_rate(video["r_frame_rate"])
    return raw.select(F.col("format.filename").alias("filename"), F.col("format.duration").cast("double").alias("duration_s"), F.col("format.size").cast("long").alias("size_bytes"), video["width"].alias("width"), video["height"].alias("height"), rate.alias("fps"), (F.abs(rate - nominal) > 0.01 * nominal).alias("variable_rate"), F.exists("streams", lambda s: s["codec_type"] == "audio").alias("has_audio"))


def hourly_series(spark: SparkSession, path: str) -> DataFrame:
    """(latitude, longitude, hour, temperature, weather_code, cloud_cover) of weather JSON with parallel arrays."""
    schema = "latitude double, longitude double, hourly struct<time:array<string>,temperature_2m:array<double>,weather_code:array<int>,cloud_cover:array<double>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"), F.col("hourly.temperature_2m").alias("temperature"), F.col("hourly.weather_code").alias("weather_code"), F.col("hourly.cloud_cover").alias("cloud_cover"))
    return raw.select("latitude", "longitude", F.inline(zipped)).withColumn("hour", F.to_timestamp("time")).drop("time")


def track_points(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon, elevation, time) of GPX files."""
    raw = spark.read.format("xml").option("rowTag", "trkpt").schema("_lat double, _lon double, ele double, time string").load(path)
    return raw.select(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.col("ele").alias("elevation"), F.to_timestamp("time").alias("time"))


def subtitle_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, start_s, end_s, text) of SRT files, one block a record."""
    raw = spark.read.option("lineSep", "\n\n").text(path).select(F.input_file_name().alias("file"), F.btrim(F.regexp_replace("value", "\r", ""), F.lit(" \n")).alias("block")).where("block <> ''")
    pattern = r"(?s)^(\d+)\n(\d+):(\d+):(\d+)[,.](\d+) --> (\d+):(\d+):(\d+)[,.](\d+)\n?(.*)$"
    part = lambda i: F.regexp_extract("block", pattern, i)
    seconds = lambda i: part(i).cast("int") * 3600 + part(i + 1).cast("int") * 60 + part(i + 2).cast("int") + part(i + 3).cast("int") / 1000
    return raw.where(F.col("block").rlike(pattern)).select("file", part(1).cast("int").alias("idx"), seconds(2).alias("start_s"), seconds(6).alias("end_s"), part(10).alias("text"))

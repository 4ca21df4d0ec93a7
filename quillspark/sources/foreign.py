"""Readers of foreign files: listings, metadata, telemetry, gazetteers, class maps, logs, analysis documents, timelines.

Whole-file readers take a file a task; a file is as large as a sidecar, log or listing is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
SAMPLE = 4 << 20
SNIFF = 65_536
EXIF_DATE = r"^\s*(\d{4})[:-](\d{2})[:-](\d{2})[ T](\d{2}):(\d{2}):(\d{2})(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?\s*$"


def listed_files(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """(path, modificationTime, length) of the named files of one folder, whatever the case of their names.

    Spark's file source lists no files without bytes.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "modificationTime", "length")
    return files.where(F.lower(F.regexp_extract("path", "([^/]+)$", 1)).isin([n.lower() for n in names]))


def fingerprint(content: Column, length: Column, sample: int = SAMPLE) -> Column:
    """A hash of a file's length and of three samples of it: start, middle and end."""
    middle = F.greatest(F.lit(0), F.floor(length / 2) - sample // 2).cast("int")
    last = F.greatest(F.lit(0), length - sample).cast("int")
    return F.xxhash64(length, F.substr(content, F.lit(1), F.lit(sample)), F.substr(content, middle + 1, F.lit(sample)), F.substr(content, last + 1, F.lit(sample)))


def set_aside(length: Column, modified: Column, now: Column, settle_s: int = 10) -> Column:
    """Why a file is not taken yet: empty, growing or future; null if it is."""
    age = now.cast("double") - modified.cast("double")
    return F.when(length == 0, "empty").when(age < -86400, "future").when(age < settle_s, "growing")


def exif_date(value: Column) -> Column:
    """struct(local, offset_min): '2025:07:14 18:32:10+02:00' and the like; null where it is no date."""
    part = lambda i: F.regexp_extract(value, EXIF_DATE, i)
    local = F.try_to_timestamp(F.concat(F.concat_ws("-", part(1), part(2), part(3)), F.lit(" "), F.concat_ws(":", part(4), part(5), part(6))), F.lit("yyyy-MM-dd HH:mm:ss"))
    zone = F.replace(part(8), F.lit(":"), F.lit(""))
    minutes = F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")
    offset = F.when(zone == "Z", 0).when(zone != "", F.when(zone.startswith("-"), -minutes).otherwise(minutes))
    return F.when(value.rlike(EXIF_DATE) & local.isNotNull(), F.struct(local.alias("local"), offset.cast("int").alias("offset_min")))


def first_tag(tags: Column, suffixes: Sequence[str]) -> Column:
    """The value of the first tag whose name after the group is one of the suffixes, in their order."""
    found = [F.get(F.transform(F.filter(F.map_entries(tags), _ends(s)), lambda e: e["value"]), F.lit(0)) for s in suffixes]
    return F.coalesce(*found)


def _ends(suffix: str):  # noqa: ANN202
    return lambda e: F.element_at(F.split(e["key"], ":"), -1) == suffix


def exif(spark: SparkSession, path: str, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """A row a JSON line of tags: for each field the first of its tags that is there, as text."""
    raw = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("tags"))
    return raw.select(*[first_tag(F.col("tags"), tags).alias(name) for name, tags in fields.items()])


def exif_track(spark: SparkSession, path: str) -> DataFrame:
    """(source, i, lat, lon, time) of timed samples 'Doc<n>:GPSLatitude' and so on in JSON lines of tags."""
    raw = spark.read.text(path).select(F.xxhash64("value").alias("source"), F.explode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("e"))
    parts = F.split("e.key", ":")
    rows = raw.where(F.col("e.key").rlike(r"^Doc\d+:GPS")).select("source", F.regexp_extract("e.key", r"^Doc(\d+):", 1).cast("int").alias("i"), F.element_at(parts, -1).alias("tag"), F.col("e.value").alias("v"))
    value = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("v")))
    track = rows.groupBy("source", "i").agg(value("GPSLatitude").cast("double").alias("lat"), value("GPSLongitude").cast("double").alias("lon"), value("GPSDateTime").alias("time"))
    return track.where("lat is not null and lon is not null")


def is_telemetry(content: Column) -> Column:
    """Does a subtitle file hold flight telemetry? Its beginning tells."""
    head = F.decode(F.substr(content, F.lit(1), F.lit(SNIFF)), "UTF-8")
    return head.rlike(r"(?i)(\[latitude\s*:|GPS\s*\(|\blatitude\b.*\blongitude\b|FrameCnt)")


def flight_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, start_s, lat, lon, iso, shutter) of telemetry subtitles; blocks without a position, or at (0, 0), are left out."""
    raw = spark.read.option("lineSep", "\n\n").text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r", "").alias("b"))
    number = lambda name: F.regexp_extract("b", rf"(?i){name}\s*:\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    clock = r"(\d+):(\d+):(\d+)[,.](\d+) -->"
    t = lambda i: F.regexp_extract("b", clock, i).try_cast("double")
    rows = raw.select("file", (t(1) * 3600 + t(2) * 60 + t(3) + t(4) / 1000).alias("start_s"), number("latitude").alias("lat"), number("longitude").alias("lon"), number("iso").alias("iso"), F.regexp_extract("b", r"(?i)shutter\s*:\s*1/(\d+(?:\.\d+)?)", 1).try_cast("double").alias("shutter"))
    return rows.where("lat is not null and lon is not null and not (lat = 0 and lon = 0)")


def upper_median(values: Column) -> Column:
    """The middle value, of an even count the upper one; an aggregate of one flight's settings."""
    return F.element_at(F.array_sort(F.collect_list(values)), (F.floor(F.count(values) / 2) + 1).cast("int"))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(name, lat, lon, country, area, zone) of tab-separated lines, compressed or not."""
    return spark.read.csv(path, sep="\t", quote="", schema="name string, lat double, lon double, country string, area int, zone string")


def build_gazetteer(dump: DataFrame, areas: DataFrame) -> DataFrame:
    """Lines of a gazetteer from a country dump (id, name, lat, lon, class, country, admin, population, zone) and area names (code, area_name).

    Inhabited places stay; areas are numbered in order of their code.
    """
    kept = dump.where((F.col("class") == "P") & (F.col("population") > 0))
    codes = kept.select(F.concat_ws(".", "country", "admin").alias("code")).distinct()
    numbered = codes.withColumn("area", F.dense_rank().over(Window.orderBy("code")) - 1).join(areas, "code", "left")
    return kept.withColumn("code", F.concat_ws(".", "country", "admin")).join(numbered, "code").select("name", "lat", "lon", "country", "area", "area_name", "zone")


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """(index, mid, name) of a class list; an error if the indexes are not 0, 1, 2 and so on."""
    rows = spark.read.csv(path, header=True, schema="index int, mid string, display_name string")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("index").alias("d"), F.max("index").alias("m"), F.min("index").alias("low")).first()
    if found["n"] and not (found["n"] == found["d"] == found["m"] + 1 and found["low"] == 0):
        raise ValueError(f"class map {path}: indexes are not contiguous")
    return rows.withColumnRenamed("display_name", "name")


def ontology_edges(spark: SparkSession, path: str) -> DataFrame:
    """(ancestor, class): direct edges of an ontology document."""
    raw = spark.read.schema("id string, child_ids array<string>").option("multiLine", True).json(path)
    return raw.select(F.col("id").alias("ancestor"), F.explode("child_ids").alias("class"))


def geocoded(payload: Column, lat: Column, lon: Column) -> Column:
    """struct(name, country, accepted): a reverse-geocoding answer; a natural feature counts within 1 km, or if its box of at most 5 km holds the point."""
    from ..functions.space import haversine_km

    doc = F.from_json(payload, "name string, category string, lat string, lon string, boundingbox array<string>, address map<string,string>")
    box = F.transform(doc["boundingbox"], lambda x: x.try_cast("double"))
    away = haversine_km(doc["lat"].try_cast("double"), doc["lon"].try_cast("double"), lat, lon)
    inside = (lat >= box[0]) & (lat <= box[1]) & (lon >= box[2]) & (lon <= box[3]) & (haversine_km(box[0], box[2], box[1], box[3]) <= 5)
    natural = doc["category"] == "natural"
    return F.when(doc.isNotNull() & (doc["name"].isNotNull() | doc["address"].isNotNull()), F.struct(doc["name"].alias("name"), doc["address"]["country"].alias("country"), (~natural | (away <= 1) | F.coalesce(inside, F.lit(False))).alias("accepted")))


def analysis_documents(spark: SparkSession, path: str, schema: str, version: int, defaults: Mapping[str, object]) -> DataFrame:
    """Rows of JSON analysis documents with `state`: ok, broken (no JSON), foreign (other kind) or outdated (other version).

    Fields that the schema does not name are ignored, those that are missing get their default.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"kind string, version int, {schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("d"))
    state = F.when(F.col("d").isNull() | F.col("d._bad").isNotNull(), "broken").when(F.coalesce("d.kind", F.lit("")) != "analysis", "foreign").when(F.col("d.version") != version, "outdated").otherwise("ok")
    names = [x.split()[0].strip() for x in schema.split(",") if " " in x.strip()]
    return raw.select("file", state.alias("state"), *[F.coalesce(F.col(f"d.{n}"), F.lit(defaults[n])).alias(n) if n in defaults else F.col(f"d.{n}") for n in names])


def loudness(spark: SparkSession, path: str) -> DataFrame:
    """(file, t, level) of a loudness log, a line a measure; 'nan' and '-inf' are silence (-120.7)."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    pattern = r"t:\s*(\d+(?:\.\d+)?)\s.*\bM:\s*(-?\d+(?:\.\d+)?|nan|-?inf)"
    found = lines.where(F.col("value").rlike(pattern))
    value = F.regexp_extract("value", pattern, 2)
    return found.select("file", F.regexp_extract("value", pattern, 1).cast("double").alias("t"), F.when(value.rlike("nan|inf"), -120.7).otherwise(value.try_cast("double")).alias("level"))


def silences(spark: SparkSession, path: str, duration: float) -> DataFrame:
    """(file, start, end) of the silences that a log tells of; one that does not end lasts to the end of the recording."""
    doc = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    marks = F.regexp_extract_all("value", F.lit(r"silence_(start|end):\s*-?\d+(?:\.\d+)?"), 0)
    each = doc.select("file", F.posexplode(marks).alias("i", "m")).select("file", "i", F.col("m").startswith("silence_start").alias("begins"), F.regexp_extract("m", r"(-?\d+(?:\.\d+)?)$", 1).cast("double").alias("t"))
    w = Window.partitionBy("file").orderBy("i")
    return each.withColumn("next", F.lead("t").over(w)).where("begins").select("file", F.greatest(F.lit(0.0), F.col("t")).alias("start"), F.coalesce("next", F.lit(duration)).alias("end"))


def timeline_clips(spark: SparkSession, path: str) -> DataFrame:
    """(timeline, track, kind, file, start, end) of editor timelines as JSON documents."""
    schema = "name string, tracks array<struct<index:int,kind:string,clips:array<struct<file:string,start:long,end:long>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    tracks = raw.select(F.col("name").alias("timeline"), F.explode("tracks").alias("t")).select("timeline", F.col("t.index").alias("track"), F.col("t.kind").alias("kind"), F.explode("t.clips").alias("c"))
    return tracks.select("timeline", "track", "kind", "c.file", "c.start", "c.end")

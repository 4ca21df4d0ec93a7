"""Foreign files and exports on small fixtures."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import foreign, sinks


def test_listings(spark, tmp_path):
    for name, size in (("A.MP4", 3000), ("b.mp4", 0), ("c.txt", 5)):
        (tmp_path / name).write_bytes(bytes(i % 251 for i in range(size)))
    files = foreign.listed_files(spark, str(tmp_path), ["a.mp4", "B.mp4"])
    assert sorted(r["length"] for r in files.collect()) == [3000]
    raw = spark.read.format("binaryFile").load(str(tmp_path)).select("path", foreign.fingerprint(F.col("content"), F.col("length"), 16).alias("f"))
    assert len({r["f"] for r in raw.collect()}) == 2
    rows = spark.createDataFrame([(0, 100), (5, 95), (5, 50), (5, 200_000)], "length long, at long")
    now = F.timestamp_seconds(F.lit(100))
    assert [r[0] for r in rows.select(foreign.set_aside(F.col("length"), F.timestamp_seconds("at"), now)).collect()] == ["empty", "growing", None, "future"]


def test_metadata(spark, tmp_path):
    tags = {"QuickTime:CreateDate": "2025:07:14 18:32:10", "Keys:CreationDate": "2025:07:14 20:32:10+02:00", "EXIF:Make": "Maker", "Doc1:GPSLatitude": "48.5", "Doc1:GPSLongitude": "2.5", "Doc2:GPSLatitude": "49"}
    (tmp_path / "e.json").write_text(json.dumps(tags))
    row = foreign.exif(spark, str(tmp_path / "e.json"), {"date": ["CreationDate", "CreateDate"], "make": ["Make"], "model": ["Model"]}).first()
    assert (row["date"], row["make"], row["model"]) == ("2025:07:14 20:32:10+02:00", "Maker", None)
    track = foreign.exif_track(spark, str(tmp_path / "e.json")).collect()
    assert [(r["i"], r["lat"], r["lon"]) for r in track] == [(1, 48.5, 2.5)]
    got = spark.createDataFrame([("2025:07:14 18:32:10+02:00",), ("2025-07-14T18:32:10Z",), ("2025:07:14 18:32:10",), ("2025:02:31 00:00:00",), ("x",)], "d string").select(foreign.exif_date(F.col("d")).alias("x")).collect()
    assert [None if r["x"] is None else r["x"]["offset_min"] for r in got] == [120, 0, None, None, None] and [r["x"] is None for r in got] == [False, False, False, True, True]


def test_telemetry(spark, tmp_path):
    (tmp_path / "d.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\n[iso : 100] [shutter : 1/50.0] [latitude: 48.5] [longitude: 2.25]\n\n2\n00:00:01,000 --> 00:00:02,000\n[iso : 200] [latitude: 0] [longitude: 0]\n\n3\n00:00:02,500 --> 00:00:03,000\n[iso : 400] [shutter : 1/100] [latitude: -48.6] [longitude: 2.26]\n")
    rows = foreign.flight_log(spark, str(tmp_path / "d.srt"))
    assert sorted((r["start_s"], r["lat"], r["iso"], r["shutter"]) for r in rows.collect()) == [(0.0, 48.5, 100.0, 50.0), (2.5, -48.6, 400.0, 100.0)]
    assert rows.agg(foreign.upper_median(F.col("iso")).alias("m")).first()["m"] == 400.0
    flags = spark.read.format("binaryFile").load(str(tmp_path)).select(foreign.is_telemetry(F.col("content")).alias("t")).collect()
    assert [r["t"] for r in flags] == [True]


def test_gazetteer(spark, tmp_path):
    with gzip.open(tmp_path / "g.tsv.gz", "wt") as f:
        f.write('Paris\t48.85\t2.35\tFR\t0\tEurope/Paris\n"Odd\t1\t2\tXX\t1\tUTC\n')
    assert sorted(r["name"] for r in foreign.gazetteer(spark, str(tmp_path / "g.tsv.gz")).collect()) == ['"Odd', "Paris"]
    dump = spark.createDataFrame([(1, "A", 1.0, 1.0, "P", "FR", "11", 5, "z"), (2, "B", 1.0, 1.0, "P", "FR", "10", 5, "z"), (3, "C", 1.0, 1.0, "H", "FR", "10", 5, "z"), (4, "D", 1.0, 1.0, "P", "FR", "10", 0, "z")], "id int, name string, lat double, lon double, class string, country string, admin string, population int, zone string")
    built = foreign.build_gazetteer(dump, spark.createDataFrame([("FR.11", "Region")], "code string, area_name string")).collect()
    assert sorted((r["name"], r["area"], r["area_name"]) for r in built) == [("A", 1, "Region"), ("B", 0, None)]


def test_class_maps(spark, tmp_path):
    (tmp_path / "c.csv").write_text("index,mid,display_name\n0,/m/a,Speech\n1,/m/b,\"Bark, dog\"\n")
    assert [r["name"] for r in foreign.class_map(spark, str(tmp_path / "c.csv")).orderBy("index").collect()] == ["Speech", "Bark, dog"]
    (tmp_path / "bad.csv").write_text("index,mid,display_name\n0,/m/a,Speech\n2,/m/b,x\n")
    with pytest.raises(ValueError, match="contiguous"):
        foreign.class_map(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "o.json").write_text(json.dumps([{"id": "a", "child_ids": ["b", "c"]}, {"id": "b", "child_ids": []}]))
    assert sorted((r["ancestor"], r["class"]) for r in foreign.ontology_edges(spark, str(tmp_path / "o.json")).collect()) == [("a", "b"), ("a", "c")]


def test_places(spark):
    lake = {"name": "Lake", "category": "natural", "lat": "48.0", "lon": "2.0", "boundingbox": ["47.99", "48.02", "1.99", "2.02"], "address": {"country": "France"}}
    rows = [(json.dumps(lake), 48.001, 2.0), (json.dumps(lake), 48.015, 2.015), (json.dumps(lake), 48.2, 2.0), (json.dumps(lake | {"category": "place"}), 48.2, 2.0), ("no json", 0.0, 0.0)]
    got = spark.createDataFrame(rows, "p string, lat double, lon double").select(foreign.geocoded(F.col("p"), F.col("lat"), F.col("lon")).alias("g")).collect()
    assert [None if r["g"] is None else r["g"]["accepted"] for r in got] == [True, True, False, True, None]


def test_documents(spark, tmp_path):
    docs = {"a": {"kind": "analysis", "version": 2, "title": "T", "extra": 1}, "b": {"kind": "analysis", "version": 1, "title": "U"}, "c": {"kind": "other"}, "e": {"kind": "analysis", "version": 2, "n": 5}}
    for name, d in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d))
    (tmp_path / "d.json").write_text("{broken")
    got = {r["file"].rsplit("/", 1)[1][0]: (r["state"], r["title"], r["n"]) for r in foreign.analysis_documents(spark, str(tmp_path), "title string, n int", 2, {"n": 7}).collect()}
    assert got == {"a": ("ok", "T", 7), "b": ("outdated", "U", 7), "c": ("foreign", None, 7), "d": ("broken", None, 7), "e": ("ok", None, 5)}


def test_logs_and_timelines(spark, tmp_path):
    (tmp_path / "l.log").write_text("[x] t: 0.4  TARGET:-23 LUFS  M: -20.5 S: -21\n[x] t: 0.5  M: nan S:1\nsilence_start: -0.1\nsilence_end: 2.5 | d\nsilence_start: 8\n")
    assert sorted((r["t"], r["level"]) for r in foreign.loudness(spark, str(tmp_path / "l.log")).collect()) == [(0.4, -20.5), (0.5, -120.7)]
    assert sorted((r["start"], r["end"]) for r in foreign.silences(spark, str(tmp_path / "l.log"), 10.0).collect()) == [(0.0, 2.5), (8.0, 10.0)]
    (tmp_path / "t.json").write_text(json.dumps({"name": "T", "tracks": [{"index": 1, "kind": "video", "clips": [{"file": "/a/x.mp4", "start": 10, "end": 20}]}, {"index": 2, "kind": "audio", "clips": []}]}))
    clips = foreign.timeline_clips(spark, str(tmp_path / "t.json"))
    assert [tuple(r) for r in clips.collect()] == [("T", 1, "video", "/a/x.mp4", 10, 20)]
    doc = json.loads(sinks.timeline_documents(clips.withColumn("place", F.lit(1)), "timeline", 25.0).first()["document"])
    child = doc["tracks"]["children"][0]["children"][0]
    assert child["name"] == "x.mp4" and child["source_range"]["duration"]["value"] == 10.0 and doc["OTIO_SCHEMA"] == "Timeline.1"


def test_more_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda x: spark.createDataFrame(x, "v string, kind string, text string")
    rows([("a", "shot", "1"), ("a", "video", "2"), ("b", "video", "3")]).write.partitionBy("v", "kind").parquet(path)
    sinks.replace_if_present(rows([("a", "video", "new"), ("z", "video", "no")]), path, ["v", "kind"], "v")
    assert sorted((r["v"], r["kind"], r["text"]) for r in spark.read.parquet(path).collect()) == [("a", "shot", "1"), ("a", "video", "new"), ("b", "video", "3")]
    base, new = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, s string, n double"), spark.createDataFrame([(2, None)], "k int, n double")
    assert sorted(map(tuple, sinks.updated(base, new, "k").collect())) == [(1, "x", 1.0), (2, "y", None)]
    cues = spark.createDataFrame([("v", 1.0, 2.0, "a --> b & <c>"), ("v", 0.0, 1.0, "x")], "k string, start_s double, end_s double, text string")
    assert sinks.webvtt(cues, ["k"]).first()["document"] == "WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nx\n\n00:00:01.000 --> 00:00:02.000\na -> b &amp; &lt;c>\n"
    vectors = spark.createDataFrame([(1, [0.5, -2.0]), (2, None)], "k int, v array<float>")
    packed = sinks.packed_vectors(vectors, "v")
    assert bytes(packed.where("k = 1").first()["v"]) == b"\x00\x00\x00\x3f\x00\x00\x00\xc0"
    assert sorted(map(str, sinks.unpacked_vectors(packed, "v").collect())) == sorted(map(str, vectors.collect()))

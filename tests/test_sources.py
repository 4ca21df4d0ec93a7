import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import sinks, tables
from quillspark.streaming import log


def test_readers(spark, tmp_path, small):
    (tmp_path / "p.json").write_text(json.dumps({"streams": [{"codec_type": "video", "width": 1920, "height": 1080, "avg_frame_rate": "30000/1001", "r_frame_rate": "30000/1001"}, {"codec_type": "audio"}], "format": {"filename": "a.mp4", "duration": "12.5", "size": "100"}}))
    row = tables.probe(spark, str(tmp_path / "p.json")).first()
    assert (round(row["fps"], 3), row["has_audio"], row["variable_rate"], row["duration_s"]) == (29.97, True, False, 12.5)
    (tmp_path / "t.gpx").write_text('<gpx><trk><trkseg><trkpt lat="1.5" lon="2.5"><ele>10</ele><time>2024-01-01T00:00:00Z</time></trkpt></trkseg></trk></gpx>')
    assert tables.track_points(spark, str(tmp_path / "t.gpx")).first()["lat"] == 1.5
    (tmp_path / "s.srt").write_text("1\n00:00:01,500 --> 00:00:02,000\nhello\nthere\n\n2\n00:01:00,000 --> 00:01:01,000\nx\n")
    got = tables.subtitle_blocks(spark, str(tmp_path / "s.srt")).orderBy("idx").collect()
    assert [(r["idx"], r["start_s"], r["text"]) for r in got] == [(1, 1.5, "hello\nthere"), (2, 60.0, "x")]
    with pytest.raises(LookupError):
        tables.lookup(tables.table(spark, small, "region"), "r_regionkey", -1)
    with pytest.raises(KeyError):
        tables.table(spark, small, "nothing")


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted((r["k"], r["v"]) for r in sinks.upserted(old, new, ["k"]).collect()) == [(1, "a"), (2, None), (3, "c")]
    path = str(tmp_path / "t")
    sinks.replace_partitions(old, path, "k")
    sinks.replace_partitions(spark.createDataFrame([("z", 2)], "v string, k int"), path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "z")]
    assert sorted(r["id"] for r in sinks.pruned(spark.range(10), "id", 3).collect()) == [7, 8, 9]
    cues = spark.createDataFrame([("v", 1.0, 2.0, "a --> b"), ("v", 0.0, 1.0, "x")], "k string, start_s double, end_s double, text string")
    assert sinks.srt(cues, ["k"]).first()["document"] == "1\n00:00:00,000 --> 00:00:01,000\nx\n\n2\n00:00:01,000 --> 00:00:02,000\na -> b\n"
    assert sinks.csv_lines(spark.createDataFrame([("=1;2", 1.5, True)], "a string, b double, c boolean"), ["a", "b", "c"]).first()[0] == "\"'=1;2\";1,5;yes"


def test_stream(spark, tmp_path, small):
    events = tables.table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.write.parquet(src)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    log.run_once(log.latest_progress(log.tail(spark, src, schema)), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/{i}"), str(tmp_path / "c"))
    seen = {}
    for p in sorted((tmp_path / "out").iterdir(), key=lambda x: int(x.name)):
        seen |= {r["user_id"]: r["event_id"] for r in spark.read.parquet(str(p)).collect()}
    want = {r["user_id"]: r["e"] for r in events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert seen == want
    known = log.changed(events.limit(0), events.select("event_id").withColumn("content", F.lit("x")), "event_id", "value")
    assert known.count() == 0

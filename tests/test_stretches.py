"""Operators over stretches on a schema of their own, against plain values."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import stretches as St


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def trips(spark):
    return spark.createDataFrame([("a", 0, 5.0), ("a", 10, 15.0), ("a", 20, 9.0), ("a", 30, 20.0), ("b", 0, 1.0)], "car string, tick long, speed double")


def test_windows_over_one_key(spark) -> None:
    df = trips(spark)
    assert rows(St.low_before(df, ["car"], "tick", "speed", 10, 10.0, "slow"), "car", "tick", "slow") == [("a", 0, True), ("a", 10, True), ("a", 20, True), ("a", 30, True), ("b", 0, True)]
    assert rows(St.low_before(df, ["car"], "tick", "speed", 5, 10.0, "slow").where("not slow"), "car", "tick") == [("a", 10), ("a", 30)]
    assert rows(St.crossing_times(df, ["car"], ["tick"], "tick", "speed", 10.0, "when"), "car", "tick", "when") == [("a", 10, 5.0), ("a", 20, 10 + 10 * 5 / 6), ("a", 30, 20 + 10 / 11)]
    assert rows(St.best_run(df, ["car"], ["tick"], "speed", 2), "car", "tick", "mean") == [("a", 30, 14.5)]
    assert rows(St.evenly(df, ["car"], ["tick"], 2, ends=True), "car", "tick") == [("a", 0), ("a", 30), ("b", 0)]
    assert rows(St.evenly(df, ["car"], ["tick"], 2, ends=False), "car", "tick") == [("a", 0), ("a", 20), ("b", 0)]


def test_stretches_meet(spark) -> None:
    df = trips(spark)
    legs = spark.createDataFrame([("a", 5, "second"), ("a", 25, "third"), ("b", 1, "late")], "car string, since long, leg string")
    assert rows(St.in_force(df, legs, ["car"], "tick", "since", "leg").fillna("none"), "car", "tick", "leg") == [("a", 0, "none"), ("a", 10, "second"), ("a", 20, "second"), ("a", 30, "third"), ("b", 0, "none")]
    notes = spark.createDataFrame([("a", 1.0, 2.0, "hi"), ("a", 3.0, 4.0, "you"), ("a", 9.0, 12.0, "there")], "car string, f double, t double, word string")
    assert rows(St.said_in_blocks(notes, ["car"], "f", "t", ["f"], "word", 5.0), "car", "block", "said") == [("a", 0, "hi you"), ("a", 2, "there")]
    gaps = spark.createDataFrame([("a", 1.5, 1.5), ("a", 10.0, 11.0), ("b", 0.0, 99.0)], "car string, low double, high double")
    assert rows(St.middles_within(notes, gaps, ["car"], "f", "t", "low", "high", 2.0), "word") == [("hi",), ("there",)]
    spans = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 10, 20), ("a", 3, 15, 40)], "car string, piece long, s long, e long")
    days = spark.createDataFrame([("a", "x", 5, 12), ("a", "y", 50, 60)], "car string, day string, p long, q long")
    assert rows(St.contents(days, spans, ["car"], "day", ("p", "q"), "piece", ("s", "e"), 7), "car", "day", "last", "n") == [("a", "x", 2, 2)]
    groups = spark.createDataFrame([("a", 1, 3)], "car string, one long, other long")
    assert rows(St.group_times(groups, spans, ["car"], "one", "other", "piece", "s", "e"), "s", "e") == [(0, 40)]


def test_files_and_roots(spark) -> None:
    clips = spark.createDataFrame([("t", "x", 3, "V"), ("t", "x", 1, "A"), ("t", "y", 2, "A"), ("t", "y", 4, "A")], "line string, media string, at long, track string")
    assert rows(St.used_files(clips, "line", "media", "at", F.col("track") == "A"), "media", "place", "uses") == [("x", 1, 1), ("y", 2, 2)]
    files = spark.createDataFrame([(1, "/m/a/b/f"), (2, "/m/c/f"), (3, "/z/f")], "no long, where string")
    roots = spark.createDataFrame([("/m",), ("/m/a",), ("/m/a",)], "top string")
    assert rows(St.deepest_root(files, roots, "no", "where", "top"), "no", "top") == [(1, "/m/a"), (2, "/m")]
    ledger = spark.createDataFrame([(1, "h"), (2, "h"), (3, "h")], "no long, sent string")
    disk = spark.createDataFrame([(1, "h"), (2, "k")], "no long, has string")
    assert rows(St.ledger_actions(ledger, disk, "no", "sent", "has"), "no", "action") == [(1, "replace"), (2, "conflict"), (3, "create")]
    moved = spark.createDataFrame([("/lib/a", "f"), ("/library", "g"), ("/lib", "h")], "base string, tail string")
    assert rows(St.under_root(moved, "base", "tail", "/lib"), "base", "tail") == [("/lib", "a/f"), ("/lib", "h"), ("/library", "g")]
    scenes = spark.createDataFrame([("v", i, float(s), 30.0) for i, s in enumerate([5, 9, 9, 1, 2, 3, 4])], "film string, no long, worth double, secs double")
    assert rows(St.most_salient(scenes, ["film"], "worth", "no", "secs"), "no") == [(1,), (2,)]

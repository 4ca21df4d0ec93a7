"""Safe cuts: ranges of a video moved to shot edges and out of words, with separate edges for picture and sound.

Shots and words reach a range by sorts and bucketed joins; the rules are column expressions over the words and pauses of
the range's shots. Words are told apart by video, start and end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlaps
from .shots import SHIFT_COST, pauses

# Fixed values.
EDGE_SNAP_S, LEAST_RANGE_S, LEAST_CLIP_S, SOUND_REACH_S, WORD_PAD_S, SAME_S, SPEECH_EDGE_S, MAX_PAUSE_S = 0.5, 0.1, 2.0, 3.0, 0.08, 0.05, 0.15, 2.0


def shot_at(points: DataFrame, shots: DataFrame, keys: Sequence[str], at: str, name: str, closing: bool = False) -> DataFrame:
    """points with `name`, struct(s, e): the shot shown at a time; `closing`: the one that a range which ends there ends in.

    Before the first shot it is the first one; null in a video without shots. One sort of points and shots together.
    """
    shot = F.struct(F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"))
    own = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    left = points.select(*keys, F.col(at).cast("double").alias("__t"), F.lit(0 if closing else 1).alias("__side"), own.alias("__row"), F.lit(None).cast("struct<s:double,e:double>").alias("__shot"))
    right = shots.select(*keys, F.col("s").cast("double").alias("__t"), F.lit(1 if closing else 0).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), shot.alias("__shot"))
    video = Window.partitionBy(*keys)
    before = video.orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = left.unionByName(right).withColumn("__found", F.coalesce(F.last("__shot", ignorenulls=True).over(before), F.min("__shot").over(video)))
    return found.where(F.col("__row").isNotNull()).select("__row.*", F.col("__found").alias(name))


def to_shots(ranges: DataFrame, shots: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """ranges with __a and __b, an edge within EDGE_SNAP_S of a shot's edge moved there, and __low and __high, the limits of the shots they are in."""
    rows = shot_at(shot_at(ranges, shots, keys, start, "__first"), shots, keys, end, "__last", closing=True)
    into, rest = F.col(start) - F.col("__first.s"), F.col("__first.e") - F.col(start)
    a = F.when((into > 0) & (into <= EDGE_SNAP_S), F.col("__first.s")).when((rest > 0) & (rest <= EDGE_SNAP_S) & (F.col("__first.e") < F.col(end) - LEAST_RANGE_S), F.col("__first.e")).otherwise(F.col(start))
    rows = rows.withColumn("__a", a)
    left, over = F.col("__last.e") - F.col(end), F.col(end) - F.col("__last.s")
    b = F.when((left > 0) & (left <= EDGE_SNAP_S), F.col("__last.e")).when((over > 0) & (over <= EDGE_SNAP_S) & (F.col("__last.s") > F.col("__a") + LEAST_RANGE_S), F.col("__last.s")).otherwise(F.col(end))
    rows = rows.withColumn("__b", b).drop("__first", "__last")
    rows = shot_at(shot_at(rows, shots, keys, "__a", "__first"), shots, keys, "__b", "__last", closing=True)
    return rows.withColumns({"__low": F.coalesce("__first.s", F.lit(0.0)), "__high": F.coalesce("__last.e", F.greatest("duration", F.col(end)))}).drop("__first", "__last")


def cut_places(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, t, quality): pauses between words (s, e, text), and the places just before the first and after the last."""
    between = pauses(words, keys, "s", "e", "text")
    ends = words.groupBy(*keys).agg(F.min("s").alias("s"), F.max("e").alias("e"))
    outer = ends.select(*keys, F.explode(F.array(F.greatest(F.lit(0.0), F.col("s") - SPEECH_EDGE_S), F.col("e") + SPEECH_EDGE_S)).alias("t"), F.lit(MAX_PAUSE_S).alias("quality"))
    return between.select(*keys, "t", "quality").unionByName(outer)


def in_word(t: Column, pad: float) -> Column:
    return F.exists("__words", lambda w: (w["s"] - pad < t) & (t < w["e"] + pad))


def moved(t: Column, low: Column, high: Column) -> Column:
    """t where it clips no word; else the best place in [low, high], each second of the way costs SHIFT_COST; t where there is none."""
    near = F.filter("__places", lambda p: (low <= p["t"]) & (p["t"] <= high))
    best = F.array_max(F.transform(near, lambda p: F.struct((p["q"] - SHIFT_COST * F.abs(p["t"] - t)).alias("score"), p["t"].alias("t"))))
    return F.when(in_word(t, WORD_PAD_S), F.coalesce(best["t"], t)).otherwise(t)


def safe_cuts(ranges: DataFrame, shots: DataFrame, words: DataFrame, keys: Sequence[str], start: str, end: str, width: int = 30) -> DataFrame:
    """ranges (keys, start, end, duration, ...; unique rows) with picture_in, picture_out, sound_in, sound_out and clipped.

    shots: (keys, s, e), side by side; words: (keys, s, e, text). The picture stays within the shots of the range. An edge
    in a word goes to the best pause; beyond the shots only the sound goes on, SOUND_REACH_S at most. Picture and sound
    last LEAST_CLIP_S where the shots allow it. clipped: an edge of the sound is in a word still. Without words near, the edges
    are those of the shots or of the range.
    """
    rows = to_shots(ranges, shots, keys, start, end).withColumn("__id", F.xxhash64(*[F.col(f"`{c}`") for c in ranges.columns]))
    reach = rows.select(*keys, "__id", (F.col("__low") - SOUND_REACH_S - 1).alias("__from"), (F.col("__high") + SOUND_REACH_S + 1).alias("__to"))
    met = overlaps(reach, words.select(*keys, "s", "e"), keys, ("__from", "__to"), ("s", "e"), width)
    heard = met.groupBy("__id").agg(F.collect_list(F.struct(F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"))).alias("__words"))
    places = cut_places(words, keys).select(*keys, (F.col("t") - 1e-9).alias("s"), (F.col("t") + 1e-9).alias("e"), F.col("t"), "quality")
    near = overlaps(reach, places, keys, ("__from", "__to"), ("s", "e"), width)
    found = near.groupBy("__id").agg(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), F.col("quality").cast("double").alias("q"))).alias("__places"))
    none = lambda kind: F.array().cast(kind)
    rows = rows.join(heard, "__id", "left").join(found, "__id", "left").withColumns({"__words": F.coalesce("__words", none("array<struct<s:double,e:double>>")), "__places": F.coalesce("__places", none("array<struct<t:double,q:double>>"))})
    a, b, low, high = (F.col(c) for c in ("__a", "__b", "__low", "__high"))
    latest = F.least(a + SOUND_REACH_S, F.greatest(low, high - LEAST_CLIP_S))
    steps: list[tuple[str, Column]] = [
        ("sound_in", moved(a, F.greatest(F.lit(0.0), low - SOUND_REACH_S), latest)),
        ("sound_in", F.when((low - SAME_S < F.col("sound_in")) & (F.col("sound_in") < low) & ~in_word(low, 0.0), low).otherwise(F.col("sound_in"))),
        ("picture_in", F.least(F.greatest("sound_in", low), high)),
        ("sound_out", moved(b, F.greatest(F.col("sound_in") + LEAST_CLIP_S, F.least(F.col("picture_in") + LEAST_CLIP_S, high), b - SOUND_REACH_S), F.least(F.greatest(F.col("duration"), high), high + SOUND_REACH_S))),
        ("sound_out", F.when((high < F.col("sound_out")) & (F.col("sound_out") < high + SAME_S) & ~in_word(high, 0.0), high).otherwise(F.col("sound_out"))),
        ("picture_out", F.least(F.greatest("sound_out", F.col("picture_in")), high)),
        ("clipped", in_word(F.col("sound_in"), 0.0) | in_word(F.col("sound_out"), 0.0)),
    ]
    rows = reduce(lambda df, s: df.withColumn(*s), steps, rows)
    silent = F.size("__words") == 0
    plain = {"picture_in": a, "sound_in": a, "picture_out": b, "sound_out": b}
    return rows.select(*[F.col(f"`{c}`") for c in ranges.columns], *[F.when(silent, v).otherwise(F.col(n)).alias(n) for n, v in plain.items()], "clipped")

"""Sound scores over time: rows (video, frame, class, score) to segments, shares, labels, events and curves.

Frames of a video are one window partition, as long as one recording; all else is grouped by video and class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequences as Q

# Fixed values.
HOP_S, PATCH_S = 0.48, 0.96
MERGE_GAP_S, MIN_SEGMENT_S, EPS = 1.0, 0.95, 1e-9
EVENT_SCORE, EVENT_MIN_S, MAX_EVENTS = 0.5, 0.01, 12
LABEL_FLOOR, ENVIRONMENT_FLOOR, ISSUE_SCORE, ISSUE_SHARE = 0.10, 0.10, 0.30, 0.05
INSTRUMENT_SCORE, INSTRUMENT_MIN_S, COVER = 0.2, 0.95, 0.8


def cells(frames: DataFrame, video: str, frame: str, count: str, duration: str) -> DataFrame:
    """frames with the stretch (s, e) of the recording that each stands for: a hop around its centre, the ends stretched."""
    centre = HOP_S * F.col(frame) + PATCH_S / 2
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.col(duration), x))
    s = F.when(F.col(frame) == 0, 0.0).otherwise(clip(centre - HOP_S / 2))
    e = F.when(F.col(frame) == F.col(count) - 1, F.col(duration)).otherwise(clip(centre + HOP_S / 2))
    return frames.withColumns({"s": s, "e": e})


def window_cells(df: DataFrame, video: str, start: str, end: str, duration: str) -> DataFrame:
    """df with the stretch (s, e) of each window, cut halfway between the centres of neighbours."""
    w = Window.partitionBy(video).orderBy(start, end)
    centre = (F.col(start) + F.col(end)) / 2
    low, high = F.coalesce((F.lag(centre).over(w) + centre) / 2, F.lit(0.0)), F.coalesce((centre + F.lead(centre).over(w)) / 2, F.col(duration))
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.col(duration), x))
    return df.withColumns({"s": clip(low), "e": F.greatest(clip(low), clip(high))})


def category_scores(scores: DataFrame, classes: DataFrame) -> DataFrame:
    """(video, frame, category, score): the greatest score of the member classes; classes (class, category) is a small table."""
    return scores.join(classes, "class").groupBy("video", "frame", "category").agg(F.max("score").alias("score"))


def segments(marked: DataFrame, keys: list[str], state: str, least: float = MIN_SEGMENT_S, gap: float = MERGE_GAP_S) -> DataFrame:
    """(keys, s, e, first, last): stretches of true states (frame, s, e), merged over gaps, short ones dropped."""
    on = marked.where(F.col(state))
    w = Window.partitionBy(*keys).orderBy("frame")
    fresh = F.coalesce((F.col("s") - F.lag("e").over(w) > gap + EPS).cast("int"), F.lit(0))
    numbered = on.withColumn("__new", fresh).withColumn("__id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*keys, "__id").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    return runs.where(F.col("e") - F.col("s") >= least - EPS).drop("__id")


def smoothed(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The centred median of three of each key's scores, as `level`."""
    return Q.median3(scores, keys, ["frame"], "score", "level")


def in_segments(levels: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """levels with `held`: is the frame inside a segment. A segment gives each of its frames, so the join is an equi join."""
    frames = found.select(*keys, F.explode(F.sequence("first", "last")).alias("frame")).withColumn("held", F.lit(True))
    return levels.join(frames, [*keys, "frame"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def share(width: Column, duration: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.sum(width) / F.max(duration)), 4)


def presence(held: DataFrame, category: str = "category") -> DataFrame:
    """(video, category, share): how much of a recording each category is heard; several may be heard at once."""
    out = held.where("held").groupBy("video", category).agg(share(F.col("e") - F.col("s"), F.col("duration")).alias("share"))
    return out.where("share > 0")


def dominance(held: DataFrame, on: Column, order: Column, other: str) -> DataFrame:
    """(video, category, share): each frame goes to the held category with the greatest level against its threshold, else to `other`."""
    best = held.groupBy("video", "frame").agg(F.max_by("category", F.when(F.col("held"), F.struct((F.col("level") / on).alias("ratio"), -order))).alias("winner"), F.first("s").alias("s"), F.first("e").alias("e"), F.first("duration").alias("duration"))
    out = best.groupBy("video", F.coalesce("winner", F.lit(other)).alias("category")).agg(share(F.col("e") - F.col("s"), F.col("duration")).alias("share"))
    return out.where("share > 0")


def curve(levels: DataFrame, hz: int = 1) -> DataFrame:
    """(video, category, bin, value): the greatest level in each bin, in percent; a cell is in at most two bins."""
    bins = F.greatest(F.lit(1), F.ceil(F.col("duration") * hz - EPS))
    clip = lambda x: F.greatest(F.lit(0), F.least(bins - 1, x)).cast("long")
    ends = F.array_distinct(F.array(clip(F.floor(F.col("s") * hz)), clip(F.ceil(F.col("e") * hz - EPS) - 1)))
    each = levels.where("e > s").select("video", "category", F.explode(ends).alias("bin"), "level")
    return each.groupBy("video", "category", "bin").agg(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("level"))) * 100).cast("long").alias("value"))


def span_means(scores: DataFrame, spans: DataFrame) -> DataFrame:
    """(video, span, class, mean): scores of frames weighted by how long their patch meets the span (video, span, a, b).

    Spans meet frames by the bin of SPAN_BIN seconds that both touch, so only neighbours are joined. Sums are taken in order of
    frames, so that a mean is the same in each run.
    """
    width = 16 * PATCH_S
    a, b = HOP_S * F.col("frame"), HOP_S * F.col("frame") + PATCH_S
    near = scores.withColumn("bin", F.explode(F.sequence(F.floor(a / width), F.floor(b / width))))
    wide = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))))
    met = near.join(wide, ["video", "bin"]).withColumn("w", F.least(b, F.col("b")) - F.greatest(a, F.col("a"))).where("w > 0")
    once = met.where(F.col("bin") == F.floor(F.greatest(a, F.col("a")) / width))
    held = once.groupBy("video", "span", "class").agg(F.array_sort(F.collect_list(F.struct("frame", "w", "score"))).alias("held"))
    total = lambda part: F.aggregate("held", F.lit(0.0), lambda s, x: s + part(x))
    return held.select("video", "span", "class", (total(lambda x: x["w"] * x["score"]) / total(lambda x: x["w"])).alias("mean"))


def events(hot: DataFrame, parents: DataFrame) -> DataFrame:
    """(video, class, s, e, peak, mean): runs of frames (video, class, frame, s, e, score) at EVENT_SCORE or more.

    Those of a class that is an ancestor (ancestor, class in parents) of an event they overlap go; the MAX_EVENTS strongest stay.
    """
    keys = ["video", "class"]
    found = segments(hot.withColumn("on", F.col("score") >= EVENT_SCORE), keys, "on", EVENT_MIN_S)
    inside = found.select(*keys, "s", "e", F.explode(F.sequence("first", "last")).alias("frame"))
    full = inside.join(hot.select(*keys, "frame", "score"), [*keys, "frame"]).groupBy(*keys, "s", "e").agg(F.max("score").alias("peak"), F.avg("score").alias("mean"))
    below = full.join(parents, "class").select("video", F.col("ancestor").alias("class"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    hidden = full.join(below, keys).where("s2 < e AND s < e2").select(*keys, "s").distinct()
    kept = full.join(hidden, [*keys, "s"], "left_anti")
    w = Window.partitionBy("video").orderBy(F.desc("peak"), "s", "class")
    return kept.withColumn("r", F.row_number().over(w)).where(F.col("r") <= MAX_EVENTS).drop("r")


def heard_long(scores: DataFrame, parents: DataFrame, least: float = INSTRUMENT_SCORE, seconds: float = INSTRUMENT_MIN_S, cover: float = COVER) -> DataFrame:
    """(video, class, seconds, peak): classes heard at `least` for `seconds`; a family goes where a member is heard `cover` as long."""
    long = scores.groupBy("video", "class").agg(F.sum(F.when(F.col("score") >= least, F.col("e") - F.col("s")).otherwise(0.0)).alias("seconds"), F.max("score").alias("peak")).where(F.col("seconds") >= seconds - EPS)
    member = long.join(parents, "class").select("video", F.col("ancestor").alias("class"), F.col("seconds").alias("part"))
    covered = long.join(member, ["video", "class"]).where(F.col("part") >= cover * F.col("seconds")).select("video", "class").distinct()
    return long.join(covered, ["video", "class"], "left_anti")


def environment(scores: DataFrame, floor: float = ENVIRONMENT_FLOOR) -> DataFrame:
    """(video, environment): the class of the greatest mean over the recording, null below the floor."""
    means = scores.groupBy("video", "class").agg((F.sum((F.col("e") - F.col("s")) * F.col("score")) / F.max("duration")).alias("mean"))
    best = means.groupBy("video").agg(F.max(F.struct("mean", "class")).alias("best"))
    return best.select("video", F.when(F.col("best.mean") >= floor, F.col("best.class")).alias("environment"))


def issues(levels: DataFrame, tag: str = "tag") -> DataFrame:
    """(video, tag, share): how much of a recording a defect is heard, from ISSUE_SHARE on; the greatest of the classes of a tag."""
    each = levels.groupBy("video", "class", tag).agg((F.sum(F.when(F.col("level") >= ISSUE_SCORE, F.col("e") - F.col("s")).otherwise(0.0)) / F.max("duration")).alias("share")).where(F.col("share") >= ISSUE_SHARE)
    return each.groupBy("video", tag).agg(F.max(F.round(F.least(F.lit(1.0), F.col("share")), 4)).alias("share"))

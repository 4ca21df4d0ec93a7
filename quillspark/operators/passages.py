"""Search passages: texts composed within a budget, facets of a stretch, one table of all kinds; crops; capture times; coverage.

A passage stands for a video, a chapter, a shot, a frame or a stretch of speech. Frames meet stretches by video and
bucket of time, never by a cross join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
ROOM, SPEECH_MIN_S = 40, 1.0
AGREEMENT_S, STRONG_S = 30, 5


def shortened(text: Column, limit: Column) -> Column:
    """At most `limit` characters, cut at the last space of the second half, without trailing punctuation, with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    head = F.substring(flat, F.lit(1), limit - 1)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    end = F.when((F.instr(head, " ") > 0) & (space >= F.floor(limit / 2)), space).otherwise(limit - 1).cast("int")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, F.lit(1), end), "[ ,;:–—]+$", ""), F.lit("…")))


def composed(parts: Column, limit: int) -> Column:
    """Lines in order of importance while they fit; the first one that does not is shortened, if there is room left for it."""
    flat = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " "))), lambda p: p != "")
    state = lambda lines, room, done: F.struct(lines.alias("lines"), room.cast("int").alias("room"), done.alias("done"))

    def step(s: Column, p: Column) -> Column:
        fits = F.length(p) <= s["room"]
        added = state(F.array_append(s["lines"], p), s["room"] - F.length(p) - 1, F.lit(False))
        last = state(F.array_append(s["lines"], shortened(p, s["room"])), F.lit(0), F.lit(True))
        return F.when(s["done"] | (s["room"] < ROOM), state(s["lines"], s["room"], F.lit(True))).when(fits, added).otherwise(last)

    begin = state(F.array().cast("array<string>"), F.lit(limit), F.lit(False))
    return F.array_join(F.aggregate(flat, begin, step, lambda s: s["lines"]), "\n")


def facets(spans: DataFrame, frames: DataFrame, speech: DataFrame, shots: DataFrame, bucket: float) -> DataFrame:
    """spans (video, span, a, b) with kinds and weather of the frames in them, whether there is speech, and the best usability of the shots.

    frames: (video, t, kind, weather); speech: (video, s, e), not overlapping; shots: (video, s, e, usability). All are dealt
    to buckets of `bucket` seconds.
    """
    key = ["video", "span"]
    wide = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("a") / bucket), F.floor(F.col("b") / bucket))))
    inside = wide.join(frames.withColumn("__bin", F.floor(F.col("t") / bucket)), ["video", "__bin"]).where("t >= a AND t < b")
    seen = inside.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(F.col("kind") != "unknown", F.col("kind")))).alias("kinds"), F.array_sort(F.collect_set("weather")).alias("weather"))

    def touching(rows: DataFrame) -> DataFrame:
        dealt = rows.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor(F.col("e") / bucket))))
        met = wide.join(dealt, ["video", "__bin"]).where("s < b AND e > a")
        # Two stretches may share several buckets: the pair counts where the later start is.
        return met.where(F.col("__bin") == F.floor(F.greatest("a", "s") / bucket))

    said = touching(speech).groupBy(*key).agg(F.sum(F.least("b", "e") - F.greatest("a", "s")).alias("said"))
    best = touching(shots).groupBy(*key).agg(F.max("usability").alias("usability"))
    none = F.array().cast("array<string>")
    out = spans.join(seen, key, "left").join(said, key, "left").join(best, key, "left")
    return out.select("video", "span", "a", "b", F.coalesce("kinds", none).alias("kinds"), F.coalesce("weather", none).alias("weather"), (F.coalesce("said", F.lit(0.0)) >= SPEECH_MIN_S).alias("speech"), "usability")


def passages(kinds: Sequence[tuple[str, DataFrame]], limit: int) -> DataFrame:
    """(video, kind, part, text): all kinds in one table; each gives (video, part, parts array). Passages without text are left out."""
    every = [df.select("video", F.lit(kind).alias("kind"), "part", composed(F.col("parts"), limit).alias("text")) for kind, df in kinds]
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df)
    return out.where("text <> ''")


def digests(built: DataFrame) -> DataFrame:
    """(video, digest) of a video's passages in a fixed order: an index is built anew where it changes."""
    rows = built.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("kind", "part", "text"))).alias("all"))
    return rows.select("video", F.sha2(F.to_json("all"), 256).alias("digest"))


def crop(union: Column, middle_x: Column, middle_y: Column, width: float, height: float, aspect: float) -> Column:
    """struct(x, y, w, h, zoom): the largest crop of a shape that shows a union of boxes (fractions of the picture), or the middle of their centres."""
    w, h = (height * aspect, height) if width / height > aspect else (width, width / aspect)
    left, right, top, bottom = union["x1"] * width, union["x2"] * width, union["y1"] * height, union["y2"] * height
    at = lambda low, high, middle, size, whole: F.greatest(F.lit(0.0), F.least(F.lit(whole - size), F.when(high - low <= size, (low + high) / 2 - size / 2).otherwise(middle * whole - size / 2)))
    return F.struct(at(left, right, middle_x, w, width).alias("x"), at(top, bottom, middle_y, h, height).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(max(width / w, height / h)).alias("zoom"))


def best_time(candidates: DataFrame, key: str, now_s: float) -> DataFrame:
    """(key, at_s, source, confidence): the capture time of each key's candidates (key, kind, at_s, source).

    Kinds are ranks of trust, 1 the best. Times before 1990 or in the future are not plausible. The best kind's earliest
    time is taken; another kind that agrees within STRONG_S makes it high, within AGREEMENT_S or a kind of 2 or better
    medium, else it is low.
    """
    good = candidates.where((F.col("at_s") >= 631152000) & (F.col("at_s") <= now_s + 86400))
    first = good.groupBy(key).agg(F.min(F.struct("kind", "at_s", "source")).alias("best"))
    off = F.min(F.when(F.col("kind") > F.col("best.kind"), F.abs(F.col("at_s") - F.col("best.at_s"))))
    judged = good.join(first, key).groupBy(key, "best").agg(off.alias("off"))
    confidence = F.when(F.col("off") <= STRONG_S, "high").when((F.col("off") <= AGREEMENT_S) | (F.col("best.kind") <= 2), "medium").otherwise("low")
    return judged.select(key, F.col("best.at_s").alias("at_s"), F.col("best.source").alias("source"), confidence.alias("confidence"))


def covered_families(sounds: DataFrame, parents: DataFrame, write: Callable[[DataFrame], DataFrame], cover: float = 0.8, per_family: int = 5) -> DataFrame:
    """(video, class, seconds) of sounds (video, class, family, s, e) that are listed: five a family, longest first, none whose kept members cover it.

    A sound that the family's limit cuts is taken out and the rule runs again, so that it hides nothing. Each round is
    written, and each takes at least one sound of a video out, so the rounds end; spans of a class do not overlap.
    """
    keys = ["video", "class"]
    rows = write(sounds)
    while True:
        total = rows.groupBy(*keys, "family").agg(F.sum(F.col("e") - F.col("s")).alias("seconds"))
        member = rows.join(parents, "class").select("video", F.col("ancestor").alias("class"), "s", "e")
        merged = _merged(member, keys)
        met = rows.select(*keys, "s", "e").join(merged.select(*keys, F.col("s").alias("s2"), F.col("e").alias("e2")), keys).where("s < e2 AND s2 < e")
        part = met.groupBy(*keys).agg(F.sum(F.least("e", "e2") - F.greatest("s", "s2")).alias("part"))
        open_ = total.join(part, keys, "left").where(F.coalesce("part", F.lit(0.0)) < cover * F.col("seconds") - 1e-9)
        w = Window.partitionBy("video", "family").orderBy(F.desc("seconds"), "class")
        ranked = write(open_.withColumn("r", F.row_number().over(w)))
        over = ranked.where(F.col("r") > per_family).select(*keys)
        if over.isEmpty():
            return ranked.select(*keys, "family", "seconds")
        rows = write(rows.join(over, keys, "left_anti"))


def _merged(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    from .sequences import merge_spans

    return merge_spans(spans, keys, "s", "e", 0.0)

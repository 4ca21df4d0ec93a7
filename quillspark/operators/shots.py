"""Shots, blocks, pauses, cues and clips: operators over the ordered rows of one video.

What a window can say is a window; folds over one video's rows read runs of sorted rows (runs.py), of which each is a
video's shots or words. A video of many hours has some ten thousand of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .runs import Group, by_runs, folded, values

# Fixed values.
MIN_SHOT_S = 0.6
LONG_SHOT_S, PART_S, MIN_PART_S, REACH, PAUSE_REACH_S = 30.0, 20.0, 4.0, 0.25, 3.0
MERGE_BELOW_S = 4.0
CLIP_PAD_S, CLIP_MAX_S = 1.0, 30.0
MAX_LINE, MAX_LINES, MAX_CUE_S, MIN_CUE_S, GAP_SPLIT_S, MIN_VISIBLE_S = 42, 2, 7.0, 1.0, 0.8, 0.1
SENTENCE_END, SOFT_END = (".", "?", "!", "…"), (",", ";", ":")
MAX_PAUSE_S, SENTENCE_BONUS, SHIFT_COST = 2.0, 0.5, 0.25


def shots(cuts: DataFrame, videos: DataFrame, video: str, at: str, duration: str, least: float = MIN_SHOT_S) -> DataFrame:
    """(video, start, end): the shots between cuts; cuts less than `least` before the end are dropped from the end on.

    videos: (video, duration). A video without cuts is one shot; one without length has none.
    """
    inner = cuts.join(videos, video).where((F.col(at) > 0) & (F.col(at) < F.col(duration)) & (F.col(duration) - F.col(at) >= least)).select(video, F.col(at).cast("double").alias("start"))
    every = inner.unionByName(videos.where(F.col(duration) > 0).select(video, F.lit(0.0).alias("start")))
    w = Window.partitionBy(video).orderBy("start")
    return every.join(videos, video).withColumn("end", F.coalesce(F.lead("start").over(w), F.col(duration))).where("end > start").select(video, "start", "end")


def motion(dx: Column, dy: Column, size: Column, divergence: Column, jitter: Column) -> Column:
    """struct(motion, stability) of a shot from the means of its flow, the median of its size and its jitter."""
    stability = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + 2 * F.coalesce(jitter, F.lit(0.0)))))
    zoom = (F.abs(divergence) > 0.35 * size) & (F.abs(divergence) > 0.08)
    kind = F.when(size < 0.25, "static").when(zoom, F.when(divergence > 0, "zoom_in").otherwise("zoom_out"))
    kind = kind.when(F.hypot(dx, dy) < 0.35 * size, F.when(stability < 0.6, "handheld").otherwise("moving"))
    kind = kind.when(F.abs(dx) >= 2 * F.abs(dy), F.when(dx < 0, "pan_right").otherwise("pan_left")).when(F.abs(dy) >= 2 * F.abs(dx), F.when(dy < 0, "tilt_down").otherwise("tilt_up")).otherwise("moving")
    return F.struct(kind.alias("motion"), stability.alias("stability"))


def chapter_count(duration: Column) -> Column:
    """One chapter under 90 s, then about one in 45 s up to five minutes, then one more each 400 s, twelve at most."""
    return F.when(duration < 90, 1).when(duration <= 300, F.greatest(F.lit(2), F.least(F.lit(4), F.bround(duration / 45.0).cast("int")))).otherwise(F.greatest(F.lit(4), F.least(F.lit(12), F.bround(3 + duration / 400.0).cast("int"))))


def interpolated(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """df with nulls of `value` filled on the line between the known neighbours, flat outside them."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    a, b = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
    marked = df.withColumns({"__a": a, "__b": b})
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col(order) - F.col("__a.t")) / (F.col("__b.t") - F.col("__a.t"))
    return marked.withColumn(value, F.when(F.col("__a").isNull(), F.col("__b.v")).when(F.col("__b").isNull() | (F.col("__a.t") == F.col("__b.t")), F.col("__a.v")).otherwise(line)).drop("__a", "__b")


def pauses(words: DataFrame, keys: Sequence[str], start: str, end: str, text: str) -> DataFrame:
    """(keys, t, quality): the middle of each gap between words; longer ones are better, up to MAX_PAUSE_S, and those after a sentence."""
    w = Window.partitionBy(*keys).orderBy(start, end, text)
    after = words.withColumn("__next", F.lead(start).over(w)).where(F.col("__next") >= F.col(end))
    quality = F.least(F.col("__next") - F.col(end), F.lit(MAX_PAUSE_S)) + F.when(F.col(text).rlike(r"[.!?…]\s*$"), SENTENCE_BONUS).otherwise(0.0)
    return after.select(*keys, ((F.col(end) + F.col("__next")) / 2).alias("t"), quality.alias("quality"))


def snapped(edges: DataFrame, found: DataFrame, keys: Sequence[str], at: str, reach: float) -> DataFrame:
    """edges with `snap`: the best pause within `reach`, where each second of the way costs SHIFT_COST; the edge itself without one.

    Edges and pauses meet by buckets of `reach`, each edge in the three around it.
    """
    cell = F.floor(F.col(at) / reach)
    near = edges.withColumn("__cell", F.explode(F.array(cell - 1, cell, cell + 1))).join(found.withColumn("__cell", F.floor(F.col("t") / reach)), [*keys, "__cell"]).where(F.abs(F.col("t") - F.col(at)) <= reach)
    best = near.groupBy(*keys, at).agg(F.max(F.struct((F.col("quality") - SHIFT_COST * F.abs(F.col("t") - F.col(at))).alias("score"), "t")).alias("__best"))
    return edges.join(best, [*keys, at], "left").withColumn("snap", F.coalesce("__best.t", at)).drop("__best")


def _out_of(t: float, starts: np.ndarray, ends: np.ndarray, until: np.ndarray, low: float, high: float) -> float:
    """t, or the nearer edge of the first span that it is in, if that is allowed and within PAUSE_REACH_S. until: the latest end so far."""
    i = int(np.searchsorted(until, t, "right"))
    if i == len(starts) or not starts[i] < t:
        return t
    edges = [float(x) for x in (starts[i], ends[i]) if low <= x <= high and abs(x - t) <= PAUSE_REACH_S]
    return min(edges, key=lambda x: abs(x - t), default=t)


def _parts(s: float, e: float, frames: Sequence[float], spans: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[float, float]]:
    """The parts of a shot; spans: starts, ends and the latest end so far of speech."""
    bounds, count = [s], max(2, round((e - s) / PART_S)) if e - s > LONG_SHOT_S else 1
    span = (e - s) / count
    for i in range(1, count):
        ideal = s + i * span
        near = [t for t in frames if abs(t - ideal) <= REACH * span]
        cut = min(near, key=lambda t, ideal=ideal: abs(t - ideal)) if near else ideal
        low, high = bounds[-1] + MIN_PART_S, e - MIN_PART_S * (count - i)
        bounds.append(min(max(_out_of(cut, *spans, low, high) if spans else cut, low), high))
    for a, b in zip(bounds, [*bounds[1:], e], strict=True):
        yield float(a), float(b)


def split_long(df: DataFrame, keys: Sequence[str], start: str, end: str, keyframes: str) -> DataFrame:
    """(keys, part, a, b): long shots cut into parts of about PART_S near their keyframes (array column); short ones stay whole."""

    def fold(g: Group) -> Iterator[tuple]:
        n = 0
        for s, e, frames in zip(g[start], g[end], g[keyframes], strict=True):
            for a, b in _parts(s, e, frames):
                n += 1
                yield n, a, b

    return folded(df, keys, fold, "part int, a double, b double", [start])


def split_spoken(runs: DataFrame, keys: Sequence[str], order: str, starts: str, ends: str, keyframes: str) -> DataFrame:
    """(keys, part, a, b): each video as one shot, from its first word to the end of its last, cut as split_long does; a cut in a word moves to its edge.

    runs: a video's words in `order`, any number a row: arrays of their starts, which ascend, and of their ends. keyframes:
    an array column; a video's first row has them. A task holds two numbers a word, of one batch and one video.
    """

    def run(table: pa.Table, begins: np.ndarray) -> tuple[list[int], list]:
        s, e = (pc.list_flatten(table.column(c)).to_numpy() for c in (starts, ends))
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(table.column(starts)).to_numpy())])
        of, rows = [], []
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), table.num_rows], strict=True):
            said = slice(at[a], at[b])
            if at[a] < at[b]:
                until = np.maximum.accumulate(e[said])
                parts = _parts(float(s[at[a]]), float(until[-1]), table.column(keyframes)[a].as_py() or (), (s[said], e[said], until))
                rows.extend((n, *p) for n, p in enumerate(parts, 1))
                of.extend([a] * (len(rows) - len(of)))
        return of, list(zip(*rows, strict=True)) if rows else [()] * 3

    return by_runs(runs, keys, [order], run, "part int, a double, b double")


def merge_short(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, no, a, b, pieces): a short piece joins the one before while the two stay within LONG_SHOT_S."""

    def fold(g: Group) -> Iterator[tuple]:
        out: list[list] = []
        for s, e in zip(g[start], g[end], strict=True):
            if out and (e - s < MERGE_BELOW_S or out[-1][1] - out[-1][0] < MERGE_BELOW_S) and e - out[-1][0] <= LONG_SHOT_S:
                out[-1][1:] = [e, out[-1][2] + 1]
            else:
                out.append([s, e, 1])
        for i, (a, b, n) in enumerate(out, 1):
            yield i, float(a), float(b), n

    return folded(df, keys, fold, "no int, a double, b double, pieces int", [start, end])


def context_clips(df: DataFrame, keys: Sequence[str], start: str, end: str, duration: str) -> DataFrame:
    """(keys, a, b, gaps): gaps widened by CLIP_PAD_S within the video and dealt to clips.

    From left to right, a gap goes into the open clip if the two meet or the clip stays within CLIP_MAX_S; else it opens
    the next one. One array expression a key; gaps that are empty once widened are left out.
    """
    wide = df.withColumns({"__a": F.greatest(F.lit(0.0), F.col(start) - CLIP_PAD_S), "__b": F.least(F.col(duration).cast("double"), F.col(end) + CLIP_PAD_S)}).where("__b > __a")
    rows = wide.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col("__a").alias("a"), F.col("__b").alias("b")))).alias("__gaps"))
    clip = lambda a, b, n: F.struct(F.coalesce(a, F.lit(0.0)).alias("a"), F.coalesce(b, F.lit(0.0)).alias("b"), n.cast("int").alias("gaps"))
    none = F.array().cast("array<struct<a:double,b:double,gaps:int>>")
    begin = F.struct(none.alias("closed"), clip(F.lit(0.0), F.lit(0.0), F.lit(0)).alias("open"))

    def deal(s: Column, gap: Column) -> Column:
        now = s["open"]
        fits = (now["gaps"] > 0) & ((gap["a"] <= now["b"]) | (gap["b"] - now["a"] <= CLIP_MAX_S))
        grown = F.struct(s["closed"].alias("closed"), clip(now["a"], F.greatest(now["b"], gap["b"]), now["gaps"] + 1).alias("open"))
        opened = F.struct(F.when(now["gaps"] > 0, F.array_append(s["closed"], now)).otherwise(s["closed"]).alias("closed"), clip(gap["a"], gap["b"], F.lit(1)).alias("open"))
        return F.when(fits, grown).otherwise(opened)

    clips = F.aggregate("__gaps", begin, deal, lambda s: F.array_append(s["closed"], s["open"]))
    return rows.select(*keys, F.inline(clips)).select(*keys, F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), "gaps")


def packed(df: DataFrame, keys: Sequence[str], order: str, size: str, most: int, chars: int) -> DataFrame:
    """(keys, order, batch): items put into batches of at most `most` items and `chars` characters; a longer item is alone."""

    def fold(g: Group) -> Iterator[tuple]:
        batch, n, total = 0, 0, 0
        for at, length in zip(g[order], g[size], strict=True):
            if n and (n >= most or total + length > chars):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + length
            yield int(at), batch

    return folded(df, keys, fold, f"{order} long, batch int", [order])


def _line_counts(texts: Sequence[str]) -> np.ndarray:
    """How many lines of MAX_LINE characters the first 1, 2, ... texts fill."""
    lines, used, out = 1, -1, []
    for text in texts:
        for token in text.split():
            used += 1 + len(token)
            if used > MAX_LINE and used > len(token):
                lines, used = lines + 1, len(token)
            over = max(0, -(-used // MAX_LINE) - 1)
            lines, used = lines + over, used - over * MAX_LINE
        out.append(lines)
    return np.array(out)


def _cue_end(i: int, starts: np.ndarray, ends: np.ndarray, texts: list[str]) -> int:
    """Where the cue that begins with word i ends: the first word after it that may not join.

    Each rule is a mask over the words that begin within MAX_CUE_S.
    """
    stop = min(len(starts), int(np.searchsorted(starts, starts[i] + MAX_CUE_S, "right")) + 1)
    held, later = slice(i, stop - 1), slice(i + 1, stop)
    if i + 1 >= stop:
        return stop
    until = np.maximum.accumulate(ends[i:stop])
    said = texts[i : stop - 1]
    chars = np.cumsum([len(t) + 1 for t in said]) - 1
    full = np.array([t.endswith(SENTENCE_END) for t in said]) & (until[:-1] - starts[i] >= MIN_CUE_S)
    soft = np.array([t.endswith(SOFT_END) for t in said]) & (chars > MAX_LINE)
    apart = starts[later] - until[:-1] > GAP_SPLIT_S
    long = (until[1:] - starts[i] > MAX_CUE_S) | (_line_counts(texts[i:stop])[1:] > MAX_LINES)
    found = np.flatnonzero(full | soft | apart | long)
    return i + 1 + int(found[0]) if len(found) else max(stop, held.stop)


def cues(words: DataFrame, keys: Sequence[str], start: str, end: str, text: str) -> DataFrame:
    """(keys, no, a, b, line): subtitle cues from timed words (no longer than a line each).

    A cue ends at a pause, after a sentence once it lasts long enough, after a comma once it fills a line, and before it
    would be too long to read. Cues do not overlap and stay on screen for MIN_CUE_S where the next one leaves room.
    """

    def fold(g: Group) -> Iterator[tuple]:
        starts, ends, texts = np.array(g[start], float), np.array(g[end], float), g[text]
        heads = [0]
        while (after := _cue_end(heads[-1], starts, ends, texts)) < len(texts):
            heads.append(after)
        tails = [*heads[1:], len(texts)]
        # When a cue would begin and end if it were alone, and when the next one wants to begin.
        begin, last = starts[heads], np.maximum.reduceat(ends, heads)
        limit, shown = np.append(begin[1:], np.inf), 0.0
        for no, (a, b) in enumerate(zip(heads, tails, strict=True)):
            at = max(begin[no], shown)
            shown = max(at + MIN_VISIBLE_S, min(limit[no], max(at + MIN_CUE_S, last[no])))
            yield no + 1, round(float(at), 3), round(float(shown), 3), " ".join(texts[a:b])

    return folded(words, keys, fold, "no int, a double, b double, line string", [start, end])


def contrast_bounds(df: DataFrame, keys: Sequence[str], order: str, words: str, reach: int = 3) -> DataFrame:
    """df with `contrast`: how little the words of the `reach` rows before and the `reach` rows from here on share (Jaccard)."""
    w = Window.partitionBy(*keys).orderBy(order)
    sets = lambda frame: F.array_distinct(F.flatten(F.collect_list(words).over(frame)))
    before, after = sets(w.rowsBetween(-reach, -1)), sets(w.rowsBetween(0, reach - 1))
    marked = df.withColumns({"__before": before, "__after": after})
    union = F.size(F.array_union("__before", "__after"))
    return marked.withColumn("contrast", F.when((F.size("__before") > 0) & (union > 0), 1 - F.size(F.array_intersect("__before", "__after")) / union)).drop("__before", "__after")


def fill_slots(start: Column, end: Column, chosen: Column, count: int = 4, apart: float = 1.0) -> Column:
    """Times for the slots of a part that its chosen times (array) leave empty, each at least `apart` from those taken."""
    low = start + F.greatest(F.lit(0.15), 0.06 * (end - start))
    high = end - F.greatest(F.lit(0.2), 0.06 * (end - start))
    slots = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.round(low + (high - low) * i / F.lit(float(count - 1)), 3))
    none = F.array().cast("array<double>")
    begin = F.struct(chosen.cast("array<double>").alias("taken"), none.alias("extra"))

    def step(s: Column, t: Column) -> Column:
        free = (F.size(s["taken"]) < count) & F.forall(s["taken"], lambda x: F.abs(x - t) >= apart)
        return F.when(free, F.struct(F.array_append(s["taken"], t).alias("taken"), F.array_append(s["extra"], t).alias("extra"))).otherwise(s)

    return F.aggregate(slots, begin, step, lambda s: s["extra"])


def excerpt(words: DataFrame, spots: DataFrame, keys: Sequence[str], start: str, end: str, text: str, at: str, around: float = 6.0, chars: int = 240) -> DataFrame:
    """(keys, at, excerpt): the words around each spot in order; the farthest ones go while there are too many characters.

    Words meet spots by buckets of `around`.
    """
    cell = F.floor(F.col(at) / around)
    met = spots.withColumn("__cell", F.explode(F.array(cell - 1, cell, cell + 1))).join(words.withColumn("__cell", F.floor(F.col(start) / around)), [*keys, "__cell"])
    met = met.where((F.col(end) >= F.col(at) - around) & (F.col(start) <= F.col(at) + around)).withColumn("__far", F.abs((F.col(start) + F.col(end)) / 2 - F.col(at)))
    w = Window.partitionBy(*keys, at).orderBy("__far", start, text).rowsBetween(Window.unboundedPreceding, 0)
    kept = met.withColumn("__used", F.sum(F.length(text) + 1).over(w)).where(F.col("__used") <= chars + 1)
    return kept.groupBy(*keys, at).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(text).alias("t")))), lambda x: x["t"]), " ").alias("excerpt"))


def reading_order(boxes: DataFrame, keys: Sequence[str], x: str, y: str, row: float = 10.0) -> DataFrame:
    """boxes with `place`: from top to bottom; neighbours less than `row` apart in height are brought into order of x, one place at a time."""

    def run(table: pa.Table, starts: np.ndarray) -> tuple[list[int], list]:
        xs, ys, of, places = values(table.column(x)), values(table.column(y)), [], []
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            order = list(range(begin, end))
            for i in range(len(order) - 1):
                for j in range(i, -1, -1):
                    a, b = order[j], order[j + 1]
                    if abs(ys[b] - ys[a]) >= row or xs[b] >= xs[a]:
                        break
                    order[j], order[j + 1] = b, a
            of += order
            places += range(len(order))
        return of, [places]

    return by_runs(boxes, keys, [y, x], run, "place int", boxes.columns)


def choose_passages(candidates: DataFrame, keys: Sequence[str], budget: int, most: int = 16, penalty: int = 4) -> DataFrame:
    """(keys, rank, place): the candidates (keys, rank, video, family, a, b, tokens) that are read, in the order they are told.

    Each round takes the best one left, where every passage taken of a video sets its others back `penalty` places, unless
    it repeats one taken (same video and family, half of the shorter stretch shared) or does not fit the budget. The
    group is one question's candidates, some forty rows.
    """
    ship(candidates.sparkSession)
    schema = candidates.select(*keys).schema.add("rank", "long").add("place", "integer")

    def clashes(pdf: pd.DataFrame) -> np.ndarray:
        """Pairs of which only one is read."""
        same = (pdf["video"].to_numpy()[:, None] == pdf["video"].to_numpy()) & (pdf["family"].to_numpy()[:, None] == pdf["family"].to_numpy())
        a, b = pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)
        timed = ~(np.isnan(a)[:, None] | np.isnan(a))
        both = np.minimum.outer(b, b) - np.maximum.outer(a, a)
        half = np.minimum.outer(b - a, b - a) / 2
        # Points are inside a stretch that they touch.
        near = np.where(half > 0, both >= half, both >= 0)
        return same & np.where(timed, near, np.isnan(a)[:, None] & np.isnan(a))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        n, tokens = len(pdf), pdf["tokens"].to_numpy(np.int64)
        video = pd.factorize(pdf["video"], use_na_sentinel=False)[0]
        clash, place, open_, left, taken = clashes(pdf), np.arange(n), np.ones(n, bool), budget, []
        # What clashes with a passage that is read, or no longer fits, never comes back.
        while len(taken) < most and (open_ := open_ & (tokens <= left)).any():
            best = int(np.flatnonzero(open_)[np.argmin(place[open_])])
            taken.append(best)
            left -= tokens[best]
            open_ = open_ & ~clash[best]
            open_[best] = False
            place = place + penalty * (video == video[best])
        chosen = pdf.loc[taken].assign(at=taken, group=video[taken])
        chosen["first"] = chosen.groupby("group")["at"].transform("min") if taken else chosen["at"]
        told = chosen.assign(start=chosen["a"].fillna(-1.0)).sort_values(["first", "start", "at"])
        own = pdf.loc[0, list(keys)]
        return pd.DataFrame({**{k: [own[k]] * len(told) for k in keys}, "rank": told["rank"].to_numpy(), "place": np.arange(len(told), dtype=np.int32)}, columns=schema.names)

    return candidates.groupBy(*keys).applyInPandas(run, schema)


def greedy_pairs(pairs: DataFrame, keys: Sequence[str], a: str, b: str, score: str) -> DataFrame:
    """pairs with each a and each b once: the best score first, ties by the greatest a, then b. The group is one frame's boxes."""

    def run(table: pa.Table, starts: np.ndarray) -> tuple[list[int], list]:
        left, right, kept = values(table.column(a)), values(table.column(b)), []
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            used_a, used_b = set(), set()
            for i in range(begin, end):
                if left[i] not in used_a and right[i] not in used_b:
                    used_a.add(left[i])
                    used_b.add(right[i])
                    kept.append(i)
        return kept, []

    return by_runs(pairs, keys, [F.desc(score), F.desc(a), F.desc(b)], run, keep=pairs.columns)


def largest_first(pairs: DataFrame, keys: Sequence[str], a: str, area: str, b: str, score: str) -> DataFrame:
    """pairs in which each reference a, the largest first, takes the free b that fits it best, ties to the least b. The group is one frame's boxes."""

    def run(table: pa.Table, starts: np.ndarray) -> tuple[list[int], list]:
        left, size, right, kept = values(table.column(a)), values(table.column(area)), values(table.column(b)), []
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            own: dict = {}
            for i in range(begin, end):
                own.setdefault(left[i], []).append(i)
            used = set()
            for x in sorted(own, key=lambda x: (-max(size[i] for i in own[x]), x)):
                best = next((i for i in own[x] if right[i] not in used), None)
                if best is not None:
                    used.add(right[best])
                    kept.append(best)
        return kept, []

    return by_runs(pairs.where(F.col(a).isNotNull()), keys, [F.desc(score), b], run, keep=pairs.columns)


def distinct_groups(df: DataFrame, keys: Sequence[str], order: str, words: str, least: float = 0.5) -> DataFrame:
    """(keys, first, n): rows grouped with the first group's first row whose words they share by `least` (Jaccard). The group is one block's captions."""

    def fold(g: Group) -> Iterator[tuple]:
        groups: list[list] = []
        for at, w in zip(g[order], g[words], strict=True):
            own = set(w)
            for first in groups:
                if len(own | first[1]) and len(own & first[1]) / len(own | first[1]) >= least:
                    first[2] += 1
                    break
            else:
                groups.append([int(at), own, 1])
        for first, _, n in groups:
            yield first, n

    return folded(df, keys, fold, "first long, n int", [order])

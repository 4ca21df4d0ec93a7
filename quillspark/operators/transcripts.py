"""Transcript and framing rules: doubtful segments, caption lines, placement on a timeline, crops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
WINDOW_LOGPROB = -0.8
MEAN_WORD_P = 0.5
TEMPERATURE = 0.8
COMPRESSION = 2.2
REPEAT_WORDS = 3
MAX_LINE = 42


def folded(text: Column) -> Column:
    """Lower case, runs of all but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def suspect_reasons(text: Column, before: Column, logprob: Column, word_p: Column, temperature: Column, compression: Column) -> Column:
    """Why a segment looks made up, as an array; null measures give no reason. `before` is the text of the segment before."""
    norm, last = folded(text), folded(before)
    inside = (F.size(F.split(norm, " ")) >= REPEAT_WORDS) & F.contains(F.concat(F.lit(" "), last, F.lit(" ")), F.concat(F.lit(" "), norm, F.lit(" ")))
    reasons = {
        "low_logprob": logprob < WINDOW_LOGPROB,
        "low_word_probability": word_p < MEAN_WORD_P,
        "repeat": (norm != "") & ((norm == last) | inside),
        "fallback_loop": (temperature >= TEMPERATURE) & (compression > COMPRESSION),
    }
    return F.array_compact(F.array(*[F.when(test, name) for name, test in reasons.items()]))


def wrapped(text: Column, width: int = MAX_LINE) -> Column:
    """Lines of at most `width` characters, filled greedily at white space; a longer word is cut. Null stays null."""
    n = lambda w: F.ceil(F.length(w) / width).cast("int")
    piece = lambda w: F.transform(F.sequence(F.lit(0), n(w) - 1), lambda i: F.struct(F.substr(w, i * width + 1, F.lit(width)).alias("t"), (i < n(w) - 1).alias("full")))
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    state = lambda lines, line: F.struct(lines.alias("lines"), line.alias("line"))
    flushed = lambda s: F.when(s["line"] == "", s["lines"]).otherwise(F.concat(s["lines"], F.array(s["line"])))

    def step(s: Column, p: Column) -> Column:
        fits = F.length(s["line"]) + 1 + F.length(p["t"]) <= width
        return F.when(p["full"], state(F.concat(flushed(s), F.array(p["t"])), F.lit(""))).when(s["line"] == "", state(s["lines"], p["t"])).when(fits, state(s["lines"], F.concat(s["line"], F.lit(" "), p["t"]))).otherwise(state(flushed(s), p["t"]))

    return F.aggregate(F.flatten(F.transform(words, piece)), state(F.array().cast("array<string>"), F.lit("")), step, flushed)


def placed(cues: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, shown: str) -> DataFrame:
    """Cues, one a clip, moved to where their clip stands and cut at the end of what is shown of it; those never shown go."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = cues.withColumn("__at", F.coalesce(F.sum(shown).over(w), F.lit(0.0))).where((F.col(start) < F.col(shown)) & (F.col(end) > F.col(start)))
    return at.withColumns({start: F.col("__at") + F.greatest(F.lit(0.0), F.col(start)), end: F.col("__at") + F.least(end, shown)}).drop("__at")


def crop_runs(df: DataFrame, keys: Sequence[str], order: str, box: str, width: float, height: float, slack: float = 1e-6) -> DataFrame:
    """(keys, first, last): runs of boxes (x1, y1, x2, y2) whose union fits a crop of width by height; one fold per key, such as a shot."""
    state = lambda done, first, last, b: F.struct(done.alias("done"), first.alias("first"), last.alias("last"), b.alias("b"))
    kind, at = df.schema[box].dataType.simpleString(), df.schema[order].dataType.simpleString()
    none = state(F.array().cast(f"array<struct<first:{at},last:{at}>>"), F.lit(None).cast(at), F.lit(None).cast(at), F.lit(None).cast(kind))

    def step(s: Column, x: Column) -> Column:
        both = F.struct(*[f(s["b"][c], x["b"][c]).alias(c) for c, f in (("x1", F.least), ("y1", F.least), ("x2", F.greatest), ("y2", F.greatest))])
        fits = (both["x2"] - both["x1"] <= width + slack) & (both["y2"] - both["y1"] <= height + slack)
        closed = F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"))))
        return F.when(s["first"].isNull(), state(s["done"], x["at"], x["at"], x["b"])).when(fits, state(s["done"], s["first"], x["at"], both)).otherwise(state(closed, x["at"], x["at"], x["b"]))

    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(box).alias("b")))).alias("__all"))
    runs = F.aggregate("__all", none, step, lambda s: F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last")))))
    return rows.select(*keys, F.explode(runs).alias("__run")).select(*keys, "__run.*")

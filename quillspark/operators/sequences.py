"""Operators over ordered samples of a key: hysteresis, runs, merging, cuts, thinning, windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship


def _w(keys: Sequence[str], order: Sequence[str]):  # noqa: ANN202
    return Window.partitionBy(*keys).orderBy(*order)


def hysteresis(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, on: float, off: float, name: str = "state") -> DataFrame:
    """True from a value of at least `on` until one below `off`; false before the first."""
    seen = F.when(F.col(value) >= on, True).when(F.col(value) < off, False)
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.last(seen, ignorenulls=True).over(w), F.lit(False)))


def median3(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Centred median of three, the ends repeated."""
    w, v = _w(keys, order), F.col(value)
    return df.withColumn(name, F.array_sort(F.array(F.coalesce(F.lag(v).over(w), v), v, F.coalesce(F.lead(v).over(w), v)))[1])


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, name: str = "run") -> DataFrame:
    """Number of the run of equal states that a row is in."""
    w = _w(keys, order)
    change = F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(0))
    return df.withColumn("__change", change).withColumn(name, F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__change")


def merge_spans(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: float | int | Column = 0, strict: bool = False) -> DataFrame:
    """(keys, start, end, parts): spans merged while the next starts within `gap` of all ends so far (strictly less with `strict`)."""
    w = _w(keys, [start, end])
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col(start) - before >= gap) if strict else (F.col(start) - before > gap)
    marked = df.withColumn("__new", F.coalesce(apart.cast("int"), F.lit(0)))
    numbered = marked.withColumn("__id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__id").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("__id")


def cut_candidates(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, floor: float = 18, sure: float = 45, ratio: float = 3, before: int = 6) -> DataFrame:
    """Rows whose value stands out: at least `floor`, and `sure` or `ratio` times the mean of the rows before (1 at least)."""
    w = _w(keys, order).rowsBetween(-before, -1)
    v = F.col(value)
    return df.where(F.lit(True)).withColumn("__mean", F.greatest(F.coalesce(F.avg(v).over(w), F.lit(0.0)), F.lit(1.0))).where((v >= floor) & ((v >= sure) | (v >= ratio * F.col("__mean")))).drop("__mean")


def min_gap(df: DataFrame, keys: Sequence[str], at: str, gap: float) -> DataFrame:
    """Rows at least `gap` after the last kept one: a fold over each key's sorted places, which a window cannot express."""
    keep = lambda s, x: F.when(F.size(s) == 0, F.array(x)).when(x - F.element_at(s, -1) >= gap, F.concat(s, F.array(x))).otherwise(s)
    kind = df.schema[at].dataType.simpleString()
    folded = df.groupBy(*keys).agg(F.sort_array(F.collect_list(at)).alias("__all"))
    return folded.select(*keys, F.explode(F.aggregate("__all", F.array().cast(f"array<{kind}>"), keep)).alias(at))


def simhash(texts: DataFrame, text: str, code: str) -> DataFrame:
    """texts with a 64-bit code of all words of `text` (ASCII white space parts them, A-Z folded) in `code`.

    A bit is set where it is set in more than half of the words' hashes, so texts that share most words share most
    bits. Null texts and texts without words have code 0.
    """
    ship(texts.sparkSession)
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(folded, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    own = [c for c in texts.columns if c != text]
    rows = texts.select(*own, F.transform(words, lambda w: F.xxhash64(w)).alias("__hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for h in batch.column("__hashes"):
                h = np.asarray(h.values, np.int64).view(np.uint64)
                total = np.zeros(64, np.int64)
                for at in range(0, len(h), 65536):
                    total += np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                codes.append(int(np.packbits(2 * total > len(h), bitorder="little").view("<i8")[0]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(codes, pa.int64())], [*own, code])

    return rows.mapInArrow(run, texts.select(*own).schema.add(code, "long"))


def hamming_thin(df: DataFrame, keys: Sequence[str], order: str, code: str, bits: int = 6, last: int = 4) -> DataFrame:
    """Rows that differ by more than `bits` from each of the last `last` kept rows of their key.

    A key's rows are read in order as a stream, so that they need not fit in memory.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, []
        for batch in batches:
            rows, own = [], zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            for i, (k, h) in enumerate(zip(own, batch.column(code).to_pylist(), strict=True)):
                if k != key:
                    key, kept = k, []
                if all(((h ^ x) & (2**64 - 1)).bit_count() > bits for x in kept):
                    kept = [*kept, h][-last:]
                    rows.append(i)
            yield batch.take(pa.array(rows, pa.int64()))

    return df.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last(order), code).mapInArrow(run, df.schema)


def text_windows(df: DataFrame, keys: Sequence[str], start: str, end: str, text: str, length: float = 30, overlap: float = 5, pause: float = 0.6) -> DataFrame:
    """Overlapping windows of whole pieces of `length` at most; one piece that is longer is a window of its own.

    A window that does not reach the last piece ends after the last sentence end or pause in its second half, if there is
    one. The next begins with the first piece that starts in its last `overlap`.
    """
    ship(df.sparkSession)
    schema = df.select(*keys).schema.add("window", "integer").add("w_start", "double").add("w_end", "double").add("w_text", "string")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, end], kind="stable")
        s, e, t = pdf[start].to_numpy(float), pdf[end].to_numpy(float), pdf[text].fillna("").tolist()
        n, rows, i = len(s), [], 0
        breaks = np.array([x.rstrip().endswith((".", "!", "?", "…")) for x in t], bool) | (np.append(s[1:], np.inf) - e >= pause)
        while i < n:
            over = np.flatnonzero(e[i + 1 :] - s[i] > length)
            stop = i + 1 + int(over[0]) if len(over) else n
            if stop < n:
                first_half = np.flatnonzero(e[i + 1 : stop] < s[i] + length / 2)
                low = i + 1 + (int(first_half[-1]) + 1 if len(first_half) else 0)
                good = np.flatnonzero(breaks[low:stop])
                stop = low + int(good[-1]) + 1 if len(good) else stop
            rows.append((*pdf.iloc[0][list(keys)], len(rows), s[i], e[stop - 1], " ".join(t[i:stop])))
            if stop >= n:
                break
            again = np.flatnonzero(s[i + 1 : stop] >= e[stop - 1] - overlap)
            i = i + 1 + int(again[0]) if len(again) else stop
        return pd.DataFrame(rows, columns=schema.names)

    return df.groupBy(*keys).applyInPandas(run, schema)


def segment_optimally(df: DataFrame, keys: Sequence[str], order: str, value: str, parts: int, least: int = 1) -> DataFrame:
    """The cut of each key's sequence into `parts` pieces of at least `least` rows with the smallest squared spread."""
    ship(df.sparkSession)
    schema = df.select(*keys).schema.add("part", "integer").add("first", "long").add("last", "long").add("cost", "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        v, ids = pdf[value].to_numpy(float), pdf[order].astype("int64").to_numpy()
        n = len(v)
        k = max(1, min(parts, n // least))
        c, q = np.concatenate([[0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(v * v)])
        cost = lambda a, b: q[b] - q[a] - (c[b] - c[a]) ** 2 / np.maximum(b - a, 1)
        best, back = np.full((k + 1, n + 1), np.inf), np.zeros((k + 1, n + 1), int)
        best[0, 0] = 0
        for i in range(1, k + 1):
            for b in range(i * least, n + 1):
                a = np.arange((i - 1) * least, b - least + 1)
                x = best[i - 1, a] + cost(a, b)
                back[i, b], best[i, b] = a[x.argmin()], x.min()
        rows, b = [], n
        for i in range(k, 0, -1):
            a = back[i, b]
            rows.append((*pdf.iloc[0][list(keys)], i - 1, ids[a], ids[b - 1], round(float(cost(a, b)), 6)))
            b = a
        return pd.DataFrame(rows[::-1], columns=schema.names)

    return df.groupBy(*keys).applyInPandas(run, schema)

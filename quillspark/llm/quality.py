"""Quality classifier: a generalised additive model with pairwise interactions.

Training boosts shallow trees in turn over one feature at a time (cyclic), then over the pairs of features that
explain most of what is left. Since every tree looks at one or two binned features only, the trees of a feature add
up to one lookup table, and a score is a sum of table entries: score = sigmoid(intercept + sum f_i[bin] + sum f_ij[bin, bin]).

Features are counted over the whole text by vectorised byte passes in Arrow batches. The fit uses at most
`sample_rows` labelled rows (those with the least seeded hash of the id), whose features alone reach the driver.
Everything else covers all rows, a row at a time, so there are no hot keys; the only shuffle is the join of
labels to features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, seeded, unit
from .textnp import SPACE, chunks, counts_between, flat, prefix_hash, span_hash, words

FEATURES = ["log_bytes", "log_words", "word_bytes", "upper", "digit", "stop", "bang", "symbol", "pipe", "space", "newline", "wide", "distinct", "cased_words", "symbol_words", "line_repeat"]


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _LETTER, _DIGIT, _STOP, _BANG, _SYMBOL, _PIPE = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), _table("0123456789"), _table(".,;:?"), _table("!"), _table("#$%&*@^~_=+<>\\/{}[]"), _table("|")


def featurise(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; null and empty texts give zeros."""
    data, starts, ends = flat(texts)
    n = (ends - starts).astype(float)
    some = np.maximum(n, 1)
    part = lambda table: counts_between(table[data], starts, ends)
    at, to, count = words(data, starts, ends, ~SPACE)
    many = np.maximum(count, 1)
    doc = np.repeat(np.arange(len(n)), count)
    letters = part(_LETTER)
    total = prefix_hash(data)
    kinds = _distinct(doc, span_hash(total, at, to))
    cased = np.bincount(doc, weights=_UPPER[data[at]], minlength=len(n)) if len(at) else np.zeros(len(n))
    odd = np.bincount(doc, weights=(_SYMBOL | _BANG)[data[to - 1]], minlength=len(n)) if len(at) else np.zeros(len(n))
    line_at, line_to, lines = words(data, starts, ends, ~_table("\n"))
    line_doc = np.repeat(np.arange(len(n)), lines)
    line_kinds = np.bincount(_distinct(line_doc, span_hash(total, line_at, line_to)), minlength=len(n))
    out = np.stack([
        np.log1p(n), np.log1p(count), n / many, part(_UPPER) / np.maximum(letters, 1), part(_DIGIT) / some, part(_STOP) / many, part(_BANG) / some,
        part(_SYMBOL) / some, part(_PIPE) / many, part(SPACE) / some, part(_table("\n")) / many, counts_between(data >= 128, starts, ends) / some,
        np.bincount(kinds, minlength=len(n)) / many, cased / many, odd / many, 1 - line_kinds / np.maximum(lines, 1),
    ], axis=1)
    out[count == 0, 2:] = 0
    return out


def _distinct(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The doc of each distinct (doc, hash); the two are packed, as distinct counts may be off by a collision in 2^40."""
    key = (doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    return (np.unique(key) >> np.uint64(40)).astype(np.int64)


@dataclass
class Additive:
    """edges[i]: bin bounds of feature i; single[i]: its table; pairs: ((i, j), table over coarse bins)."""

    intercept: float
    edges: list[np.ndarray]
    single: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[tuple[int, int], np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for i, (e, t) in enumerate(zip(self.edges, self.single, strict=True)):
            z += t[np.searchsorted(e, x[:, i], "right")]
        for (i, j), t in self.pairs:
            z += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _stump(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Newton steps of a tree with up to `leaves` leaves over ordered bins, grown greedily."""
    gain = lambda a, b: a * a / (b + 1.0)
    parts, cg, ch = [(0, len(g))], np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gl, hl = cg[m] - cg[a], ch[m] - ch[a]
                gr, hr = cg[b] - cg[m], ch[b] - ch[m]
                v = np.where((hl >= least) & (hr >= least), gain(gl, hl) + gain(gr, hr) - gain(cg[b] - cg[a], ch[b] - ch[a]), 0)
                if v.max() > best[0]:
                    best = (v.max(), k, int(m[v.argmax()]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """The best split of a grid into four quadrants: its gain and Newton steps."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    right, right_h = cg[:-1, -1:] - a, ch[:-1, -1:] - b
    low, low_h = cg[-1:, :-1] - a, ch[-1:, :-1] - b
    rest, rest_h = tg - a - right - low, th - b - right_h - low_h
    v = sum(x * x / (y + 1.0) for x, y in ((a, b), (right, right_h), (low, low_h), (rest, rest_h)))
    i, j = np.unravel_index(v.argmax(), v.shape) if v.size else (0, 0)
    out = np.zeros_like(g)
    if v.size:
        for rows, cols, x, y in ((slice(0, i + 1), slice(0, j + 1), a, b), (slice(0, i + 1), slice(j + 1, None), right, right_h), (slice(i + 1, None), slice(0, j + 1), low, low_h), (slice(i + 1, None), slice(j + 1, None), rest, rest_h)):
            if y[i, j] >= least:
                out[rows, cols] = -x[i, j] / (y[i, j] + 1.0)
    return (float(v.max() - tg * tg / (th + 1.0)) if v.size else 0.0), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 8, rounds: int = 120, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.1, leaves: int = 3) -> Additive:
    """Without rows of both labels the score is the share of label 1 (0.5 without any)."""
    n, d = x.shape
    prior = (y.sum() + 1) / (n + 2)
    bounds = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1])) if len(v) else np.zeros(0)
    edges = [bounds(x[:, i], bins) for i in range(d)]
    coarse = [bounds(x[:, i], coarse_bins) for i in range(d)]
    model = Additive(float(np.log(prior / (1 - prior))), edges, [np.zeros(len(e) + 1) for e in edges], coarse, [])
    if n == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)]
    z, least = np.full(n, model.intercept), 2.0

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p) + 1e-6

    for _ in range(rounds):
        for i in range(d):
            g, h = slopes()
            step = rate * _stump(np.bincount(at[i], g, len(edges[i]) + 1), np.bincount(at[i], h, len(edges[i]) + 1), leaves, least)
            model.single[i] += step
            z += step[at[i]]
    wide = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(coarse)]
    grid = lambda i, j, v: np.bincount(wide[i] * (len(coarse[j]) + 1) + wide[j], v, (len(coarse[i]) + 1) * (len(coarse[j]) + 1)).reshape(len(coarse[i]) + 1, -1)
    g, h = slopes()
    ranked = sorted(((_quadrants(grid(i, j, g), grid(i, j, h), least)[0], i, j) for i in range(d) for j in range(i)), reverse=True)
    model.pairs = [((i, j), np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for v, i, j in ranked[:pairs] if v > 0]
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs:
            g, h = slopes()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h), least)[1]
            table += step
            z += step[wide[i], wide[j]]
    return model


def features(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, features array<double>) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                x = featurise(part.column("text"))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("key"), rows], ["key", "features"])

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"key {kind}, features array<double>")


def train(feats: DataFrame, labels: DataFrame, sample_rows: int = 20_000, seed: int = 0) -> Additive:
    """labels: (key, label 0 or 1). Null keys and labels are left out; of several labels of a key the largest counts.

    The rows of the least hashes are taken. Those beyond a bound that the count of rows gives are dropped first, so that
    about sample_rows rows, not that many a partition, are sorted and sent.
    """
    known = labels.where(F.col("key").isNotNull() & F.col("label").isNotNull()).groupBy("key").agg(F.max("label").alias("label"))
    held = feats.where(F.col("key").isNotNull()).select("key").join(known, "key").count()
    bound = (sample_rows + 6 * math.sqrt(sample_rows)) / max(1, held)
    some = known.where(unit(seeded(seed, "key")) < bound)
    rows = feats.where(unit(seeded(seed, "key")) < bound).join(some, "key").orderBy(unit(seeded(seed, "key")), "key", "features").limit(sample_rows).toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["label"].to_numpy(float))


def score(feats: DataFrame, model: Additive) -> DataFrame:
    """(key, score double) for each row of feats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("features").flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(model.score(x))], ["key", "score"])

    return feats.mapInArrow(run, f"key {feats.schema['key'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", sample_rows: int = 20_000, seed: int = 0) -> DataFrame:
    """(key, score) for each row of docs, learnt from labels (key, label).

    Any row gets a score, null and empty texts too (their features are 0); null keys are kept; repeated rows score
    alike. An empty table gives an empty result.
    """
    feats = cut(features(docs, key), "quality-features")
    return score(feats, train(feats, labels.select(F.col(key).alias("key"), F.col("label")), sample_rows, seed))

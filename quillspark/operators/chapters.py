"""Chapters: a video's blocks cut into contiguous parts, and single boundaries chosen by how much changes there.

The exact cut needs all costs of a video's blocks at once, n x n numbers, so it runs per video in a task of Python (2000
blocks are 32 MB). The choice of boundaries is one array fold a video and stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import Group, folded

# Fixed values.
COMMON_SHARE, FEW_BLOCKS, MIN_CHAPTER_S, WEIGHT_CAP_S = 0.6, 12, 20.0, 30.0


def term_vectors(blocks: Sequence[Sequence[str]]) -> np.ndarray:
    """A unit row a block over the words that tell blocks apart, rarer ones heavier: 1 / ln(1 + blocks with it).

    Words of more than COMMON_SHARE of the blocks are left out, and, beyond FEW_BLOCKS blocks, words of one block.
    """
    n = len(blocks)
    at, words = np.concatenate([[i] * len(set(b)) for i, b in enumerate(blocks)]).astype(int), np.array([w for b in blocks for w in sorted(set(b))], object)
    if not len(words):
        return np.zeros((n, 1))
    _, column, df = np.unique(words.astype(str), return_inverse=True, return_counts=True)
    telling = (df > 1) & (df <= max(2, COMMON_SHARE * n)) | (df == 1) & (n <= FEW_BLOCKS)
    x = np.zeros((n, len(df)))
    x[at, column] = np.where(telling, 1 / np.log1p(df), 0.0)[column]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def spreads(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """[i, j]: the weighted spread of rows i to j - 1 around their mean, infinite for j <= i.

    The squared length of a weighted sum of rows is a square block of their Gram matrix, which two running sums give.
    """
    n = len(weight)
    corner = np.zeros((n + 1, n + 1))
    rows = x * weight[:, None]
    corner[1:, 1:] = (rows @ rows.T).cumsum(axis=0).cumsum(axis=1)
    edge = np.diag(corner)
    block = edge[:, None] + edge[None, :] - corner - corner.T
    mass, norm = (np.concatenate([[0.0], np.cumsum(v)]) for v in (weight, weight * (x * x).sum(axis=1)))
    later = np.triu(np.ones((n + 1, n + 1), bool), 1)
    heavy = np.where(later, mass[None, :] - mass[:, None], 1.0)
    return np.where(later, norm[None, :] - norm[:, None] - block / heavy, np.inf)


def best_cut(cost: np.ndarray, parts: int) -> list[int]:
    """Bounds of the cheapest cut into `parts` parts, or as many fewer as make it possible; ties to the earliest bound. None possible: one part."""
    n = len(cost) - 1
    layers, came = [np.where(np.arange(n + 1) == 0, 0.0, np.inf)], []
    for _ in range(min(parts, n)):
        through = layers[-1][:, None] + cost
        came.append(through.argmin(axis=0))
        layers.append(through.min(axis=0))
    used = next((m for m in range(len(came), 0, -1) if np.isfinite(layers[m][n])), 0)
    bounds = [n]
    for m in range(used, 0, -1):
        bounds.append(int(came[m - 1][bounds[-1]]))
    return bounds[::-1] if used else [0, n]


def chapters(df: DataFrame, keys: Sequence[str], start: str, end: str, words: str, duration: str, parts: str) -> DataFrame:
    """(keys, chapter, first, last, a, b, spread): each key's blocks cut into `parts` chapters of least spread.

    words: array column; duration, parts: of the video, in each of its rows. A chapter lasts MIN_CHAPTER_S and half of an even
    share at least, from its first block to the next chapter's; where that cannot be, there are fewer. A block
    weighs its seconds up to WEIGHT_CAP_S, and one more. first and last count blocks from 0 in order of start.
    """

    def fold(g: Group) -> Iterator[tuple]:
        begin, until = np.array(g[start], float), np.array(g[end], float)
        whole, wanted = max(float(g[duration][0]), float(until[-1])), int(g[parts][0])
        cost = spreads(term_vectors([list(w) if w is not None else [] for w in g[words]]), np.minimum(until - begin, WEIGHT_CAP_S) + 1.0)
        edges = np.append(begin, whole)
        allowed = cost.copy()
        allowed[edges[None, :] - edges[:, None] < max(MIN_CHAPTER_S, 0.5 * whole / max(1, wanted))] = np.inf
        bounds = best_cut(allowed, max(1, wanted))
        for no, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)):
            yield no, i, j - 1, float(begin[i]), float(edges[j]), round(float(cost[i, j]), 9)

    return folded(df, keys, fold, "chapter int, first int, last int, a double, b double, spread double", [start, end])


def spaced_bounds(df: DataFrame, keys: Sequence[str], at: str, score: str, duration: Column, most: Column, apart: Column) -> DataFrame:
    """(keys, at): up to `most` of each key's candidates, the best score first (the later one among equals), none nearer than `apart` to another or to 0 and `duration`.

    duration, most and apart are aggregates over a key's rows. A null score is no candidate.
    """
    rows = df.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(score).alias("s"), F.col(at).cast("double").alias("t"))), asc=False).alias("__all"), duration.cast("double").alias("__end"), most.cast("int").alias("__most"), apart.cast("double").alias("__apart"))
    free = lambda kept, x: (F.size(kept) < F.col("__most") + 2) & F.forall(kept, lambda k: F.abs(k - x["t"]) >= F.col("__apart"))
    kept = F.aggregate("__all", F.array(F.lit(0.0), F.col("__end")), lambda kept, x: F.when(free(kept, x), F.array_append(kept, x["t"])).otherwise(kept))
    return rows.select(*keys, F.explode(F.slice(kept, 3, F.greatest(F.size(kept) - 2, F.lit(0)))).alias(at))

"""Dominant colours: k-means over the pixels of one picture."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame

from .runs import Group, folded

# Fixed values.
ROUNDS, LEAST_MOVE, DUST = 20, 1.0, 0.005


def k_means(pixels: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(centres, pixels of each). The same for any order of the pixels.

    The first centre is the pixel nearest to the mean, each next one the pixel farthest from all before (the least by its
    channels among equals). A centre that gets no pixel stays where it is. It ends when no centre moves by LEAST_MOVE.
    """
    pixels = pixels[np.lexsort(pixels.T[::-1])]
    away = lambda c: ((pixels - c) ** 2).sum(axis=1)
    first = pixels[away(pixels.mean(axis=0)).argmin()]
    centres, far = [first], away(first)
    while len(centres) < min(k, len(pixels)):
        centres.append(pixels[far.argmax()])
        far = np.minimum(far, away(centres[-1]))
    centres = np.array(centres, float)
    for _ in range(rounds):
        nearest = ((pixels[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        count = np.bincount(nearest, minlength=len(centres))
        sums = np.stack([np.bincount(nearest, pixels[:, c], len(centres)) for c in range(pixels.shape[1])], axis=1)
        moved = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        step, centres = np.sqrt(((moved - centres) ** 2).sum(axis=1)).max(), moved
        if step < LEAST_MOVE:
            break
    nearest = ((pixels[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
    return centres, np.bincount(nearest, minlength=len(centres))


def dominant_colours(df: DataFrame, keys: Sequence[str], channels: Sequence[str], k: int = 5) -> DataFrame:
    """(keys, rank, colour, share): up to k colours of each picture (rows of three channels from 0 to 255), as #rrggbb, the most frequent first.

    Centres that are one colour once rounded are one row, and shares under DUST are left out. Pixels with a null channel do
    not count. A picture is reduced to some thousand pixels before; a group must fit in a task.
    """

    def fold(g: Group) -> Iterator[tuple]:
        pixels = np.array([g[c] for c in channels], float).T
        pixels = pixels[~np.isnan(pixels).any(axis=1)]
        if not len(pixels):
            return
        centres, count = k_means(pixels, k)
        shares: dict[str, float] = {}
        for c, n in zip(np.clip(centres, 0, 255).round().astype(int).tolist(), (count / count.sum()).tolist(), strict=True):
            name = "#" + "".join(f"{v:02x}" for v in c)
            shares[name] = shares.get(name, 0.0) + n
        for rank, (name, share) in enumerate(sorted(shares.items(), key=lambda x: (-round(x[1], 9), x[0]))):
            if share >= DUST:
                yield rank, name, round(share, 3)

    return folded(df, keys, fold, "rank int, colour string, share double", list(channels))

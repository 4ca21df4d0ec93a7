"""Vectorised text helpers over Arrow batches: texts as one byte array with bounds, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
_P = 0x9E3779B97F4A7C15
_PI = pow(_P, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string or binary array; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_string() if pa.types.is_string(col.type) else pa.large_binary()).cast(pa.large_binary())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    data = data[bounds[0] : bounds[-1]]
    starts, ends = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
    if col.null_count:
        gone = np.asarray(col.is_null())
        ends = np.where(gone, starts, ends)
    return data, starts, ends


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each; a longer text forms one of its own."""
    _, starts, ends = flat(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + size, "right")))
        yield batch.slice(i, j - i)
        i = j


def counts_between(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[ends] - total[starts]


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each run of bytes for which the table `inside` holds, and the number of words of each text."""
    w = inside[data]
    first, last = w.copy(), w.copy()
    if len(w):
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        some = ends > starts
        first[starts[some]] = w[starts[some]]
        last[ends[some] - 1] = w[ends[some] - 1]
    at, to = np.flatnonzero(first), np.flatnonzero(last) + 1
    return at, to, np.searchsorted(at, ends) - np.searchsorted(at, starts)


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = 1 << max(21, (n - 1).bit_length())
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _tables[base] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(29))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash mod 2^64 of the bytes; span_hash() takes differences of it."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(data) + 1)[: len(data)], out=total[1:])
    return total


def span_hash(total: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, the same wherever the span stands."""
    return mixed((total[to] - total[at]) * _powers(_PI, len(total))[at] + (to - at).astype(np.uint64))


def shingles(hashes: np.ndarray, n_words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a text, and how many each text has; fewer words form one shingle together."""
    n = len(hashes)
    end = np.cumsum(n_words)
    begin = end - n_words
    doc = np.repeat(np.arange(len(n_words)), n_words)
    at = np.arange(n)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        word = np.zeros(n, np.uint64)
        word[: n - i] = hashes[i:]
        word[at + i >= end[doc]] = 0
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + word
    left = end[doc] - at
    valid = (left >= k) | ((at == begin[doc]) & (left < k))
    return mixed(out[valid]), np.where(n_words > 0, np.maximum(1, n_words - k + 1), 0)

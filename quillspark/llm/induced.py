"""External induced suffix sorting with common-prefix values.

Suffixes are classed as S (smaller than the next one) or L. The S suffixes that follow an L one (S*) are sorted first:
their substrings up to the next S* are named, and the string of names is sorted in the same way, or by rank doubling
where its alphabet is large. Then one pass over the buckets of first characters induces all L suffixes from the S*
ones, and a second one, backwards, all S suffixes from the L ones.

The queue of a pass is monotone: what a scanned suffix induces belongs to a bucket not yet left and comes after
everything induced into it before. So the priority queue is one queue a bucket, and whole runs of tuples (place, common
prefix with the one before) move through it at once. Queues that outgrow `memory` tuples go to an anonymous file.

Common prefixes count up to `depth`; the order of suffixes that agree so far is left open.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY = 1 << 22
LARGE = 512


class Queues:
    """First-in first-out queues of (place, prefix) tuples, one for each character, on disk beyond `memory` tuples."""

    def __init__(self, sigma: int, memory: int) -> None:
        self.parts: list[list] = [[] for _ in range(sigma)]
        self.memory, self.held, self.file, self.end = memory, 0, None, 0

    def push(self, c: int, place: np.ndarray, prefix: np.ndarray) -> None:
        if not len(place):
            return
        self.parts[c].append((place, prefix))
        self.held += len(place)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for parts in self.parts:
            for i, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    self.file.seek(self.end)
                    self.file.write(part[0].astype(np.uint32).tobytes() + part[1].astype(np.uint8).tobytes())
                    parts[i] = (self.end, len(part[0]))
                    self.end += 5 * len(part[0])
        self.held = 0

    def drain(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        places, prefixes = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)]
        for part in self.parts[c]:
            if isinstance(part[0], np.ndarray):
                self.held -= len(part[0])
                places.append(part[0])
                prefixes.append(part[1])
            else:
                self.file.seek(part[0])
                raw = self.file.read(5 * part[1])
                places.append(np.frombuffer(raw, np.uint32, part[1]))
                prefixes.append(np.frombuffer(raw, np.uint8, part[1], 4 * part[1]))
        self.parts[c] = []
        return np.concatenate(places), np.concatenate(prefixes)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low .. high]), both included, for each pair."""
    level = np.zeros(len(low), np.int64)
    width = high - low + 1
    if len(width):
        level = np.log2(width).astype(np.int64)
    out = np.zeros(len(low), values.dtype)
    table, size = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - size + 1])
        if 2 * size <= len(values):
            table = np.minimum(table[: len(table) - size], table[size:])
            size *= 2
    return out


class _Pass:
    """One scan: takes sorted runs of suffixes and pushes what they induce."""

    def __init__(self, text: np.ndarray, is_s: np.ndarray, want_s: bool, sigma: int, depth: int, memory: int) -> None:
        self.text, self.is_s, self.want_s, self.depth = text, is_s, want_s, depth
        self.queues = Queues(sigma, memory)
        self.since = np.zeros(sigma, np.uint8)

    def scan(self, place: np.ndarray, prefix: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Pushes the predecessors of the wanted type; returns those that start with `own`, for the next round."""
        if not len(place):
            return place, prefix
        some = np.flatnonzero(place > 0)
        before = place[some] - np.uint32(1)
        right = self.is_s[before] == self.want_s
        some, before = some[right], before[right]
        mine = (before[:0], prefix[:0])
        first = self.text[before]
        order = np.argsort(first, kind="stable")
        some, before, first = some[order], before[order], first[order]
        bounds = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.zeros(0, np.int64)
        low = np.zeros(len(some), np.int64)
        low[1:] = some[:-1] + 1
        low[bounds] = 0
        got = _least(prefix, low, some)
        chars = first[bounds].astype(np.int64)
        got[bounds] = np.minimum(got[bounds], self.since[chars])
        # The least prefix since the last suffix that was induced into each bucket.
        self.since = np.minimum(self.since, prefix.min())
        ends = np.concatenate([bounds[1:], [len(some)]]) - 1 if len(bounds) else bounds
        rest = np.full(len(prefix) + 1, 255, np.uint8)
        rest[:-1] = np.minimum.accumulate(prefix[::-1])[::-1]
        self.since[chars] = rest[some[ends] + 1] if len(bounds) else self.since[chars]
        got = np.minimum(got, self.depth - 1) + np.uint8(1)
        for c, a, z in zip(chars.tolist(), bounds.tolist(), (ends + 1).tolist(), strict=True):
            if c == own:
                mine = (before[a:z], got[a:z])
            else:
                self.queues.push(c, before[a:z], got[a:z])
        return mine


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the end is smaller than any character."""
    n = len(text)
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64))
    sign[-1] = -1
    at = np.where(sign != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return sign[at] > 0


def _runs(text: np.ndarray, depth: int) -> np.ndarray:
    """How often the first character of each suffix is repeated, up to depth."""
    n = len(text)
    end = np.where(np.concatenate([text[1:] != text[:-1], [True]]), np.arange(n), n)
    end = np.minimum.accumulate(end[::-1])[::-1]
    return np.minimum(end - np.arange(n) + 1, depth).astype(np.uint8)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, up to depth."""
    n = len(text)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    padded = np.concatenate([text.astype(np.int64), np.full(8, -1)]) if text.dtype != np.uint8 else None
    if padded is None:
        wide = np.zeros(n + 16, np.uint8)
        wide[:n] = text
        words = np.lib.stride_tricks.as_strided(wide, (n + 8, 8), (1, 1))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        room = n - np.maximum(x, y)
        if padded is None:
            u, v = words[np.minimum(x, n)].view(np.uint64).ravel(), words[np.minimum(y, n)].view(np.uint64).ravel()
            d = u ^ v
            lowest = np.where(d == 0, np.uint64(1), d & (~d + np.uint64(1))).astype(np.float64)
            same = np.where(d == 0, 8, np.log2(lowest).astype(np.int64) // 8)
            same = np.minimum(same, np.maximum(room, 0))
            step = 8
        else:
            same = ((room > 0) & (padded[np.minimum(x, n)] == padded[np.minimum(y, n)])).astype(np.int64)
            step = 1
        out[live] += same
        live = live[(same == step) & (out[live] < depth)]
    return np.minimum(out, depth).astype(np.uint8)


def _ranks(values: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones."""
    order = np.argsort(values)
    out = np.zeros(len(values), np.int64)
    ordered = values[order]
    out[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
    return out


def _double(names: np.ndarray, steps: int) -> np.ndarray:
    """The order of all suffixes of names by their first `steps` names, by doubling of ranks."""
    rank = _ranks(names).astype(np.uint64)
    width = 1
    while True:
        top = np.uint64(rank.max()) + np.uint64(2)
        if width >= steps or int(top) > len(rank):
            return np.argsort(rank)
        after = np.zeros(len(rank), np.uint64)
        after[:-width] = rank[width:] + np.uint64(1) if width < len(rank) else after[:0]
        both = rank * top + after
        rank = _ranks(both).astype(np.uint64)
        width *= 2


def _names(text: np.ndarray, star: np.ndarray, sigma: int, depth: int) -> np.ndarray:
    """Order-preserving names of the substrings from each S* place to the next one, up to depth characters.

    Characters are packed into 63-bit words; where one substring begins another, the longer is the smaller.
    """
    bits = int(sigma + 1).bit_length()
    per, pad = 63 // bits, sigma + 1
    n, m = len(text), len(star)
    # The end of the text counts as a character below all others.
    length = np.minimum(np.concatenate([star[1:] - star[:-1] + 1, [n - star[-1] + 1]]), depth)
    wide = np.zeros(n + 1, np.uint64)
    wide[:n] = text.astype(np.uint64) + np.uint64(1)

    def word(which: np.ndarray, skip: int) -> np.ndarray:
        out = np.zeros(len(which), np.uint64)
        for i in range(per):
            inside = skip + i < length[which]
            out = (out << np.uint64(bits)) | np.where(inside, wide[np.minimum(star[which] + skip + i, n)], np.uint64(pad))
        return out

    rank = _ranks(word(np.arange(m), 0))
    skip = per
    while (length > skip).any():
        # Only those that are longer than what was packed and not told apart yet.
        count = np.bincount(rank)
        live = np.flatnonzero((count[rank] > 1) & (length > skip))
        if not len(live):
            break
        same = np.flatnonzero(count[rank] > 1)
        part = word(same, skip)
        order = np.lexsort((part, rank[same]))
        r, p = rank[same][order], part[order]
        sub = np.concatenate([[0], np.cumsum((r[1:] == r[:-1]) & (p[1:] != p[:-1]))])
        first = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1])
        extra = np.zeros(m, np.int64)
        extra[same[order]] = sub - np.repeat(sub[first], np.diff(np.concatenate([first, [len(r)]])))
        both = rank * (int(extra.max()) + 1) + extra
        rank = _ranks(both)
        skip += per
    return rank


def star_order(text: np.ndarray, star: np.ndarray, sigma: int, depth: int, memory: int) -> np.ndarray:
    names = _names(text, star, sigma, depth)
    kinds = int(names.max()) + 1
    if kinds == len(names):
        return np.argsort(names)
    steps = depth // 2 + 1
    if kinds > LARGE or depth > 250:
        return _double(names, steps)
    order = np.zeros(len(names), np.int64)
    at = 0
    for place, _ in suffixes(names.astype(np.uint32), kinds, min(steps, 200), memory):
        order[at : at + len(place)] = place
        at += len(place)
    return order[::-1]


def suffixes(text: np.ndarray, sigma: int = 256, depth: int = 200, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the largest to the smallest, in runs (place, prefix): prefix counts what a suffix shares with the one before it.

    depth is at most 254.
    """
    n = len(text)
    if n == 0:
        return
    is_s = _types(text)
    run = _runs(text, depth)
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(star):
        star = star[star_order(text, star, sigma, depth, memory)]
        prefix = np.zeros(len(star), np.uint8)
        prefix[1:] = common_prefix(text, star[:-1], star[1:], depth)
    else:
        prefix = np.zeros(0, np.uint8)
    star_first = text[star]
    bounds = np.searchsorted(star_first, np.arange(sigma + 1))
    forward = _Pass(text, is_s, False, sigma, depth, memory)
    held = Queues(sigma, memory)
    # The last suffix is of type L and has nothing after it that could induce it.
    forward.queues.push(int(text[-1]), np.array([n - 1], np.uint32), np.zeros(1, np.uint8))
    for c in range(sigma):
        last = 0
        place, common = forward.queues.drain(c)
        while len(place):
            common = common.copy()
            common[0] = min(last, int(run[place[0]]))
            held.push(c, place, common)
            last = int(run[place[-1]])
            place, common = forward.scan(place, common, c)
        a, z = bounds[c], bounds[c + 1]
        if z > a:
            common = prefix[a:z].copy()
            common[0] = min(last, int(run[star[a]]))
            forward.scan(star[a:z].astype(np.uint32), common, -1)
    forward.queues.close()
    backward = _Pass(text, is_s, True, sigma, depth, memory)
    for c in range(sigma - 1, -1, -1):
        last = 0
        place, common = backward.queues.drain(c)
        while len(place):
            common = common.copy()
            common[0] = min(last, int(run[place[0]]))
            yield place, common
            last = int(run[place[-1]])
            place, common = backward.scan(place, common, c)
        place, common = held.drain(c)
        if len(place):
            # Backwards, a suffix's prefix is what it shares with the next larger one.
            shared = np.concatenate([[min(last, int(run[place[-1]]))], common[:0:-1]]).astype(np.uint8)
            place = place[::-1].copy()
            yield place, shared
            backward.scan(place, shared, -1)
    backward.queues.close()
    held.close()

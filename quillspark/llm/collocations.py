"""Phrase collocation mining: HAT-tries in tasks, their subtrees merged as sorted runs per prefix partition.

Phrases of one word are counted first, then of two, and so on. A task holds a trie of word ids for each language: a
child of the root is a hash container of the rest of a phrase, which bursts into a node with containers of its own when
it has too many entries. Beyond ENTRIES counts in all tries, whole subtrees are spilled, the largest first, as runs
sorted by phrase. Runs are dealt to prefix partitions and merged there, neighbour by neighbour.

A phrase of m words can reach `least` only if both its parts of m - 1 words do. Such parts are marked in a table of bits
(the sieve) that the next pass reads: a false mark costs a row and changes nothing, since every kept count is exact.

Scale: a task emits a phrase once a spill, so common phrases are one row a task. The sieve has at most MAX_CELLS bits
(8 MB). A prefix partition is a first word; words with more than 1 / HOT of all occurrences (at most HOT of them) are
divided by their second word, such pairs by their third, and so on. Joins of counts are plain equi joins.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, seeded
from .textnp import chunks

#: Ids of three words fit in one 64-bit key; a task begins a new vocabulary before it has more words.
BITS = 21
ENTRIES, BURST, CHUNK, PENDING = 3 << 18, 4096, 1 << 22, 1 << 22
LEAST_CELLS, MAX_CELLS = 1 << 16, 1 << 26
HOT, PARTS, SALTS, BANDS = 1000, 1 << 16, 64, 1000
#: Odd factors under 2^28, so that sums of five products with a 32-bit checksum stay under 2^63.
FACTORS = [0xB5297A5, 0x9E3779B, 0xC2B2AE3, 0x85EBCA7, 0xA7C1567]
STOPS = ".,;:!?\n\x0b\x0c\r"
_END = re.compile(rb"[. ]")
_MAP = bytes.maketrans(STOPS.encode() + b"\t", b"." * len(STOPS) + b" ")


class Node(dict):
    """Children by next word id: nodes or containers (plain dicts from the packed rest of a phrase to its count)."""


class HatTrie:
    """Counts of phrases of `length` word ids, packed in integers with the first id highest."""

    def __init__(self, length: int, burst: int = BURST) -> None:
        self.length, self.burst = length, burst
        self.root: Node | dict = Node() if length > 1 else {}
        self.sizes: dict[int, int] = {}

    def __len__(self) -> int:
        return sum(self.sizes.values()) if self.length > 1 else len(self.root)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys ascend."""
        if self.length == 1:
            self._fill(self.root, keys.tolist(), counts.tolist())
        else:
            self._descend(self.root, self.length - 1, keys, counts, self.sizes)

    @staticmethod
    def _fill(container: dict, keys: list, counts: list) -> int:
        before, get = len(container), container.get
        for k, n in zip(keys, counts, strict=True):
            container[k] = get(k, 0) + n
        return len(container) - before

    def _descend(self, node: Node, rest: int, keys: np.ndarray, counts: np.ndarray, sizes: dict | None) -> int:
        """`rest`: ids below the node's children. Returns the number of new phrases."""
        first = keys >> (BITS * rest)
        below = keys & ((1 << BITS * rest) - 1)
        bounds = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(keys)] if len(keys) else [0]
        heads, low, number, added = first.tolist(), below.tolist(), counts.tolist(), 0
        for a, b in zip(bounds, bounds[1:], strict=False):
            child = node.get(heads[a])
            if child is None:
                child = node[heads[a]] = {}
            if isinstance(child, Node):
                new = self._descend(child, rest - 1, below[a:b], counts[a:b], None)
            else:
                new = self._fill(child, low[a:b], number[a:b])
                if rest > 1 and len(child) > self.burst:
                    node[heads[a]] = self._burst(child, rest - 1)
            added += new
            if sizes is not None:
                sizes[heads[a]] = sizes.get(heads[a], 0) + new
        return added

    @staticmethod
    def _burst(container: dict, rest: int) -> Node:
        node = Node()
        for k, n in container.items():
            node.setdefault(k >> (BITS * rest), {})[k & ((1 << BITS * rest) - 1)] = n
        return node

    def _gather(self, child: dict, rest: int) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(child, Node):
            return np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
        parts = [(k << (BITS * (rest - 1)), *self._gather(x, rest - 1)) for k, x in child.items()]
        return np.concatenate([keys + k for k, keys, _ in parts]), np.concatenate([n for _, _, n in parts])

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes whole subtrees out, the largest first, until at most `keep` phrases are left; their keys and counts."""
        if self.length == 1:
            out = self._gather(self.root, 1)
            self.root = {}
            return out
        taken, left = [], len(self)
        for word in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if left <= keep:
                break
            left -= self.sizes.pop(word)
            keys, counts = self._gather(self.root.pop(word), self.length - 1)
            taken.append((keys + (word << (BITS * (self.length - 1))), counts))
        if not taken:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([k for k, _ in taken]), np.concatenate([n for _, n in taken])


class Vocabulary(dict):
    """Word to id, in order of first sight; id 0 is the break between pieces."""

    def __init__(self) -> None:
        super().__init__({b".": 0})
        self.words, self.sums = [b"."], array("q", [0])

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.words)
        self.words.append(word)
        self.sums.append(zlib.crc32(word))
        return i

    def checksums(self) -> np.ndarray:
        return np.frombuffer(self.sums, np.int64).copy()


def segments(text: bytes, length: int, size: int = CHUNK) -> Iterator[bytes]:
    """Parts of a mapped text (stops are `.`, blanks are spaces), each phrase of `length` words in one of them.

    Parts have about `size` bytes. They end at stops; a piece longer than that is cut at a blank, and the next part
    begins with the last length - 1 words again.
    """
    at, carry = 0, b""
    while len(text) - at > size:
        end = text.rfind(b".", at, at + size)
        if end < 0:
            found = _END.search(text, at + size)
            end = found.start() if found else len(text)
        part = carry + text[at:end]
        yield part
        inside = end < len(text) and text[end : end + 1] == b" "
        carry = b" ".join(part.rsplit(None, length - 1)[1 - length :]) + b" " if inside and length > 1 else b""
        at = end + 1
    yield carry + text[at:]


def _cells(lang_sum: int, sums: list[np.ndarray], cells: int) -> np.ndarray:
    """Cells of phrases, given the checksums of their words."""
    total = np.int64(lang_sum * FACTORS[0])
    for s, f in zip(sums, FACTORS[1:], strict=False):
        total = total + s * np.int64(f)
    return (total >> np.int64(20)) & np.int64(cells - 1)


def cell(lang: Column, words: list[Column], cells: int) -> Column:
    """The same in Spark."""
    sums = [F.crc32(F.encode(x, "UTF-8")) * F.lit(f) for x, f in zip([lang, *words], FACTORS, strict=False)]
    return F.shiftright(reduce(Column.__add__, sums), 20).bitwiseAND(F.lit(cells - 1))


def sieve(frequent: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """A table of bits (bytes, number of bits) that marks the phrases of frequent (lang, phrase)."""
    rows = frequent.count()
    cells = min(MAX_CELLS, max(LEAST_CELLS, 1 << math.ceil(math.log2(max(1, 16 * rows)))))
    words = F.split("phrase", " ")
    marked = frequent.select(cell(F.col("lang"), [F.get(words, F.lit(i)) for i in range(length)], cells).alias("cell"))
    bits = marked.groupBy(F.shiftright("cell", 5).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 31 as int)))").alias("bits")).toArrow()
    table = np.zeros(cells // 32, "<u4")
    table[np.asarray(bits["at"])] = np.asarray(bits["bits"]).astype("<u4")
    return table.view(np.uint8), cells


def count_runs(length: int, marks: tuple[np.ndarray, int] | None, hot: dict[int, set], entries: int = ENTRIES, burst: int = BURST) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (lang, text) to sorted runs (part, lang, phrase, n). hot: by number of words, the (lang, phrase) that are divided further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}
        # Phrases of some chunks together, so that the trie is walked once for them.
        pending: dict[str, list[np.ndarray]] = {}
        vocabulary = Vocabulary()

        def settle(lang: str) -> None:
            tries.setdefault(lang, HatTrie(length, burst)).add(*np.unique(np.concatenate(pending.pop(lang)), return_counts=True))

        def ids_of(keys: np.ndarray) -> list[np.ndarray]:
            return [(keys >> (BITS * (length - 1 - i))) & ((1 << BITS) - 1) for i in range(length)]

        def sorted_run(lang: str, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            ids, crc, own = ids_of(keys), vocabulary.checksums(), zlib.crc32(lang.encode())
            words = pa.array(vocabulary.words, pa.large_binary())
            columns = [words.take(pa.array(x)) for x in ids]
            phrases = columns[0] if length == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary()))
            part, open_ = _cells(own, [crc[ids[0]]], PARTS), np.ones(len(keys), bool)
            prefix = ids[0]
            for k in range(1, length):
                known = [tuple(vocabulary.get(w.encode(), -1) for w in p.split(" ")) for x, p in hot.get(k, ()) if x == lang]
                packed = [sum(i << (BITS * (k - 1 - j)) for j, i in enumerate(t)) for t in known if -1 not in t]
                open_ &= np.isin(prefix, np.array(packed, np.int64))
                part = np.where(open_, _cells(own, [crc[x] for x in ids[: k + 1]], PARTS), part)
                prefix = (prefix << BITS) | ids[k]
            order = np.asarray(pc.sort_indices(phrases))
            for at in range(0, len(order), 1 << 16):
                some = pa.array(order[at : at + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(part[order[at : at + (1 << 16)]]), pa.array([lang] * len(some), pa.string()), phrases.take(some).cast(pa.large_string()).cast(pa.string()), pa.array(counts[order[at : at + (1 << 16)]])], ["part", "lang", "phrase", "n"])

        def relieve(keep: int) -> Iterator[pa.RecordBatch]:
            for lang in list(pending):
                settle(lang)
            for lang in sorted(tries, key=lambda x: -len(tries[x])):
                if sum(map(len, tries.values())) <= keep:
                    break
                yield from sorted_run(lang, *tries[lang].spill(max(0, keep // len(tries))))
            for lang in [x for x, t in tries.items() if not len(t)]:
                del tries[lang]

        for batch in batches:
            for piece in chunks(batch, "text", CHUNK):
                texts: dict[str, list[bytes]] = {}
                for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                    if text:
                        texts.setdefault(lang, []).append(text)
                for lang, some in texts.items():
                    for part in segments(b".".join(some).lower().translate(_MAP), length):
                        tokens = part.replace(b".", b" . ").split()
                        if len(vocabulary) + len(tokens) >= 1 << BITS:
                            yield from relieve(0)
                            vocabulary = Vocabulary()
                        ids = np.fromiter(map(vocabulary.__getitem__, tokens), np.int64, len(tokens))
                        windows = [ids[i : len(ids) - length + 1 + i] for i in range(length)] if len(ids) >= length else [ids[:0]] * length
                        held = reduce(np.logical_and, [w != 0 for w in windows])
                        if marks is not None:
                            table, cells = marks
                            crc = vocabulary.checksums()[ids]
                            at = _cells(zlib.crc32(lang.encode()), [crc[i : len(ids) - length + 2 + i] for i in range(length - 1)], cells) if len(ids) >= length else np.zeros(0, np.int64)
                            there = (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                            held &= (there[:-1] & there[1:]) if len(there) else held
                        keys = reduce(lambda a, b: (a << BITS) | b, [w[held] for w in windows])
                        pending.setdefault(lang, []).append(keys)
                    if sum(len(k) for keys in pending.values() for k in keys) >= min(PENDING, 8 * entries):
                        for one in list(pending):
                            settle(one)
                    if sum(map(len, tries.values())) > entries:
                        yield from relieve(entries // 2)
        yield from relieve(0)

    return run


def merge_runs(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums neighbours of batches (lang, phrase, n) that are sorted by phrase and lang; sums below `least` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["lang", "phrase", "n"], None
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(names)
            table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
            if not table.num_rows:
                continue
            lang, phrase, n = (table[c] for c in names)
            new = pc.or_(pc.not_equal(phrase[1:], phrase[:-1]), pc.not_equal(lang[1:], lang[:-1]))
            starts = np.flatnonzero(np.concatenate([[True], np.asarray(new)]))
            sums = np.add.reduceat(np.asarray(n), starts)
            merged = table.take(pa.array(starts)).set_column(2, "n", pa.array(sums))
            held = merged.slice(merged.num_rows - 1)
            whole = merged.slice(0, merged.num_rows - 1)
            yield from whole.filter(pc.greater_equal(whole["n"], least)).to_batches()
        if held is not None:
            yield from held.filter(pc.greater_equal(held["n"], least)).to_batches()

    return run


def counted(docs: DataFrame, length: int, least: int, marks: tuple[np.ndarray, int] | None, hot: dict[int, set]) -> DataFrame:
    """(lang, phrase, n): all phrases of `length` words of docs (lang, text) with n >= least, written."""
    ship(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = docs.mapInArrow(count_runs(length, marks, hot), "part long, lang string, phrase string, n long")
    dealt = runs.repartition(parts, "part").sortWithinPartitions("phrase", "lang").select("lang", "phrase", "n")
    return cut(dealt.mapInArrow(merge_runs(least), "lang string, phrase string, n long"), f"phrases-{length}")


def phrase_counts(docs: DataFrame, max_words: int, least: int) -> dict[int, DataFrame]:
    """Counts (lang, phrase, n) of all phrases by number of words: every word, and longer phrases with n >= least."""
    levels = {1: counted(docs, 1, 1, None, {})}
    total = levels[1].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot: dict[int, set] = {}
    for length in range(2, max_words + 1):
        before = levels[length - 1].where(F.col("n") >= least)
        # At most HOT of them, since they share `total` occurrences.
        hot[length - 1] = {(r["lang"], r["phrase"]) for r in before.where(F.col("n") * HOT >= total).select("lang", "phrase").collect()}
        levels[length] = counted(docs, length, least, sieve(before, length - 1), hot)
    return levels


def scored(levels: dict[int, DataFrame], length: int, scale: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of `length` words, by their lowest-scoring cut."""
    rows, cuts = levels[length].withColumnRenamed("n", "a"), []
    for k in range(1, length):
        first = levels[k].select("lang", F.col("phrase").alias("first"), F.col("n").alias(f"l{k}"))
        rest = levels[length - k].select("lang", F.col("phrase").alias("rest"), F.col("n").alias(f"r{k}"))
        rows = rows.withColumn("first", F.substring_index("phrase", " ", k)).withColumn("rest", F.substring_index("phrase", " ", k - length))
        rows = rows.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).drop("first", "rest")
        wide = lambda c: F.col(c).cast("decimal(15,0)")
        rows = rows.withColumn("above", wide("a") * wide("a") * F.lit(scale).cast("decimal(7,0)")).withColumn("below", wide(f"l{k}") * wide(f"r{k}"))
        rows = rows.withColumn(f"s{k}", F.expr("above div below").cast("long")).drop("above", "below")
        cuts.append(F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return rows.withColumn("cut", best).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(levels: dict[int, DataFrame], length: int) -> DataFrame | None:
    """(lang, phrase, most): phrases of `length` words inside longer ones, and the largest count of those."""
    longer = [(m, levels[m]) for m in levels if m > length]
    if not longer:
        return None
    inside = [t.select("lang", F.array_join(F.slice(F.split("phrase", " "), i + 1, length), " ").alias("phrase"), "n") for m, t in longer for i in range(m - length + 1)]
    return reduce(DataFrame.unionByName, inside).groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def best_bands(rows: DataFrame, top: int, scale: int) -> DataFrame:
    """The rows (lang, score, ...) of the BANDS bands of scores that can hold a language's first `top`, found by counts alone."""
    band = F.floor(F.col("score") * BANDS / (scale + 1))
    above = Window.partitionBy("lang").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("lang", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    open_ = counts.where("n > 0").withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).where(F.col("above") < top)
    return rows.withColumn("band", band).join(open_.select("lang", "band"), ["lang", "band"], "left_semi").drop("band")


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, cover: tuple[int, int] = (50, 100), top: int = 2000, scale: int = 1_000_000) -> DataFrame:
    """Each language's first `top` phrases: (lang, rank, phrase, a, l, r, n, score), all numbers long.

    docs: (lang, text); null lang is `und`, null text is empty, other columns are not read. A-Z is lower-cased; pieces
    end at stops and line ends, words at spaces and tabs. A candidate has 2 to max_words words (3 at most, as ids
    are packed) and a >= least occurrences. Its score is floor(scale * a * a / (l * r)) at its lowest-scoring cut, the first among
    equals. It goes if a longer candidate that holds it has cover[0] / cover[1] of its occurrences. Order: score
    and a descending, phrase ascending by bytes. Repeated rows count as often as they stand; an empty table, or one
    without candidates, gives an empty result.
    """
    if not 2 <= max_words <= 63 // BITS:
        raise ValueError(f"max_words must be 2 to {63 // BITS}")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    levels = phrase_counts(texts, max_words, least)
    words = levels[1].groupBy("lang").agg(F.sum("n").alias("n"))
    levels[1] = levels[1].where(F.col("n") >= least)
    kept = []
    for length in range(2, max_words + 1):
        rows, over = scored(levels, length, scale), covered(levels, length)
        if over is not None:
            rows = rows.join(over, ["lang", "phrase"], "left").where(~F.coalesce(F.col("most") * cover[1] >= F.col("a") * cover[0], F.lit(False))).drop("most")
        kept.append(rows)
    rows = cut(reduce(DataFrame.unionByName, kept), "phrases-scored")
    rows = best_bands(rows, top, scale).withColumn("salt", F.pmod(seeded(6, "phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

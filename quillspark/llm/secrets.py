"""Secret scans: patterns, and character Markov models of random strings and of ordinary identifiers.

Patterns find what has a telling form. The method finds the rest: two first-order Markov models of characters are
counted from labelled samples, and a string whose log-likelihood under the model of random strings exceeds that under
the model of ordinary ones by `margin` is a span of kind `markov`. A pair of characters costs one look-up, so a
batch of texts is scored by one running sum.

Labelled samples: identifiers inside what a pattern took for a value are random, all others in the corpus are ordinary,
and seeded random strings of the usual alphabets are added, since a corpus rarely shows all of them. Counts are taken
over the whole corpus, a table of CLASSES x CLASSES numbers a task, and summed by Spark.

Scale: no shuffle of texts; two tables of 67 x 67 counts go to the driver, whatever the input. Texts are scanned whole.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .textnp import chunks, words

#: The patterns of the kinds of base spans, in order. The least lengths are the values' of `assign`, the whole matches' of the others.
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = [*LEAST, "markov"]
_assign = re.compile(ASSIGN, re.IGNORECASE)
# The least lengths are part of these two: a greedy run that is too short holds no longer one.
_access = re.compile(rb"AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4))
_hex = re.compile(rb"[0-9a-f]{%d,}" % LEAST["hex"])

#: A string must be this long to be judged, and differ by this much (natural logarithm).
LEAST_CHARS, MARGIN = 16, 12.0
#: Seeded samples: so many strings of each alphabet and length.
SAMPLES, LENGTHS = 200, (16, 24, 32, 40, 64)
ALPHABETS = [string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_uppercase + "234567"]

#: Characters of identifiers, each a class of its own; class 0 is the end of a string.
CHARACTERS = string.ascii_letters + string.digits + "+/_-"
CLASSES = len(CHARACTERS) + 1
CODE = np.zeros(256, np.int16)
CODE[np.frombuffer(CHARACTERS.encode(), np.uint8)] = np.arange(1, CLASSES)
INSIDE = CODE > 0


@dataclass
class Texts:
    """Some texts as one array of bytes, a line end between them, which no pattern and no identifier holds."""

    raw: bytes
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Texts:
        whole = [x or b"" for x in texts]
        return cls(b"\n".join(whole), np.cumsum([0, *(len(x) + 1 for x in whole)])[:-1].astype(np.int64))

    @property
    def data(self) -> np.ndarray:
        return np.frombuffer(self.raw, np.uint8)

    def identifiers(self) -> tuple[np.ndarray, np.ndarray]:
        at, to, _ = words(self.data, np.zeros(1, np.int64), np.array([len(self.raw)]), INSIDE)
        return at, to

    def base(self) -> list[tuple[int, int, int, int]]:
        """(start, kind's number, end, start of the value) of the patterns' matches, in bytes, by start and kind."""
        found = [(m.start(), 0, m.end(), m.start(2)) for m in _assign.finditer(self.raw) if m.end(2) - m.start(2) >= LEAST["assign"]]
        found += [(m.start(), kind, m.end(), m.start()) for kind, x in ((1, _access), (2, _hex)) for m in x.finditer(self.raw)]
        return sorted(found)

    def covered(self, spans: list[tuple[int, int]]) -> np.ndarray:
        """Whether each byte lies in one of the spans."""
        edges = np.zeros(len(self.raw) + 1, np.int32)
        for a, b in spans:
            edges[a] += 1
            edges[b] -= 1
        return np.cumsum(edges)[:-1] > 0

    def places(self, spans: list[tuple[int, int, int]]) -> list[list[dict]]:
        """By text, the spans (start, kind's number, end) in code points from the text's start."""
        out: list[list[dict]] = [[] for _ in self.starts]
        if spans:
            chars = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
            row = np.searchsorted(self.starts, [a for a, _, _ in spans], "right") - 1
            for i, (a, kind, b) in zip(row.tolist(), spans, strict=True):
                begin = chars[self.starts[i]]
                out[i].append({"kind": KINDS[kind], "start": int(chars[a] - begin), "end": int(chars[b] - begin)})
        return out


def pair_counts(data: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Counts of neighbours, CLASSES * CLASSES, in the strings data[at:to], their ends included."""
    code = CODE[data].astype(np.int64)
    edges = np.zeros(len(data) + 1, np.int32)
    edges[at] += 1
    edges[to] -= 1
    inside = np.cumsum(edges)[:-1] > 0
    inside[at] = False
    inner = np.flatnonzero(inside)
    pairs = np.concatenate([code[inner - 1] * CLASSES + code[inner], code[at], code[to - 1] * CLASSES])
    return np.bincount(pairs, minlength=CLASSES * CLASSES)


def scores(data: np.ndarray, at: np.ndarray, to: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each string data[at:to], its ends included."""
    if not len(at):
        return np.zeros(0)
    code = CODE[data].astype(np.int64)
    total = np.concatenate([[0.0], np.cumsum(ratio[code[:-1], code[1:]])])
    return total[to - 1] - total[at] + ratio[0, code[at]] + ratio[code[to - 1], 0]


def seeded_counts(seed: int) -> np.ndarray:
    """Counts of SAMPLES random strings of each alphabet and length."""
    draw = random.Random(seed)
    texts = Texts.of(["".join(draw.choices(a, k=n)).encode() for a in ALPHABETS for n in LENGTHS for _ in range(SAMPLES)])
    return pair_counts(texts.data, *texts.identifiers()).reshape(CLASSES, CLASSES)


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """Counts [ordinary, random] of neighbours in all identifiers of docs (text), by whether a pattern's value holds them."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CLASSES * CLASSES), np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = Texts.of(part.column("text").cast(pa.large_binary()).to_pylist())
                at, to = texts.identifiers()
                secret = texts.covered([(value, b) for _, _, b, value in texts.base()])[at] if len(at) else np.zeros(0, bool)
                for label, kept in enumerate((~secret, secret)):
                    total[label] += pair_counts(texts.data, at[kept], to[kept])
        label, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[label, pair])], ["label", "pair", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "label int, pair int, n long")
    out = np.zeros((2, CLASSES * CLASSES), np.int64)
    for r in rows.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        out[r["label"], r["pair"]] = r["n"]
    return out.reshape(2, CLASSES, CLASSES)


def train(counts: np.ndarray, seed: int = 17) -> np.ndarray:
    """Log-likelihood ratios, random over ordinary, of a character after another; counts: [ordinary, random].

    The corpus's random samples weigh as much as the seeded ones at most, so that a corpus of one alphabet does not hide
    the others. Cells are smoothed by one, so that what no sample shows is judged alike by both.
    """
    known, added = counts.astype(np.float64), seeded_counts(seed)
    share = min(1.0, added.sum() / max(1.0, known[1].sum()))
    both = np.stack([known[0], known[1] * share + added])
    chance = np.log((both + 1) / (both.sum(axis=2, keepdims=True) + CLASSES))
    return chance[1] - chance[0]


def _scanner(ratio: np.ndarray, margin: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                texts = Texts.of(part.column("__text").cast(pa.large_binary()).to_pylist())
                base = [x[:3] for x in texts.base()]
                at, to = texts.identifiers()
                long = to - at >= LEAST_CHARS
                at, to = at[long], to[long]
                found = scores(texts.data, at, to, ratio) > margin
                at, to = at[found], to[found]
                if base and len(at):
                    taken = np.concatenate([[0], np.cumsum(texts.covered([(a, b) for a, _, b in base]))])
                    free = taken[at] == taken[to]
                    at, to = at[free], to[free]
                every = sorted(base + [(a, KINDS.index("markov"), b) for a, b in zip(at.tolist(), to.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("__row"), pa.array(texts.places(base), kind), pa.array(texts.places(every), kind)], ["__row", "base", "spans"])

    return run


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, ratio: np.ndarray, margin: float = MARGIN, names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """Rows of docs (text, ...) with their patterns' spans and all spans: arrays of (kind, start, end) by start and kind.

    Places are code points, the end exclusive. Patterns match leftmost, without overlaps within a kind, and a match
    whose value is too short is dropped. Strings that look random are runs of at least LEAST_CHARS letters, digits and
    +/_-; those that meet a pattern's span are left to it. Null and empty texts have empty arrays. Repeated rows
    are scanned each. Columns that carry the new names are replaced; all others pass through. An empty table gives an
    empty result.
    """
    ship(docs.sparkSession)
    docs = docs.drop(*names)
    own = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("__row"), F.col("text").cast("string").alias("__text"))
    kinds = T.StructType([*rows.select("__row").schema.fields, T.StructField("base", SPANS), T.StructField("spans", SPANS)])
    return rows.mapInArrow(_scanner(ratio, margin), kinds).select("__row.*", F.col("base").alias(names[0]), F.col("spans").alias(names[1]))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

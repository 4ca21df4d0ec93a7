"""Embedding near-duplicates by spherical-cap filters.

Filters are directions of a structured random product code: after a random rotation a vector is cut into blocks, each
block has its own codebook of random unit directions, and a filter is one codeword of each block. A vector is
list-decoded to all filters that its projection exceeds: codewords are combined block after block, and a partial sum
that the best of the remaining blocks cannot lift over the threshold goes. Vectors that share a filter are compared by
cosine in double precision.

The threshold is set by the number of vectors n, so that about OCCUPANCY of n unrelated vectors exceed a filter, and a
code would have so many filters that a vector exceeds LIST on average if projections were normal (a product code's
tails are lighter, and lists get shorter as n grows). Codes are repeated with new rotations until two vectors at the
threshold cosine miss each other with probability under MISS; where that takes many codes, OCCUPANCY is raised.
Recall is measured against brute force in the tests.

Equal vectors are one class. Filters with one member go before vectors are moved. A large filter is cut into blocks
of at most BLOCK members, and pairs of blocks are compared in tasks of their own, so a hot group never sits in one
task. A pair that shares several filters counts in the least one. Links are counted in the task: no row a pair is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, seeded
from .graph import components

OCCUPANCY, LIST, MISS, BLOCK = 0.1, 20, 5e-3, 1024
CODES, MOST, RECALL, PAIRS = 48, 1000, 0.9, 3000


class Code:
    """One product code: a rotation, a codebook for each block, and the threshold that a share of vectors exceeds."""

    def __init__(self, share: float, dim: int, rng: np.random.Generator) -> None:
        total = LIST / share
        self.m = min(dim, max(1, math.ceil(math.log(total) / math.log(5000))))
        # One component has two directions, whatever the number of vectors.
        self.b = max(2, math.ceil(total ** (1 / self.m))) if dim > 1 else 2
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = [round(i * dim / self.m) for i in range(self.m + 1)]
        self.books = []
        for a, z in zip(self.cuts, self.cuts[1:], strict=False):
            c = rng.standard_normal((self.b, z - a))
            self.books.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        self.least = NormalDist().inv_cdf(1 - share) * math.sqrt(self.m / dim) if dim > 1 else 0.5
        if dim == 1:
            self.books = [np.array([[1.0], [-1.0]])]

    def decode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for each filter of each unit vector, in order of rows."""
        n = len(v)
        v = v @ self.rotation
        scores = [v[:, a:z] @ book.T for a, z, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]
        best = [s.max(1) for s in scores]
        row, code, total = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
        for j, s in enumerate(scores):
            low = self.least - sum(best[j + 1 :], np.zeros(n))
            most = np.full(n, -np.inf)
            np.maximum.at(most, row, total)
            # The codewords that can go on with the best partial sum of their row, then each partial sum with each of them.
            at, which = np.nonzero(s >= (low - most)[:, None])
            count = np.bincount(at, minlength=n)
            start, many = np.cumsum(count) - count, count[row]
            part = np.repeat(np.arange(len(row)), many)
            some = np.arange(len(part)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[row], many)
            sums = total[part] + s[at[some], which[some]]
            kept = np.flatnonzero(sums >= low[row[part]])
            part, some = part[kept], some[kept]
            row, code, total = row[part], code[part] * self.b + which[some], sums[kept]
        return row, code


class Filters:
    """As many codes for n vectors of `dim` components as links at cosine rho need.

    A random rotation makes all pairs of one cosine alike, so the share of pairs that meet in a code is taken from
    simulated pairs (its lower bound of two standard errors), and codes are added until a pair misses all of them with
    probability under MISS. Where that takes more than CODES codes, filters that more vectors exceed are tried. What
    the codes find together is then taken from new pairs: under RECALL is an error.
    """

    def __init__(self, n: int, dim: int, rho: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        best, share = None, min(0.01, OCCUPANCY / max(1, n))
        while True:
            code = Code(share, dim, rng)
            count = self._needed(code, dim, rho, rng)
            if best is None or count < best[0]:
                best = (count, share, code)
            # Vectors of few components never exceed the threshold of a small share.
            if best[0] <= CODES or share == 0.5:
                break
            share = min(0.5, 4 * share)
        count, share, code = best
        if count > MOST:
            raise ValueError(f"links at cosine {rho} among {n} vectors of {dim} components would take {count} codes")
        self.codes = [code, *(Code(share, dim, rng) for _ in range(int(count) - 1))]
        x, y = _pairs(400, dim, rho, rng)
        self.recall = _met(self.decode(x), self.decode(y), len(x))
        if self.recall < RECALL:
            raise ValueError(f"{len(self.codes)} codes find {self.recall:.3f} of the links at cosine {rho} among {n} vectors of {dim} components")

    @staticmethod
    def _needed(code: Code, dim: int, rho: float, rng: np.random.Generator) -> float:
        x, y = _pairs(PAIRS, dim, rho, rng)
        met = _met(code.decode(x), code.decode(y), len(x))
        low = min(0.99, met - 2 * math.sqrt(met * (1 - met) / PAIRS))
        return math.ceil(math.log(MISS) / math.log1p(-low)) if low > 0 else math.inf

    def decode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, found = zip(*(c.decode(v) for c in self.codes), strict=True)
        row, code = np.concatenate(rows), np.concatenate([np.int64(i * c.b**c.m) + x for i, (c, x) in enumerate(zip(self.codes, found, strict=True))])
        order = np.lexsort((code, row))
        return row[order], code[order]


def _met(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], n: int) -> float:
    """The share of n rows that have a filter in common."""
    both = np.intersect1d(np.stack(x, 1).astype(np.int64).view("i8,i8"), np.stack(y, 1).astype(np.int64).view("i8,i8"))
    return len(np.unique(both["f0"])) / n


def _pairs(count: int, dim: int, rho: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors x and y, each pair at cosine rho."""
    x, y = _unit(rng.standard_normal((count, dim))), _unit(rng.standard_normal((count, dim)))
    return x, rho * x + math.sqrt(1 - rho * rho) * _unit(y - (y * x).sum(1, keepdims=True) * x) if dim > 1 else x


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), float).reshape(len(col), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(rho: float):  # noqa: ANN202
    """A kernel over many filters' members: (k, links, root), links of each member counted where its pair's least filter is."""

    def kernel(table: pa.Table) -> pa.Table:
        cols = {c: np.asarray(table.column(c)) for c in ("f", "i", "j", "own", "k", "copies")}
        order = np.lexsort((cols["own"], cols["j"], cols["i"], cols["f"]))
        cols = {c: x[order] for c, x in cols.items()}
        v = _unit(_matrix(table.column("v")))[order]
        lists = table.column("filters").combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets))
        flat, starts = np.asarray(lists.flatten()), np.asarray(lists.offsets)[:-1] - np.asarray(lists.offsets)[0]
        n, f = len(order), cols["f"]
        new = np.flatnonzero((np.diff(f) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0)) + 1
        bounds = [0, *new.tolist(), n]
        links, pair_a, pair_b = np.zeros(n, np.int64), [], []
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            if z - a < 2:
                continue
            c = v[a:z] @ v[a:z].T
            hit = c >= rho
            if cols["i"][a] == cols["j"][a]:
                np.fill_diagonal(hit, False)
            else:
                hit &= cols["own"][a:z, None] != cols["own"][None, a:z]
            if not hit.any():
                continue
            x, y = np.nonzero(np.triu(hit))
            pair_a.append(x + a)
            pair_b.append(y + a)
            # Pairs that share a smaller filter are counted there.
            rows = np.flatnonzero(hit.any(1))
            own = [flat[starts[order[a + r]] : starts[order[a + r]] + sizes[order[a + r]]] for r in rows]
            own = [x[x < f[a]] for x in own]
            seen, place = np.unique(np.concatenate(own), return_inverse=True)
            member = np.zeros((len(rows), len(seen)), np.float32)
            member[np.repeat(np.arange(len(rows)), [len(x) for x in own]), place] = 1
            fresh = hit[np.ix_(rows, rows)] & (member @ member.T == 0)
            links[a + rows] += (fresh * cols["copies"][a + rows][None, :]).sum(1)
        if pair_a:
            # The same vector stands in several filters: rows of a vector are joined, too.
            keys, at = np.unique(cols["k"], return_inverse=True)
            x, y = at[np.concatenate(pair_a)], at[np.concatenate(pair_b)]
            label = _labels(len(keys), x, y)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, links)
            some = np.unique(np.concatenate([x, y]))
            return pa.table({"k": keys[some], "links": total[some], "root": keys[label[some]]})
        return pa.table({"k": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})

    return kernel


def _links(classes: DataFrame, n: int, dim: int, rho: float, seed: int) -> DataFrame:
    """(k, links, root) of n classes (k, v, copies) whose vectors have `dim` components."""
    code = Filters(n, dim, rho, seed)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, found = code.decode(_unit(_matrix(part.column("v"))))
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(part.column("k"))[row]), pa.array(found)], ["k", "f"])

    member = cut(classes.select("k", "v").mapInArrow(decode, "k long, f long"), "near-filters")
    # Ids of filters are spread by a hash, since codewords that many vectors exceed are neighbours.
    size = member.groupBy("f").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = member.join(size, "f")
    lists = shared.groupBy("k").agg(F.collect_list("f").alias("filters"))
    full = shared.join(classes, "k").join(lists, "k").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    full = full.withColumn("own", F.pmod(seeded(seed + 1, "k", "f"), F.col("blocks")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = full.select("f", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "copies", "v", "filters")
    tasks = max(16, min(100_000, n * 8 // 4000))
    groups = full.withColumn("g", F.pmod(seeded(seed + 2, "f", "i", "j"), F.lit(tasks)).cast("int"))
    return cut(groups.groupBy("g").applyInArrow(_compare(rho), "k long, links long, root long"), "near-links")


def near_duplicates(vectors: DataFrame, rho: float = 0.95, seed: int = 0) -> DataFrame:
    """(vec_id, n_links long, component_id, kept boolean) for each row of vectors (vec_id, embedding).

    Two rows are linked if the cosine of their vectors is at least rho. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing; vectors of different lengths are not compared. Equal vectors are
    linked. component_id is the smallest vec_id that links reach; null ids are passed over, and a row whose component
    has no other id has null. kept: vec_id is component_id (null ids: false). Repeated rows are vectors of their own.
    An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    # Of one component only the sign counts, so that all vectors of a sign are one class.
    v = F.when(F.size("embedding") == 1, F.transform(v, lambda x: F.when(F.abs(x) < float("inf"), F.signum(x)).otherwise(x))).otherwise(v)
    good = F.col("embedding").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding", v.alias("v"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    # A key stands for one vector: where two have the same hash, another hash is taken.
    while True:
        keyed = rows.withColumn("k", F.when(F.col("good"), seeded(seed, "v")))
        classes = cut(keyed.where("k is not null").groupBy("k", "v").agg(F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v")), "near-classes")
        if classes.count() == classes.select("k").distinct().count():
            break
        seed += 1
    rows = keyed
    # A length's vectors are compared with each other; one that stands alone has no partner.
    dims = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().where("count > 1").orderBy("dim").collect()}
    found = [_links(classes.where(F.col("dim") == dim), n, dim, rho, seed) for dim, n in dims.items()]
    if found:
        met = reduce(DataFrame.unionByName, found)
        comps = components(met.select(F.col("k").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "k")
        links = met.groupBy("k").agg(F.sum("links").alias("links"))
    else:
        empty = spark.createDataFrame([], "k long, links long, component long")
        comps, links = empty.select("k", "component"), empty.select("k", "links")
    facts = classes.select("k", "copies").join(links, "k", "left").join(comps, "k", "left").select("k", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "k").alias("c"))
    known = rows.where("k is not null").select("vec_id", "k").join(facts, "k")
    ids = known.groupBy("c").agg(F.min("vec_id").alias("component_id"))
    out = known.join(ids, "c").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("k is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

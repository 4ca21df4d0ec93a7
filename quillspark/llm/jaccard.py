"""N-gram Jaccard join with several global token orders.

A document is its set of distinct k-word shingles; documents link when the Jaccard similarity reaches the threshold.
Equal sets are one class, whose members are linked by definition, so only classes are compared.

1. Every shingle's document frequency is counted over all classes. Shingles travel as packed Arrow blobs, dealt by
   hash, each batch's copies dropped before the shuffle. Shingles of one class only cannot be shared, so a class's
   overlap with any other is at most its shared shingles; classes that this bound rules out go.
2. Under each of ORDERS global orders (rare first, ties by a different hash each) a class's prefix holds the tokens
   of which two linked classes must share one. Candidates come from the lists of the first order and must also share
   a prefix token under the others; the bound above is applied to the pair. Then shared shingles are intersected.
3. Components need no more links than keep them connected. First each class meets one class with few unique shingles
   that it shares most lists with. Then every pair of a list whose classes are still apart is tried. So a large group
   of near copies costs a pair a member, and no pair of unconnected classes is left out.

Lists are never gathered: the hub of a list is a map-side combined aggregate, and joins on tokens are split by AQE.
A shingle is a hash of 64 bits: two sets of a million shingles each share a false one with a probability under 1e-7. A
set is a hash of 64 bits, too; keys that stand for two sets (told apart by a second hash) get both hashes mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import cut
from .graph import components
from .textnp import LOWER, SPACE, chunks, flat, mixed, prefix_hash, shingles, span_hash, words

ORDERS = 3
FLUSH = 1_500_000
#: Rows of a bucket, at first and at most.
ROWS = (2000, 16_000)
#: Sets of one blob, so that 16 bits number them.
OWNERS = 60_000
_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def set_hash(h: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each set; h holds the sets' shingles one after another, n how many each has."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mixed(h ^ np.uint64(salt)), out=total[1:])
    end = np.cumsum(n)
    return mixed(total[end] - total[end - n] + n.astype(np.uint64) * np.uint64(_SALTS[0]))


def shingle_sets(texts: pa.Array, k: int, shared_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of all texts, sorted in each; how many each has; a key and a second hash of each set).

    shared_keys: keys that stand for several sets.
    """
    data, starts, ends = flat(texts)
    data = LOWER[data]
    at, to, n_words = words(data, starts, ends, ~SPACE)
    h, n = shingles(span_hash(prefix_hash(data), at, to), n_words, k)
    end = np.cumsum(n)
    for a, b in zip((end - n).tolist(), end.tolist(), strict=True):
        h[a:b].sort()
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    first[(end - n)[n > 0]] = True
    doc = np.repeat(np.arange(len(n)), n)[first]
    h = h[first]
    n = np.bincount(doc, minlength=len(n)).astype(np.int64)
    key, check = set_hash(h, n, _SALTS[2]), set_hash(h, n, _SALTS[1])
    if len(shared_keys):
        key = np.where(np.isin(key, shared_keys), mixed(key ^ mixed(check)), key)
    return h, n, key, check


def set_keys(docs: DataFrame, k: int, shared_keys: np.ndarray) -> DataFrame:
    """(doc_id, set long, check long, n long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                _, n, key, check = shingle_sets(part.column("text"), k, shared_keys)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(key.view(np.int64)), pa.array(check.view(np.int64)), pa.array(n)], ["doc_id", "set", "check", "n"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, set long, check long, n long")


def keys_of_several(sizes: DataFrame) -> np.ndarray:
    """The keys of sizes (set, check) with more than one second hash: about rows^2 / 2^65 of them."""
    several = sizes.groupBy("set").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("set")
    return np.array([r[0] for r in several.collect()], np.int64).view(np.uint64)


def _dealt(docs: DataFrame, k: int, buckets: int, shared_keys: np.ndarray) -> DataFrame:
    """(bucket, tokens, owners, sets): the bucket's tokens of a batch of documents, each with the place of its set in sets (none: in order)."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h, n, key = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        _, some = np.unique(key, return_index=True)
        some = some[n[some] > 0]
        keep = np.zeros(len(n), bool)
        keep[some] = True
        place = np.cumsum(keep) - 1
        own = np.repeat(np.arange(len(n)), n)
        mask = keep[own]
        # At most OWNERS sets are held.
        h, own = h[mask], place[own[mask]].astype(np.uint16)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, own, bucket = h[order], own[order], bucket[order]
        sets, bounds = key[keep], np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(h) else [0]
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            # Numbers of sets beside the list of them where that is shorter, else the sets themselves.
            blobs = (own[a:z].tobytes(), sets.tobytes()) if 6 * (z - a) > 8 * len(sets) else (b"", sets[own[a:z]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int64()), pa.array([h[a:z].tobytes()], pa.binary()), *(pa.array([x], pa.binary()) for x in blobs)], ["bucket", "tokens", "owners", "sets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for part in chunks(batch, "text"):
                for at in range(0, part.num_rows, OWNERS // 2):
                    held.append(shingle_sets(part.slice(at, OWNERS // 2).column("text"), k, shared_keys)[:3])
                    if sum(len(x[0]) for x in held) >= FLUSH or sum(len(x[1]) for x in held) > OWNERS // 2:
                        yield from flush(held)
        yield from flush(held)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, tokens binary, owners binary, sets binary")


def _shared(buckets: int):  # noqa: ANN202
    """A kernel over one bucket: for each shared token and set (doc_bucket, sets, tokens, df), dealt by set."""

    def kernel(_: tuple, table: pa.Table) -> pa.Table:
        toks, sets = [], []
        for t, o, s in zip(*(table.column(c).to_pylist() for c in ("tokens", "owners", "sets")), strict=True):
            toks.append(np.frombuffer(t, np.uint64))
            sets.append(np.frombuffer(s, np.uint64)[np.frombuffer(o, np.uint16)] if o else np.frombuffer(s, np.uint64))
        tok, own = np.concatenate(toks), np.concatenate(sets)
        del toks, sets
        ordered = np.sort(tok)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        if len(again):
            at = np.minimum(np.searchsorted(again, tok), len(again) - 1)
            mask = again[at] == tok
            tok, own = tok[mask], own[mask]
            order = np.lexsort((own, tok))
            tok, own = tok[order], own[order]
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])
            tok, own = tok[new], own[new]
            _, inverse, count = np.unique(tok, return_inverse=True, return_counts=True)
            df = np.minimum(count[inverse], 255).astype(np.uint8)
            mask = df > 1
            tok, own, df = tok[mask], own[mask], df[mask]
        else:
            tok, own, df = tok[:0], own[:0], np.zeros(0, np.uint8)
        to = (own % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        tok, own, df, to = tok[order], own[order], df[order], to[order]
        bounds = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else [0]
        rows: list[list] = [[], [], [], []]
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            for col, v in zip(rows, (to[a], own[a:z].tobytes(), tok[a:z].tobytes(), df[a:z].tobytes()), strict=True):
                col.append(v)
        return pa.table([pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["bucket", "sets", "tokens", "df"])

    return kernel


def _profile(num: int, den: int):  # noqa: ANN202
    """A kernel over the sets of one bucket: those that can have a partner, with prefixes and shared tokens."""

    def kernel(_: tuple, shared: pa.Table, sizes: pa.Table) -> pa.Table:
        names = ["set", "n", "shared", *[f"prefix{i}" for i in range(ORDERS)], "tokens"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * (ORDERS + 1)]
        out: list[list] = [[] for _ in names]
        if shared.num_rows and sizes.num_rows:
            own = np.concatenate([np.frombuffer(x, np.uint64) for x in shared.column("sets").to_pylist()])
            tok = np.concatenate([np.frombuffer(x, np.uint64) for x in shared.column("tokens").to_pylist()])
            df = np.concatenate([np.frombuffer(x, np.uint8) for x in shared.column("df").to_pylist()])
            total = dict(zip(sizes.column("set").to_pylist(), sizes.column("n").to_pylist(), strict=True))
            order = np.argsort(own, kind="stable")
            own, tok, df = own[order], tok[order], df[order]
            bounds = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                s = int(own[a : a + 1].view(np.int64)[0])
                n = total[s]
                least = (num * n + den - 1) // den
                if b - a < least:
                    continue
                t, d = tok[a:b], df[a:b]
                take = (n - least + 1) - (n - (b - a))
                prefixes = [t[np.lexsort((mixed(t ^ np.uint64(salt)), d))[:take]].view(np.int64) for salt in _SALTS[:ORDERS]]
                for col, v in zip(out, (s, n, b - a, *prefixes, np.sort(t).view(np.int64)), strict=True):
                    col.append(v)
        return pa.table([pa.array(col, kind) for col, kind in zip(out, kinds, strict=True)], names=names)

    return kernel


def profiles(docs: DataFrame, sizes: DataFrame, k: int, num: int, den: int, buckets: int, shared_keys: np.ndarray) -> DataFrame:
    """(set, n, shared, prefix0.., tokens) of the classes that may have a partner."""
    shared = _dealt(docs, k, buckets, shared_keys).groupBy("bucket").applyInArrow(_shared(buckets), "bucket long, sets binary, tokens binary, df binary")
    own = sizes.where("n > 0").select("set", "n").distinct().withColumn("bucket", _unsigned_mod(F.col("set"), buckets))
    arrays = ", ".join(f"prefix{i} array<long>" for i in range(ORDERS))
    return shared.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(_profile(num, den), f"set long, n long, shared long, {arrays}, tokens array<long>")


def _unsigned_mod(h: Column, m: int) -> Column:
    """h as an unsigned number, modulo m."""
    return F.pmod(F.pmod(F.shiftrightunsigned(h, 1), F.lit(m)) * 2 + h.bitwiseAND(F.lit(1)), F.lit(m)).cast("long")


def linked(pairs: DataFrame, profile: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that share a prefix token under every further order, and whose sets reach the threshold."""
    later = [f"prefix{i}" for i in range(1, ORDERS)]
    side = lambda s, cols: profile.select(F.col("set").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in cols])
    near = pairs.join(side("a", later), "a").join(side("b", later), "b")
    for c in later:
        near = near.where(F.arrays_overlap(f"a_{c}", f"b_{c}"))
    full = near.select("a", "b").join(side("a", ["n", "tokens"]), "a").join(side("b", ["n", "tokens"]), "b")
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return full.where(both * (num + den) >= (F.col("a_n") + F.col("b_n")) * num).select("a", "b")


def class_components(docs: DataFrame, sizes: DataFrame, k: int, num: int, den: int, buckets: int, shared_keys: np.ndarray) -> DataFrame:
    """(node, component) of the classes that have a link to another class."""
    profile = cut(profiles(docs, sizes, k, num, den, buckets, shared_keys), "jaccard-profiles")
    post = cut(profile.select("set", "n", "shared", F.posexplode("prefix0").alias("at", "token")), "jaccard-postings")
    # The hub of a list: the class with the least part of unique shingles, then the least key.
    lists = post.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((F.col("n") - F.col("shared")).alias("unique"), "set", "n", "shared")).alias("hub")).where("size > 1")
    # Lists and spans are written before they meet the postings again, so that AQE can split a list of many classes.
    lists = cut(lists, "jaccard-lists")
    fits = lambda x, y: F.least(x["shared"], y["shared"]) * (num + den) >= (x["n"] + y["n"]) * num
    star = post.join(lists, "token").where((F.col("set") != F.col("hub.set")) & fits({c: F.col(c) for c in ("n", "shared")}, {c: F.col(f"hub.{c}") for c in ("n", "shared")}))
    best = star.groupBy(F.col("set").alias("a"), F.col("hub.set").alias("b")).agg(F.count(F.lit(1)).alias("lists")).groupBy("a").agg(F.max_by("b", F.struct("lists", "b")).alias("b"))
    edges = cut(linked(best, profile, num, den), "jaccard-edges")
    first = components(edges)
    # Every pair of a list that is not connected yet; a class outside its hub's component meets all others of the list.
    marked = post.join(first.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    span = marked.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct((F.col("n") - F.col("shared")).alias("unique"), "set", "component"))["component"].alias("main")).where("low <> high")
    span = cut(span.select("token", "main"), "jaccard-spans")
    apart = marked.join(span, "token").join(profile.select("set", "prefix0"), "set")
    apart = cut(apart, "jaccard-apart")
    x, y = apart.where("component <> main").alias("x"), apart.alias("y")
    meets = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.set") < F.col("y.set")))
    # A pair is made at its first common token only; shared shingles before it are not common, which tightens the bound.
    left = lambda s: {"n": F.col(f"{s}.n"), "shared": F.col(f"{s}.shared") - F.col(f"{s}.at")}
    first_common = F.get(F.array_intersect("x.prefix0", "y.prefix0"), F.lit(0)) == F.col("x.token")
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & meets & fits(left("x"), left("y")) & first_common)
    rest = rest.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct()
    more = cut(linked(rest, profile, num, den), "jaccard-edges")
    if more.isEmpty():
        return first
    return components(edges.unionByName(more))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles long, component_id) for each row of docs (doc_id, text).

    Two rows are linked if |A and B| * den >= |A or B| * num for their sets of distinct k-word shingles (words are runs
    outside ASCII white space, A-Z lower-cased); a text of fewer words has all of them as its one shingle, null and
    empty texts have none and are linked with nothing. component_id is the smallest doc_id that links reach; nulls
    among ids are passed over, a row whose component has no other id has null. Repeated rows have equal sets. An
    empty table gives an empty result.
    """
    ship(docs.sparkSession)
    shared_keys = np.zeros(0, np.uint64)
    while True:
        sizes = cut(set_keys(docs, k, shared_keys), "jaccard-sizes")
        several = keys_of_several(sizes)
        if not len(several):
            break
        shared_keys = np.union1d(shared_keys, several)
    # Small buckets up to 65000 of them; then they grow to what a task can hold, so that blobs do not get too short.
    rows = sizes.count()
    buckets = max(8, min(rows // ROWS[0], 65_000), rows // ROWS[1])
    comps = class_components(docs, sizes.select("set", "n"), k, num, den, buckets, shared_keys)
    rows = sizes.join(comps.withColumnRenamed("node", "set"), "set", "left").withColumn("c", F.coalesce("component", "set"))
    # Written first, so that the join deals both sides anew and AQE can split a component that holds many rows.
    ids = cut(rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("component_id")), "jaccard-ids")
    out = rows.where("n > 0").join(ids, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))

"""Exact substring dedup by suffix arrays: bytes that a repeated string of `length` bytes covers are removed.

Every string of `length` bytes (a window) is dealt to a shard by its anchor, the least hash of the substrings of
ANCHOR bytes in it (ties: the leftmost). Equal windows have equal anchors, so they meet in one shard. Windows whose
anchor stands at one place only cannot be repeated and stay at home. The windows of one anchor are a stretch of text, a
piece. Equal pieces are merged before the shuffle to the shards (they carry how often they stand). At the borders of a
passage that many texts hold, pieces take in what each text has around it, and differ: pieces of an anchor with more
than HOT of them are cut into parts by how far the anchor is from a window's start, WIDTHS places each, and dealt by
what all windows of a part have in common. Parts that stand alone go; parts that still are too many are cut again, down
to single windows, which are merged where they are equal. Each shard sorts all suffixes of its pieces by induced
sorting; neighbours whose common prefix reaches `length` are repeated windows.

Equal texts are one text with copies: all its windows are repeated, and one of them stands for the others.

Scale: anchors are about two in `length - ANCHOR` places. Shards are sized by the number of pieces; the queues of their
sort spill, but a shard's text and its types, names and ranks must fit in memory. Spans go back to their text by its hash and are united there; a text's spans are bounded by its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, seeded
from .induced import suffixes
from .textnp import chunks, flat, mixed, prefix_hash, span_hash

ANCHOR = 32
PIECES = 16_000
SALTS = 16
#: 8 bytes each.
BROADCAST_ROWS = 1_000_000
HOT, WIDTHS = 2000, (22, 3, 1)


def _anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor place, anchor hash, first window, last window) of each stretch of windows with one anchor; places are in data."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none.astype(np.uint64), none, none
    total = prefix_hash(data)
    at = np.arange(n - ANCHOR + 1)
    h = span_hash(total, at, at + ANCHOR)
    width = length - ANCHOR + 1
    # Hashes are compared by their upper 56 bits, ties by place: the lowest byte holds the place within a block of `width`.
    # So a window's anchor depends on the window alone. Least of `width` neighbours: from the left within blocks, and from the right.
    blocks = -(-len(h) // width)
    grid = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(h)] = h & np.uint64(0xFFFFFFFFFFFFFF00)
    grid = grid.reshape(blocks, width)
    grid |= np.arange(width, dtype=np.uint64)
    m = n - length + 1
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[:m]
    left = np.minimum.accumulate(grid, axis=1).ravel()[width - 1 : width - 1 + m]
    first = np.arange(m) // width * width
    after = right >> np.uint64(8) > left >> np.uint64(8)
    # A window that begins a block is in it whole.
    first[after] += width
    place = first + (np.where(after, left, right) & np.uint64(255)).astype(np.int64)
    sizes = ends - starts
    windows = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(starts)), windows)
    window = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts, windows)
    place = place[window]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])) if len(text) else none
    last = np.concatenate([new[1:], [len(text)]]) - 1 if len(text) else none
    return text[new], place[new], h[place[new]], window[new], window[last]


def anchor_places(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, hashes, keys, places): packed anchors of texts (k, text), each text once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = np.unique(np.asarray(batch.column("k")), return_index=True)
            for part in chunks(batch.take(pa.array(np.sort(first))), "text"):
                data, starts, ends = flat(part.column("text"))
                text, place, h, _, _ = _anchors(data, starts, ends, length)
                key, place = np.asarray(part.column("k"))[text], (place - starts[text]).astype(np.int64)
                bucket = (h % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
                order = np.argsort(bucket, kind="stable")
                bounds = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
                rows = np.flatnonzero(np.diff(bounds)).tolist()
                blobs = [[v[order[bounds[b] : bounds[b + 1]]].tobytes() for b in rows] for v in (h, key, place.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], ["bucket", "hashes", "keys", "places"])

    return texts.mapInArrow(run, "bucket int, hashes binary, keys binary, places binary")


def _repeated(_: tuple, table: pa.Table) -> pa.Table:
    """(k, places): the anchors of a bucket that stand at two places or more."""
    h, k, p = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("hashes", np.uint64), ("keys", np.int64), ("places", np.uint32)))
    ordered = np.sort(h)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(again):
        some = again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h
        h, k, p = h[some], k[some], p[some]
        order = np.lexsort((p, k, h))
        h, k, p = h[order], k[order], p[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1])])
        h, k, p = h[new], k[new], p[new]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        some = np.repeat(np.diff(edge) > 1, np.diff(edge))
        k, p = k[some], p[some]
    else:
        k, p = k[:0], p[:0]
    order = np.argsort(k, kind="stable")
    k, p = k[order], p[order]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return pa.table({"k": pa.array(k[edge]), "places": pa.ListArray.from_arrays(pa.array(np.concatenate([edge, [len(k)]]).astype(np.int32)), pa.array(p.astype(np.int32)))})


def _pieces(length: int):  # noqa: ANN202
    """A kernel over (k, text, places): the pieces of repeated anchors (shard key, piece key, k, at, place of the anchor in the body, body), bodies once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, starts, ends = flat(part.column("text"))
                text, place, h, first, last = _anchors(data, starts, ends, length)
                lists = part.column("places")
                wanted = (np.repeat(np.arange(len(starts)), np.diff(np.asarray(lists.offsets))).astype(np.int64) << 32) | np.asarray(lists.flatten()).astype(np.int64)
                some = np.isin((text << 32) | (place - starts[text]), wanted)
                text, place, h, first, last = text[some], place[some], h[some], first[some], last[some]
                piece = mixed(span_hash(prefix_hash(data), first, last + length) ^ h)
                _, one = np.unique(piece, return_index=True)
                own = np.zeros(len(piece), bool)
                own[one] = True
                bodies = [data[a:z].tobytes() if keep else None for a, z, keep in zip(first.tolist(), (last + length).tolist(), own.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(np.asarray(part.column("k"))[text]), pa.array((first - starts[text]).astype(np.int64)), pa.array((place - first).astype(np.int32)), pa.array(bodies, pa.binary())], ["anchor", "piece", "k", "at", "pivot", "body"])

    return run


def _parts(length: int, width: int):  # noqa: ANN202
    """A kernel over pieces (anchor, piece, n, pivot, body): their parts (..., of, shift), which stand at `shift` in piece `of`.

    Equal windows have their anchor at the same place, so they are in the same part; its key is the anchor and what
    all windows with the anchor at these `width` places share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "body"):
                data, starts, ends = flat(part.column("body"))
                anchor, of, n, pivot = (np.asarray(part.column(c)).astype(np.int64) for c in ("anchor", "piece", "n", "pivot"))
                total, raw, out = prefix_hash(data), data.tobytes(), []
                for g in range((length - ANCHOR) // width + 1):
                    high, low = pivot - g * width, pivot - (g + 1) * width + 1
                    first, last = np.maximum(low, 0), np.minimum(high, ends - starts - length)
                    some = np.flatnonzero(first <= last)
                    key = mixed(span_hash(total, (starts + high)[some], (starts + low)[some] + length) ^ mixed(anchor[some].view(np.uint64) ^ np.uint64((g + 1) * 1000 + width)))
                    out.append((key, some, first[some], last[some] + length))
                key, some, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
                piece = mixed(span_hash(total, starts[some] + first, starts[some] + last) ^ key)
                _, one = np.unique(piece, return_index=True)
                own = np.zeros(len(piece), bool)
                own[one] = True
                bodies = [raw[a:z] if keep else None for a, z, keep in zip((starts[some] + first).tolist(), (starts[some] + last).tolist(), own.tolist(), strict=True)]
                cols = [pa.array(key.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(n[some]), pa.array((pivot[some] - first).astype(np.int32)), pa.array(bodies, pa.binary()), pa.array(of[some]), pa.array(first)]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "piece", "n", "pivot", "body", "of", "shift"])

    return run


def _sorted(length: int):  # noqa: ANN202
    """A kernel over a shard's pieces (piece, n, body): (piece, from, to) of the stretches that repeated windows cover."""

    def kernel(_: tuple, table: pa.Table) -> pa.Table:
        data, starts, ends = flat(table.column("body"))
        many = np.asarray(table.column("n")) > 1
        own = np.repeat(np.arange(len(starts)), ends - starts)
        valid = np.arange(len(data)) <= (ends - length)[own]
        hit = np.zeros(len(data), bool)
        held, open_ = [], False

        def settle() -> None:
            place = np.concatenate(held)
            place = place[valid[place]]
            if len(place) > 1 or len(place) and many[own[place[0]]]:
                hit[place] = True

        for place, prefix in suffixes(data, depth=length):
            near = prefix >= length
            edges = np.flatnonzero(~near)
            # Groups of suffixes that agree in `length` bytes; one may go on from the run before.
            if not len(edges):
                held.append(place)
                continue
            if held:
                held.append(place[: edges[0]])
                settle()
            ids = np.cumsum(~near) - 1
            inside = np.flatnonzero((ids >= 0) & (ids < len(edges) - 1))
            good = inside[valid[place[inside]]]
            count = np.bincount(ids[good], minlength=len(edges))
            copies = np.bincount(ids[good], many[own[place[good]]], minlength=len(edges))
            hit[place[good[(count[ids[good]] > 1) | (copies[ids[good]] > 0)]]] = True
            held = [place[edges[-1] :]]
        if held:
            settle()
        at = np.flatnonzero(hit)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] > at[:-1] + length) | (own[at[1:]] != own[at[:-1]])])) if len(at) else at
        last = np.concatenate([new[1:], [len(at)]]) - 1 if len(at) else at
        which = own[at[new]]
        return pa.table({"piece": table.column("piece").combine_chunks().take(pa.array(which)), "from": pa.array(at[new] - starts[which]), "to": pa.array(at[last] + length - starts[which])})

    return kernel


def repeated_spans(texts: DataFrame, length: int, rows: int) -> DataFrame:
    """(k, spans): the stretches of each text (k, text; rows of one k are equal) that windows at two places cover."""
    buckets = int(max(16, rows // 4000))
    again = anchor_places(texts, length, buckets).groupBy("bucket").applyInArrow(_repeated, "k long, places array<int>")
    again = again.groupBy("k").agg(F.flatten(F.collect_list("places")).alias("places"))
    # One row of each text is enough.
    bodies = texts.join(again, "k")
    pieces = cut(bodies.mapInArrow(_pieces(length), "anchor long, piece long, k long, at long, pivot int, body binary"), "substring-pieces")
    kinds = pieces.groupBy("anchor", "piece").agg(F.count_distinct("k", "at").alias("n"))
    spots = pieces.select("piece", "k", "at").distinct()
    unique = pieces.where("body is not null").groupBy("anchor", "piece").agg(F.min("body").alias("body"), F.min("pivot").alias("pivot"))
    level, per, count = unique.join(kinds, ["anchor", "piece"]), kinds, pieces.count()
    ready, links = [], []
    for width in WIDTHS:
        # At most one anchor in HOT pieces; their table is broadcast up to BROADCAST_ROWS rows.
        hot = cut(per.groupBy("anchor").agg(F.count(F.lit(1)).alias("pieces")).where(F.col("pieces") > HOT).select("anchor"), "substring-hot")
        n_hot = hot.count()
        if not n_hot:
            break
        few = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        ready.append(level.join(few, "anchor", "left_anti"))
        split = level.join(few, "anchor", "left_semi").select("anchor", "piece", "n", "pivot", "body")
        parts = cut(split.mapInArrow(_parts(length, width), "anchor long, piece long, n long, pivot int, body binary, of long, shift long"), "substring-parts")
        links.append(parts.select("piece", "of", "shift"))
        merged = parts.groupBy("anchor", "piece").agg(F.sum("n").alias("n"), F.min("pivot").alias("pivot"), F.min("body").alias("body"))
        alone = parts.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("piece").alias("piece")).where("n = 1").select("anchor", "piece")
        level = per = cut(merged.join(alone, ["anchor", "piece"], "left_anti"), "substring-parts")
        count += level.count()
    ready.append(level)
    shards = int(max(8, count // PIECES))
    columns = ["anchor", "piece", "n", "body"]
    sharded = reduce(DataFrame.unionByName, [x.select(columns) for x in ready]).withColumn("shard", F.pmod(seeded(5, "anchor"), F.lit(shards)).cast("int"))
    found = sharded.groupBy("shard").applyInArrow(_sorted(length), "piece long, from long, to long")
    if links:
        found = cut(found, "substring-found")
    for link in reversed(links):
        # From parts to the pieces that hold them; a part of a passage stands in many pieces, so its rows are salted.
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = link.withColumn("salt", F.pmod(seeded(8, "of", "shift"), F.lit(SALTS)).cast("int")).join(salted, ["piece", "salt"])
        found = found.unionByName(held.select(F.col("of").alias("piece"), (F.col("shift") + F.col("from")).alias("from"), (F.col("shift") + F.col("to")).alias("to")))
    found = found.groupBy("piece").agg(F.collect_list(F.struct("from", "to")).alias("parts"))
    # A piece of a passage that many texts hold stands in many rows: its row of `found` is salted.
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spots = spots.withColumn("salt", F.pmod(seeded(7, "k", "at"), F.lit(SALTS)).cast("int"))
    spans = spots.join(found, ["piece", "salt"]).select("k", F.explode(F.transform("parts", lambda p: F.struct((F.col("at") + p["from"]).alias("a"), (F.col("at") + p["to"]).alias("b")))).alias("span"))
    return spans.groupBy("k").agg(F.collect_set("span").alias("spans"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            text, kept, end, removed, count = text or b"", [], 0, 0, 0
            for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                if a > end or not count:
                    kept.append(text[end:a])
                    count += 1
                    end = a
                removed += max(0, b - end)
                end = max(end, b)
            kept.append(text[end:])
            for k, v in zip(out, (len(text), removed, count, b"".join(kept)), strict=True):
                out[k].append(v)
        own = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*own, *(pa.array(out[c], pa.int64()) for c in list(out)[:3]), pa.array(out["kept"], pa.binary())], [*(n for n in batch.schema.names if n not in ("text", "spans")), *out])


def dedup_substrings(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for each row of docs (doc_id, text).

    A byte of the UTF-8 text goes if a string of `length` (ANCHOR to 254) bytes that covers it also starts at another
    place of any row's text. Removed stretches that touch or overlap are one span. Null and empty texts, and texts
    shorter than `length`, lose nothing. Rows are places of their own, whatever their ids, so repeated rows of a long
    text lose all of it. An empty table gives an empty result.
    """
    if not ANCHOR <= length <= 254:
        raise ValueError(f"length must be {ANCHOR} to 254")
    ship(docs.sparkSession)
    plain = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumns({"k": seeded(6, plain), "k2": seeded(11, plain)})
    sizes = cut(rows.select("k", "k2", F.octet_length("text").alias("n")), "substring-sizes")
    # A key stands for one text: texts that share a hash and differ in the second are told apart by both.
    shared = cut(sizes.groupBy("k").agg(F.min("k2").alias("low"), F.max("k2").alias("high")).where("low <> high").select("k", F.lit(1).alias("shared")), "substring-shared")
    if not shared.isEmpty():
        apart = F.when(F.col("shared").isNull(), F.col("k")).otherwise(seeded(12, "k", "k2"))
        rows, sizes = (d.join(shared, "k", "left").withColumn("k", apart).drop("shared") for d in (rows, sizes))
    copies = sizes.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")).where((F.col("rows") > 1) & (F.col("n") >= length))
    long = rows.where(F.octet_length("text") >= length).select("k", "text")
    spans = cut(repeated_spans(long, length, sizes.count()), "substring-spans")
    whole = copies.select("k", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("b"))).alias("whole"))
    all_spans = spans.join(whole, "k", "full").select("k", F.coalesce("whole", "spans").alias("spans"))
    out = rows.join(all_spans, "k", "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(_cut_out, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")

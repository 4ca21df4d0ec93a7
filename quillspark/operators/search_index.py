"""A stored inverted index that follows its documents: immutable segments, graves, levelled merging, atomic manifests.

A segment holds postings (term, key, tf, len, places), up to PACK of one term in a row, and the documents' fingerprints
(key, p1, p2). A change writes one
new segment with the changed documents and a file of graves: the keys whose rows in earlier segments are dead. When a
level has FANOUT segments they are merged into one of the next level, without their dead rows. A manifest names the
segments and graves of one state; it is written aside and published by a rename that fails if another writer was
first, so that readers see a whole state or the one before.

Postings are dealt to folders by the beginning of the term, as many as the text has bytes for, and a query reads its
terms' folders only. Spark rebalances the tasks that write a folder by size, so a term of all documents is
written by many.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.search_words import MIN_PREFIX, fold_all, query_terms
from ..functions.text import tokens
from ..session import shared_path, ship
from .retrieval import B, IDF_FLOOR, K1

FANOUT = 4
#: Bytes of text for which a segment has one more folder of postings.
FOLDER_BYTES, MAX_FOLDERS = 1 << 20, 4096
#: Rows of graves that are broadcast (a key and a number each); more are joined by a shuffle.
BROADCAST_GRAVES = 200_000
#: Words of documents that are counted together in a task, and those of one document more.
WORDS_AT_ONCE = 1 << 20
#: Postings of one term that are shuffled, sorted and stored as one row.
PACK = 256
INDEX_WORD = r"[\p{L}\p{N}\p{Co}]+"


def index_words(c: Column) -> Column:
    """The words of a text as the search has them: folded runs of letters and digits."""
    return F.regexp_extract_all(fold_all(F.coalesce(c, F.lit(""))), F.lit(f"({INDEX_WORD})"), 1)


@dataclass(frozen=True)
class Segment:
    name: str
    seq: int
    level: int
    folders: int


@dataclass(frozen=True)
class Manifest:
    """One state: its segments from old to new, its graves (name, rows, seq), the number of live documents and of their words."""

    version: int = 0
    seq: int = 0
    segments: tuple[Segment, ...] = ()
    graves: tuple[tuple[str, int, int], ...] = ()
    docs: int = 0
    words: int = 0

    @classmethod
    def read(cls, text: str) -> Manifest:
        raw = json.loads(text)
        return cls(**{**raw, "segments": tuple(Segment(**s) for s in raw["segments"]), "graves": tuple(tuple(g) for g in raw["graves"])})


class Conflict(RuntimeError):
    """Another writer published the next state first."""


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@dataclass
class WordIndex:
    """The index in one folder of the shared store. Keys are unique and not null; rows of null keys are left out."""

    spark: SparkSession
    path: str
    analyse: Callable[[Column], Column] = index_words
    fanout: int = FANOUT
    _known: Manifest | None = field(default=None, repr=False)

    # The store: a few small files, reached from the driver.

    def _fs(self, path: str):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def manifest(self) -> Manifest:
        """The latest published state; an empty one where there is none."""
        fs, at = self._fs(f"{self.path}/manifest-*.json")
        found = sorted(s.getPath().toString() for s in (fs.globStatus(at) or ()))
        if not found:
            return Manifest()
        if self._known is None or not found[-1].endswith(self._name(self._known.version)):
            fs, at = self._fs(found[-1])
            stream = fs.open(at)
            self._known = Manifest.read(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        return self._known

    @staticmethod
    def _name(version: int) -> str:
        return f"manifest-{version:012d}.json"

    def _publish(self, state: Manifest) -> Manifest:
        state = replace(state, version=state.version + 1)
        fs, aside = self._fs(f"{self.path}/.aside-{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(asdict(state)).encode()))
        out.close()
        _, target = self._fs(f"{self.path}/{self._name(state.version)}")
        fs_package = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(getattr(fs_package, "Options$Rename"), 0)
        try:
            fs_package.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, target, options)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {state.version} exists") from e
            raise
        return state

    def vacuum(self) -> None:
        """Deletes what the latest state does not name: for a time when no reader holds an older one."""
        state = self.manifest()
        kept = {s.name for s in state.segments} | {g[0] for g in state.graves} | {self._name(state.version)}
        for folder in ("segments", "graves", "."):
            fs, at = self._fs(f"{self.path}/{folder}")
            for s in fs.listStatus(at) if fs.exists(at) else ():
                name = s.getPath().getName()
                if name not in kept and (folder != "." or name.startswith("manifest-")):
                    fs.delete(s.getPath(), True)

    # Reading.

    def _read(self, state: Manifest, table: str, segments: Sequence[Segment], only: Callable[[Segment, DataFrame], DataFrame] = lambda s, d: d) -> DataFrame:
        """Live rows of a table of some segments."""
        rows = _union([only(s, self.spark.read.parquet(f"{self.path}/segments/{s.name}/{table}")).withColumn("seq", F.lit(s.seq)) for s in segments])
        if state.graves:
            dead = _union([self.spark.read.parquet(f"{self.path}/graves/{g[0]}") for g in state.graves]).groupBy(F.col("key").alias("d_key")).agg(F.max("upto").alias("upto"))
            dead = F.broadcast(dead) if sum(g[1] for g in state.graves) <= BROADCAST_GRAVES else dead
            # A merged segment's seq is its newest part's, and its dead rows are gone already.
            rows = rows.join(dead, (F.col("key") == F.col("d_key")) & (F.col("seq") < F.col("upto")), "left_anti")
        return rows.drop("seq")

    def documents(self) -> DataFrame:
        """(key, p1, p2): live documents and the fingerprints of their texts."""
        state = self.manifest()
        return self._read(state, "docs", state.segments)

    def _postings(self, state: Manifest, segments: Sequence[Segment], places: bool = True, only: Callable[[Segment, DataFrame], DataFrame] = lambda s, d: d) -> DataFrame:
        ship(self.spark)
        return self._read(state, "postings", segments, lambda s, d: _unpack(only(s, d), places))

    def postings(self, patterns: Sequence[str] | None = None, places: bool = True) -> DataFrame:
        """Live (term, key, tf, len, places) of some terms; one that ends in * matches beginnings of two letters or more. All terms without patterns."""
        state = self.manifest()
        if patterns is None:
            return self._postings(state, state.segments, places)
        heads = self.spark.createDataFrame([(p.removesuffix("*")[:2],) for p in patterns], "b string")
        hashes = {r[0] for r in heads.select(_spread(F.col("b"))).collect()}
        asked = reduce(Column.__or__, [_match(F.col("term"), p) for p in patterns])
        return self._postings(state, state.segments, places, lambda s, d: d.where(F.col("folder").isin(sorted({h % s.folders for h in hashes}))).where(asked))

    def tallies(self, state: Manifest) -> DataFrame:
        """(term, docs, words): numbers of live documents and words, to be summed. Where nothing is dead, rows are counted as they are stored."""
        if state.graves:
            return self._postings(state, state.segments, places=False).select("term", F.lit(1).alias("docs"), F.col("tf").cast("long").alias("words"))
        return self._read(state, "postings", state.segments).select("term", F.size("tf").alias("docs"), F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"))

    # Writing.

    def _write(self, texts: DataFrame, seq: int) -> Segment:
        """A segment of level 0 of texts (key, text)."""
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        made = Segment(uuid.uuid4().hex, seq, 0, min(MAX_FOLDERS, max(1, math.ceil(size / FOLDER_BYTES))))
        texts.select("key", *_print(F.col("text"))).write.parquet(f"{self.path}/segments/{made.name}/docs")
        held = texts.select("key", self.analyse(F.col("text")).alias("t"))
        ship(self.spark)
        key = texts.schema["key"].dataType.simpleString()
        post = held.mapInArrow(lambda batches: _packed(_postings(batches)), _pack_schema(key))
        self._write_postings(post, made)
        return made

    def _write_postings(self, post: DataFrame, made: Segment) -> None:
        """Packed postings, dealt to the folders of a segment."""
        dealt = post.withColumn("folder", F.pmod(_spread(F.substring("term", 1, 2)), F.lit(made.folders)))
        dealt.hint("rebalance", "folder").sortWithinPartitions("folder", "term").write.partitionBy("folder").option("compression", "zstd").parquet(f"{self.path}/segments/{made.name}/postings")

    def apply(self, changed: DataFrame | None, removed: DataFrame | None = None) -> Manifest:
        """Takes new and changed documents (key, text) and removed ones (key); one new segment, published with its graves."""
        state = self.manifest()
        seq, segments, graves = state.seq + 1, list(state.segments), list(state.graves)
        dead = [d.select("key") for d in (changed, removed) if d is not None]
        if state.segments and dead:
            name = uuid.uuid4().hex
            _union(dead).distinct().withColumn("upto", F.lit(seq)).write.parquet(f"{self.path}/graves/{name}")
            rows = self.spark.read.parquet(f"{self.path}/graves/{name}").count()
            graves += [(name, rows, seq)] if rows else []
        if changed is not None:
            segments.append(self._write(changed.select("key", "text").where("key is not null"), seq))
        state = self._counted(replace(state, seq=seq, segments=tuple(segments), graves=tuple(graves)))
        return self._merged(self._publish(state))

    def _counted(self, state: Manifest) -> Manifest:
        """The state with its numbers; without live documents, without segments."""
        docs = self._read(state, "docs", state.segments).count() if state.segments else 0
        words = self.tallies(state).agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0] if docs else 0
        return replace(state, docs=docs, words=words) if docs else replace(state, segments=(), graves=(), docs=0, words=0)

    def _merged(self, state: Manifest) -> Manifest:
        """Merges each level that has `fanout` segments into one of the next."""
        level = 0
        while any(s.level >= level for s in state.segments):
            own = [s for s in state.segments if s.level == level]
            if len(own) >= self.fanout:
                made = Segment(uuid.uuid4().hex, max(s.seq for s in own), level + 1, max(s.folders for s in own))
                self._read(state, "docs", own).write.parquet(f"{self.path}/segments/{made.name}/docs")
                live = self._postings(state, own).sortWithinPartitions("term")
                self._write_postings(live.mapInArrow(_packed, _pack_schema(live.schema["key"].dataType.simpleString())), made)
                rest = [s for s in state.segments if s not in own]
                # Graves are for older rows; where none are left, those up to this merge have done their work.
                graves = state.graves if any(s.seq < made.seq for s in rest) else tuple(g for g in state.graves if g[2] > made.seq)
                state = self._publish(replace(state, segments=tuple(sorted([*rest, made], key=lambda s: s.seq)), graves=graves))
            level += 1
        return state

    def refresh(self, docs: DataFrame, key: str, text: str) -> tuple[int, int]:
        """Brings the index in step with docs; returns how many documents were written and how many removed.

        Documents are compared by 128 bits of their text. Nothing is published where nothing changed.
        """
        now = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("key is not null")
        if not self.manifest().segments:
            return self.apply(now).docs, 0
        # Fingerprints are compared without the texts, which would be shuffled for each use of what changed.
        before, prints = self.documents(), now.select("key", *_print(F.col("text")))
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        prints.join(before, ["key", "p1", "p2"], "left_anti").select("key").write.parquet(f"{aside}/changed")
        before.join(now.select("key"), "key", "left_anti").select("key").write.parquet(f"{aside}/removed")
        fresh, removed = (self.spark.read.parquet(f"{aside}/{n}") for n in ("changed", "removed"))
        counts = fresh.count(), removed.count()
        changed = now.join(F.broadcast(fresh) if counts[0] <= BROADCAST_GRAVES else fresh.hint("shuffle_hash"), "key", "left_semi")
        if any(counts):
            self.apply(changed if counts[0] else None, removed if counts[1] else None)
        fs, at = self._fs(aside)
        fs.delete(at, True)
        return counts


def _postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, key, tf, len, places) of documents (key, t): a document's words are counted where they are read, without a shuffle or a sort of all words."""
    for batch in batches:
        length = pc.fill_null(pc.list_value_length(batch.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(length) // WORDS_AT_ONCE
        cuts = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist(), batch.num_rows] if batch.num_rows else []
        for low, high in zip(cuts, cuts[1:], strict=False):
            rows, n = batch.slice(low, high - low), length[low:high]
            words = rows.column("t").flatten().dictionary_encode()
            if not len(words):
                continue
            doc, first = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n)
            # Term by term, so that rows of one term stand together in the shuffle and compress.
            pair = words.indices.to_numpy().astype(np.int64) * len(n) + doc
            order = np.argsort(pair, kind="stable")
            heads = np.flatnonzero(np.append(True, pair[order][1:] != pair[order][:-1]))
            one, ends = order[heads], np.append(heads, len(order)).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array((order - first[order]).astype(np.int32)))
            columns = [words.dictionary.take(words.indices.take(pa.array(one))), rows.column("key").take(pa.array(doc[one])), pa.array(np.diff(ends), pa.int32()), pa.array(n[doc[one]], pa.int32()), places]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "key", "tf", "len", "places"])


def _pack_schema(key: str) -> str:
    return f"term string, key array<{key}>, tf array<int>, len array<int>, places array<int>"


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings that stand together by term, up to PACK in a row: (term, key, tf, len) with lists of one length, places of all one after another."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        code = batch.column("term").dictionary_encode().indices.to_numpy()
        runs = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        heads = np.flatnonzero((np.arange(n) - np.repeat(runs, np.diff(np.append(runs, n)))) % PACK == 0)
        ends = np.append(heads, n).astype(np.int32)
        at = np.append(0, np.cumsum(batch.column("tf").to_numpy()))[ends].astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), batch.column(x)) for x in ("key", "tf", "len")]
        columns = [batch.column("term").take(pa.array(heads)), *lists, pa.ListArray.from_arrays(pa.array(at), batch.column("places").flatten())]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "key", "tf", "len", "places"])


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of packed rows."""
    for batch in batches:
        size = pc.list_value_length(batch.column("key")).to_numpy()
        key, tf, length, places = (batch.column(x).flatten() for x in ("key", "tf", "len", "places"))
        ends = np.append(0, np.cumsum(tf.to_numpy())).astype(np.int32)
        columns = [batch.column("term").take(pa.array(np.repeat(np.arange(len(size)), size))), key, tf, length, pa.ListArray.from_arrays(pa.array(ends), places)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "key", "tf", "len", "places"])


def _unpack(packs: DataFrame, places: bool) -> DataFrame:
    """(term, key, tf, len), and places where they are asked for."""
    if not places:
        return packs.select("term", F.inline(F.arrays_zip("key", "tf", "len")))
    key = packs.schema["key"].dataType.elementType.simpleString()
    return packs.select("term", "key", "tf", "len", "places").mapInArrow(_unpacked, f"term string, key {key}, tf int, len int, places array<int>")


def _spread(beginning: Column) -> Column:
    """Terms of one beginning are together, so that a term asked for as a beginning is in one folder."""
    return F.pmod(F.xxhash64(beginning), F.lit(1 << 30)).cast("int")


def _print(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(F.lit(1), t).alias("p1"), F.xxhash64(F.lit(2), t).alias("p2")]


def _match(term: Column, pattern: str) -> Column:
    return term.startswith(pattern[:-1]) if pattern.endswith("*") else term == pattern


def signature(docs: DataFrame) -> str:
    """Changes whenever a file of the table does; one aggregate row reaches the driver."""
    meta = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    row = meta.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time")).alias("x"), F.max(F.xxhash64("file_path", "file_size", "file_modification_time")).alias("m")).first()
    return "-".join("none" if v is None else format(v & (2**64 - 1), "x") for v in row)


def ensure(docs: DataFrame, key: str, text: str, name: str, analyse: Callable[[Column], Column] = tokens) -> WordIndex:
    """The index of a state of the source files of docs, which is built where it is not there yet."""
    index = WordIndex(docs.sparkSession, shared_path(docs.sparkSession, f"{name}-packed-{signature(docs)}"), analyse)
    if not index.manifest().version:
        try:
            index.apply(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
        except Conflict:
            # Another session has built the same state.
            pass
    return index


def unit_counts(index: WordIndex, units: Sequence[Sequence[str]]) -> DataFrame:
    """(key, len, unit, tf): how often each unit stands in a document.

    A unit is one pattern or several words one after another, of which each may end in *. The posting lists of a longer unit meet
    by document, shifted by their place in it.
    """
    single = [u[0] for u in units if len(u) == 1]
    post = index.postings(sorted(set(single)), places=False) if single else None
    parts = []
    for i, unit in enumerate(units):
        if len(unit) == 1:
            parts.append(post.where(_match(F.col("term"), unit[0])).groupBy("key", "len").agg(F.sum("tf").alias("tf")).withColumn("unit", F.lit(i)))
            continue
        place = F.array(*[F.when(_match(F.col("term"), p), F.struct(F.lit(j).alias("j"), F.transform("places", _back(j)).alias("at"))) for j, p in enumerate(unit)])
        lists = index.postings(sorted(set(unit))).select("key", "len", F.inline(F.array_compact(place)))
        # Terms of one beginning are one list; a place holds one term, so nothing is counted twice.
        lists = lists.groupBy("key", "len", "j").agg(F.flatten(F.collect_list("at")).alias("at")).groupBy("key", "len").agg(F.collect_list("at").alias("lists"))
        met = F.aggregate(F.slice("lists", 2, len(unit)), F.get("lists", F.lit(0)), lambda a, x: F.array_intersect(a, x))
        parts.append(lists.where(F.size("lists") == len(unit)).select("key", "len", F.size(met).cast("long").alias("tf"), F.lit(i).alias("unit")).where("tf > 0"))
    return _union([p.select("key", "len", "unit", "tf") for p in parts])


def _back(by: int) -> Callable[[Column], Column]:
    return lambda p: p - by


def bm25(index: WordIndex, units: Sequence[Sequence[str]], key: str) -> DataFrame:
    """(key, score) of the documents that hold a unit. Statistics are over all live documents."""
    state, counted = index.manifest(), unit_counts(index, units)
    counts = [F.coalesce(F.sum(F.when(F.col("unit") == i, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i in range(len(units))]
    rows = counted.groupBy("key", "len").agg(*counts)
    found = rows.agg(*[F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("long")), F.lit(0)).alias(f"df{i}") for i in range(len(units))])
    total, mean, part = F.lit(state.docs), F.lit(state.words / max(1, state.docs)), F.lit(0.0)
    for i in range(len(units)):
        n, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.log((total - n + 0.5) / (n + 0.5)), F.lit(IDF_FLOOR))
        part = part + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / mean))
    # The counts of documents are one row.
    return rows.join(F.broadcast(found)).select(F.col("key").alias(key), part.alias("score"))


def asked_units(spark: SparkSession, query: str) -> list[tuple[str, ...]]:
    """What a query string asks the index for: its phrases, then its words, those of MIN_PREFIX letters or more as beginnings.

    The parser's words may hold an underscore, at which the index divides them: such a word is a unit of several.
    """
    asked = spark.range(1).select(query_terms(F.lit(query)).alias("q")).first()["q"]
    split = lambda w: [r for r in _split(w) if r]
    phrases = [tuple(x for w in p for x in split(w)) for p in asked["phrases"]]
    words = []
    for t in asked["terms"]:
        parts = split(t)
        if parts:
            words.append((*parts[:-1], parts[-1] + "*" if len(t) >= MIN_PREFIX and len(parts[-1]) > 1 else parts[-1]))
    return list(dict.fromkeys(u for u in [*phrases, *words] if u))


def _split(word: str) -> list[str]:
    return word.split("_")


def search(index: WordIndex, query: str, key: str) -> DataFrame:
    """(key, score) of the documents that a query string finds; a query without words finds none."""
    units = asked_units(index.spark, query)
    return bm25(index, units, key) if units and index.manifest().segments else index.spark.createDataFrame([], f"{key} long, score double")


def phrase(index: WordIndex, words: Sequence[str], key: str) -> DataFrame:
    """(key, n): how often the words stand one after another."""
    return unit_counts(index, [words]).select(F.col("key").alias(key), F.col("tf").alias("n"))


def vocabulary(index: WordIndex) -> DataFrame:
    """(term, df, n): documents of each term, and of the table."""
    state = index.manifest()
    return index.tallies(state).groupBy("term").agg(F.sum("docs").alias("df")).withColumn("n", F.lit(state.docs))


def roll_up(hits: DataFrame, group: str, score: str, key: str, own: DataFrame) -> DataFrame:
    """The best hit of each group, replaced by the group's own passage (group, passage) where it has one."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    best = hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return best.join(own, group, "left")

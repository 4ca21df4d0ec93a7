"""Queries of the search: what a query asks for, marked words, snippets, roll-up, vectors of one model."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import search_words as W
from ..operators import questions as Q
from ..operators import retrieval as S
from ..operators import search_index as X
from ..session import shared_path
from .registry import load, query

_SOURCE, _PLAIN = (x.replace("'", "''") for x in W.fold_table())


def _fold(c: str) -> str:
    return f"replace(replace(replace(replace(regexp_replace(translate(lower({c}), '{_SOURCE}', '{_PLAIN}'), '\\p{{M}}+', '', 'g'), 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '…', '...')"


_STOP = "[" + ", ".join(f"'{w}'" for w in W.STOP_WORDS) + "]"
_ASKED = W.Asked(("then", "the", "queux"), (("of", "the"),))
_MATCH = "(starts_with({0}, 'then') OR {0} = 'the' OR starts_with({0}, 'queux'))"


@query(f"SELECT doc_id, sha256({_fold('text')}) AS folded FROM documents WHERE text IS NOT NULL")
def fold_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(W.fold_all(F.col("text")), 256).alias("folded"))


@query(rf"""WITH q AS (SELECT conv_id, turn, role, coalesce(text, '') || ' "' || array_to_string(string_split(coalesce(text, ''), ' ')[1:2], ' ') || '"' AS q FROM conversations),
p AS (SELECT conv_id, turn, role, q, list_transform(regexp_extract_all(q, '"([^"]+)"', 1), lambda x: regexp_extract_all({_fold('x')}, '[\p{{L}}\p{{N}}_]+')) AS quoted, regexp_extract_all({_fold("regexp_replace(q, '" + W.PHRASE + "', ' ', 'g')")}, '[\p{{L}}\p{{N}}_]+') AS rest FROM q),
l AS (SELECT *, list_concat(rest, flatten(list_filter(quoted, lambda p: len(p) = 1))) AS loose, list_filter(quoted, lambda p: len(p) > 1) AS ph FROM p),
k AS (SELECT *, list_filter(loose, lambda w: NOT list_contains({_STOP}, w)) AS kept FROM l),
c AS (SELECT *, CASE WHEN len(kept) = 0 AND len(ph) = 0 THEN loose ELSE kept END AS asked FROM k)
SELECT conv_id, turn, role, array_to_string(list_transform(list_filter(list_zip(asked, range(1, len(asked) + 1)), lambda x: list_position(asked, x[1]) = x[2]), lambda x: x[1])[1:12], ' ') AS terms,
array_to_string(list_transform(list_transform(ph, lambda p: array_to_string(p, ' '))[1:1], lambda p: p), '|') AS first_phrase FROM c""")
def query_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a query whose first two words are quoted."""
    text = F.coalesce("text", F.lit(""))
    quoted = F.concat(text, F.lit(' "'), F.array_join(F.slice(F.split(text, " "), 1, 2), " "), F.lit('"'))
    parsed = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", W.query_terms(quoted).alias("q"))
    return parsed.select("conv_id", "turn", "role", F.array_join("q.terms", " ").alias("terms"), F.coalesce(F.array_join(F.get("q.phrases", F.lit(0)), " "), F.lit("")).alias("first_phrase"))


_WORDS = rf"""p AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')) AS p, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), 1) AS i FROM documents),
o AS (SELECT doc_id, p, i, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM p),
w AS (SELECT doc_id, a, a + length(p) AS z, {_fold('p')} AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM o WHERE regexp_matches(p, '[\p{{L}}\p{{N}}_]')),
x AS (SELECT *, lead(w) OVER b AS nxt, lag(w) OVER b AS prv FROM w WINDOW b AS (PARTITION BY doc_id ORDER BY n)),
r AS (SELECT doc_id, a, z FROM x WHERE {_MATCH.format('w')} OR (w = 'of' AND nxt = 'the') OR (w = 'the' AND prv = 'of'))"""


@query(f"WITH {_WORDS} SELECT doc_id, count(*) AS n, sum(a) AS starts, sum(z) AS ends, min(a) AS first, max(z) AS last FROM r GROUP BY doc_id")
def highlight_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = load(spark, sf_dir, "documents").select("doc_id", F.inline(W.marked_words(F.col("text"), _ASKED)))
    return marks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("starts"), F.sum("z").alias("ends"), F.min("a").cast("long").alias("first"), F.max("z").cast("long").alias("last"))


def snippets(docs: DataFrame, asked: W.Asked) -> DataFrame:
    """(doc_id, snippet) of every row."""
    flat = docs.select("doc_id", W.flat_lines(F.col("text")).alias("flat"))
    rows = flat.select("doc_id", "flat", W.marked_words(F.col("flat"), asked).alias("ranges"))
    return rows.select("doc_id", W.snippet(F.col("flat"), F.col("ranges")).alias("snippet"), F.size("ranges").alias("marks"))


@query()
def snippet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(load(spark, sf_dir, "documents"), _ASKED)


@query("""WITH q AS (SELECT label, embedding AS q FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS similarity FROM embeddings e JOIN q ON q.label = e.label WHERE vec_id <> 7""")
def same_model_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are compared within one model only; the label stands for the model."""
    rows = load(spark, sf_dir, "embeddings")
    probe = rows.where("vec_id = 7").limit(1).select(F.col("label").alias("own"), F.col("embedding").alias("q"))
    met = rows.where("vec_id <> 7").join(F.broadcast(probe), F.col("label") == F.col("own"))
    return met.select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


@query("""WITH s AS (SELECT e.vec_id AS id, d.source, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 7) q),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY s DESC, id) = 1), o AS (SELECT source, min(doc_id) AS passage FROM documents GROUP BY source)
SELECT b.source, b.id AS hit, coalesce(o.passage, b.id) AS shown, round(b.s, 6) AS score FROM b LEFT JOIN o ON o.source = b.source""")
def shot_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each source, shown as the source's own first document."""
    docs, rows = load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings")
    probe = rows.where("vec_id = 7").limit(1).select(F.col("embedding").alias("q"))
    hits = rows.join(F.broadcast(probe)).select(F.col("vec_id").alias("id"), F.round(S.cosine(F.col("embedding"), F.col("q")), 9).alias("s"))
    hits = hits.join(docs.select(F.col("doc_id").alias("id"), "source"), "id")
    own = docs.groupBy("source").agg(F.min("doc_id").alias("passage"))
    return X.roll_up(hits, "source", "s", "id", own).select("source", F.col("id").alias("hit"), F.coalesce("passage", "id").alias("shown"), F.round("s", 6).alias("score"))


@query("""WITH h AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS r FROM documents d)
SELECT h.doc_id, coalesce(l.quality::VARCHAR, h.source, 'untitled') AS title, round_even(h.n_chars / 7.0::DOUBLE, 6) AS score FROM h LEFT JOIN labels l ON l.doc_id = h.doc_id WHERE r <= 50""")
def hit_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with a title that falls back, and a rounded score."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    hits = load(spark, sf_dir, "documents").withColumn("r", F.row_number().over(w)).where("r <= 50")
    rows = hits.join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.col("quality").cast("string"), "source", F.lit("untitled")).alias("title"), F.bround(F.col("n_chars") / 7.0, 6).alias("score"))


#: A phrase, a beginning of four letters or more, a short word that must be whole, and a common word that is not searched.
ASKED = 'the "of the" thend ea'
_BM25 = f"""t AS (SELECT doc_id, regexp_extract_all({_fold("coalesce(text, '')")}, '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS t FROM shown),
w AS (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM t)),
h AS (SELECT doc_id, count(*) FILTER (w = 'of' AND nxt = 'the') AS f0, count(*) FILTER (starts_with(w, 'thend')) AS f1, count(*) FILTER (w = 'ea') AS f2 FROM w GROUP BY doc_id),
f AS (SELECT t.doc_id, len(t.t) AS l, coalesce(f0, 0) AS f0, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2 FROM t LEFT JOIN h ON h.doc_id = t.doc_id),
g AS (SELECT count(*) AS n, avg(l) AS a, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM f),
b AS (SELECT doc_id, {" + ".join(f"greatest(ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))" for i in range(3))} AS score FROM f, g WHERE f0 + f1 + f2 > 0)
SELECT doc_id, round(score, 6) AS score FROM b"""


@query(f"WITH shown AS (SELECT doc_id, text FROM documents), {_BM25}")
def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query string with a phrase, a beginning and a short word, scored in one sum over the stored index."""
    index = X.ensure(load(spark, sf_dir, "documents"), "doc_id", "text", "search", X.index_words)
    return X.search(index, ASKED, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH shown AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' of the thendea ea' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0), {_BM25}")
def index_after_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same query over an index that followed its table: documents were added, then edited and removed, a segment each."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    index = X.WordIndex(spark, shared_path(spark, f"edited-{uuid.uuid4().hex}"))
    index.refresh(docs.where("doc_id % 7 <> 0"), "doc_id", "text")
    index.refresh(docs, "doc_id", "text")
    edited = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" of the thendea ea"))).otherwise(F.col("text")))
    index.refresh(edited.where("doc_id % 11 <> 0"), "doc_id", "text")
    return X.search(index, ASKED, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


def passages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for passages of their source: those of every fifth id for whole videos, the others for stretches of ten seconds."""
    start = F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 600).cast("double"))
    return load(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("video"), F.when(start.isNull(), "video").otherwise("shot").alias("kind"), F.lit("visual").alias("family"), start.alias("a"), (start + 10).alias("b"), F.coalesce("text", F.lit("")).alias("text"))


QUESTION = 'where is "of the" thending and ea'


@query()
def question_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read to answer a question: passages found by words and by the vector of one of them, chosen for a budget of tokens."""
    index = X.ensure(load(spark, sf_dir, "documents"), "doc_id", "text", "search", X.index_words)
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    probe = vectors.where("doc_id = 7").first()
    found = Q.retrieved(index, QUESTION, "doc_id", vectors, probe["vector"] if probe else None)
    return Q.context(found, passages_of(spark, sf_dir), "doc_id", budget=1500)


@query()
def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn read as an answer that cites by its own numbers, some of them of no passage."""
    mark = F.concat(F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("] and ["), (F.col("conv_id") % 30).cast("string"), F.lit("-"), (F.col("conv_id") % 30 + 2).cast("string"), F.lit("]."))
    text = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("**NO_ANSWER**: "), F.coalesce("text", F.lit("")))).when(F.col("turn") % 4 == 2, F.col("text")).otherwise(F.concat(F.coalesce("text", F.lit("")), mark))
    read = Q.read_answers(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("text")), "text", 12)
    return read.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"), F.array_join("cited", ",").alias("cited"), "dropped", "status")

"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..operators import retrieval as S
from ..operators import search_index as X
from .registry import load, query

TERMS = ["then*", "the", "and", "queux*"]
PROBE = 7
FOLD = f"lower(translate({{}}, '{T.ACCENTED}', '{T.PLAIN}'))"
TOKENS = "list_filter(regexp_split_to_array(" + FOLD.format("text") + r", '[^\p{L}\p{N}]+'), lambda t: t <> '')"

_BM25 = f"""
t AS (SELECT doc_id, {TOKENS} AS t FROM documents),
f AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: starts_with(x, 'then'))) AS f0, len(list_filter(t, lambda x: x = 'the')) AS f1,
             len(list_filter(t, lambda x: x = 'and')) AS f2, len(list_filter(t, lambda x: starts_with(x, 'queux'))) AS f3 FROM t),
g AS (SELECT count(*) AS n, avg(l) AS a, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2, count(*) FILTER (f3 > 0) AS d3 FROM f),
b AS (SELECT doc_id,
  greatest(ln((n - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)), 1e-6::DOUBLE) * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) +
  greatest(ln((n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)), 1e-6::DOUBLE) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) +
  greatest(ln((n - d2 + 0.5::DOUBLE) / (d2 + 0.5::DOUBLE)), 1e-6::DOUBLE) * f2 * 2.2::DOUBLE / (f2 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) +
  greatest(ln((n - d3 + 0.5::DOUBLE) / (d3 + 0.5::DOUBLE)), 1e-6::DOUBLE) * f3 * 2.2::DOUBLE / (f3 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) AS score
  FROM f, g WHERE f0 + f1 + f2 + f3 > 0)"""
_COS = f"""
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {PROBE}),
c AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS similarity FROM embeddings, q WHERE vec_id <> {PROBE})"""


def _index(spark: SparkSession, sf_dir: str) -> X.WordIndex:
    return X.ensure(load(spark, sf_dir, "documents"), "doc_id", "text", "words")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Ranked by the rounded score, shown from the exact one.
    return S.ranked(X.bm25(_index(spark, sf_dir), [(t,) for t in TERMS], "doc_id").withColumn("near", F.round("score", 9)), "near", "doc_id", 200)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ranked(S.similar(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", PROBE).withColumn("near", F.round("similarity", 9)), "near", "vec_id", 200)


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY round(b.score, 9) DESC, doc_id LIMIT 200")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({TOKENS}, lambda t: starts_with(t, 'thend'))) > 0")
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).postings(["thend*"], places=False).select(F.col("key").alias("doc_id")).distinct()


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' of the ')")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.phrase(_index(spark, sf_dir), ["of", "the"], "doc_id").select("doc_id")


@query(f"WITH {_COS} SELECT vec_id, round(similarity, 6) AS similarity FROM c ORDER BY round(c.similarity, 9) DESC, vec_id LIMIT 200")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_COS} SELECT vec_id, round(similarity, 6) AS similarity FROM c WHERE similarity >= 0.2")
def cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.similar(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", PROBE, 0.2).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""
WITH s AS (SELECT vec_id, list_slice(embedding, 1, 16)::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM s)
SELECT vec_id, round(v[1] / n, 6) AS first, round(v[16] / n, 6) AS last FROM n""")
def matryoshka_renorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").select("vec_id", S.unit_vector(F.col("embedding"), 16).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[15], 6).alias("last"))


_FUSED = f"""WITH {_BM25}, {_COS},
l1 AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM b QUALIFY r <= 200),
l2 AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(similarity, 9) DESC, vec_id) AS r FROM c QUALIFY r <= 200),
u AS (SELECT id, r, 0 AS list FROM l1 UNION ALL SELECT id, r, 1 FROM l2),
z AS (SELECT id AS doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, min(list) AS list, count(*) AS lists FROM u GROUP BY id)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.rank_fusion([_words(spark, sf_dir).select("doc_id", "rank"), _vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "rank")], "doc_id")
    return out.withColumn("near", F.round("score", 9))


@query(f"{_FUSED} SELECT doc_id, round(score, 6) AS score, lists FROM z ORDER BY z.score DESC, list, doc_id LIMIT 50")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).orderBy(F.desc("near"), "list", "doc_id").limit(50).select("doc_id", F.round("score", 6).alias("score"), "lists")


@query(f"""{_FUSED}, best AS (SELECT doc_id, score, lists FROM z ORDER BY z.score DESC, list, doc_id LIMIT 30)
SELECT best.doc_id, round(score, 6) AS score, lists, d.lang, d.source, l.quality FROM best JOIN documents d ON d.doc_id = best.doc_id LEFT JOIN labels l ON l.doc_id = best.doc_id""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and vectors fused by rank, the best 30 enriched; enrichment reads the large tables by the 30 ids only."""
    best = _fused(spark, sf_dir).orderBy(F.desc("near"), "list", "doc_id").limit(30).select("doc_id", F.round("score", 6).alias("score"), "lists")
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), load(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(F.broadcast(best), "doc_id").join(labels, "doc_id", "left")


@query("""SELECT d.doc_id, l.quality, d.n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
ORDER BY l.quality DESC NULLS LAST, d.n_chars DESC NULLS LAST, d.source, d.doc_id LIMIT 500""")
def browse_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.orderBy(F.desc_nulls_last("quality"), F.desc_nulls_last("n_chars"), "source", "doc_id").limit(500).select("doc_id", "quality", "n_chars")


@query("SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, lower(source), source LIMIT 10")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.facet_counts(load(spark, sf_dir, "documents"), "source", 10)


@query(f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), d AS (SELECT DISTINCT doc_id, term FROM t), n AS (SELECT count(*) AS n FROM documents),
f AS (SELECT term, count(*) AS df FROM d GROUP BY term) SELECT term, df FROM f, n WHERE df > 1 AND df <= greatest(2, 0.6 * n)""")
def vocabulary_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of more than one and at most 60 % of the documents; the count of documents is one broadcast row."""
    return X.vocabulary(_index(spark, sf_dir)).where((F.col("df") > 1) & (F.col("df") <= F.greatest(F.lit(2.0), 0.6 * F.col("n")))).select("term", "df")


@query(f"""WITH h AS (SELECT doc_id, d.lang, {', '.join(f"len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: list_contains({words}, t))) AS {x}" for x, words in T.FUNCTION_WORDS.items())} FROM documents d)
SELECT doc_id, lang, CASE WHEN greatest(de, en, es, fr) < 3 THEN NULL WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS detected FROM h""")
def lang_function_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "lang", T.language_of(F.col("text")).alias("detected"))

"""The thin queries op1 to op13 over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, htmltext, jaccard, linededup, manifest, mixing, nearvec, quality, secrets, sharding, substrings, warczip
from .common import load, lower_ascii

SHARDS = 24
MIX_WEIGHTS = [3, 1, 2]


def op1_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"))
    return sharding.shard(rows, SHARDS, seed=17).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    sizes = docs.select(F.col("doc_id").alias("id"), "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.mix(sizes, MIX_WEIGHTS, share=1.5, max_epochs=2, seed=17)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def held_out() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score), learnt from the labelled rows that are not held out."""
    known = labels.where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return quality.classify(docs, known, seed=17).withColumnRenamed("key", "doc_id")


def op3_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.decontaminate(docs, load(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("hit_items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def op5_tree_scored_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_levelled_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op7_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(load(spark, sf_dir, "documents").select("doc_id", "text"), k=4, num=85, den=100)


def op8_zip_packaged_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warczip.archive_and_read(load(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url")


def op9_spherical_cap_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearvec.near_duplicates(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), rho=0.95, seed=17)


def op10_induced_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(load(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_hat_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents").select("lang", "text"))


def op12_recursive_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    row = lambda text: manifest.row_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text])
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    rows = docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("group"), row(F.col("text")).alias("hash"), F.when(tampered, row(lower_ascii(F.col("text")))).alias("tampered"))
    return manifest.verified(rows, fanout=8).withColumnRenamed("key", "doc_id")


def op13_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.corpus_counts(docs), seed=17))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in secrets.LEAST], F.sha2(F.encode(secrets.joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hypergeometric_sharding": op1_hypergeometric_sharding,
    "op2_water_filling_mix": op2_water_filling_mix,
    "op3_additive_quality": op3_additive_quality,
    "op4_positional_decontamination": op4_positional_decontamination,
    "op5_tree_scored_html": op5_tree_scored_html,
    "op6_levelled_line_dedup": op6_levelled_line_dedup,
    "op7_multi_order_jaccard": op7_multi_order_jaccard,
    "op8_zip_packaged_warc": op8_zip_packaged_warc,
    "op9_spherical_cap_near_dedup": op9_spherical_cap_near_dedup,
    "op10_induced_suffix_dedup": op10_induced_suffix_dedup,
    "op11_hat_trie_collocations": op11_hat_trie_collocations,
    "op12_recursive_merkle_climb": op12_recursive_merkle_climb,
    "op13_markov_secret_scan": op13_markov_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op6_levelled_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op11_hat_trie_collocations": r"""
WITH p AS (
  SELECT lang, row_number() OVER () AS pid, string_split(piece, ' ') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz.....' || ' ....'), '.')) AS piece FROM documents)
), u AS (
  SELECT lang, pid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM p
), w AS (
  SELECT lang, w AS w1, lead(w, 1) OVER here AS w2, lead(w, 2) OVER here AS w3 FROM u WHERE w <> '' WINDOW here AS (PARTITION BY pid ORDER BY i)
), g AS (
  SELECT lang, 1 AS m, w1 AS phrase FROM w
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM w WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM w WHERE w3 IS NOT NULL
), f AS (
  SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY ALL
), t AS (
  SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), cuts AS (
  SELECT c.lang, c.m, c.phrase, c.n AS a, k, x.n AS l, y.n AS r, (1000000 * c.n::HUGEINT * c.n) // (x.n::HUGEINT * y.n) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m > 1 AND n >= 10) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.ws, 1, k), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.ws, k + 1, c.m), ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, array_to_string(list_slice(ws, i, i + 1), ' ') AS phrase, max(n) AS most
  FROM (SELECT lang, n, string_split(phrase, ' ') AS ws, unnest([1, 2]) AS i FROM f WHERE m = 3 AND n >= 10) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank, b.phrase, b.a, b.l, b.r, t.n, b.score::BIGINT AS score
FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase JOIN t ON t.lang = b.lang
WHERE i.most IS NULL OR 100 * i.most < 50 * b.a
QUALIFY rank <= 2000
""",
    "op12_recursive_merkle_climb": r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_concat([b], range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) AS r(b)
  )
), d AS (
  SELECT doc_id, lang, text, n_chars, source,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) % 3 = 0 AS hit
  FROM documents, tab
), e AS (
  SELECT doc_id, lang, hit, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM d
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN hit THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS t,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
  FROM e
), own AS (
  SELECT tree, 0 AS level, pos, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM own) WHERE n > 1 GROUP BY tree, level, pos // 8
), subs AS (
  SELECT tree, h AS subroot, level AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM (SELECT * FROM own QUALIFY level = max(level) OVER (PARTITION BY tree))
), top AS (
  SELECT 0 AS level, pos, subroot AS h FROM subs
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, pos // 8
), climb AS (
  SELECT l.doc_id, l.tree, l.leaf, s.subroot, s.height, s.pos AS rank, 0 AS step, l.pos, l.t AS folded, '' AS proof FROM leaves l JOIN subs s ON s.tree = l.tree
  UNION ALL
  SELECT c.doc_id, c.tree, c.leaf, c.subroot, c.height, c.rank, c.step + 1, c.at // 8,
         sha256(coalesce(string_agg(c.h, '' ORDER BY c.p) FILTER (c.p < c.at), '') || c.folded || coalesce(string_agg(c.h, '' ORDER BY c.p) FILTER (c.p > c.at), '')),
         c.proof || coalesce(string_agg(c.h, '' ORDER BY c.p) FILTER (c.p <> c.at), '')
  FROM (
    SELECT c.*, c.pos AS at, o.pos AS p, o.h FROM climb c JOIN own o ON o.tree = c.tree AND o.level = c.step AND o.pos // 8 = c.pos // 8 WHERE c.step < c.height
    UNION ALL
    SELECT c.*, c.rank // (8 ** (c.step - c.height))::BIGINT AS at, o.pos AS p, o.h FROM climb c JOIN top o ON o.level = c.step - c.height AND o.pos // 8 = c.rank // (8 ** (c.step - c.height + 1))::BIGINT WHERE c.step >= c.height AND c.step < c.height + (SELECT max(level) FROM top)
  ) c
  GROUP BY c.doc_id, c.tree, c.leaf, c.subroot, c.height, c.rank, c.step, c.at, c.folded, c.proof
), r AS (
  SELECT h AS root FROM top QUALIFY level = max(level) OVER ()
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM climb, r QUALIFY step = max(step) OVER (PARTITION BY doc_id)
""",
}

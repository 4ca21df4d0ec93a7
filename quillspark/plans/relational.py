"""Relational queries: filters, joins, aggregates, ranking, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from .registry import load, query


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view') AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")
def filter_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rows.where(R.Filter(any_of=("event_type", ["click", "view"]), at_least=("k", 50)).predicate()).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) IN (3, 5, 8, 13)")
def any_of_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").cast("int").isin(3, 5, 8, 13)).select("event_id")


@query(r"SELECT p_partkey, p_name FROM part WHERE len(list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+'), lambda w: starts_with(w, 'p'))) > 0")
def word_start_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").where(R.Filter(word_starts=("p_name", ["p"])).predicate()).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '01') OR contains(lower(c_mktsegment), 'build')")
def contains_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = R.Filter(contains=(["c_name"], "01")).predicate() | R.Filter(contains=(["c_mktsegment"], "build")).predicate()
    return load(spark, sf_dir, "customer").where(hit).select("c_custkey")


@query("SELECT page_id, url FROM pages WHERE starts_with(lower(url), 'https://blog.')")
def path_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").where(R.Filter(path_prefix=("url", "https://BLOG.")).predicate()).select("page_id", "url")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31' AND o_totalprice >= 100000")
def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.Filter(between=("o_orderdate", F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz")), at_least=("o_totalprice", 100000))
    return load(spark, sf_dir, "orders").where(f.predicate()).select("o_orderkey")


@query("SELECT d.doc_id FROM documents d WHERE d.lang = 'fr' OR NOT EXISTS (SELECT 1 FROM documents o WHERE o.source = d.source AND o.lang = 'fr')")
def filter_language_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    owners = docs.where("lang = 'fr'").select("source").distinct()
    return docs.where("lang = 'fr'").select("doc_id").unionByName(docs.where("lang <> 'fr'").join(owners, "source", "left_anti").select("doc_id"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(load(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT e.user_id, e.event_type, e.event_id FROM events e JOIN (SELECT user_id, event_type, max(ts) AS m FROM events GROUP BY ALL) x ON e.user_id = x.user_id AND e.event_type = x.event_type AND e.ts = x.m")
def latest_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(load(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts")], ties=True).select("user_id", "event_type", "event_id")


@query("SELECT e.event_id FROM events e WHERE e.event_type = 'click' AND EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'view' AND o.user_id = e.user_id AND date_trunc('minute', o.ts) = date_trunc('minute', e.ts))")
def semi_exists_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("minute", F.date_trunc("minute", "ts"))
    return rows.where("event_type = 'click'").join(rows.where("event_type = 'view'").select("user_id", "minute"), ["user_id", "minute"], "left_semi").select("event_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey IS NOT NULL)")
def anti_busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    busy = load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").join(busy, "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus, c.c_name, n.n_name FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def left_enrich_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders, customer, nation = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = rows.join(orders, rows["l_orderkey"] == orders["o_orderkey"], "left").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name", "n_name")


@query()
def left_enrich_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem row enriched, under the name that its brute-force test has."""
    return left_enrich_three(spark, sf_dir)


@query("SELECT o_orderkey, r.first_part FROM orders JOIN (SELECT l_orderkey, min(l_linenumber) AS first_part FROM lineitem GROUP BY l_orderkey) r ON l_orderkey = o_orderkey")
def join_first_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").alias("first_part"))
    return load(spark, sf_dir, "orders").select("o_orderkey").join(first, "o_orderkey")


@query("SELECT c.conv_id, c.turn, d.source FROM conversations c LEFT JOIN documents d ON d.doc_id = coalesce(CASE WHEN c.role = 'user' THEN c.conv_id END, c.turn)")
def coalesce_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").withColumn("k", F.coalesce(F.when(F.col("role") == "user", F.col("conv_id")), F.col("turn")))
    return c.join(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "source"), "k", "left").select("conv_id", "turn", "source")


@query("SELECT count(DISTINCT o_custkey) AS customers, count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open_orders, max(o_totalprice) AS most, coalesce(min(o_totalprice), 0) AS least FROM orders")
def count_distinct_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey").alias("customers"), F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.max("o_totalprice").alias("most"), F.coalesce(F.min("o_totalprice"), F.lit(0.0)).alias("least"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_orderpriority")
def pivot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts, bool_or(value > 90) AS any_high FROM events GROUP BY event_type")
def grouped_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.bool_or(F.col("value") > 90).alias("any_high"))


@query("""WITH p AS (SELECT string_split(regexp_replace(url, '[?#].*$', ''), '/') AS p FROM pages), f AS (SELECT list_slice(p, 1, greatest(len(p) - 1, 1)) AS p FROM p),
e AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM f)
SELECT array_to_string(list_slice(p, 1, i), '/') AS folder, sum(CASE WHEN i = len(p) THEN 1 ELSE 0 END)::BIGINT AS direct, count(*) AS total FROM e GROUP BY folder""")
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.path_rollup(load(spark, sf_dir, "pages"), F.regexp_replace("url", r"[?#].*$", ""))


@query("""WITH d AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, round(median(gap) / 1000000.0::DOUBLE, 3) AS pace_s, count(gap) AS n FROM d WHERE gap IS NOT NULL GROUP BY user_id HAVING count(gap) >= 4""")
def median_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = load(spark, sf_dir, "events").select("user_id", gap.alias("gap")).where("gap is not null")
    return rows.groupBy("user_id").agg(F.round(F.median("gap") / 1e6, 3).alias("pace_s"), F.count("gap").alias("n")).where("n >= 4")


@query("""WITH c AS (SELECT l_suppkey, p_brand, count(*) AS n, round(sum(l_quantity), 2) AS weight FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT l_suppkey, p_brand, n, weight FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, weight DESC, p_brand) = 1""")
def mode_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_quantity").join(load(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    return R.mode(rows, ["l_suppkey"], "p_brand", "l_quantity")


@query("""WITH v AS (SELECT user_id, event_type, round(sum(value), 4) AS votes, min(epoch_us(ts)) AS seen FROM events GROUP BY ALL), t AS (SELECT *, sum(votes) OVER (PARTITION BY user_id) AS total FROM v)
SELECT user_id, event_type, round(votes / total, 6) AS share FROM t WHERE votes / total >= 0.2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, seen, event_type) = 1""")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("votes"), F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("seen"))
    votes = votes.withColumn("share", F.col("votes") / F.sum("votes").over(Window.partitionBy("user_id"))).where("share >= 0.2")
    return R.latest(votes, ["user_id"], [F.desc("votes"), "seen", "event_type"]).select("user_id", "event_type", F.round("share", 6).alias("share"))


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id) <= 5")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_per_group(load(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], [F.sha1(F.col("doc_id").cast("string")), "doc_id"], 5)


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS turn FROM events)
SELECT user_id, event_id, turn::INTEGER AS turn FROM r ORDER BY r.turn, value DESC, event_id LIMIT 40""")
def round_robin_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.round_robin(load(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 40).select("user_id", "event_id", "turn")


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 5")
def topk_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_per_group(load(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 5).select("p_brand", "p_partkey")


@query("SELECT event_id, value FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 12) ORDER BY ts")
def two_phase_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.two_phase(load(spark, sf_dir, "events"), [F.desc("value"), F.col("event_id")], 12, [F.col("ts")]).select("event_id", "value")


@query("SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY round(s_acctbal / 100) DESC)::INTEGER AS place FROM supplier")
def competition_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.rank().over(Window.partitionBy("s_nationkey").orderBy(F.desc(F.round(F.col("s_acctbal") / 100)))).alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, -o_orderkey) < (200000, -100) ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = (F.col("o_totalprice") < 200000) | ((F.col("o_totalprice") == 200000) & (F.col("o_orderkey") > 100))
    return load(spark, sf_dir, "orders").where(after).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderstatus = 'O' DESC, o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def priority_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").orderBy(F.desc(F.col("o_orderstatus") == "O"), "o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("""SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'gone' WHEN a.n = b.n THEN 'unchanged' ELSE 'changed' END AS state
FROM (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id) b ON a.user_id = b.user_id""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, cut = load(spark, sf_dir, "events"), F.lit("2024-01-15").cast("timestamp_ntz")
    part = lambda c: events.where(c).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return R.snapshot_diff(part(F.col("ts") < cut), part(F.col("ts") >= cut), "user_id", "n")


@query("""WITH x AS (SELECT DISTINCT array_to_string(list_slice(string_split(url, '/'), 1, 4), '/') AS root FROM pages WHERE url LIKE '%/en/%'),
m AS (SELECT page_id, url, root FROM pages JOIN x ON starts_with(url || '/', root || '/'))
SELECT p.page_id, m.root FROM pages p LEFT JOIN m ON m.page_id = p.page_id QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(m.root) DESC) = 1""")
def longest_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    roots = pages.where(F.col("url").like("%/en/%")).select(F.array_join(F.slice(F.split("url", "/"), 1, 4), "/").alias("root"))
    return R.longest_prefix(pages, "url", roots, "root").select("page_id", "root")


@query("""SELECT n_nationkey AS a, n_regionkey + 100 AS b FROM nation UNION SELECT r_regionkey + 100, 1000 FROM region UNION SELECT n_nationkey, 1000 FROM nation JOIN region ON r_regionkey = n_regionkey""")
def closure_of_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of each node; the edges are a class hierarchy of a fixed depth, joined level by level."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    edges = nation.select(F.col("n_nationkey").alias("a"), (F.col("n_regionkey") + 100).alias("b")).unionByName(region.select((F.col("r_regionkey") + 100).alias("a"), F.lit(1000).alias("b")))
    up = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
    return edges.unionByName(edges.join(up, "b").select("a", F.col("c").alias("b"))).distinct()


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("user_id", "event_type").distinct()


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(load(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT vec_id AS k FROM embeddings EXCEPT SELECT doc_id FROM labels")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k")).exceptAll(load(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT vec_id AS k FROM embeddings INTERSECT SELECT doc_id FROM labels")
def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k")).intersect(load(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) = 1")
def dedupe_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dedupe_folded(load(spark, sf_dir, "part"), "p_brand", [F.col("p_partkey")]).select("p_partkey", "p_brand")


@query("""SELECT DISTINCT sha256(c.text) AS key, c.text FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.text = c.text) AND c.text IS NOT NULL""")
def translation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without an entry in the memory, each once; texts meet by their hash, not by themselves."""
    asked = load(spark, sf_dir, "conversations").where("text is not null").select(F.sha2("text", 256).alias("key"), "text")
    known = load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"))
    return asked.join(known, "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))


@query()
def translation_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be asked for conversations (language unknown) and documents, whose texts are the memory for their own language."""
    docs = load(spark, sf_dir, "documents")
    sources = load(spark, sf_dir, "conversations").select("text", F.lit(None).cast("string").alias("language")).unionByName(docs.select("text", F.col("lang").alias("language")))
    return R.wanted(sources, docs.select("text", F.col("lang").alias("target"), F.col("text").alias("answer")))


@query("SELECT doc_id FROM documents WHERE sha256(coalesce(text, '') || chr(31) || coalesce(lang, '')) <> sha256(coalesce(text, '') || chr(31) || CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE coalesce(lang, '') END)")
def content_key_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.when(F.col("doc_id") % 3 == 0, "xx").otherwise(F.col("lang")).alias("before"))
    return docs.where(T.content_key(F.col("text"), F.col("lang")) != T.content_key(F.col("text"), F.col("before"))).select("doc_id")


@query("""WITH q AS (SELECT l.quality, l.toxic, d.lang, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, round(avg(n_chars), 4) AS chars, round(100.0::DOUBLE * avg(quality) / max(avg(quality)) OVER (), 4) AS points FROM q GROUP BY lang""")
def bench_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("q"), F.avg("toxic").alias("t"), F.avg("n_chars").alias("c"))
    best = rows.agg(F.max("q").alias("best"))
    return rows.join(F.broadcast(best)).select("lang", "n", F.round("q", 6).alias("quality"), F.round("t", 6).alias("toxic"), F.round("c", 4).alias("chars"), F.round(100.0 * F.col("q") / F.col("best"), 4).alias("points"))


@query("""SELECT l_suppkey, round(greatest(0, 100 - 40 * avg(l_discount) * 10 - 30 * avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) - 20 * avg(l_tax) * 10), 4) AS usability FROM lineitem GROUP BY l_suppkey""")
def usability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    penalty = 40 * F.avg("l_discount") * 10 + 30 * F.avg((F.col("l_returnflag") == "R").cast("double")) + 20 * F.avg("l_tax") * 10
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.greatest(F.lit(0.0), 100 - penalty), 4).alias("usability"))


@query("SELECT event_type, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY event_type")
def nearest_rank_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("p90"))


@query("""WITH p AS (SELECT o_orderkey, coalesce(l1.n, 0) AS items, CASE WHEN o_orderstatus = 'F' THEN 'path' WHEN l1.n > 4 THEN 'size' WHEN o_orderpriority = '1-URGENT' THEN 'name' ELSE 'ambiguous' END AS matched
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l1 ON l1.l_orderkey = o_orderkey) SELECT matched, count(*) AS n, sum(items)::BIGINT AS items FROM p GROUP BY matched""")
def priority_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = load(spark, sf_dir, "orders").join(items, "o_orderkey", "left")
    matched = F.when(F.col("o_orderstatus") == "F", "path").when(F.col("n") > 4, "size").when(F.col("o_orderpriority") == "1-URGENT", "name").otherwise("ambiguous")
    return rows.groupBy(matched.alias("matched")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("n", F.lit(0))).alias("items"))

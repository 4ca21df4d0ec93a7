"""Queries of library listings, their joins and their state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import library as L
from ..operators import relational as R
from ..session import shared_path
from .registry import load, query
from .sequences import us


@query("WITH d AS (SELECT p_partkey, trim(trim(coalesce(p_brand, '')) || ' ' || trim(coalesce(p_type, ''))) AS device FROM part) SELECT p_partkey, device FROM d WHERE device = (SELECT device FROM d WHERE p_partkey = 7)")
def device_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_partkey", L.device(F.col("p_brand"), F.col("p_type")).alias("device"))
    return rows.join(F.broadcast(rows.where("p_partkey = 7").select("device")), "device").select("p_partkey", "device")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT coalesce(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_orderkey END, l_partkey) FROM lineitem WHERE l_linenumber = 1)")
def bin_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.coalesce(F.when(F.col("l_returnflag") != "R", F.col("l_orderkey")), "l_partkey").alias("o_orderkey"))
    return load(spark, sf_dir, "orders").join(items, "o_orderkey", "left_semi").select("o_orderkey")


@query("""WITH u AS (SELECT page_id, url, regexp_replace(url, '/[^/]*$', '') AS folder FROM pages), t AS (SELECT DISTINCT folder FROM u)
SELECT page_id, t.folder FROM pages p JOIN t ON starts_with(p.url, t.folder || '/') AND instr(substr(p.url, length(t.folder) + 2), '/') = 0 AND length(p.url) > length(t.folder) + 1""")
def folder_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with the folder that it stands in itself; a path meets its own folder, so no join is needed."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("url", "/[^/]*$", "").alias("folder"))
    return pages.where(L.direct_child(F.col("url"), F.col("folder"))).select("page_id", "folder")


@query("""WITH c AS (SELECT user_id, date_trunc('minute', ts) AS m, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT e.event_id, c.value AS context FROM events e LEFT JOIN c ON c.user_id = e.user_id AND c.m = date_trunc('minute', e.ts)""")
def same_minute_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.floor(us() / 60000000).alias("m"))
    context = rows.where("event_type = 'view'").groupBy("user_id", "m").agg(F.max("value").alias("context"))
    return rows.join(context, ["user_id", "m"], "left").select("event_id", "context")


@query("""SELECT event_id FROM events WHERE CASE WHEN event_type IN ('view', 'click') THEN 'done' ELSE 'failed' END IN ('done', 'skipped') AND json_extract_string(props, '$.k') <> '' AND NOT coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 5 = 0 END, FALSE)""")
def reusable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type").isin("view", "click"), "done").otherwise("failed")
    retry = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 5 == 0)
    return load(spark, sf_dir, "events").where(L.reusable(status, F.get_json_object("props", "$.k"), retry)).select("event_id")


@query("WITH b AS (SELECT l_orderkey, list_distinct(list(l_linestatus || l_returnflag)) AS b FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey FROM b WHERE len(list_filter(b, lambda x: NOT list_contains(['FA', 'FR', 'FN', 'OA'], x))) = 0")
def unblocked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_linestatus", "l_returnflag")).alias("b"))
    redone = F.array(*[F.lit(x) for x in ("FA", "FR", "FN", "OA")])
    return blocked.where(F.size(F.array_except("b", redone)) == 0).select("l_orderkey")


@query(r"""WITH l AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations), t AS (SELECT *, (length(t) % 30) / 30.0::DOUBLE AS s FROM l), n AS (SELECT *, length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) AS n FROM t)
SELECT conv_id, turn, role, i, trim(regexp_replace(t, '\s+', ' ', 'g')) AS line FROM n WHERE CASE WHEN n >= 3 THEN s >= 0.8 ELSE n = 2 AND s >= 0.9 END""")
def ocr_lines_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every text, with a score of its own."""
    lines = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return lines.where(L.keep_line(F.col("t"), (F.length("t") % 30) / 30.0)).select("conv_id", "turn", "role", F.col("i").cast("long").alias("i"), L.clean_line(F.col("t")).alias("line"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity / 10 >= 2 AND coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 10 END, 0) <= 0.5 AND coalesce(l_tax * 12, 0) <= 0.7 AND NOT (l_returnflag = 'N' AND l_linenumber <= 1)""")
def eligible_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    black = F.coalesce(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount") * 10), F.lit(0.0))
    still = (F.col("l_returnflag") == "N") & (F.col("l_linenumber") <= 1)
    return load(spark, sf_dir, "lineitem").where((F.col("l_quantity") / 10 >= 2) & (black <= 0.5) & (F.col("l_tax") * 12 <= 0.7) & ~still).select("l_orderkey", "l_linenumber")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 2 ELSE 1 END AS sources, l_discount * 10 AS score, l_quantity / 5 AS seconds, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, p_name FROM s WHERE sources >= 2 OR (score >= 0.6 AND seconds >= 3) OR (score >= 0.4 AND seconds >= 1 AND len(list_filter(string_split(lower(p_name), ' '), lambda w: list_contains(['part', 'red', 'blue', 'widget'], w))) > 0)""")
def sound_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources, or strong and long, or fair with a word that names it; a NaN never passes."""
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    score, seconds = F.nanvl(F.col("l_discount") * 10, F.lit(-1.0)), F.nanvl(F.col("l_quantity") / 5, F.lit(-1.0))
    named = F.arrays_overlap(F.split(F.lower("p_name"), " "), F.array(*[F.lit(w) for w in ("part", "red", "blue", "widget")]))
    return rows.where((F.col("l_linenumber") % 3 == 0) | ((score >= 0.6) & (seconds >= 3)) | ((score >= 0.4) & (seconds >= 1) & named)).select("l_orderkey", "l_linenumber", "p_name")


@query("WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity >= 40 AS ok FROM lineitem) SELECT l_orderkey, l_linenumber FROM m QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY l_orderkey)")
def allowed_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.or_all(load(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_quantity") >= 40).select("l_orderkey", "l_linenumber")


@query("""WITH p AS (SELECT conv_id, turn, role, text AS a, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS b FROM conversations)
SELECT conv_id, turn, role FROM p WHERE trim(b) <> '' AND length(b) <= 3 * length(a) + 40""")
def plausible_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")), F.lit(""))
    rows = load(spark, sf_dir, "conversations").withColumn("after", after)
    return rows.where(L.plausible(F.col("text"), F.col("after"))).select("conv_id", "turn", "role")


@query("""SELECT e.event_id, coalesce(CASE event_type WHEN 'view' THEN c.c_name WHEN 'click' THEN s.s_name ELSE p.p_name END, 'gone') AS target FROM events e
LEFT JOIN customer c ON e.event_type = 'view' AND c.c_custkey = e.user_id LEFT JOIN supplier s ON e.event_type = 'click' AND s.s_suppkey = e.user_id LEFT JOIN part p ON p.p_partkey = e.user_id""")
def job_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target of a job is in another table for each kind: a left join each, then the one that the kind asks for."""
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    for table, key, name in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")):
        rows = rows.join(load(spark, sf_dir, table).select(F.col(key).alias("user_id"), name), "user_id", "left")
    target = F.when(F.col("event_type") == "view", F.col("c_name")).when(F.col("event_type") == "click", F.col("s_name")).otherwise(F.col("p_name"))
    return rows.select("event_id", F.coalesce(target, F.lit("gone")).alias("target"))


@query("WITH k AS (SELECT sha256(coalesce(text, '')) AS h, min(doc_id) AS known FROM documents WHERE doc_id % 2 = 0 GROUP BY h) SELECT d.doc_id, k.known FROM documents d JOIN k ON k.h = sha256(coalesce(d.text, '')) WHERE d.doc_id % 2 = 1")
def known_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents whose text an even one has: one equi join on the hash."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    known = rows.where("doc_id % 2 = 0").groupBy("h").agg(F.min("doc_id").alias("known"))
    return rows.where("doc_id % 2 = 1").join(known, "h").select("doc_id", "known")


@query("""WITH seen AS (SELECT doc_id + 5 AS path, md5(coalesce(text, '')) AS mark FROM documents WHERE doc_id % 3 <> 0), known AS (SELECT doc_id AS path, md5(coalesce(text, '')) AS mark, doc_id % 2 = 0 AS offline FROM documents),
g AS (SELECT mark, min(path) AS was FROM known WHERE offline GROUP BY mark)
SELECT seen.path, CASE WHEN k.path IS NOT NULL THEN 'known' WHEN g.was IS NOT NULL THEN 'moved' ELSE 'new' END AS state, CASE WHEN k.path IS NULL THEN g.was END AS was FROM seen LEFT JOIN known k ON k.path = seen.path LEFT JOIN g ON g.mark = seen.mark""")
def moved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("mark"))
    seen = docs.where("doc_id % 3 <> 0").select((F.col("doc_id") + 5).alias("path"), "mark")
    known = docs.select(F.col("doc_id").alias("path"), "mark", (F.col("doc_id") % 2 == 0).alias("offline"))
    return L.moved(seen, known, "mark", "path").select("path", "state", "was")


@query("""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS key, l_quantity AS size, l_partkey % 50 AS mark FROM lineitem WHERE l_returnflag = 'R'), f AS (SELECT l_orderkey * 10 + l_linenumber AS file, l_quantity AS size, l_partkey % 50 AS mark FROM lineitem WHERE l_returnflag = 'A'),
x AS (SELECT *, row_number() OVER (PARTITION BY size, mark ORDER BY key) AS i FROM l), y AS (SELECT *, row_number() OVER (PARTITION BY size, mark ORDER BY file) AS i FROM f) SELECT key, file FROM x JOIN y USING (size, mark, i)""")
def relink_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_quantity").alias("size"), (F.col("l_partkey") % 50).alias("mark"), "l_returnflag")
    return L.relink(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'").withColumnRenamed("key", "file"), "size", "mark", "key", "file")


@query("""WITH lib AS (SELECT p_partkey AS found, p_name AS path, p_brand AS clip, p_type AS name, p_size AS size FROM part), w AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS path, CASE WHEN p_partkey % 3 = 1 THEN p_brand END AS clip, p_type AS name, p_size AS size FROM part),
a AS (SELECT path, count(*) AS n, min(found) AS f FROM lib GROUP BY path), b AS (SELECT clip, name, count(*) AS n, min(found) AS f FROM lib GROUP BY ALL), c AS (SELECT name, size, count(*) AS n, min(found) AS f FROM lib GROUP BY ALL), d AS (SELECT name, count(*) AS n, min(found) AS f FROM lib GROUP BY ALL)
SELECT key, CASE WHEN a.n = 1 THEN 'path' WHEN a.n > 1 THEN 'ambiguous' WHEN b.n = 1 THEN 'clip' WHEN b.n > 1 THEN 'ambiguous' WHEN c.n = 1 THEN 'size' WHEN c.n > 1 THEN 'ambiguous' WHEN d.n = 1 THEN 'name' WHEN d.n > 1 THEN 'ambiguous' ELSE 'missing' END AS way,
CASE WHEN a.n IS NOT NULL THEN CASE WHEN a.n = 1 THEN a.f END WHEN b.n IS NOT NULL THEN CASE WHEN b.n = 1 THEN b.f END WHEN c.n IS NOT NULL THEN CASE WHEN c.n = 1 THEN c.f END WHEN d.n = 1 THEN d.f END AS found
FROM w LEFT JOIN a ON a.path = w.path LEFT JOIN b ON b.clip = w.clip AND b.name = w.name LEFT JOIN c ON c.name = w.name AND c.size = w.size LEFT JOIN d ON d.name = w.name""")
def clip_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    library = part.select(F.col("p_partkey").alias("found"), F.col("p_name").alias("path"), F.col("p_brand").alias("clip"), F.col("p_type").alias("name"), F.col("p_size").alias("size"))
    key = F.col("p_partkey")
    wanted = part.select(key.alias("key"), F.when(key % 3 == 0, F.col("p_name")).alias("path"), F.when(key % 3 == 1, F.col("p_brand")).alias("clip"), F.col("p_type").alias("name"), F.col("p_size").alias("size"))
    return L.cascade(wanted, library, [("path", ["path"]), ("clip", ["clip", "name"]), ("size", ["name", "size"]), ("name", ["name"])], "key", "found").select("key", "way", "found")


@query("""WITH a AS (SELECT l_orderkey, list_distinct(list(l_shipdate::DATE::VARCHAR)) AS d FROM lineitem GROUP BY ALL)
SELECT l_orderkey % 500 AS bin, bool_or(l_orderkey % 97 = 0) AS everything, CASE WHEN bool_or(l_orderkey % 97 = 0) THEN '' ELSE array_to_string(list_sort(list_distinct(flatten(list(d)))), ',') END AS names FROM a GROUP BY bin""")
def scope_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of a bin united one after another; one that holds everything absorbs the others."""
    # Names are distinct before they are gathered, so a list holds each of them once, however many scopes have it.
    names = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("bin"), (F.col("l_orderkey") % 97 == 0).alias("every"), F.col("l_shipdate").cast("date").cast("string").alias("d"))
    rows = names.groupBy("bin", "d").agg(F.bool_or("every").alias("every")).groupBy("bin").agg(F.bool_or("every").alias("everything"), F.array_sort(F.collect_list("d")).alias("names"))
    none = F.array().cast("array<string>")
    return rows.select("bin", L.union_scope(F.col("everything"), none, F.lit(False), F.col("names")).alias("s")).select("bin", "s.everything", F.array_join("s.names", ",").alias("names"))


@query("""WITH t AS (SELECT p_partkey, p_brand, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS likeness FROM t a JOIN t b ON b.p_brand = a.p_brand AND b.p_partkey = a.p_partkey + 25""")
def jaccard_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_brand", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("w"))
    other = rows.select((F.col("p_partkey") - 25).alias("p_partkey"), "p_brand", F.col("w").alias("v"))
    met = rows.join(other, ["p_partkey", "p_brand"])
    return met.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 25).alias("b"), F.round(L.jaccard(F.col("w"), F.col("v")), 6).alias("likeness"))


@query(r"""WITH u AS (SELECT page_id, '\\?\UNC\' || replace(replace(url, '://', '\'), '/', '\\') || '\x\..\.\' AS p FROM pages), s AS (SELECT page_id, lower('//' || rtrim(regexp_replace(replace(substr(p, 9), '\', '/'), '/+', '/', 'g'), '/')) AS k FROM u)
SELECT page_id, rtrim(regexp_replace(k, '/x/\.\./\.$', ''), '/') AS key FROM s""")
def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.lit("\\\\?\\UNC\\"), F.replace(F.replace(F.col("url"), F.lit("://"), F.lit("\\")), F.lit("/"), F.lit("\\\\")), F.lit("\\x\\..\\.\\"))
    return load(spark, sf_dir, "pages").select("page_id", L.path_key(odd).alias("key"))


@query(r"""WITH e AS (SELECT p_brand || ' - cut v' || p_size AS name FROM part), x AS (SELECT regexp_extract(name, '^(.*) - cut v', 1) AS base, max(regexp_extract(name, 'v(\d+)$', 1)::BIGINT) AS n FROM e GROUP BY base), w AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part)
SELECT w.name, w.name || ' - cut v' || (coalesce(n, 0) + 1) AS versioned FROM w LEFT JOIN x ON x.base = w.name""")
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    wanted = part.select(F.col("p_brand").alias("name")).union(part.select("p_type")).distinct()
    return L.next_version(wanted, part.select(F.concat("p_brand", F.lit(" - cut v"), F.col("p_size").cast("string")).alias("name")), "name", "cut", "Untitled")


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(html, '<b>', ''), '</b>', ''), '[ \t\r\n]+', ' ', 'g')) AS text FROM (SELECT page_id, regexp_replace('<sp<b>an>' || coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') || '</sp</b>an>', '</?span>|</?sp<b>an>|</sp</b>an>', '', 'g') AS html FROM pages)""")
def clean_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup that appears once other markup is taken out goes, too."""
    title = F.concat(F.lit("<sp<b>an>"), F.coalesce(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")), F.lit("</sp</b>an>"))
    return load(spark, sf_dir, "pages").select("page_id", L.clean_fixed(title).alias("text"))


def edges_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("url", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.array_join(F.slice("p", 1, i), "/").alias("up"), F.array_join(F.slice("p", 1, i + 1), "/").alias("down")))
    return load(spark, sf_dir, "pages").withColumn("p", parts).where(F.size("p") > 1).select(F.inline(ups)).distinct()


@query(r"""WITH RECURSIVE p AS (SELECT DISTINCT string_split(url, '/') AS p FROM pages), e AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS up, array_to_string(p[1:i + 1], '/') AS down FROM p, range(1, 12) r(i) WHERE i < len(p)),
c AS (SELECT up, down FROM e UNION SELECT c.up, e.down FROM c JOIN e ON e.up = c.down) SELECT up, count(*) AS below, max(down) AS last FROM c GROUP BY up""")
def closure_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything below each folder, by doubling of paths until nothing is new."""

    def write(df: DataFrame) -> DataFrame:
        path = shared_path(spark, f"closure-{uuid.uuid4().hex}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    pairs = L.closure(edges_of_paths(spark, sf_dir), "up", "down", write)
    return pairs.groupBy("up").agg(F.count(F.lit(1)).alias("below"), F.max("down").alias("last"))


@query("""WITH r AS (SELECT user_id, epoch_us(ts) AS us, event_id, event_id % 19 = 0 AS every, [event_type] AS names, event_type || (event_id % 5) AS focus FROM events)
SELECT user_id, bool_or(every) AS everything, CASE WHEN bool_or(every) THEN '' ELSE array_to_string(list_sort(list_distinct(flatten(list(names)))), ',') END AS names, arg_max(focus, struct_pack(us := us, focus := focus)) AS focus, count(*) AS requests FROM r GROUP BY user_id""")
def merged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", us().alias("us"), (F.col("event_id") % 19 == 0).alias("everything"), F.array("event_type").alias("names"), F.concat("event_type", (F.col("event_id") % 5).cast("string")).alias("focus"))
    return L.merged_requests(rows, "user_id", "us").withColumn("names", F.array_join("names", ","))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'queued' WHEN event_type = 'click' THEN 'cancelled' ELSE 'done' END AS status, CASE WHEN event_type = 'view' THEN value END AS progress FROM events""")
def crash_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that were running are queued again, stages that were running are cancelled; progress is kept of live jobs only."""
    before = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "stage").otherwise("done")
    after = F.when(before == "running", "queued").when(before == "stage", "cancelled").otherwise(before)
    return load(spark, sf_dir, "events").select("event_id", after.alias("status"), F.when(before == "running", F.col("value")).alias("progress"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), s AS (SELECT user_id, event_type FROM e WHERE r = 1)
SELECT e.user_id, max(CASE WHEN s.event_type <> 'purchase' THEN e.value END) AS progress FROM events e JOIN s ON s.user_id = e.user_id GROUP BY e.user_id""")
def late_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress counts only while its job still runs: the job's last state decides."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", us().alias("us"))
    last = rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("us", "event_id")).alias("state"))
    return rows.join(last, "user_id").groupBy("user_id").agg(F.max(F.when(F.col("state") != "purchase", F.col("value"))).alias("progress"))


@query("""WITH l AS (SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, array_to_string(list_sort(list(event_type)), ',') AS stages FROM l WHERE event_id % 3 = 0 AND user_id NOT IN (SELECT user_id FROM l WHERE event_id % 7 = 0) GROUP BY user_id""")
def waiting_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos whose latest run of a stage waits, and that have no active job."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_type", "event_id", us().alias("us"))
    last = R.latest(rows, ["user_id", "event_type"], [F.desc("us"), F.desc("event_id")])
    active = last.where("event_id % 7 = 0").select("user_id").distinct()
    return last.where("event_id % 3 = 0").join(active, "user_id", "left_anti").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("stages"))


@query("""WITH pl AS (SELECT unnest(['view', 'click', 'purchase', 'export']) AS stage, unnest([2, 3, 1, 1]) AS wanted), r AS (SELECT user_id, event_type AS stage, event_id % 4 AS version, CASE WHEN event_id % 11 = 0 THEN 'skipped' ELSE 'done' END AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
m AS (SELECT u.user_id, pl.stage, CASE WHEN r.status IS NULL THEN 'missing' WHEN r.status = 'skipped' THEN 'skipped' WHEN r.version < pl.wanted THEN 'outdated' END AS state FROM (SELECT DISTINCT user_id FROM r) u CROSS JOIN pl LEFT JOIN r ON r.user_id = u.user_id AND r.stage = pl.stage)
SELECT user_id, coalesce(array_to_string(list_sort(list(stage) FILTER (state = 'missing')), ','), '') AS missing, coalesce(array_to_string(list_sort(list(stage) FILTER (state = 'outdated')), ','), '') AS outdated, coalesce(array_to_string(list_sort(list(stage) FILTER (state = 'skipped')), ','), '') AS skipped FROM m GROUP BY user_id""")
def analysis_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = spark.createDataFrame([("view", 2), ("click", 3), ("purchase", 1), ("export", 1)], "stage string, version int")
    rows = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("stage"), "event_id", us().alias("us"))
    runs = R.latest(rows, ["user_id", "stage"], [F.desc("us"), F.desc("event_id")]).select("user_id", "stage", (F.col("event_id") % 4).alias("version"), F.when(F.col("event_id") % 11 == 0, "skipped").otherwise("done").alias("status"))
    out = L.gaps(plan, runs, "user_id", "stage")
    return out.select("user_id", *[F.array_join(c, ",").alias(c) for c in ("missing", "outdated", "skipped")])


def _sort(df: DataFrame, order: list, name: str) -> DataFrame:
    return df.orderBy(*order).limit(100).select("o_orderkey", F.lit(name).alias("listing"))


@query("""(SELECT o_orderkey, 'recent' AS listing FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100) UNION ALL (SELECT o_orderkey, 'name' FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 100)
UNION ALL (SELECT o_orderkey, 'duration' FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100) UNION ALL (SELECT o_orderkey, 'timeline' FROM orders ORDER BY o_custkey, o_orderstatus, o_orderkey LIMIT 100)""")
def listing_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four orders of a listing, each a bounded heap, with nulls placed and ties broken."""
    rows = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    ways = {"recent": [F.desc_nulls_last("o_orderdate"), key], "name": [F.col("o_orderpriority"), key], "duration": [F.desc_nulls_last("o_totalprice"), key], "timeline": [F.col("o_custkey"), F.col("o_orderstatus"), key]}
    parts = [_sort(rows, order, name) for name, order in ways.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT p_partkey, p_name FROM part ORDER BY regexp_replace(lower(p_name), '[0-9]+', '', 'g'), length(p_name), lower(p_name), p_partkey LIMIT 200")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in natural order: numbers count as numbers."""
    return load(spark, sf_dir, "part").orderBy(T.natural_key(F.col("p_name")), "p_partkey").limit(200).select("p_partkey", "p_name")


@query("""SELECT source, count(*) AS total, ceil(count(*) / 30.0)::BIGINT AS pages FROM documents GROUP BY source""")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / 30.0).alias("pages"))


@query("""WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) AS value FROM part) SELECT value, count(*) AS n FROM w GROUP BY value ORDER BY n DESC, value LIMIT 40""")
def facet_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select(F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("word"))
    return R.facet_counts(rows, "word", 40)

"""Queries of facts: shots, frames, sky, tracks, places, boxes, ranks, tags, nested values, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facts as A
from ..operators import stretches as St
from .registry import load, query
from .sequences import samples

_LIN = "l_orderkey, l_linenumber"


@query("""SELECT l_orderkey, round(avg(l_quantity), 6) AS mean, median(l_extendedprice) AS middle, round(avg(CASE WHEN l_discount < 0.03 THEN 1.0::DOUBLE ELSE 0 END), 6) AS dark, count(*) AS n FROM lineitem GROUP BY l_orderkey""")
def shot_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.median("l_extendedprice").alias("middle"), F.round(F.avg((F.col("l_discount") < 0.03).cast("double")), 6).alias("dark"), F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, 2 * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) >= count(*) AS wide, 2 * sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) >= count(*) AS calm, count(*) AS voters FROM lineitem GROUP BY l_orderkey""")
def block_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = lambda c, v: (2 * F.sum((F.col(c) == v).cast("int")) >= F.count(F.lit(1)))
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(votes("l_returnflag", "R").alias("wide"), votes("l_linestatus", "F").alias("calm"), F.count(F.lit(1)).alias("voters"))


_SKY = """s AS (SELECT l_orderkey, l_linenumber, [NULL, 'clear', 'partly_cloudy', 'overcast', 'rain', 'fog'][l_linenumber % 6 + 1] AS model, [NULL, 'clear', 'partly_cloudy', 'overcast', 'rain', 'snow'][l_partkey % 6 + 1] AS seen, l_quantity / 10 AS weight, l_discount * 10 AS share, l_suppkey % 4 AS views, l_tax * 12 AS sunshine FROM lineitem)"""


@query(f"""WITH {_SKY}, r AS (SELECT *, CASE model WHEN 'clear' THEN 0 WHEN 'partly_cloudy' THEN 1 WHEN 'overcast' THEN 2 END AS a, CASE seen WHEN 'clear' THEN 0 WHEN 'partly_cloudy' THEN 1 WHEN 'overcast' THEN 2 END AS b, weight >= 3 AND share >= 0.75 AS many FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN model IS NULL AND seen IS NULL THEN NULL WHEN model IS NULL THEN seen WHEN seen IS NULL OR model = seen THEN model WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN model = 'overcast' AND sunshine >= 0.6 THEN seen WHEN abs(a - b) = 1 THEN 'partly_cloudy' WHEN many THEN seen ELSE model END ELSE model END AS category,
CASE WHEN model IS NULL AND seen IS NULL THEN 'unknown' WHEN model IS NULL THEN 'visual_only' WHEN seen IS NULL THEN 'api_only' WHEN model = seen THEN 'agree' WHEN a IS NOT NULL AND b IS NOT NULL AND ((model = 'overcast' AND sunshine >= 0.6) OR abs(a - b) = 1) THEN 'close' ELSE 'disagree' END AS agreement,
CASE WHEN model IS NULL AND seen IS NULL THEN 'low' WHEN model IS NULL THEN CASE WHEN views >= 2 AND share >= 0.75 THEN 'medium' ELSE 'low' END WHEN seen IS NULL THEN 'medium' WHEN model = seen THEN 'high' WHEN a IS NOT NULL AND b IS NOT NULL AND ((model = 'overcast' AND sunshine >= 0.6) OR abs(a - b) = 1) THEN 'medium' ELSE 'low' END AS confidence FROM r""")
def weather_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, i: F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    model = pick([None, "clear", "partly_cloudy", "overcast", "rain", "fog"], F.col("l_linenumber") % 6)
    seen = pick([None, "clear", "partly_cloudy", "overcast", "rain", "snow"], F.col("l_partkey") % 6)
    v = A.sky_verdict(model, seen, F.col("l_quantity") / 10, F.col("l_discount") * 10, F.col("l_suppkey") % 4, F.col("l_tax") * 12, F.lit(None).cast("double"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v")).select("l_orderkey", "l_linenumber", "v.category", "v.agreement", "v.confidence")


@query("""WITH m AS (SELECT l_orderkey, median(2000 + l_extendedprice / 10) AS k, 3000 + min(l_quantity) * 50 AS low, 5000 + max(l_quantity) * 100 AS high FROM lineitem GROUP BY l_orderkey),
b AS (SELECT *, 153.8::DOUBLE + least(0, 1e6::DOUBLE / high - 181.8::DOUBLE) - 40 AS lo, 153.8::DOUBLE + greatest(0, 1e6::DOUBLE / low - 181.8::DOUBLE) + 40 AS hi FROM m)
SELECT l_orderkey, round(k, 4) AS kelvin, CASE WHEN 1e6::DOUBLE / k > hi THEN 'warmer' WHEN 1e6::DOUBLE / k < lo THEN 'cooler' ELSE 'consistent' END AS verdict FROM b""")
def white_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.median(2000 + F.col("l_extendedprice") / 10).alias("k"), (3000 + F.min("l_quantity") * 50).alias("low"), (5000 + F.max("l_quantity") * 100).alias("high"))
    return m.select("l_orderkey", F.round("k", 4).alias("kelvin"), A.light_verdict(F.col("k"), F.col("low"), F.col("high")).alias("verdict"))


@query("""WITH i AS (SELECT l_suppkey AS video, l_orderkey * 10 + l_linenumber AS frame, CASE WHEN l_quantity > 10 THEN l_returnflag END AS issue FROM lineitem), f AS (SELECT video, count(DISTINCT frame) AS n FROM i GROUP BY video HAVING count(DISTINCT frame) >= 5),
c AS (SELECT video, issue, count(DISTINCT frame) AS k FROM i WHERE issue IS NOT NULL GROUP BY ALL) SELECT c.video, c.issue FROM c JOIN f ON f.video = c.video WHERE k / n::DOUBLE >= 0.3""")
def source_wide_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("video"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame"), F.when(F.col("l_quantity") > 10, F.col("l_returnflag")).alias("issue"))
    return A.source_wide(rows, "video", "frame", "issue", share=0.3)


@query("""WITH p AS (SELECT l_orderkey, CASE WHEN l_quantity < 10 THEN 35 WHEN l_quantity < 20 THEN 15 ELSE 0 END::DOUBLE AS p, CASE WHEN l_quantity < 10 THEN 'very short' ELSE 'short' END AS l FROM lineitem UNION ALL SELECT l_orderkey, 25 * greatest(0, 0.05 - l_discount) / 0.05, 'shaky' FROM lineitem UNION ALL SELECT l_orderkey, CASE WHEN l_tax > 0.07 THEN 20 ELSE 0 END, 'dark' FROM lineitem),
s AS (SELECT l_orderkey, greatest(0, round_even(100 - sum(p), 0))::INTEGER AS score FROM p GROUP BY l_orderkey), r AS (SELECT l_orderkey, l, max(p) AS p FROM p WHERE p >= 5 GROUP BY ALL), t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, l) <= 3)
SELECT s.l_orderkey, s.score, coalesce(string_agg(t.l, ',' ORDER BY t.p DESC, t.l), '') AS reasons FROM s LEFT JOIN t ON t.l_orderkey = s.l_orderkey GROUP BY ALL""")
def usability_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    each = F.array(
        F.struct(F.when(q < 10, 35.0).when(q < 20, 15.0).otherwise(0.0).alias("p"), F.when(q < 10, "very short").otherwise("short").alias("l")),
        F.struct((25 * F.greatest(F.lit(0.0), 0.05 - F.col("l_discount")) / 0.05).alias("p"), F.lit("shaky").alias("l")),
        F.struct(F.when(F.col("l_tax") > 0.07, 20.0).otherwise(0.0).alias("p"), F.lit("dark").alias("l")),
    )
    out = A.scored(rows.select("l_orderkey", F.inline(each)), ["l_orderkey"], "p", "l")
    return out.select("l_orderkey", "score", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT l_orderkey, round(CASE WHEN sum(greatest(0, l_quantity - 5)) > 0 THEN sum(l_discount * 100 * greatest(0, l_quantity - 5)) / sum(greatest(0, l_quantity - 5)) ELSE avg(l_discount * 100) END, 4) AS usability FROM lineitem GROUP BY l_orderkey""")
def block_usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 100).alias("v"), (F.col("l_quantity") - 5).alias("w"))
    return A.weighted_mean(rows, ["l_orderkey"], "v", "w", "usability").withColumn("usability", F.round("usability", 4))


@query("""SELECT o_custkey, CASE WHEN min(o_orderdate)::DATE = max(o_orderdate)::DATE THEN min(o_orderdate)::DATE::VARCHAR ELSE min(o_orderdate)::DATE || ' - ' || max(o_orderdate)::DATE END AS name FROM orders GROUP BY o_custkey""")
def suggested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(first == last, first.cast("string")).otherwise(F.concat_ws(" - ", first.cast("string"), last.cast("string"))).alias("name"))


@query("""WITH p AS (SELECT user_id, epoch_us(ts) AS us, value / 2 - 20 AS lat, (event_id % 90)::DOUBLE AS lon, value AS h FROM events), q AS (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS b FROM p WINDOW w AS (PARTITION BY user_id ORDER BY us)),
d AS (SELECT *, 2 * 6371.0088::DOUBLE * asin(sqrt(least(pow(sin(radians(lat - a) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin(radians(lon - b) / 2), 2), 1.0::DOUBLE))) * 1000 AS m FROM q)
SELECT user_id, round(coalesce(sum(m), 0), 2) AS meters, round(min(lat), 4) AS south, round(max(lat), 4) AS north, round(max(h) - min(h), 4) AS climb, count(*) AS points FROM d GROUP BY user_id""")
def track_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select("user_id", "us", (F.col("value") / 2 - 20).alias("lat"), (F.col("event_id") % 90).cast("double").alias("lon"), "value")
    out = A.track_stats(rows, ["user_id"], "us", "lat", "lon", "value")
    return out.select("user_id", F.round("meters", 2).alias("meters"), F.round("south", 4).alias("south"), F.round("north", 4).alias("north"), F.round(F.col("high") - F.col("low"), 4).alias("climb"), "points")


@query("""WITH p AS (SELECT s_suppkey AS p_id, (s_suppkey * 37 % 1600) / 10.0::DOUBLE - 80 AS p_lat, (s_suppkey * 91 % 3600) / 10.0::DOUBLE - 180 AS p_lon FROM supplier), c AS (SELECT c_custkey, (c_custkey * 37 % 1600) / 10.0::DOUBLE - 80 + 0.1::DOUBLE AS lat, (c_custkey * 91 % 3600) / 10.0::DOUBLE - 180 + 0.1::DOUBLE AS lon FROM customer),
d AS (SELECT c_custkey, p_id, round(2 * 6371.0088::DOUBLE * asin(sqrt(least(pow(sin(radians(p_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(p_lat)) * pow(sin(radians(p_lon - lon) / 2), 2), 1.0::DOUBLE))), 9) AS km FROM c, p),
b AS (SELECT * FROM d WHERE km <= 30 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, p_id) = 1) SELECT c.c_custkey, b.p_id, round(b.km, 4) AS km FROM c LEFT JOIN b ON b.c_custkey = c.c_custkey""")
def nearest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c, k, m, off: (F.col(c) * k % m) / 10.0 - off
    places = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_id"), at("s_suppkey", 37, 1600, 80).alias("p_lat"), at("s_suppkey", 91, 3600, 180).alias("p_lon"))
    points = load(spark, sf_dir, "customer").select("c_custkey", (at("c_custkey", 37, 1600, 80) + 0.1).alias("lat"), (at("c_custkey", 91, 3600, 180) + 0.1).alias("lon"))
    return A.nearest_places(points, places, "c_custkey").select("c_custkey", "p_id", F.round("km", 4).alias("km"))


@query("""WITH o AS (SELECT user_id, event_id, avg(value) OVER w AS factor, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)) SELECT event_id, round(factor, 6) AS factor, n FROM o""")
def rolling_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(-63, 0)
    return samples(spark, sf_dir).select("event_id", F.round(F.avg("value").over(w), 6).alias("factor"), F.count(F.lit(1)).over(w).alias("n"))


@query("""WITH k AS (SELECT doc_id, 'video' AS kind FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT doc_id, 'chapter' FROM documents WHERE n_chars > 2000 UNION ALL SELECT doc_id, 'shot' FROM documents UNION ALL SELECT doc_id, 'keyframe' FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'transcript' FROM documents WHERE lang <> 'en') SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def passage_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of five kinds in one union, counted by kind: each document makes its kinds in place, so it is read once."""
    kinds = {"video": F.col("doc_id") % 9 == 0, "chapter": F.col("n_chars") > 2000, "shot": F.lit(True), "keyframe": F.col("lang") == "en", "transcript": F.col("lang") != "en"}
    made = F.array_compact(F.array(*[F.when(test, name) for name, test in kinds.items()]))
    return load(spark, sf_dir, "documents").select(F.explode(made).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT l_orderkey AS timeline, l_partkey AS file, l_linenumber AS pos, l_returnflag = 'A' AS audio FROM lineitem), g AS (SELECT timeline, file, min(pos) AS first, count(*) FILTER (NOT audio) AS video_uses, count(*) FILTER (audio) AS audio_uses FROM c GROUP BY ALL)
SELECT timeline, file, row_number() OVER (PARTITION BY timeline ORDER BY first, file) AS place, CASE WHEN video_uses > 0 THEN video_uses ELSE audio_uses END AS uses FROM g""")
def timeline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct files of a timeline in order of their first clip; uses on picture tracks count before those on sound tracks."""
    clips = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("timeline"), F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("pos"), "l_returnflag")
    return St.used_files(clips, "timeline", "file", "pos", F.col("l_returnflag") == "A")


@query("""SELECT lang, count(*) FILTER (n_chars = 0 OR text IS NULL) AS empty, count(*) FILTER (n_chars > 0 AND doc_id % 4 = 0) AS added, count(*) FILTER (n_chars > 0 AND doc_id % 4 = 1) AS changed, count(*) FILTER (n_chars > 0 AND doc_id % 4 > 1) AS unchanged FROM documents GROUP BY lang""")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.col("n_chars") > 0
    count = lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("long"))
    return load(spark, sf_dir, "documents").groupBy("lang").agg(count((F.col("n_chars") == 0) | F.col("text").isNull()).alias("empty"), count(some & (F.col("doc_id") % 4 == 0)).alias("added"), count(some & (F.col("doc_id") % 4 == 1)).alias("changed"), count(some & (F.col("doc_id") % 4 > 1)).alias("unchanged"))


@query("""WITH j AS (SELECT user_id, epoch_us(ts) AS us, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20) SELECT user_id, median(value) AS pace, round(median(value) * (user_id % 7), 4) AS eta FROM j GROUP BY user_id""")
def queue_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median pace of the last twenty jobs, and how long the waiting ones take at it."""
    w = Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id"))
    last = samples(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 20")
    return last.groupBy("user_id").agg(F.median("value").alias("pace")).withColumn("eta", F.round(F.col("pace") * (F.col("user_id") % 7), 4))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, 24 + l_discount * 60 + l_linenumber AS fps, l_returnflag = 'R' AS v FROM lineitem), r AS (SELECT unnest(['24000/1001','24/1','25/1','30000/1001','30/1','48000/1001','48/1','50/1','60000/1001','60/1','100/1','120000/1001','120/1']) AS name, unnest([24000/1001.0::DOUBLE, 24, 25, 30000/1001.0::DOUBLE, 30, 48000/1001.0::DOUBLE, 48, 50, 60000/1001.0::DOUBLE, 60, 100, 120000/1001.0::DOUBLE, 120]) AS r, unnest(range(0, 13)) AS i),
b AS (SELECT DISTINCT fps, v, arg_min(struct_pack(r := r, name := name), struct_pack(o := abs(r - fps), i := i)) AS b FROM (SELECT DISTINCT fps, v FROM f), r GROUP BY fps, v)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(b.r / f.fps - 1) <= 0.005 THEN CASE WHEN f.v AND b.name = '30/1' THEN '30000/1001' WHEN f.v AND b.name = '60/1' THEN '60000/1001' ELSE b.name END END AS rate FROM f JOIN b ON b.fps = f.fps AND b.v = f.v""")
def standard_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = 24 + F.col("l_discount") * 60 + F.col("l_linenumber")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", A.standard_rate(fps, F.col("l_returnflag") == "R").alias("rate"))


@query("""WITH a AS (SELECT o_orderkey, (o_totalprice / 40)::BIGINT AS slot, o_custkey % 400 AS p FROM orders), b AS (SELECT *, least(800, greatest(256, slot // 5)) AS answer FROM a) SELECT o_orderkey, answer, greatest(0, slot - answer - p - slot // 20) AS passages FROM b""")
def answer_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.bround(F.col("o_totalprice") / 40).cast("long")
    return load(spark, sf_dir, "orders").select("o_orderkey", A.answer_budget(slot, F.col("o_custkey") % 400).alias("b")).select("o_orderkey", "b.answer", "b.passages")


@query("""WITH s AS (SELECT s_suppkey, round(s_acctbal / 100, 0) AS score FROM supplier), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, s_suppkey) AS i, lag(score) OVER (ORDER BY score DESC, s_suppkey) - score AS gap FROM s)
SELECT s_suppkey, score, max(CASE WHEN gap IS NULL OR gap > 1 THEN i END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS place FROM o""")
def competition_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a score board with a tolerance; the board is one row a model."""
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") / 100, 0).alias("score"))
    return A.competition(rows, "score", 1.0).select("s_suppkey", "score", F.col("place").cast("long").alias("place"))


@query("""WITH m AS (SELECT l_suppkey, sum(l_quantity) AS seconds, sum(l_extendedprice) AS words FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round_even(100 * min(seconds) OVER () / seconds, 0)::INTEGER AS speed, round_even(100 * words / max(words) OVER (), 0)::INTEGER AS recall FROM m""")
def normalised_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from 0 to 100 against the best; the best values are one broadcast row, so the board is not put in one task."""
    m = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("seconds"), F.sum("l_extendedprice").alias("words"))
    best = m.agg(F.min("seconds").alias("fast"), F.max("words").alias("most"))
    return m.join(F.broadcast(best)).select("l_suppkey", F.bround(100 * F.col("fast") / F.col("seconds")).cast("int").alias("speed"), F.bround(100 * F.col("words") / F.col("most")).cast("int").alias("recall"))


_BOX = "l_orderkey, l_linenumber, l_discount * 5 AS x1, l_tax * 5 AS y1, l_discount * 5 + l_quantity / 100 AS x2, l_tax * 5 + l_quantity / 80 AS y2"


@query(f"""WITH b AS (SELECT {_BOX}, l_returnflag = 'R' AS f, l_partkey AS score FROM lineitem), a AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM b), w AS (SELECT *, sum(f::INTEGER) OVER v AS n, max(CASE WHEN f THEN area END) OVER v AS largest, max(struct_pack(s := score, a := area)) OVER v AS best FROM a WINDOW v AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber, CASE WHEN n = 0 THEN struct_pack(s := score, a := area) = best ELSE f AND (n < 3 OR area >= 0.4 * largest) END AS main FROM w""")
def main_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = (F.col("l_quantity") / 100) * (F.col("l_quantity") / 80)
    x2, y2 = F.col("l_discount") * 5 + F.col("l_quantity") / 100, F.col("l_tax") * 5 + F.col("l_quantity") / 80
    area = (x2 - F.col("l_discount") * 5) * (y2 - F.col("l_tax") * 5)
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("f"), area.alias("area"), F.col("l_partkey").alias("score"))
    return A.main_flags(rows, "l_orderkey", "f", "area", "score").select("l_orderkey", "l_linenumber", "main")


@query(f"""WITH b AS (SELECT {_BOX}, l_partkey * 10 + l_linenumber AS id, l_suppkey AS score, l_returnflag FROM lineitem), f AS (SELECT l_orderkey, id AS face, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, score FROM b WHERE l_returnflag = 'A'), p AS (SELECT l_orderkey, id AS person, x1, y1, x2, y2 FROM b WHERE l_returnflag <> 'A'),
m AS (SELECT f.l_orderkey, face, score, arg_min(person, struct_pack(a := (x2 - x1) * (y2 - y1), p := person)) AS person FROM f JOIN p ON p.l_orderkey = f.l_orderkey AND x1 <= x AND x <= x2 AND y1 <= y AND y <= y2 GROUP BY ALL)
SELECT l_orderkey, person, arg_max(face, struct_pack(s := score, f := -face)) AS face FROM m GROUP BY ALL""")
def faces_of_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t, q = F.col("l_discount") * 5, F.col("l_tax") * 5, F.col("l_quantity")
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("score"), "l_returnflag", d.alias("x1"), t.alias("y1"), (d + q / 100).alias("x2"), (t + q / 80).alias("y2"))
    faces = rows.where("l_returnflag = 'A'").select("l_orderkey", F.col("id").alias("face"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), "score")
    people = rows.where("l_returnflag <> 'A'").select("l_orderkey", F.col("id").alias("person"), "x1", "y1", "x2", "y2")
    return A.smallest_container(faces, people, "l_orderkey")


@query(f"""WITH RECURSIVE b AS (SELECT {_BOX}, l_returnflag AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_discount * 5, l_tax * 5, l_discount * 5 + l_quantity / 100) AS i FROM lineitem),
r AS (SELECT l_orderkey, i, [i] AS kept FROM b WHERE i = 1 UNION ALL SELECT b.l_orderkey, b.i, CASE WHEN EXISTS (SELECT 1 FROM b c WHERE c.l_orderkey = b.l_orderkey AND list_contains(r.kept, c.i) AND c.kind = b.kind AND
greatest(0, least(b.x2, c.x2) - greatest(b.x1, c.x1)) * greatest(0, least(b.y2, c.y2) - greatest(b.y1, c.y1)) / ((b.x2 - b.x1) * (b.y2 - b.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) - greatest(0, least(b.x2, c.x2) - greatest(b.x1, c.x1)) * greatest(0, least(b.y2, c.y2) - greatest(b.y1, c.y1))) >= 0.3) THEN r.kept ELSE list_append(r.kept, b.i) END FROM r JOIN b ON b.l_orderkey = r.l_orderkey AND b.i = r.i + 1)
SELECT l_orderkey, max(len(kept))::BIGINT AS kept FROM r GROUP BY l_orderkey""")
def deduped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t, q = F.col("l_discount") * 5, F.col("l_tax") * 5, F.col("l_quantity")
    box = F.struct(d.alias("x1"), t.alias("y1"), (d + q / 100).alias("x2"), (t + q / 80).alias("y2"))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"), box.alias("box"))
    return A.kept_boxes(rows, "l_orderkey", "l_linenumber", "box", "kind", 0.3).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("kept"))


@query("""WITH s AS (SELECT doc_id, lang, source, sha1(doc_id::VARCHAR) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS turn FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, sha1(coalesce(source, '')), h) AS n FROM r) SELECT doc_id, lang FROM q WHERE n <= 10""")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of each language, sources in turn, both in the order of hashes."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha1(F.col("doc_id").cast("string")).alias("h"))
    # No source gives a language more than its quota, so only the first rows of each are ranked again.
    turn = docs.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("h")))
    own = F.row_number().over(Window.partitionBy("source", "lang").orderBy("h"))
    few = turn.withColumn("own", own).where("own <= 10")
    w = Window.partitionBy("lang").orderBy("turn", F.sha1(F.coalesce("source", F.lit(""))), "h")
    return few.withColumn("n", F.row_number().over(w)).where("n <= 10").select("doc_id", "lang")


@query(r"""WITH a AS (SELECT p_brand AS k, p_type AS tag, p_partkey AS o FROM part WHERE p_size <= 10), b AS (SELECT p_brand, unnest(string_split(p_name, ' ')) AS tag, p_partkey FROM part WHERE p_size > 40), u AS (SELECT k, 0 AS source, lower(tag) AS tag, o FROM a UNION ALL SELECT p_brand, 1, lower(tag), p_partkey FROM b),
f AS (SELECT k, tag, min(struct_pack(source := source, o := o)) AS f FROM u WHERE tag <> '' GROUP BY ALL) SELECT k, tag, f.source FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY f, tag) <= 15""")
def merged_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), "p_type", "p_name", "p_size", F.col("p_partkey").alias("o"))
    a = part.where("p_size <= 10").select("k", F.col("p_type").alias("tag"), "o")
    b = part.where("p_size > 40").select("k", F.explode(F.split("p_name", " ")).alias("tag"), "o")
    return A.merged_tags([a, b], ["k"], "tag", "o", 15)


@query(r"""SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_'']+'), lambda w: length(w) > 2 AND NOT list_contains(['the', 'and', 'les', 'des', 'der', 'die', 'los', 'las'], w)))) AS words FROM documents""")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = F.array(*[F.lit(w) for w in ("the", "and", "les", "des", "der", "die", "los", "las")])
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}_']+)"), 1)
    return load(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))).cast("long").alias("words"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_concat(list_distinct(string_split(lower(p_name), ' ')), ['@place:' || lower(p_brand), '@setting:' || lower(p_type)])), ' ') AS signature FROM part""")
def block_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.array(F.concat(F.lit("@place:"), F.lower("p_brand")), F.concat(F.lit("@setting:"), F.lower("p_type")))
    words = F.array_distinct(F.split(F.lower("p_name"), " "))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_union(words, typed)), " ").alias("signature"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+'), lambda w: list_contains(['the', 'and', 'of', 'with', 'is', 'are'], w))) >= 2 AS english FROM documents")
def english_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("the", "and", "of", "with", "is", "are")])
    found = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z']+)"), 1), lambda w: F.array_contains(words, w))
    return load(spark, sf_dir, "documents").select("doc_id", (F.size(found) >= 2).alias("english"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'anglais' WHEN 'fr' THEN 'français' WHEN 'de' THEN 'allemand' WHEN 'es' THEN 'espagnol' ELSE coalesce(lang, 'inconnue') END AS language FROM documents")
def language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("en", "anglais", "fr", "français", "de", "allemand", "es", "espagnol")])
    return load(spark, sf_dir, "documents").select("doc_id", F.coalesce(names[F.col("lang")], "lang", F.lit("inconnue")).alias("language"))


@query(r"""SELECT doc_id, source || ' | ' || lang || ' | ' || printf('%02d:%02d', (doc_id % 3600) // 60, doc_id % 60) || ' | ' || CASE WHEN length(f) <= 80 THEN f ELSE regexp_replace(substr(f, 1, 80), ' [^ ]*$', '') || '…' END AS line FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g')) AS f FROM documents)""")
def passage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.clocks import short_clock

    blank = lambda c: F.coalesce(c, F.lit(""))
    return load(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" | ", blank(F.col("source")), blank(F.col("lang")), short_clock(F.col("doc_id") % 3600), T.cut_words(blank(F.col("text")), 80)).alias("line"))


@query("""WITH a AS (SELECT p_partkey, p_size % 12 AS n, p_size % 5 AS k FROM part) SELECT p_partkey, 'A claim' || CASE WHEN n BETWEEN 1 AND 6 THEN ' [' || n || ']' ELSE '' END || ' and more' || CASE WHEN k >= 1 THEN ' [' || k || '][' || (k + 1) || ']' ELSE ' [1]' END || '. End.' AS text,
array_to_string(list_distinct(list_concat(CASE WHEN n BETWEEN 1 AND 6 THEN [n] ELSE [] END, CASE WHEN k >= 1 THEN [k, k + 1] ELSE [1] END)), ',') IS NOT NULL AS cited, CASE WHEN n BETWEEN 1 AND 6 THEN 0 ELSE 1 END + CASE WHEN k >= 1 THEN 0 ELSE 1 END + 1 AS dropped FROM a""")
def read_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = (F.col("p_size") % 12).cast("string"), F.col("p_size") % 5
    answer = F.concat(F.lit("A claim ["), n, F.lit("] and more ["), k.cast("string"), F.lit("-"), (k + 1).cast("string"), F.lit("]. End [99]."))
    out = load(spark, sf_dir, "part").select("p_partkey", A.citations(answer, 6).alias("c"))
    return out.select("p_partkey", "c.text", F.col("c.cited").isNotNull().alias("cited"), F.col("c.dropped").alias("dropped"))


@query("""WITH d AS (SELECT user_id, list({'label': event_type, 'at': event_id} ORDER BY event_id) AS items FROM events GROUP BY user_id) SELECT user_id, array_to_string(list_transform(items, lambda x: upper(x.label) || ':' || x.at), ',') AS rewritten FROM d""")
def nested_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts inside a nested list are found by their path and replaced in place."""
    items = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("at"), F.col("event_type").alias("label")))).alias("items"))
    done = items.withColumn("items", F.transform("items", lambda x: x.withField("label", F.upper(x["label"]))))
    return done.select("user_id", F.array_join(F.transform("items", lambda x: F.concat(x["label"], F.lit(":"), x["at"].cast("string"))), ",").alias("rewritten"))


@query("""WITH m AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, array_to_string(list_transform(ids, lambda x: CASE WHEN x % 3 = 0 THEN 'gone' ELSE 'k' || x END), ',') AS ids FROM m""")
def id_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in nested lists meet their new names by a join of the exploded list, and go back in order."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    names = load(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("name"))
    met = rows.join(names, "l_partkey", "left").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.coalesce("name", F.when(F.col("l_partkey") % 3 == 0, "gone").otherwise(F.concat(F.lit("k"), F.col("l_partkey").cast("string")))).alias("name")))).alias("ids"))
    return met.select("l_orderkey", F.array_join(F.transform("ids", lambda x: x["name"]), ",").alias("ids"))


@query("""WITH o AS (SELECT c.c_custkey, map([c.c_mktsegment, 'all'], [c.c_custkey % 7, 1]) AS a, map(['all', 'extra'], [c.c_custkey % 5, 2]) AS b FROM customer c)
SELECT c_custkey, array_to_string(list_sort(list_transform(list_distinct(list_concat(map_keys(a), map_keys(b))), lambda k: k || '=' || coalesce(b[k], a[k]))), ',') AS merged FROM o""")
def payload_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two payloads of one target as one: the newer value wins, keys of either stay."""
    a = F.create_map(F.col("c_mktsegment"), F.col("c_custkey") % 7, F.lit("all"), F.lit(1).cast("long"))
    b = F.create_map(F.lit("all"), F.col("c_custkey") % 5, F.lit("extra"), F.lit(2).cast("long"))
    merged = F.map_zip_with(a, b, lambda k, old, new: F.coalesce(new, old))
    pairs = F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return load(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(pairs), ",").alias("merged"))


@query("""WITH p AS (SELECT conv_id, role, list(text ORDER BY turn) AS t FROM conversations GROUP BY ALL), a AS (SELECT conv_id, t FROM p WHERE role = 'user'), b AS (SELECT conv_id, t FROM p WHERE role = 'assistant') SELECT a.conv_id, count(*) AS pairs, sum(length(x[1]) + length(x[2])) AS chars FROM a JOIN b ON b.conv_id = a.conv_id, unnest(list_zip(a.t, b.t)) u(x) WHERE x[1] IS NOT NULL AND x[2] IS NOT NULL GROUP BY a.conv_id""")
def paired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents' lists of texts side by side, by place."""
    rows = load(spark, sf_dir, "conversations")
    texts = lambda role, name: rows.where(F.col("role") == role).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias(name))
    both = texts("user", "a").join(texts("assistant", "b"), "conv_id").select("conv_id", F.explode(F.arrays_zip("a", "b")).alias("p"))
    return both.where("p.a.text is not null AND p.b.text is not null").groupBy("conv_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.length("p.a.text") + F.length("p.b.text")).alias("chars"))


@query(r"""SELECT page_id, replace(replace(json, '/home/me', '<folder>'), '\\', '/') AS clean FROM (SELECT page_id, '{"path":"/home/me/' || regexp_extract(url, '://([^/]+)', 1) || '","n":' || page_id || '}' AS json FROM pages)""")
def scrubbed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder names of this computer taken out of nested values, wherever they stand in the document."""
    doc = F.to_json(F.struct(F.concat(F.lit("/home/me/"), F.regexp_extract("url", "://([^/]+)", 1)).alias("path"), F.col("page_id").alias("n")))
    return load(spark, sf_dir, "pages").select("page_id", F.replace(F.replace(doc, F.lit("/home/me"), F.lit("<folder>")), F.lit("\\/"), F.lit("/")).alias("clean"))


@query("""SELECT l_orderkey, string_agg(CASE WHEN i = 1 THEN '00:00' ELSE printf('%02d:%02d', s // 60, s % 60) END || ' ' || l_returnflag || l_linenumber, chr(10) ORDER BY i) || chr(10) AS chapters FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS i, (l_linenumber * 61)::BIGINT AS s FROM lineitem) GROUP BY l_orderkey""")
def chapter_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line a chapter; the first one is at 00:00."""
    from ..functions.clocks import short_clock

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    rows = load(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(w))
    line = F.concat(F.when(F.col("i") == 1, "00:00").otherwise(short_clock(F.col("l_linenumber") * 61)), F.lit(" "), "l_returnflag", F.col("l_linenumber").cast("string"))
    return rows.groupBy("l_orderkey").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("chapters"))


@query("""WITH m AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 100 + l_quantity, l_partkey) AS n, (l_linenumber * 100 + l_quantity)::BIGINT AS f FROM lineitem), t AS (SELECT *, printf('%02d:%02d:%02d:%02d', f // 90000, f // 1500 % 60, f // 25 % 60, f % 25) AS a, printf('%02d:%02d:%02d:%02d', (f + 1) // 90000, (f + 1) // 1500 % 60, (f + 1) // 25 % 60, (f + 1) % 25) AS b FROM m WHERE n <= 999)
SELECT l_orderkey, string_agg(printf('%03d', n) || '  001      V     C        ' || a || ' ' || b || ' ' || a || ' ' || b, chr(10) ORDER BY n) AS edl FROM t GROUP BY l_orderkey""")
def marker_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers by frame, at most 999 a list, as edit-list lines."""
    from ..functions.clocks import frames_timecode

    frame = (F.col("l_linenumber") * 100 + F.col("l_quantity")).cast("long")
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", frame.alias("f"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.col("l_linenumber") * 100 + F.col("l_quantity"), "l_partkey")).alias("n")).where("n <= 999")
    a, b = frames_timecode(F.col("f"), 25), frames_timecode(F.col("f") + 1, 25)
    line = F.concat(F.lpad(F.col("n").cast("string"), 3, "0"), F.lit("  001      V     C        "), F.concat_ws(" ", a, b, a, b))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("edl"))


@query("""SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name, x.n AS lines, x.total FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN (SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_orderkey) x ON x.l_orderkey = o.o_orderkey""")
def library_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line a video with the facts of all its tables: small ones are broadcast by their size, the rest joins on the key."""
    rows = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left")
    rows = rows.join(load(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "left").join(load(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "left")
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return rows.join(lines, "o_orderkey", "left").select("o_orderkey", "c_name", "n_name", "r_name", "lines", "total")


@query("""WITH d AS (SELECT conv_id, to_json(list({'turn': turn, 'role': role, 'chars': length(text)} ORDER BY turn, role)) AS doc FROM conversations GROUP BY conv_id) SELECT conv_id, sha256(doc) AS digest FROM d""")
def analysis_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of an owner as one JSON text, fields in a fixed order, and its digest."""
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("chars")))).alias("rows"))
    return rows.select("conv_id", F.sha2(F.to_json("rows"), 256).alias("digest"))


@query("""WITH r AS (SELECT DISTINCT regexp_replace(url, '/[^/]*$', '') AS root FROM pages), p AS (SELECT page_id, url FROM pages)
SELECT p.page_id, arg_max(root, length(root)) AS root FROM p JOIN r ON starts_with(p.url, r.root || '/') GROUP BY p.page_id""")
def covering_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest root folder that holds a file: a file's own prefixes meet the roots."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return St.deepest_root(pages, pages.select(F.regexp_replace("url", "/[^/]*$", "").alias("root")), "page_id", "url", "root")


@query("""WITH s AS (SELECT o_orderkey, o_orderstatus = 'F' AS offline, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48) AS running FROM orders) SELECT o_orderkey, offline AND NOT running AS taken FROM s""")
def forgotten_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline videos without a running job are taken, the others are left."""
    running = load(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("running", F.lit(True))
    rows = load(spark, sf_dir, "orders").join(running, "o_orderkey", "left")
    return rows.select("o_orderkey", ((F.col("o_orderstatus") == "F") & F.col("running").isNull()).alias("taken"))


@query("""WITH w AS (SELECT doc_id, sha256(coalesce(text, '')) AS written, sha256(CASE WHEN doc_id % 7 = 0 THEN 'edited' ELSE coalesce(text, '') END) AS holds, doc_id % 5 = 0 AS gone FROM documents) SELECT doc_id, CASE WHEN gone THEN 'create' WHEN holds = written THEN 'replace' ELSE 'conflict' END AS action FROM w""")
def file_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file is replaced only while it holds what was written to it."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    files = docs.where("doc_id % 5 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, "edited").otherwise(F.col("t")), 256).alias("holds"))
    return St.ledger_actions(docs.select("doc_id", F.sha2("t", 256).alias("written")), files, "doc_id", "written", "holds")


@query("""WITH a AS (SELECT p_partkey, lower(p_brand || '/' || p_type) AS rel, CASE WHEN p_size % 2 = 0 THEN '/lib/' || p_brand ELSE '/other' END AS root FROM part) SELECT p_partkey, CASE WHEN starts_with(root, '/lib/') THEN substr(root, 6) || '/' || rel ELSE rel END AS rel, CASE WHEN starts_with(root, '/lib/') THEN '/lib' ELSE root END AS root FROM a""")
def reparented_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of roots below a new folder root move under it: their path gets the part in between."""
    root = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/lib/"), "p_brand")).otherwise("/other")
    rows = load(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat("p_brand", F.lit("/"), "p_type")).alias("rel"), root.alias("root"))
    return St.under_root(rows, "root", "rel", "/lib")
"""Queries that apply scalar functions to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import space as P
from ..functions import text as T
from .registry import load, query


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]|[​-‏‪-‮⁦-⁩]', '', 'g'), '</?[A-Za-z][^<>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def clean_untrusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.clean_untrusted(F.col("html")).alias("text"))


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS f FROM documents) SELECT doc_id, CASE WHEN length(f) <= 160 THEN f ELSE regexp_replace(substr(f, 1, 160), ' [^ ]*$', '') || '…' END AS short FROM f""")
def cut_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.cut_words(F.col("text"), 160).alias("short"))


@query(r"""WITH g AS (SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[=+\-@\t\r]') THEN '''' || p_name ELSE p_name END AS n, p_retailprice FROM part)
SELECT p_partkey, (CASE WHEN regexp_matches(n, '[;"\r\n]') THEN '"' || replace(n, '"', '""') || '"' ELSE n END) || ';' || replace(printf('%.2f', p_retailprice), '.', ',') AS line FROM g""")
def csv_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.concat_ws(";", T.csv_field(F.col("p_name")), F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(","))).alias("line"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '[\r\n]+', ' ', 'g'), '([\\|*_`\[\]<>])', '\\\1', 'g') AS cell FROM pages""")
def md_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.markdown_cell(F.col("url")).alias("cell"))


@query("""WITH m AS (SELECT event_id, floor(value * 100 * 1000 + 0.5)::BIGINT AS ms, floor(value * 25)::BIGINT AS f FROM events)
SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock, printf('%02d:%02d:%02d:%02d', f // 90000, f // 1500 % 60, f // 25 % 60, f % 25) AS timecode FROM m""")
def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", T.clock(F.col("value") * 100).alias("clock"), T.timecode(F.floor(F.col("value") * 25), 25).alias("timecode"))


@query("""WITH p AS (SELECT c_custkey, ((c_custkey * 37) % 180 - 90)::DOUBLE AS lat, ((c_custkey * 91) % 360 - 180)::DOUBLE AS lon FROM customer)
SELECT c_custkey, round(2 * 6371.0088::DOUBLE * asin(sqrt(least(pow(sin(radians(48.8566::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.8566::DOUBLE)) * pow(sin(radians(2.3522::DOUBLE - lon) / 2), 2), 1.0::DOUBLE))), 3) AS km FROM p""")
def haversine_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 37) % 180 - 90).cast("double").alias("lat"), ((F.col("c_custkey") * 91) % 360 - 180).cast("double").alias("lon"))
    return rows.select("c_custkey", F.round(P.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.8566), F.lit(2.3522)), 3).alias("km"))


@query("""WITH d AS (SELECT event_id, epoch_us(ts) / 1000000.0::DOUBLE / 86400.0::DOUBLE - 10957.5::DOUBLE AS d FROM events), g AS (SELECT event_id, d, radians(357.529::DOUBLE + 0.98560028::DOUBLE * d) AS g, 280.459::DOUBLE + 0.98564736::DOUBLE * d AS q, radians(23.439::DOUBLE - 0.00000036::DOUBLE * d) AS e FROM d),
l AS (SELECT *, radians(q + 1.915::DOUBLE * sin(g) + 0.020::DOUBLE * sin(2 * g)) AS l FROM g), s AS (SELECT event_id, asin(sin(e) * sin(l)) AS dec, radians(280.46061837::DOUBLE + 360.98564736629::DOUBLE * d + 2.35::DOUBLE - degrees(atan2(cos(e) * sin(l), cos(l)))) AS h FROM l),
x AS (SELECT event_id, degrees(asin(sin(radians(48.85::DOUBLE)) * sin(dec) + cos(radians(48.85::DOUBLE)) * cos(dec) * cos(h))) AS el FROM s)
SELECT event_id, round(el, 4) AS elevation, CASE WHEN el < -18 THEN 'night' WHEN el < -12 THEN 'astronomical' WHEN el < -6 THEN 'nautical' WHEN el < -0.833 THEN 'civil' WHEN el < 6 THEN 'golden' ELSE 'day' END AS phase FROM x""")
def sun_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    el = load(spark, sf_dir, "events").select("event_id", P.sun_elevation(at, F.lit(48.85), F.lit(2.35)).alias("el"))
    return el.select("event_id", F.round("el", 4).alias("elevation"), P.light_phase(F.col("el")).alias("phase"))


@query("SELECT c, count(*) AS n FROM (SELECT CASE WHEN k = 0 THEN 'clear' WHEN k <= 2 THEN 'partly' WHEN k = 3 THEN 'overcast' WHEN k BETWEEN 45 AND 48 THEN 'fog' WHEN k BETWEEN 51 AND 67 THEN 'rain' WHEN k BETWEEN 71 AND 77 THEN 'snow' WHEN k BETWEEN 80 AND 82 THEN 'showers' WHEN k >= 95 THEN 'storm' ELSE 'other' END AS c FROM (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)) GROUP BY c")
def weather_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(P.weather_category(F.get_json_object("props", "$.k").cast("int")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_discount * 5 AS x1, l_tax * 5 AS y1, l_discount * 5 + l_quantity / 100 AS x2, l_tax * 5 + l_quantity / 80 AS y2 FROM lineitem),
p AS (SELECT a.l_orderkey, a.l_linenumber, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS s, (b.x2 - b.x1) * (b.y2 - b.y1) AS t FROM b a JOIN b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
SELECT l_orderkey, l_linenumber, round(max(CASE WHEN s + t - i > 0 THEN i / (s + t - i) ELSE 0 END), 6) AS iou FROM p GROUP BY ALL""")
def iou_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct((F.col("l_discount") * 5).alias("x1"), (F.col("l_tax") * 5).alias("y1"), (F.col("l_discount") * 5 + F.col("l_quantity") / 100).alias("x2"), (F.col("l_tax") * 5 + F.col("l_quantity") / 80).alias("y2"))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("a"))
    other = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("a").alias("b"))
    met = rows.join(other, ["l_orderkey", "l_linenumber"])
    return met.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.max(P.iou(F.col("a"), F.col("b"))), 6).alias("iou"))

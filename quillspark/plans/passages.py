"""Queries of passages, crops, capture times and coverage. Users stand for videos, days for stretches, event types for kinds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import passages as P
from ..session import shared_path
from .registry import load, query
from .sequences import samples

_T = "(epoch_us(ts) / 1000000.0::DOUBLE - 1704067200.0::DOUBLE)"


def _t() -> F.Column:
    return F.col("us") / 1e6 - 1704067200.0


@query(f"""WITH f AS (SELECT user_id AS video, {_T} AS t, CASE WHEN event_type = 'click' THEN 'unknown' ELSE event_type END AS kind, CASE WHEN value > 50 THEN 'w' || (event_id % 4) END AS weather, value FROM events),
sp AS (SELECT DISTINCT video, d AS span, d * 172800.0::DOUBLE AS a, d * 172800.0::DOUBLE + 172800.0::DOUBLE AS b FROM f, range(0, 15) r(d)), sh AS (SELECT video, floor(t / 7200)::BIGINT * 7200.0::DOUBLE AS s, floor(t / 7200)::BIGINT * 7200.0::DOUBLE + 7200 AS e, max(value) AS u FROM f GROUP BY ALL),
k AS (SELECT sp.video, sp.span, list_sort(list_distinct(list(kind) FILTER (kind <> 'unknown'))) AS kinds, list_sort(list_distinct(list(weather) FILTER (weather IS NOT NULL))) AS weather FROM sp JOIN f ON f.video = sp.video AND t >= a AND t < b GROUP BY ALL),
v AS (SELECT sp.video, sp.span, sum(least(b, t + 0.3::DOUBLE) - greatest(a, t)) AS said FROM sp JOIN f ON f.video = sp.video AND kind = 'view' AND t < b AND t + 0.3::DOUBLE > a GROUP BY ALL), m AS (SELECT sp.video, sp.span, max(u) AS usability FROM sp JOIN sh ON sh.video = sp.video AND sh.s < b AND sh.e > a GROUP BY ALL)
SELECT sp.video, sp.span, coalesce(array_to_string(k.kinds, ','), '') AS kinds, coalesce(array_to_string(k.weather, ','), '') AS weather, coalesce(said, 0) >= 1.0 AS speech, usability FROM sp LEFT JOIN k USING (video, span) LEFT JOIN v USING (video, span) LEFT JOIN m USING (video, span)""")
def passage_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select(F.col("user_id").alias("video"), _t().alias("t"), F.when(F.col("event_type") == "click", "unknown").otherwise(F.col("event_type")).alias("kind"), F.when(F.col("value") > 50, F.concat(F.lit("w"), (F.col("event_id") % 4).cast("string"))).alias("weather"), "value")
    spans = rows.select("video").distinct().select("video", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("span")).select("video", "span", (F.col("span") * 172800.0).alias("a"), (F.col("span") * 172800.0 + 172800.0).alias("b"))
    speech = rows.where("kind = 'view'").select("video", F.col("t").alias("s"), (F.col("t") + 0.3).alias("e"))
    shots = rows.groupBy("video", (F.floor(F.col("t") / 7200) * 7200.0).alias("s")).agg(F.max("value").alias("usability")).withColumn("e", F.col("s") + 7200)
    out = P.facets(spans, rows.select("video", "t", "kind", "weather"), speech, shots, 86400.0)
    return out.select("video", "span", F.array_join("kinds", ",").alias("kinds"), F.array_join("weather", ",").alias("weather"), "speech", "usability")


def built(spark: SparkSession, sf_dir: str, limit: int = 400) -> DataFrame:
    """Passages of three kinds over conversations: the whole, a turn, and what is said in groups of four turns."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    ordered = lambda: F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"])
    whole = rows.groupBy(F.col("conv_id").alias("video")).agg(ordered().alias("parts")).withColumn("part", F.lit(0).cast("long"))
    shots = rows.select(F.col("conv_id").alias("video"), (F.col("turn") * 2 + (F.col("role") == "user").cast("int")).cast("long").alias("part"), F.array("role", "text").alias("parts"))
    speech = rows.groupBy(F.col("conv_id").alias("video"), F.floor(F.col("turn") / 4).cast("long").alias("part")).agg(ordered().alias("parts"))
    return P.passages([("video", whole), ("shot", shots), ("transcript", speech)], limit)


@query(r"""WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS x FROM conversations), s AS (SELECT conv_id AS video, 'shot' AS kind, turn * 2 + (role = 'user')::INTEGER AS part, role AS head, x, 400 - length(role) - 1 AS room FROM t),
h AS (SELECT *, left(x, room - 1) AS h FROM s), e AS (SELECT *, CASE WHEN instr(h, ' ') > 0 AND length(h) - instr(reverse(h), ' ') >= room // 2 THEN length(h) - instr(reverse(h), ' ') ELSE room - 1 END AS n FROM h)
SELECT video, part::BIGINT AS part, head || CASE WHEN x = '' THEN '' WHEN length(x) <= room THEN chr(10) || x ELSE chr(10) || regexp_replace(left(x, n), '[ ,;:–—]+$', '') || '…' END AS text FROM e""")
def shot_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).where("kind = 'shot'").select("video", "part", "text")


@query("SELECT CASE n WHEN 0 THEN 'video' WHEN 1 THEN 'shot' ELSE 'transcript' END AS kind, CASE n WHEN 0 THEN count(DISTINCT conv_id) FILTER (coalesce(trim(text), '') <> '') WHEN 1 THEN count(*) ELSE count(DISTINCT conv_id || '/' || (turn // 4)) FILTER (coalesce(trim(text), '') <> '') END AS passages FROM conversations, range(0, 3) r(n) GROUP BY n")
def passage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("passages"))


@query()
def passage_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.digests(built(spark, sf_dir))


@query("""WITH b AS (SELECT l_orderkey, l_discount * 5 AS x1, l_tax * 5 AS y1, l_discount * 5 + l_quantity / 100 AS x2, l_tax * 5 + l_quantity / 80 AS y2 FROM lineitem), u AS (SELECT l_orderkey, min(x1) * 1920 AS l, max(x2) * 1920 AS r, min(y1) * 1080 AS t, max(y2) * 1080 AS b, median((x1 + x2) / 2) AS mx, median((y1 + y2) / 2) AS my FROM b GROUP BY l_orderkey)
SELECT l_orderkey, round(greatest(0, least(1920 - 607.5::DOUBLE, CASE WHEN r - l <= 607.5 THEN (l + r) / 2 - 303.75::DOUBLE ELSE mx * 1920 - 303.75::DOUBLE END)), 3) AS x, round(greatest(0, least(0, CASE WHEN b - t <= 1080 THEN (t + b) / 2 - 540 ELSE my * 1080 - 540 END)), 3) AS y FROM u""")
def static_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upright crop for all boxes of an order."""
    d, t, q = F.col("l_discount") * 5, F.col("l_tax") * 5, F.col("l_quantity")
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", d.alias("x1"), t.alias("y1"), (d + q / 100).alias("x2"), (t + q / 80).alias("y2"))
    u = rows.groupBy("l_orderkey").agg(F.struct(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")).alias("u"), F.median((F.col("x1") + F.col("x2")) / 2).alias("mx"), F.median((F.col("y1") + F.col("y2")) / 2).alias("my"))
    out = u.select("l_orderkey", P.crop(F.col("u"), F.col("mx"), F.col("my"), 1920.0, 1080.0, 9 / 16).alias("c"))
    return out.select("l_orderkey", F.round("c.x", 3).alias("x"), F.round("c.y", 3).alias("y"))


_NOW = 1706659200


@query(f"""WITH c AS (SELECT user_id, 1 + event_id % 5 AS kind, epoch_us(ts) // 1000000 + CASE WHEN event_id % 5 = 0 THEN 4000000 ELSE 0 END AS at_s, event_type AS source FROM events), g AS (SELECT * FROM c WHERE at_s BETWEEN 631152000 AND {_NOW} + 86400),
b AS (SELECT user_id, min(struct_pack(kind := kind, at_s := at_s, source := source)) AS b FROM g GROUP BY user_id), o AS (SELECT g.user_id, b.b, min(abs(g.at_s - b.b.at_s)) FILTER (g.kind > b.b.kind) AS off FROM g JOIN b ON b.user_id = g.user_id GROUP BY ALL)
SELECT user_id, b.at_s AS at_s, b.source AS source, CASE WHEN off <= 5 THEN 'high' WHEN off <= 30 OR b.kind <= 2 THEN 'medium' ELSE 'low' END AS confidence FROM o""")
def capture_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.col("us") / 1000000) + F.when(F.col("event_id") % 5 == 0, 4000000).otherwise(0)
    rows = samples(spark, sf_dir).select("user_id", (1 + F.col("event_id") % 5).alias("kind"), at.alias("at_s"), F.col("event_type").alias("source"))
    return P.best_time(rows, "user_id", _NOW)


@query()
def listed_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heard sounds of each user, at most two a family, none that its kept members cover."""
    rows = heard(spark, sf_dir)
    parents = F.broadcast(spark.createDataFrame(PARENTS, "class string, ancestor string"))
    return P.covered_families(rows, parents, _writer(spark), per_family=2).select("video", "class", F.round("seconds", 3).alias("seconds"))


PARENTS = [("c1", "c0"), ("c2", "c0"), ("c3", "c0"), ("c4", "c3")]


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged stretches of five classes in two families."""
    k = F.col("event_id") % 5
    rows = samples(spark, sf_dir).select(F.col("user_id").alias("video"), F.concat(F.lit("c"), k.cast("string")).alias("class"), F.when(k < 3, "f").otherwise("g").alias("family"), (F.floor(F.col("us") / 86400000000) * 1.0).alias("s"))
    return rows.distinct().withColumn("e", F.col("s") + F.when(F.col("class") == "c0", 0.5).otherwise(1.0))


def _writer(spark: SparkSession):  # noqa: ANN202
    def write(df: DataFrame) -> DataFrame:
        path = shared_path(spark, f"sounds-{uuid.uuid4().hex}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write

"""Queries that join on time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as J
from ..operators import sequences as Q
from .registry import load, query
from .sequences import samples

HOUR = 3_600_000_000


@query("""SELECT c.event_id, v.value AS seen FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON v.user_id = c.user_id AND c.ts >= v.ts""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    views = rows.where("event_type = 'view'").groupBy("user_id", "us").agg(F.max("value").alias("seen"))
    return J.asof_backward(rows.where("event_type = 'click'").select("user_id", "us", "event_id"), views, ["user_id"], "us", ["seen"]).select("event_id", "seen")


@query("""WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'), v AS (SELECT user_id, epoch_us(ts) AS us, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL),
n AS (SELECT c.event_id, v.value AS near, abs(v.us - c.us) AS distance, v.us AS vus FROM c JOIN v ON v.user_id = c.user_id AND abs(v.us - c.us) <= 21600000000 QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY abs(v.us - c.us), v.us) = 1)
SELECT c.event_id, n.near, n.distance FROM c LEFT JOIN n ON n.event_id = c.event_id""")
def nearest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    views = rows.where("event_type = 'view'").groupBy("user_id", "us").agg(F.max("value").alias("near"))
    return J.nearest(rows.where("event_type = 'click'").select("user_id", "us", "event_id"), views, ["user_id"], "us", "near", 6 * HOUR).select("event_id", "near", "distance")


_A = "a AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 7200000000 AS e FROM events WHERE event_type = 'click')"
_B = "b AS (SELECT user_id, epoch_us(ts) AS s2, epoch_us(ts) + 3600000000 AS e2 FROM events WHERE event_type = 'view')"


def _spans(spark: SparkSession, sf_dir: str, kind: str, hours: int, names: tuple[str, str]) -> DataFrame:
    return samples(spark, sf_dir).where(F.col("event_type") == kind).select("user_id", F.col("us").alias(names[0]), (F.col("us") + hours * HOUR).alias(names[1]))


@query(f"WITH {_A}, p AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view') SELECT p.event_id, a.s FROM p JOIN a ON a.user_id = p.user_id AND a.s <= p.us AND p.us < a.e")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = samples(spark, sf_dir).where("event_type = 'view'").select("user_id", "event_id", "us")
    return J.point_in_interval(points, _spans(spark, sf_dir, "click", 2, ("s", "e")), ["user_id"], "us", "s", "e", 2 * HOUR).select("event_id", "s")


@query(f"WITH {_A}, {_B} SELECT a.user_id, sum(least(e, e2) - greatest(s, s2))::BIGINT AS overlap, count(*) AS n FROM a JOIN b ON a.user_id = b.user_id AND s < e2 AND s2 < e GROUP BY a.user_id")
def overlap_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = J.overlaps(_spans(spark, sf_dir, "click", 2, ("s", "e")), _spans(spark, sf_dir, "view", 1, ("s2", "e2")), ["user_id"], ("s", "e"), ("s2", "e2"), 2 * HOUR)
    return met.groupBy("user_id").agg(F.sum("overlap").alias("overlap"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_A}, {_B}, o AS (SELECT a.user_id, a.s, least(e, e2) - greatest(s, s2) AS o, s2 FROM a JOIN b ON a.user_id = b.user_id AND s < e2 AND s2 < e)
SELECT user_id, s, s2, o FROM o QUALIFY row_number() OVER (PARTITION BY user_id, s ORDER BY o DESC, s2) <= 2""")
def overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relational import top_per_group

    met = J.overlaps(_spans(spark, sf_dir, "click", 2, ("s", "e")), _spans(spark, sf_dir, "view", 1, ("s2", "e2")), ["user_id"], ("s", "e"), ("s2", "e2"), 2 * HOUR)
    return top_per_group(met, ["user_id", "s"], [F.desc("overlap"), F.col("s2")], 2).select("user_id", "s", "s2", F.col("overlap").alias("o"))


@query(f"""WITH {_A}, {_B}, t AS (SELECT user_id, s AS t, 1 AS a, 0 AS b FROM a UNION ALL SELECT user_id, e, -1, 0 FROM a UNION ALL SELECT user_id, s2, 0, 1 FROM b UNION ALL SELECT user_id, e2, 0, -1 FROM b),
g AS (SELECT user_id, t, sum(a) AS a, sum(b) AS b FROM t GROUP BY ALL), r AS (SELECT user_id, t, sum(a) OVER w AS a, sum(b) OVER w AS b, lead(t) OVER w2 AS n FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, sum(n - t)::BIGINT AS alone FROM r WHERE a > 0 AND b = 0 GROUP BY user_id""")
def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = Q.merge_spans(_spans(spark, sf_dir, "click", 2, ("s", "e")), ["user_id"], "s", "e").drop("parts")
    left = J.difference(merged, _spans(spark, sf_dir, "view", 1, ("s", "e")), ["user_id"], "s", "e")
    return left.groupBy("user_id").agg(F.sum(F.col("e") - F.col("s")).alias("alone"))


@query("""WITH h AS (SELECT user_id, (epoch_us(ts) // 3600000000)::BIGINT AS hour, avg(value) AS v FROM events GROUP BY ALL), p AS (SELECT user_id, event_id, epoch_us(ts) / 3600000000.0::DOUBLE AS at, (epoch_us(ts) // 3600000000)::BIGINT AS hour FROM events)
SELECT p.event_id, round(a.v + (coalesce(b.v, a.v) - a.v) * (p.at - p.hour), 6) AS value FROM p JOIN h a ON a.user_id = p.user_id AND a.hour = p.hour LEFT JOIN h b ON b.user_id = p.user_id AND b.hour = p.hour + 1""")
def bracketing_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / HOUR))
    hours = rows.groupBy("user_id", "hour").agg(F.avg("value").alias("v"))
    after = hours.select("user_id", (F.col("hour") - 1).alias("hour"), F.col("v").alias("next"))
    both = rows.join(hours, ["user_id", "hour"]).join(after, ["user_id", "hour"], "left")
    return both.select("event_id", F.round(F.col("v") + (F.coalesce("next", "v") - F.col("v")) * (F.col("us") / float(HOUR) - F.col("hour")), 6).alias("value"))

"""Queries of sound scores. Each user's events are the frames of a recording; four classes are scored from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequences as Q
from ..operators import sounds as A
from .registry import load, query
from .sequences import us

PARENTS = [("talk", "voice"), ("voice", "voice_top"), ("talk", "voice_top")]

_FRAMES = """f AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, count(*) OVER (PARTITION BY user_id) AS n, event_id, value FROM events),
g AS (SELECT *, n * 0.48::DOUBLE + 0.2::DOUBLE AS duration FROM f),
cell AS (SELECT *, CASE WHEN frame = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(duration, 0.48::DOUBLE * frame + 0.48::DOUBLE - 0.24::DOUBLE)) END AS s, CASE WHEN frame = n - 1 THEN duration ELSE greatest(0.0::DOUBLE, least(duration, 0.48::DOUBLE * frame + 0.48::DOUBLE + 0.24::DOUBLE)) END AS e FROM g),
score AS (SELECT video, frame, n, duration, s, e, unnest(['voice', 'talk', 'music', 'wind']) AS class, unnest([least(value / 100.0::DOUBLE, 1.0::DOUBLE), (event_id * 37 % 101) / 100.0::DOUBLE, (event_id * 53 % 101) / 100.0::DOUBLE, (event_id * 71 % 101) / 100.0::DOUBLE]) AS score FROM cell),
cat AS (SELECT video, frame, duration, s, e, CASE WHEN class IN ('voice', 'talk') THEN 'speech' ELSE class END AS category, max(score) AS score FROM score GROUP BY ALL),
lev AS (SELECT *, list_sort([coalesce(lag(score) OVER w, score), score, coalesce(lead(score) OVER w, score)])[2] AS level FROM cat WINDOW w AS (PARTITION BY video, category ORDER BY frame)),
st AS (SELECT *, coalesce(last_value(CASE WHEN level >= 0.7 THEN TRUE WHEN level < 0.4 THEN FALSE END IGNORE NULLS) OVER (PARTITION BY video, category ORDER BY frame ROWS UNBOUNDED PRECEDING), FALSE) AS st FROM lev),
nw AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY video, category ORDER BY frame) > 1.0::DOUBLE + 1e-9::DOUBLE THEN 1 ELSE 0 END AS nw FROM st WHERE st),
idd AS (SELECT *, sum(nw) OVER (PARTITION BY video, category ORDER BY frame ROWS UNBOUNDED PRECEDING) AS id FROM nw),
seg AS (SELECT video, category, min(s) AS s, max(e) AS e, min(frame) AS a, max(frame) AS z FROM idd GROUP BY video, category, id HAVING max(e) - min(s) >= 0.95::DOUBLE - 1e-9::DOUBLE),
held AS (SELECT l.*, EXISTS (SELECT 1 FROM seg WHERE seg.video = l.video AND seg.category = l.category AND l.frame BETWEEN a AND z) AS held FROM lev l)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("video"), (F.row_number().over(w.orderBy(us(), "event_id")) - 1).alias("frame"), F.count(F.lit(1)).over(w).alias("n"), "event_id", "value")
    return A.cells(rows.withColumn("duration", F.col("n") * 0.48 + 0.2), "video", "frame", "n", "duration")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: (F.col("event_id") * k % 101) / 100.0
    each = [("voice", F.least(F.col("value") / 100.0, F.lit(1.0))), ("talk", part(37)), ("music", part(53)), ("wind", part(71))]
    rows = F.array(*[F.struct(F.lit(name).alias("class"), score.alias("score")) for name, score in each])
    return frames(spark, sf_dir).select("video", "frame", "duration", "s", "e", F.inline(rows))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame([("voice", "speech"), ("talk", "speech"), ("music", "music"), ("wind", "wind")], "class string, category string")
    rows = scores(spark, sf_dir)
    by = A.category_scores(rows, F.broadcast(classes))
    return A.smoothed(by.join(rows.select("video", "frame", "duration", "s", "e").distinct(), ["video", "frame"]), ["video", "category"])


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["video", "category"]
    rows = levels(spark, sf_dir)
    found = A.segments(Q.hysteresis(rows, keys, ["frame"], "level", 0.7, 0.4, "on"), keys, "on")
    return A.in_segments(rows, found, keys)


@query(f"WITH {_FRAMES} SELECT video, frame, round(s, 6) AS s, round(e, 6) AS e FROM cell")
def sound_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("video", "frame", F.round("s", 6).alias("s"), F.round("e", 6).alias("e"))


@query("""WITH x AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200.0::DOUBLE AS a, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200.0::DOUBLE + value AS b FROM events), c AS (SELECT *, (a + b) / 2 AS c FROM x),
d AS (SELECT user_id, event_id, greatest(0.0::DOUBLE, least(2592000.0::DOUBLE, coalesce((lag(c) OVER w + c) / 2, 0))) AS s, greatest(0.0::DOUBLE, least(2592000.0::DOUBLE, coalesce((c + lead(c) OVER w) / 2, 2592000))) AS e FROM c WINDOW w AS (PARTITION BY user_id ORDER BY a, b))
SELECT user_id, event_id, round(s, 3) AS s, round(greatest(s, e), 3) AS e FROM d""")
def sound_window_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = us() / 1e6 - 1704067200.0
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", a.alias("a"), (a + F.col("value")).alias("b"), F.lit(2592000.0).alias("d"))
    return A.window_cells(rows, "user_id", "a", "b", "d").select("user_id", "event_id", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"))


@query(f"WITH {_FRAMES} SELECT video, category, frame, round(score, 6) AS score FROM cat")
def sound_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(spark, sf_dir).select("video", "category", "frame", F.round("score", 6).alias("score"))


@query(f"WITH {_FRAMES} SELECT video, category, round(s, 2) AS s, round(e, 2) AS e FROM seg")
def sound_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["video", "category"]
    found = A.segments(Q.hysteresis(levels(spark, sf_dir), keys, ["frame"], "level", 0.7, 0.4, "on"), keys, "on")
    return found.select(*keys, F.round("s", 2).alias("s"), F.round("e", 2).alias("e"))


@query(f"WITH {_FRAMES}, p AS (SELECT video, category, round(least(1.0::DOUBLE, sum(e - s) / max(duration)), 4) AS share FROM held WHERE held GROUP BY ALL) SELECT * FROM p WHERE share > 0")
def sound_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.presence(held(spark, sf_dir))


@query(f"""WITH {_FRAMES}, b AS (SELECT video, frame, any_value(s) AS s, any_value(e) AS e, any_value(duration) AS duration, coalesce(arg_max(category, CASE WHEN held THEN level / CASE category WHEN 'speech' THEN 0.6::DOUBLE WHEN 'music' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END END), 'other') AS w,
FROM (SELECT * FROM held ORDER BY video, frame, category) GROUP BY video, frame), p AS (SELECT video, w AS category, round(least(1.0::DOUBLE, sum(e - s) / max(duration)), 4) AS share FROM b GROUP BY ALL) SELECT * FROM p WHERE share > 0""")
def sound_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = F.when(F.col("category") == "speech", 0.6).when(F.col("category") == "music", 0.5).otherwise(0.4)
    order = F.when(F.col("category") == "music", 0).when(F.col("category") == "speech", 1).otherwise(2)
    return A.dominance(held(spark, sf_dir), on, order, "other")


@query(f"""WITH {_FRAMES}, x AS (SELECT video, category, level, greatest(1, ceil(duration - 1e-9::DOUBLE))::BIGINT AS n, floor(s)::BIGINT AS a, ceil(e - 1e-9::DOUBLE)::BIGINT - 1 AS z FROM lev WHERE e > s),
y AS (SELECT video, category, level, unnest(list_distinct([greatest(0, least(n - 1, a)), greatest(0, least(n - 1, z))])) AS bin FROM x) SELECT video, category, bin, round_even(greatest(0, least(1, max(level))) * 100, 0)::BIGINT AS value FROM y GROUP BY ALL""")
def sound_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.curve(levels(spark, sf_dir))


@query(f"""WITH {_FRAMES}, sp AS (SELECT DISTINCT video, unnest(range(0, 4)) AS span, n FROM f), q AS (SELECT video, span, span * n * 0.12::DOUBLE AS a, (span + 1) * n * 0.12::DOUBLE AS b FROM sp),
w AS (SELECT q.video, span, class, score, least(0.48::DOUBLE * frame + 0.96::DOUBLE, b) - greatest(0.48::DOUBLE * frame, a) AS w FROM score x JOIN q ON q.video = x.video),
m AS (SELECT video, span, class, sum(w * score) / sum(w) AS mean FROM w WHERE w > 0 GROUP BY ALL)
SELECT video, span, class, round(mean, 4) AS mean FROM m WHERE mean >= 0.1 QUALIFY row_number() OVER (PARTITION BY video, span ORDER BY mean DESC, class) <= 3""")
def span_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    spans = frames(spark, sf_dir).select("video", "n").distinct().select("video", "n", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("span"))
    spans = spans.select("video", "span", (F.col("span") * F.col("n") * 0.12).alias("a"), ((F.col("span") + 1) * F.col("n") * 0.12).alias("b"))
    w = Window.partitionBy("video", "span").orderBy(F.desc("mean"), "class")
    best = A.span_means(rows.select("video", "frame", "class", "score"), spans).where(F.col("mean") >= A.LABEL_FLOOR).withColumn("r", F.row_number().over(w)).where("r <= 3")
    # Half of the last place goes up, as in SQL, though the mean has no exact half.
    return best.select("video", "span", "class", (F.round(F.col("mean") * 10000, 0) / 10000).alias("mean"))


_EVENTS = """hot AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY video, class ORDER BY frame) > 1.0::DOUBLE + 1e-9::DOUBLE THEN 1 ELSE 0 END AS nw FROM score WHERE score >= 0.5),
hid AS (SELECT *, sum(nw) OVER (PARTITION BY video, class ORDER BY frame ROWS UNBOUNDED PRECEDING) AS id FROM hot),
hr AS (SELECT video, class, min(s) AS s, max(e) AS e, min(frame) AS a, max(frame) AS z FROM hid GROUP BY video, class, id HAVING max(e) - min(s) >= 0.01::DOUBLE - 1e-9::DOUBLE),
ev AS (SELECT hr.video, hr.class, hr.s, hr.e, max(score.score) AS peak, avg(score.score) AS mean FROM hr JOIN score ON score.video = hr.video AND score.class = hr.class AND score.frame BETWEEN a AND z GROUP BY ALL),
par AS (SELECT unnest(['talk', 'voice', 'talk']) AS class, unnest(['voice', 'voice_top', 'voice_top']) AS ancestor),
kept AS (SELECT * FROM ev WHERE NOT EXISTS (SELECT 1 FROM ev x JOIN par ON par.class = x.class WHERE x.video = ev.video AND par.ancestor = ev.class AND x.s < ev.e AND ev.s < x.e))"""


@query(f"WITH {_FRAMES}, {_EVENTS} SELECT video, class, round(s, 2) AS s, round(e, 2) AS e, round(peak, 3) AS peak, round(mean + 1e-7::DOUBLE, 3) AS mean FROM kept QUALIFY row_number() OVER (PARTITION BY video ORDER BY peak DESC, s, class) <= 12")
def sound_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = F.broadcast(spark.createDataFrame(PARENTS, "class string, ancestor string"))
    found = A.events(scores(spark, sf_dir), parents)
    return found.select("video", "class", F.round("s", 2).alias("s"), F.round("e", 2).alias("e"), F.round("peak", 3).alias("peak"), F.round(F.col("mean") + 1e-7, 3).alias("mean"))


@query(f"""WITH {_FRAMES}, l AS (SELECT video, class, sum(CASE WHEN score >= 0.2 THEN e - s ELSE 0 END) AS seconds, max(score) AS peak FROM score GROUP BY ALL HAVING sum(CASE WHEN score >= 0.2 THEN e - s ELSE 0 END) >= 0.95::DOUBLE - 1e-9::DOUBLE)
SELECT video, class, round(seconds, 2) AS seconds, round(peak, 2) AS peak FROM l WHERE NOT (class = 'voice' AND EXISTS (SELECT 1 FROM l m WHERE m.video = l.video AND m.class = 'talk' AND m.seconds >= 0.8 * l.seconds))""")
def instruments_heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = F.broadcast(spark.createDataFrame(PARENTS, "class string, ancestor string"))
    return A.heard_long(scores(spark, sf_dir), parents).select("video", "class", F.round("seconds", 2).alias("seconds"), F.round("peak", 2).alias("peak"))


@query(f"WITH {_FRAMES}, m AS (SELECT video, class, sum((e - s) * score) / max(duration) AS mean FROM score GROUP BY ALL), b AS (SELECT video, max(struct_pack(mean := mean, class := class)) AS b FROM m GROUP BY video) SELECT video, CASE WHEN b.mean >= 0.1 THEN b.class END AS environment FROM b")
def sound_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.environment(scores(spark, sf_dir))


@query(f"""WITH {_FRAMES}, ml AS (SELECT *, list_sort([coalesce(lag(score) OVER w, score), score, coalesce(lead(score) OVER w, score)])[2] AS level FROM score WINDOW w AS (PARTITION BY video, class ORDER BY frame)),
i AS (SELECT video, class, CASE WHEN class = 'wind' THEN 'wind_noise' ELSE 'other' END AS tag, sum(CASE WHEN level >= 0.3 THEN e - s ELSE 0 END) / max(duration) AS share FROM ml GROUP BY ALL)
SELECT video, tag, max(round(least(1.0::DOUBLE, share), 4)) AS share FROM i WHERE share >= 0.05 GROUP BY ALL""")
def sound_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.smoothed(scores(spark, sf_dir), ["video", "class"]).withColumn("tag", F.when(F.col("class") == "wind", "wind_noise").otherwise("other"))
    return A.issues(rows)


@query(f"""WITH {_FRAMES}, w2 AS (SELECT video, frame, (frame * 0.7::DOUBLE) AS a, (frame * 0.7::DOUBLE + 1.5::DOUBLE) AS b, (event_id * 13 % 100) / 100.0::DOUBLE AS p FROM g)
SELECT DISTINCT seg.video, category, round(s, 2) AS s FROM seg JOIN w2 ON w2.video = seg.video AND w2.a < seg.e AND w2.b > seg.s AND w2.p >= 0.9 WHERE category <> 'wind'""")
def agreeing_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that a second tagger's window agrees with: a semi join on overlap, by buckets of ten seconds."""
    keys = ["video", "category"]
    found = A.segments(Q.hysteresis(levels(spark, sf_dir), keys, ["frame"], "level", 0.7, 0.4, "on"), keys, "on").where("category <> 'wind'")
    second = frames(spark, sf_dir).select("video", (F.col("frame") * 0.7).alias("a"), (F.col("frame") * 0.7 + 1.5).alias("b"), ((F.col("event_id") * 13 % 100) / 100.0).alias("p")).where("p >= 0.9")
    cut = lambda df, a, b: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(a) / 10), F.floor(F.col(b) / 10))))
    met = cut(found, "s", "e").join(cut(second, "a", "b"), ["video", "bin"]).where("a < e AND b > s")
    return met.select("video", "category", F.round("s", 2).alias("s")).distinct()


@query("""WITH e AS (SELECT user_id, event_id, ts, pow(10.0::DOUBLE, -least(value, 90) / 10) AS p FROM events)
SELECT user_id, event_id, round(10 * log10(greatest((p + coalesce(lead(p) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0)) / 2, 1e-12::DOUBLE)), 4) AS level FROM e""")
def patch_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of patches of two hops."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(0, 1)
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", us().alias("us"), F.pow(F.lit(10.0), -F.least(F.col("value"), F.lit(90.0)) / 10).alias("p"))
    return rows.select("user_id", "event_id", F.round(10 * F.log10(F.greatest(F.sum("p").over(w) / 2, F.lit(1e-12))), 4).alias("level"))


@query("""WITH n AS (SELECT o_orderkey, floor(o_totalprice * 10)::BIGINT AS n FROM orders), r AS (SELECT o_orderkey, CASE WHEN n < 8000 THEN [] WHEN n <= 80000 THEN [0] ELSE list_concat(range(0, n - 80000 + 1, 40000), CASE WHEN (n - 80000) % 40000 > 0 THEN [n - 80000] ELSE [] END) END AS r FROM n)
SELECT o_orderkey, unnest(r) AS start FROM r""")
def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 80000 samples every 40000, the last one at the end; short recordings have one, very short ones none."""
    n = F.col("n")
    hops = F.sequence(F.lit(0).cast("long"), n - 80000, F.lit(40000).cast("long"))
    starts = F.when(n < 8000, F.array().cast("array<bigint>")).when(n <= 80000, F.array(F.lit(0).cast("long"))).when((n - 80000) % 40000 > 0, F.array_append(hops, n - 80000)).otherwise(hops)
    return load(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 10).alias("n")).select("o_orderkey", F.explode(starts).alias("start"))

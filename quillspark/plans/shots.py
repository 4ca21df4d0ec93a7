"""Queries of shots, blocks, pauses, cues, clips and passages. A user's events stand for a video's samples, an order's lines for its words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..operators import shots as S
from ..operators import stretches as St
from .registry import load, query
from .sequences import samples

DAY = 2_592_000.0
_AT = "(epoch_us(ts) / 1000000.0::DOUBLE - 1704067200.0::DOUBLE)"


def at() -> F.Column:
    return F.col("us") / 1e6 - 1704067200.0


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("user_id").agg((F.max(at()) + 0.4).alias("duration"))


@query(f"""WITH v AS (SELECT user_id, max({_AT}) + 0.4::DOUBLE AS duration FROM events GROUP BY user_id), c AS (SELECT e.user_id, {_AT} AS start, duration FROM events e JOIN v ON v.user_id = e.user_id WHERE value >= 60),
s AS (SELECT * FROM c WHERE start > 0 AND start < duration AND duration - start >= 0.6::DOUBLE UNION ALL SELECT user_id, 0.0::DOUBLE, duration FROM v WHERE duration > 0),
e AS (SELECT user_id, start, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY start), duration) AS e FROM s) SELECT user_id, round(start, 3) AS start, round(e, 3) AS e FROM e WHERE e > start""")
def shots_from_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = samples(spark, sf_dir).where("value >= 60").select("user_id", at().alias("at"))
    out = S.shots(cuts, videos(spark, sf_dir), "user_id", "at", "duration")
    return out.select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("e"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_discount * 20 - 1 AS dx, l_tax * 25 - 1 AS dy, l_quantity / 25 AS m, l_discount * 4 - 0.2::DOUBLE AS d FROM lineitem), j AS (SELECT *, sqrt(pow(dx - lag(dx) OVER w, 2) + pow(dy - lag(dy) OVER w, 2)) AS j FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, dx, dy, m, d)),
g AS (SELECT l_orderkey, avg(dx) AS dx, avg(dy) AS dy, median(m) AS m, avg(d) AS d, coalesce(avg(j), 0) AS j FROM j GROUP BY l_orderkey), s AS (SELECT *, greatest(0, least(1, 1 / (1 + 2 * j))) AS st FROM g)
SELECT l_orderkey, CASE WHEN m < 0.25 THEN 'static' WHEN abs(d) > 0.35 * m AND abs(d) > 0.08 THEN CASE WHEN d > 0 THEN 'zoom_in' ELSE 'zoom_out' END WHEN sqrt(dx * dx + dy * dy) < 0.35 * m THEN CASE WHEN st < 0.6 THEN 'handheld' ELSE 'moving' END
WHEN abs(dx) >= 2 * abs(dy) THEN CASE WHEN dx < 0 THEN 'pan_right' ELSE 'pan_left' END WHEN abs(dy) >= 2 * abs(dx) THEN CASE WHEN dy < 0 THEN 'tilt_down' ELSE 'tilt_up' END ELSE 'moving' END AS motion, round(st, 5) AS stability FROM s""")
def motion_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 20 - 1).alias("dx"), (F.col("l_tax") * 25 - 1).alias("dy"), (F.col("l_quantity") / 25).alias("m"), (F.col("l_discount") * 4 - 0.2).alias("d"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "dx", "dy", "m", "d")
    rows = rows.withColumn("j", F.hypot(F.col("dx") - F.lag("dx").over(w), F.col("dy") - F.lag("dy").over(w)))
    # Added line by line in the window: a grouping adds the lines of an order in two parts where a task's map of groups is full, and a tie hangs on the last bit.
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({c: F.avg(c).over(whole) for c in ("dx", "dy", "d", "j")})
    means = rows.groupBy("l_orderkey").agg(*[F.first(c).alias(c) for c in ("dx", "dy", "d", "j")], F.median("m").alias("m"))
    out = means.select("l_orderkey", S.motion(F.col("dx"), F.col("dy"), F.col("m"), F.col("d"), F.col("j")).alias("x"))
    return out.select("l_orderkey", "x.motion", F.round("x.stability", 5).alias("stability"))


@query("""SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) < 20 AS fades FROM events""")
def fade_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Did the value fall low shortly before?"""
    return St.low_before(samples(spark, sf_dir), ["user_id"], "us", "value", 7_200_000_000, 20, "fades").select("event_id", "fades")


@query("""SELECT o_orderkey, CASE WHEN d < 90 THEN 1 WHEN d <= 300 THEN greatest(2, least(4, round_even(d / 45.0::DOUBLE, 0)::INTEGER)) ELSE greatest(4, least(12, round_even(3 + d / 400.0::DOUBLE, 0)::INTEGER)) END AS chapters FROM (SELECT o_orderkey, o_totalprice / 100 AS d FROM orders)""")
def chapter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", S.chapter_count(F.col("o_totalprice") / 100).alias("chapters"))


@query("""WITH k AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN event_type = 'view' THEN value END AS v FROM events),
n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN us END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS ta, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS va,
first_value(CASE WHEN v IS NOT NULL THEN us END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tb, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM k)
SELECT event_id, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR ta = tb THEN va ELSE va + (vb - va) * (us - ta) / (tb - ta) END, 4) AS value FROM n""")
def interpolated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("v", F.when(F.col("event_type") == "view", F.col("value")))
    return S.interpolated(rows, ["user_id"], "us", "v").select("event_id", F.round("v", 4).alias("value"))


_WORDS = "w AS (SELECT l_orderkey AS k, l_linenumber AS i, l_linenumber * 2.0::DOUBLE + l_discount * 4 AS s, l_linenumber * 2.0::DOUBLE + l_discount * 4 + l_tax * 20 AS e, l_returnflag || CASE WHEN l_linestatus = 'F' THEN '.' ELSE '' END AS t FROM lineitem)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_linenumber") * 2.0 + F.col("l_discount") * 4
    text = F.concat("l_returnflag", F.when(F.col("l_linestatus") == "F", ".").otherwise(""))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), s.alias("s"), (s + F.col("l_tax") * 20).alias("e"), text.alias("t"))


_PAUSES = f"{_WORDS}, n AS (SELECT *, lead(s) OVER (PARTITION BY k ORDER BY s, e, t) AS nx FROM w), p AS (SELECT k, (e + nx) / 2 AS t, least(nx - e, 2.0::DOUBLE) + CASE WHEN ends_with(n.t, '.') THEN 0.5::DOUBLE ELSE 0 END AS q FROM n WHERE nx >= e)"


@query(f"WITH {_PAUSES} SELECT k, round(t, 4) AS t, round(q, 4) AS quality FROM p")
def word_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pauses(words(spark, sf_dir), ["k"], "s", "e", "t").select("k", F.round("t", 4).alias("t"), F.round("quality", 4).alias("quality"))


@query(f"""WITH {_PAUSES}, d AS (SELECT DISTINCT k, i * 3.1::DOUBLE AS spot FROM w WHERE i <= 2), m AS (SELECT d.k, d.spot, max(struct_pack(score := q - 0.25::DOUBLE * abs(t - spot), t := t)) AS b FROM d JOIN p ON p.k = d.k AND abs(t - spot) <= 3.0 GROUP BY ALL)
SELECT d.k, round(d.spot, 3) AS spot, round(coalesce(m.b.t, d.spot), 4) AS snap FROM d LEFT JOIN m ON m.k = d.k AND m.spot = d.spot""")
def snapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = words(spark, sf_dir)
    edges = rows.where("i <= 2").select("k", (F.col("i") * 3.1).alias("spot")).distinct()
    out = S.snapped(edges, S.pauses(rows, ["k"], "s", "e", "t"), ["k"], "spot", 3.0)
    return out.select("k", F.round("spot", 3).alias("spot"), F.round("snap", 4).alias("snap"))


@query(f"""WITH {_WORDS}, b AS (SELECT DISTINCT k, j AS block, j * 4.0::DOUBLE AS a, (j + 1) * 4.0::DOUBLE AS z FROM w, range(0, 5) r(j))
SELECT b.k, b.block, string_agg(t, ' ' ORDER BY s, e, i, t) AS said FROM b JOIN w ON w.k = b.k AND (s + e) / 2 >= a AND (s + e) / 2 < z GROUP BY ALL""")
def speech_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words go to the block that holds their middle; blocks of equal length are a bucket of it."""
    return St.said_in_blocks(words(spark, sf_dir), ["k"], "s", "e", ["s", "e", "i"], "t", 4.0, most=5)


@query(f"WITH {_WORDS} SELECT DISTINCT k, i FROM w WHERE EXISTS (SELECT 1 FROM w g WHERE g.k = w.k AND g.i % 2 = 0 AND (w.s + w.e) / 2 BETWEEN g.s - 0.5 AND g.e + 0.5) AND i % 2 = 1")
def midpoints_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose middle lies in a gap: both are dealt to buckets of four seconds."""
    rows = words(spark, sf_dir)
    gaps = rows.where("i % 2 = 0").select("k", (F.col("s") - 0.5).alias("a"), (F.col("e") + 0.5).alias("z"))
    return St.middles_within(rows.where("i % 2 = 1"), gaps, ["k"], "s", "e", "a", "z", 4.0).select("k", "i").distinct()


_SHOT = "h AS (SELECT user_id, (epoch_us(ts) // 21600000000)::BIGINT AS shot, min(epoch_us(ts)) AS s FROM events GROUP BY ALL)"


@query(f"""WITH {_SHOT}, f AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN event_type = 'click' THEN 600000000 ELSE 0 END AS tol FROM events)
SELECT f.event_id, (SELECT max(shot) FROM h WHERE h.user_id = f.user_id AND h.s <= f.us + f.tol) AS shot FROM f""")
def shot_of_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shot in force at a frame, which some frames may lead by ten minutes: one union, one sort."""
    rows = samples(spark, sf_dir)
    starts = rows.groupBy("user_id", F.floor(F.col("us") / 21600000000).alias("shot")).agg(F.min("us").alias("t"))
    frames = rows.select("user_id", (F.col("us") + F.when(F.col("event_type") == "click", 600000000).otherwise(0)).alias("t"), "event_id")
    return St.in_force(frames, starts, ["user_id"], "t", "t", "shot").select("event_id", "shot")


@query(f"""WITH {_SHOT}, e AS (SELECT *, s + 7200000000 AS e FROM h), q AS (SELECT DISTINCT user_id, 1704067200000000 + d * 86400000000 AS a, 1704067200000000 + d * 86400000000 + 36000000000 AS z, d FROM events, range(0, 30) r(d)),
m AS (SELECT q.user_id, q.d, max(shot) AS last, count(*) AS n FROM q JOIN e ON e.user_id = q.user_id AND e.e > q.a AND e.s < q.z GROUP BY ALL) SELECT * FROM m""")
def range_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a range of each day holds: shots meet the days that they touch."""
    day, base = 86400000000, 1704067200000000
    rows = samples(spark, sf_dir)
    shots = rows.groupBy("user_id", F.floor(F.col("us") / 21600000000).alias("shot")).agg(F.min("us").alias("s")).withColumn("e", F.col("s") + 7200000000)
    days = rows.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("d"))
    days = days.withColumns({"a": base + F.col("d") * day, "z": base + F.col("d") * day + 36000000000})
    return St.contents(days, shots, ["user_id"], "d", ("a", "z"), "shot", ("s", "e"), day)


@query(f"""WITH {_SHOT}, b AS (SELECT user_id, shot AS no, s, s + 7200000000 AS e FROM h), c AS (SELECT user_id, min(no) AS first, max(no) AS last, no // 12 AS chapter FROM b GROUP BY user_id, no // 12)
SELECT c.user_id, c.chapter, x.s AS start_us, y.e AS end_us FROM c JOIN b x ON x.user_id = c.user_id AND x.no = c.first JOIN b y ON y.user_id = c.user_id AND y.no = c.last""")
def chapter_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters name their first and last block; two joins give the times."""
    blocks = samples(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / 21600000000).alias("no")).agg(F.min("us").alias("start_us")).withColumn("end_us", F.col("start_us") + 7200000000)
    chapters = blocks.groupBy("user_id", F.floor(F.col("no") / 12).alias("chapter")).agg(F.min("no").alias("first"), F.max("no").alias("last"))
    return St.group_times(chapters, blocks, ["user_id"], "first", "last", "no", "start_us", "end_us").select("user_id", "chapter", "start_us", "end_us")


_PIECES = "p AS (SELECT l_orderkey AS k, (l_linenumber - 1) * 12.0::DOUBLE AS s, (l_linenumber - 1) * 12.0::DOUBLE + greatest(1.0::DOUBLE, l_quantity / 5) AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS i FROM lineitem)"


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.col("l_linenumber") - 1) * 12.0
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), s.alias("s"), (s + F.greatest(F.lit(1.0), F.col("l_quantity") / 5)).alias("e"))


@query(f"""WITH RECURSIVE {_PIECES}, r AS (SELECT k, i, s AS a, e AS b, 1 AS n, 1 AS no FROM p WHERE i = 1 UNION ALL
SELECT p.k, p.i, CASE WHEN (p.e - p.s < 4 OR r.b - r.a < 4) AND p.e - r.a <= 30 THEN r.a ELSE p.s END, p.e, CASE WHEN (p.e - p.s < 4 OR r.b - r.a < 4) AND p.e - r.a <= 30 THEN r.n + 1 ELSE 1 END, CASE WHEN (p.e - p.s < 4 OR r.b - r.a < 4) AND p.e - r.a <= 30 THEN r.no ELSE r.no + 1 END FROM r JOIN p ON p.k = r.k AND p.i = r.i + 1)
SELECT k, no, round(arg_max(a, i), 3) AS a, round(arg_max(b, i), 3) AS b, max(n) AS pieces FROM r GROUP BY k, no""")
def merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_short(pieces(spark, sf_dir), ["k"], "s", "e").select("k", "no", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), "pieces")


@query(f"""WITH RECURSIVE {_PIECES}, g AS (SELECT k, i, greatest(0.0::DOUBLE, s - 1) AS lo, least(70.0::DOUBLE, e + 1) AS hi FROM p WHERE s < 69), q AS (SELECT k, lo, hi, row_number() OVER (PARTITION BY k ORDER BY i) AS i FROM g WHERE hi > lo),
r AS (SELECT k, i, lo AS a, hi AS b, 1 AS n, 1 AS no FROM q WHERE i = 1 UNION ALL SELECT q.k, q.i, CASE WHEN q.lo <= r.b OR q.hi - r.a <= 30 THEN r.a ELSE q.lo END, CASE WHEN q.lo <= r.b OR q.hi - r.a <= 30 THEN greatest(r.b, q.hi) ELSE q.hi END,
CASE WHEN q.lo <= r.b OR q.hi - r.a <= 30 THEN r.n + 1 ELSE 1 END, CASE WHEN q.lo <= r.b OR q.hi - r.a <= 30 THEN r.no ELSE r.no + 1 END FROM r JOIN q ON q.k = r.k AND q.i = r.i + 1)
SELECT k, round(arg_max(a, i), 3) AS a, round(arg_max(b, i), 3) AS b, max(n) AS gaps FROM r GROUP BY k, no""")
def gap_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces(spark, sf_dir).where("s < 69").withColumn("d", F.lit(70.0))
    return S.context_clips(rows, ["k"], "s", "e", "d")


@query("""WITH RECURSIVE d AS (SELECT source, lang, doc_id, length(text)::BIGINT AS n, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS i FROM documents WHERE text IS NOT NULL),
r AS (SELECT source, lang, doc_id, i, 0 AS batch, 1 AS items, n AS total FROM d WHERE i = 1 UNION ALL SELECT d.source, d.lang, d.doc_id, d.i, CASE WHEN r.items >= 12 OR r.total + d.n > 9000 THEN r.batch + 1 ELSE r.batch END,
CASE WHEN r.items >= 12 OR r.total + d.n > 9000 THEN 1 ELSE r.items + 1 END, CASE WHEN r.items >= 12 OR r.total + d.n > 9000 THEN d.n ELSE r.total + d.n END FROM r JOIN d ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.i = r.i + 1)
SELECT source, lang, doc_id, batch FROM r""")
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one source and language in requests of at most 12 texts and 9000 characters."""
    rows = load(spark, sf_dir, "documents").where("text is not null").select("source", "lang", "doc_id", F.length("text").cast("long").alias("n"))
    return S.packed(rows, ["source", "lang"], "doc_id", "n", 12, 9000)


@query()
def subtitle_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cues(words(spark, sf_dir), ["k"], "s", "e", "t")


@query()
def split_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long shots of each order cut near their keyframes."""
    s = (F.col("l_linenumber") - 1) * 100.0
    frames = F.array(s + F.col("l_discount") * 300, s + F.col("l_tax") * 700, s + F.col("l_quantity"))
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), s.alias("s"), (s + F.col("l_quantity") * 1.9).alias("e"), frames.alias("frames"))
    return S.split_long(rows, ["k"], "s", "e", "frames").select("k", "part", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("""WITH t AS (SELECT conv_id, turn, role, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 2)) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i FROM conversations),
b AS (SELECT t.conv_id, t.i, list_distinct(flatten(list(p.w) FILTER (p.i < t.i))) AS b, list_distinct(flatten(list(p.w) FILTER (p.i >= t.i))) AS a FROM t JOIN t p ON p.conv_id = t.conv_id AND p.i BETWEEN t.i - 3 AND t.i + 2 GROUP BY t.conv_id, t.i)
SELECT conv_id, i, CASE WHEN len(b) > 0 AND len(list_distinct(list_concat(b, a))) > 0 THEN round(1 - len(list_intersect(b, a)) / len(list_distinct(list_concat(b, a)))::DOUBLE, 6) END AS contrast FROM b""")
def contrast_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) > 2))
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    rows = load(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(w).alias("i"), own.alias("w"))
    return S.contrast_bounds(rows, ["conv_id"], "i", "w").select("conv_id", "i", F.round("contrast", 6).alias("contrast"))


@query()
def filled_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.array((F.col("l_quantity") * 0.3), F.col("l_discount") * 100)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(S.fill_slots(F.lit(0.0), F.col("l_quantity"), chosen), ",").alias("extra"))


@query(f"""WITH {_WORDS}, d AS (SELECT DISTINCT k, 5.0::DOUBLE AS spot FROM w), m AS (SELECT d.k, w.s, t, sum(length(t) + 1) OVER (PARTITION BY d.k ORDER BY abs((s + e) / 2 - spot), s, t ROWS UNBOUNDED PRECEDING) AS used FROM d JOIN w ON w.k = d.k AND w.e >= spot - 6 AND w.s <= spot + 6)
SELECT k, string_agg(t, ' ' ORDER BY s, t) AS excerpt FROM m WHERE used <= 7 GROUP BY k""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = words(spark, sf_dir)
    return S.excerpt(rows, rows.select("k", F.lit(5.0).alias("at")).distinct(), ["k"], "s", "e", "t", "at", chars=6).select("k", "excerpt")


@query()
def box_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 1000).alias("x"), (F.col("l_tax") * 500).alias("y"))
    return S.reading_order(rows, ["l_orderkey"], "x", "y").select("l_orderkey", "l_linenumber", "place")


@query()
def chosen_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language the forty longest documents compete for a budget; sources stand for videos."""
    docs = R.top_per_group(load(spark, sf_dir, "documents").where("text is not null"), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 40)
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    start = F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 60).cast("double"))
    rows = docs.select("lang", (F.row_number().over(w) - 1).cast("long").alias("rank"), F.coalesce("source", F.lit("")).alias("video"), F.lit("visual").alias("family"), start.alias("a"), (start + 10).alias("b"), T.token_estimate(F.col("text")).alias("tokens"))
    return S.choose_passages(rows, ["lang"], budget=20_000)


@query()
def matched_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.greedy_pairs(box_pairs(spark, sf_dir), ["l_orderkey"], "a", "b", "iou")


def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one order from two sources (odd and even lines) that overlap by a tenth; an order has a few lines."""
    from ..functions.space import box_area, iou

    box = F.struct((F.col("l_discount") * 5).alias("x1"), (F.col("l_tax") * 5).alias("y1"), (F.col("l_discount") * 5 + F.col("l_quantity") / 100).alias("x2"), (F.col("l_tax") * 5 + F.col("l_quantity") / 80).alias("y2"))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("i"), box.alias("box"))
    one, two = rows.where("i % 2 = 1").select("l_orderkey", F.col("i").alias("a"), F.col("box").alias("p")), rows.where("i % 2 = 0").select("l_orderkey", F.col("i").alias("b"), F.col("box").alias("q"))
    met = one.join(two, "l_orderkey").select("l_orderkey", "a", "b", F.round(iou(F.col("p"), F.col("q")), 6).alias("iou"), F.round(box_area(F.col("p")), 6).alias("area"))
    return met.where("iou >= 0.1")


@query()
def matched_beings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.largest_first(box_pairs(spark, sf_dir), ["l_orderkey"], "a", "area", "b", "iou")


@query()
def caption_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_brand", "p_partkey", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("w"))
    return S.distinct_groups(rows, ["p_brand"], "p_partkey", "w")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, 50 * l_quantity / 50 + 20 * (l_discount * 10) + 15 * (l_tax * 12) + 10 * least(1, l_linenumber / 3.0::DOUBLE) + 5 * least(1, l_quantity / 40) - CASE WHEN l_quantity / 10 < 2 THEN 30 ELSE 0 END AS s FROM lineitem),
k AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS d FROM lineitem GROUP BY l_orderkey), c AS (SELECT *, greatest(1, least(least(8, greatest(1, floor(d / 60 + 0.5)::BIGINT)), n // 3)) AS c FROM k)
SELECT l_orderkey, l_linenumber, round(s, 4) AS salience FROM s JOIN c USING (l_orderkey) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY round(s, 6) DESC, l_linenumber) <= any_value(c) OVER (PARTITION BY l_orderkey)""")
def salient_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many of the most salient blocks as the video's length and blocks allow."""
    q = F.col("l_quantity")
    score = 50 * q / 50 + 20 * (F.col("l_discount") * 10) + 15 * (F.col("l_tax") * 12) + 10 * F.least(F.lit(1.0), F.col("l_linenumber") / 3.0) + 5 * F.least(F.lit(1.0), q / 40) - F.when(q / 10 < 2, 30).otherwise(0)
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.alias("s"), "l_quantity")
    return St.most_salient(rows, ["l_orderkey"], "s", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", F.round("s", 4).alias("salience"))


@query("WITH b AS (SELECT user_id, arg_min(event_id, struct_pack(d := abs(epoch_us(ts) - (1704067200000000 + 259200000000)), e := event_id)) AS poster, arg_max(event_id, struct_pack(f := event_type = 'view', v := value, e := event_id)) AS best FROM events GROUP BY user_id) SELECT * FROM b")
def posters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame nearest to a tenth of the recording, and the best frame: described ones first, then the sharpest."""
    near = F.abs(F.col("us") - (1704067200000000 + 259200000000))
    return samples(spark, sf_dir).groupBy("user_id").agg(F.min_by("event_id", F.struct(near.alias("d"), "event_id")).alias("poster"), F.max_by("event_id", F.struct((F.col("event_type") == "view").alias("f"), "value", "event_id")).alias("best"))


@query("""WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT DISTINCT user_id, round_even(j * n / least(n, 7)::DOUBLE, 0)::BIGINT AS i FROM x, range(0, 7) r(j) WHERE j < least(n, 7)) SELECT x.user_id, x.event_id FROM x JOIN k USING (user_id, i)""")
def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most seven frames of each video, evenly spread, the first one kept."""
    return St.evenly(samples(spark, sf_dir), ["user_id"], ["us", "event_id"], 7, ends=False).select("user_id", "event_id")



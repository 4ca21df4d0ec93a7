"""Stages of the analysis as data flows: each query puts the operators of one stage together over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sky as K
from ..operators import shots as S
from . import clocks, facts, library, passages, sequences, shots, sounds, transcripts
from .registry import ORACLE_SQL, load, query
from .sequences import samples, us

_SQL = dict(ORACLE_SQL)


@query(f"""WITH k AS ({_SQL['nearest_places']}) SELECT c.c_custkey, CASE WHEN c.c_custkey % 3 = 0 THEN 'cache:' || n.n_name WHEN k.p_id IS NOT NULL THEN 'offline:' || k.p_id ELSE 'unknown' END AS place FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN k ON k.c_custkey = c.c_custkey""")
def flow_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached place of a point, else the nearest one of the gazetteer, else none."""
    near = facts.nearest_places(spark, sf_dir).select("c_custkey", "p_id")
    cache = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(cache, "c_nationkey", "left").join(near, "c_custkey")
    place = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("cache:"), "n_name")).when(F.col("p_id").isNotNull(), F.concat(F.lit("offline:"), F.col("p_id").cast("string"))).otherwise("unknown")
    return rows.select("c_custkey", place.alias("place"))


@query("""WITH a AS (SELECT user_id, (epoch_us(ts) // 3600000000)::BIGINT AS hour, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL), b AS (SELECT (epoch_us(ts) // 3600000000)::BIGINT AS hour, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY ALL), e AS (SELECT event_id, user_id, (epoch_us(ts) // 3600000000)::BIGINT AS hour FROM events)
SELECT e.event_id, round(coalesce(a.v, b.v), 4) AS value, CASE WHEN a.v IS NOT NULL THEN 'forecast' WHEN b.v IS NOT NULL THEN 'archive' ELSE 'none' END AS source FROM e LEFT JOIN a ON a.user_id = e.user_id AND a.hour = e.hour LEFT JOIN b ON b.hour = e.hour""")
def flow_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source that has data at the hour of a capture."""
    rows = samples(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / 3600000000))
    a = rows.where("event_type = 'view'").groupBy("user_id", "hour").agg(F.avg("value").alias("a"))
    b = rows.where("event_type = 'click'").groupBy("hour").agg(F.avg("value").alias("b"))
    met = rows.join(a, ["user_id", "hour"], "left").join(b, "hour", "left")
    return met.select("event_id", F.round(F.coalesce("a", "b"), 4).alias("value"), F.when(F.col("a").isNotNull(), "forecast").when(F.col("b").isNotNull(), "archive").otherwise("none").alias("source"))


_PHASE = "CASE WHEN {0} >= 6 THEN 'day' WHEN {0} >= -4 THEN 'golden_hour' WHEN {0} >= -6 THEN 'blue_hour' WHEN {0} >= -12 THEN 'nautical_twilight' WHEN {0} >= -18 THEN 'astronomical_twilight' ELSE 'night' END"
_AT = [clocks._SUN.replace("epoch_us(ts) / 1000000.0::DOUBLE AS t", f"epoch_us(ts) / 1000000.0::DOUBLE + {off} AS t") for off in (-1800, 0, 1800)]


@query(f"""WITH x AS (WITH {_AT[0]} SELECT event_id, {_PHASE.format('el')} AS phase FROM p), y AS (WITH {_AT[1]} SELECT event_id, {_PHASE.format('el')} AS phase FROM p), z AS (WITH {_AT[2]} SELECT event_id, {_PHASE.format('el')} AS phase FROM p)
SELECT y.event_id, CASE WHEN x.phase = y.phase AND y.phase = z.phase THEN y.phase END AS phase FROM y JOIN x ON x.event_id = y.event_id JOIN z ON z.event_id = y.event_id""")
def flow_sun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The light of a capture whose time is known within half an hour: kept only if it is one phase all along."""
    lat, lon = (F.col("user_id") % 120 - 60).cast("double"), (F.col("user_id") * 7 % 360 - 180).cast("double")
    phase = lambda off: K.light_phase(K.sun(F.col("us") / 1e6 + off, lat, lon)["elevation"])
    rows = samples(spark, sf_dir).select("event_id", phase(-1800).alias("x"), phase(0).alias("y"), phase(1800).alias("z"))
    return rows.select("event_id", F.when((F.col("x") == F.col("y")) & (F.col("y") == F.col("z")), F.col("y")).alias("phase"))


_SHOTS = _SQL["shots_from_cuts"].replace("SELECT user_id, round(start, 3) AS start, round(e, 3) AS e FROM e WHERE e > start", "SELECT user_id, start, e FROM e WHERE e > start")


@query(f"""WITH s AS ({_SHOTS}), e AS (SELECT user_id, {shots._AT} AS t, value FROM events) SELECT s.user_id, round(s.start, 3) AS start, count(*) AS n, round(avg(value), 4) AS mean FROM s JOIN e ON e.user_id = s.user_id AND e.t >= s.start AND e.t < s.e GROUP BY s.user_id, s.start""")
def flow_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, shots, and what the samples of each shot come to: a sample takes the last shot that began, by one union and one sort."""
    cuts = samples(spark, sf_dir).where("value >= 60").select("user_id", shots.at().alias("at"))
    found = S.shots(cuts, shots.videos(spark, sf_dir), "user_id", "at", "duration")
    rows = samples(spark, sf_dir).select("user_id", shots.at().alias("t"), "value", F.lit(None).cast("double").alias("start"))
    both = rows.unionByName(found.select("user_id", F.col("start").alias("t"), F.lit(None).cast("double").alias("value"), "start"))
    w = Window.partitionBy("user_id").orderBy("t", F.col("value").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("shot", F.last("start", ignorenulls=True).over(w)).where("value is not null")
    return inside.groupBy("user_id", F.col("shot").alias("exact")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean")).select("user_id", F.round("exact", 3).alias("start"), "n", "mean")


@query("""WITH e AS (SELECT user_id, (epoch_us(ts) // 43200000000)::BIGINT AS bucket, value FROM events), c AS (SELECT user_id, bucket, 10 * log10(greatest(avg(pow(10.0::DOUBLE, value / 10)), 1e-12::DOUBLE)) AS level FROM e GROUP BY ALL), s AS (SELECT user_id, avg(CASE WHEN value < 10 THEN 1.0::DOUBLE ELSE 0 END) AS silent FROM e GROUP BY user_id)
SELECT c.user_id, count(*) AS buckets, round(max(level), 4) AS peak, round(any_value(silent), 4) AS silent FROM c JOIN s ON s.user_id = c.user_id GROUP BY c.user_id""")
def flow_audio_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The energy curve of a recording and how much of it is silent."""
    rows = samples(spark, sf_dir).withColumn("bucket", F.floor(F.col("us") / 43200000000))
    each = rows.groupBy("user_id", "bucket").agg((10 * F.log10(F.greatest(F.avg(F.pow(F.lit(10.0), F.col("value") / 10)), F.lit(1e-12)))).alias("level"), F.sum((F.col("value") < 10).cast("int")).alias("low"), F.count(F.lit(1)).alias("n"))
    return each.groupBy("user_id").agg(F.count(F.lit(1)).alias("buckets"), F.round(F.max("level"), 4).alias("peak"), F.round(F.sum("low") / F.sum("n"), 4).alias("silent"))


@query(f"""WITH a AS ({_SQL['sound_segments']}), b AS ({_SQL['sound_events']}), c AS ({_SQL['agreeing_sounds']})
SELECT video, 'segment' AS kind, category AS label, s FROM a UNION ALL SELECT video, 'event', class, s FROM b UNION ALL SELECT video, 'heard', category, s FROM c""")
def flow_sound_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval rows of three kinds in one table."""
    rows = lambda df, kind, label: df.select("video", F.lit(kind).alias("kind"), F.col(label).alias("label"), "s")
    return rows(sounds.sound_segments(spark, sf_dir), "segment", "category").unionByName(rows(sounds.sound_events(spark, sf_dir), "event", "class")).unionByName(rows(sounds.agreeing_sounds(spark, sf_dir), "heard", "category"))


@query(f"""WITH s AS ({_SQL['suspect_segments']}) SELECT conv_id, count(*) AS segments, count(*) FILTER (reasons <> '') AS suspect, count(*) FILTER (contains(reasons, 'repeat')) AS repeats FROM s GROUP BY conv_id""")
def flow_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a transcript, those that look made up, and the repeats among them."""
    rows = transcripts.suspect_segments(spark, sf_dir)
    count = lambda test: F.sum(test.cast("long"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("segments"), count(F.col("reasons") != "").alias("suspect"), count(F.contains("reasons", F.lit("repeat"))).alias("repeats"))


@query(f"""WITH b AS ({_SQL['merged_blocks']}), u AS ({_SQL['block_usability']}), h AS ({_SQL['salient_blocks']}), n AS (SELECT k, count(*) AS blocks, max(b) AS duration FROM b GROUP BY k), g AS (SELECT l_orderkey, count(*) AS highlights FROM h GROUP BY l_orderkey)
SELECT n.k, n.blocks, u.usability, coalesce(g.highlights, 0) AS highlights, CASE WHEN duration < 90 THEN 1 WHEN duration <= 300 THEN greatest(2, least(4, round_even(duration / 45.0::DOUBLE, 0)::INTEGER)) ELSE 4 END AS chapters FROM n JOIN u ON u.l_orderkey = n.k LEFT JOIN g ON g.l_orderkey = n.k""")
def flow_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, usability, highlights and chapters of a video."""
    blocks = shots.merged_blocks(spark, sf_dir).groupBy("k").agg(F.count(F.lit(1)).alias("blocks"), F.max("b").alias("duration"))
    usable = facts.block_usability(spark, sf_dir).withColumnRenamed("l_orderkey", "k")
    best = shots.salient_blocks(spark, sf_dir).groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("highlights"))
    return blocks.join(usable, "k").join(best, "k", "left").select("k", "blocks", "usability", F.coalesce("highlights", F.lit(0)).alias("highlights"), S.chapter_count(F.col("duration")).alias("chapters"))


@query(f"""WITH p AS ({_SQL['shot_passages']}) SELECT video, count(*) AS passages, sum(length(text)) AS chars, max(length(text)) AS longest FROM p GROUP BY video""")
def flow_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a video gives to the index."""
    n = F.length("text")
    return passages.shot_passages(spark, sf_dir).groupBy("video").agg(F.count(F.lit(1)).alias("passages"), F.sum(n).alias("chars"), F.max(n).alias("longest"))


@query(f"""WITH t AS ({_SQL['capture_times']}), o AS (SELECT e.user_id, min(x.minutes) AS offset_min FROM events e JOIN ({_SQL['offsets_inferred']}) x ON x.event_id = e.event_id GROUP BY e.user_id) SELECT t.user_id, t.at_s, t.confidence, o.offset_min FROM t LEFT JOIN o ON o.user_id = t.user_id""")
def flow_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture time and offset of a video from all its candidates."""
    owner = load(spark, sf_dir, "events").select("event_id", "user_id")
    offsets = clocks.offsets_inferred(spark, sf_dir).join(owner, "event_id").groupBy("user_id").agg(F.min("minutes").alias("offset_min"))
    return passages.capture_times(spark, sf_dir).join(offsets, "user_id", "left").select("user_id", "at_s", "confidence", "offset_min")


@query(f"""WITH f AS ({_SQL['timeline_files']}), x AS (SELECT f.timeline, f.file, f.place, p.p_size AS frames FROM f JOIN part p ON p.p_partkey = f.file) SELECT timeline, file, place, coalesce(sum(frames) OVER (PARTITION BY timeline ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM x""")
def flow_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a timeline in order and the frame that each begins at."""
    sizes = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("frames"))
    w = Window.partitionBy("timeline").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return facts.timeline_files(spark, sf_dir).join(sizes, "file").select("timeline", "file", "place", F.coalesce(F.sum("frames").over(w), F.lit(0)).alias("at"))


@query(f"""WITH p AS ({_SQL['sound_presence']}), l AS (SELECT user_id, event_type AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT p.video, p.category, p.share, l.state FROM p JOIN l ON l.user_id = p.video""")
def flow_audio_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is heard in a recording, with the state of its latest run."""
    last = samples(spark, sf_dir).groupBy(F.col("user_id").alias("video")).agg(F.max_by("event_type", F.struct("us", "event_id")).alias("state"))
    return sounds.sound_presence(spark, sf_dir).join(last, "video").select("video", "category", "share", "state")


@query(f"""WITH m AS ({_SQL['clip_match']}), s AS ({_SQL['bin_members']}) SELECT way, count(*) AS files, count(found) AS linked, (SELECT count(*) FROM s) AS members FROM m GROUP BY way""")
def flow_bin_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the files of a timeline were matched, beside the members of its bin; the count of members is one row."""
    matched = library.clip_match(spark, sf_dir).groupBy("way").agg(F.count(F.lit(1)).alias("files"), F.count("found").alias("linked"))
    members = library.bin_members(spark, sf_dir).agg(F.count(F.lit(1)).alias("members"))
    return matched.join(F.broadcast(members))


@query(f"""WITH c AS ({_SQL['cuts_accepted']}), f AS (SELECT user_id, event_id, epoch_us(ts) AS us, value FROM events), k AS (SELECT c.user_id, c.us, arg_max(f.event_id, struct_pack(v := f.value, e := f.event_id)) AS frame FROM c JOIN f ON f.user_id = c.user_id AND f.us >= c.us AND f.us < c.us + 3600000000 GROUP BY ALL) SELECT * FROM k""")
def flow_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best frame of the hour after each accepted cut: cuts and frames meet by the hour."""
    cuts = sequences.cuts_accepted(spark, sf_dir)
    hour = 3600000000
    dealt = cuts.withColumn("h", F.explode(F.array(F.floor(F.col("us") / hour), F.floor(F.col("us") / hour) + 1)))
    frames = load(spark, sf_dir, "events").select("user_id", "event_id", "value", us().alias("t")).withColumn("h", F.floor(F.col("t") / hour))
    met = dealt.join(frames, ["user_id", "h"]).where((F.col("t") >= F.col("us")) & (F.col("t") < F.col("us") + hour))
    return met.groupBy("user_id", "us").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("frame"))

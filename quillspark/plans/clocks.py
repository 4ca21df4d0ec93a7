"""Queries of timecodes, dates, offsets, sun, moon and air."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clocks as C
from ..functions import sky as K
from .registry import load, query
from .sequences import us

NTSC = 30000 / 1001
_N = "(event_id * 7919 + floor(value * 100)::BIGINT)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts", us().alias("us"), (F.col("event_id") * 7919 + F.floor(F.col("value") * 100)).alias("n"))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


@query(f"""WITH c AS (SELECT event_id, {_N} AS n FROM events), p AS (SELECT event_id, n // 60 % 24 AS h, n % 60 AS m, n // 7 % 60 AS s, n % 33 AS f, CASE WHEN n % 2 = 0 THEN ';' ELSE ':' END AS sep FROM c)
SELECT event_id, printf('%02d:%02d:%02d', h, m, s) || sep || printf('%02d', f) AS code,
CASE WHEN f < 30 THEN ((h * 60 + m) * 60 + s) * 30 + f - CASE WHEN sep = ';' THEN 2 * (h * 60 + m - (h * 60 + m) // 10) ELSE 0 END END AS frames,
CASE WHEN f < 30 THEN round(h * 3600 + m * 60 + s + f / 30.0::DOUBLE, 6) END AS seconds FROM p""")
def timecode_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    code = F.concat(_two(F.floor(n / 60) % 24), F.lit(":"), _two(n % 60), F.lit(":"), _two(F.floor(n / 7) % 60), F.when(n % 2 == 0, ";").otherwise(":"), _two(n % 33))
    rows = _events(spark, sf_dir).select("event_id", code.alias("code"))
    return rows.select("event_id", "code", C.timecode_frames(F.col("code"), NTSC).alias("frames"), F.round(C.timecode_seconds(F.col("code"), NTSC), 6).alias("seconds"))


@query(f"""WITH c AS (SELECT event_id, ({_N} * 31) % (17982 * 144) AS f FROM events), d AS (SELECT event_id, f, f + f // 17982 * 18 + CASE WHEN f % 17982 > 2 THEN (f % 17982 - 2) // 1798 * 2 ELSE 0 END AS g FROM c)
SELECT event_id, printf('%02d:%02d:%02d;%02d', g // 108000, g // 1800 % 60, g // 30 % 60, g % 30) AS code FROM d""")
def drop_frame_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", C.frames_timecode(F.col("n") * 31, NTSC, drop_frame=True).alias("code"))


@query("""WITH s AS (SELECT event_id, value * 90.0::DOUBLE AS s FROM events)
SELECT event_id, greatest(0, floor(s * 25.0::DOUBLE + 1e-6::DOUBLE))::BIGINT AS frame, CASE WHEN s >= 3600 THEN (floor(s)::BIGINT // 3600)::VARCHAR || ':' ELSE '' END || printf('%02d:%02d', floor(s)::BIGINT // 60 % 60, floor(s)::BIGINT % 60) AS clock FROM s""")
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("value") * 90.0
    return _events(spark, sf_dir).select("event_id", C.frame_at(s, 25).alias("frame"), C.short_clock(s).alias("clock"))


_MONTHS = {k: "[" + ", ".join(f"'{m}'" for m in v) + "]" for k, v in C.MONTHS.items()}


@query(f"""SELECT o_orderkey, CASE WHEN day(o_orderdate) = 1 THEN '1er' ELSE day(o_orderdate)::VARCHAR END || ' ' || {_MONTHS['fr']}[month(o_orderdate)] || ' ' || year(o_orderdate) AS fr,
day(o_orderdate) || ' ' || {_MONTHS['en']}[month(o_orderdate)] || ' ' || year(o_orderdate) AS en FROM orders""")
def spoken_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", C.spoken_date(F.col("o_orderdate"), "fr").alias("fr"), C.spoken_date(F.col("o_orderdate"), "en").alias("en"))


@query(f"""WITH p AS (SELECT event_id, {_N} AS n FROM events), d AS (SELECT event_id, n, 2000 + n % 30 AS y, n // 3 % 14 AS m, n // 5 % 34 AS d FROM p),
v AS (SELECT event_id, 'VID_' || y || printf('-%02d-%02d', m, d) || CASE WHEN n % 3 = 0 THEN '_10-20-30' WHEN n % 3 = 1 THEN '.mp4' ELSE '7' END AS name, n % 3 = 2 AS longer, try_strptime(y || printf('-%02d-%02d', m, d), '%Y-%m-%d')::DATE AS day FROM d)
SELECT event_id, name, CASE WHEN NOT longer THEN day END AS day FROM v""")
def name_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    tail = F.when(n % 3 == 0, "_10-20-30").when(n % 3 == 1, ".mp4").otherwise("7")
    name = F.concat(F.lit("VID_"), (2000 + n % 30).cast("string"), F.lit("-"), _two(F.floor(n / 3) % 14), F.lit("-"), _two(F.floor(n / 5) % 34), tail)
    return _events(spark, sf_dir).select("event_id", name.alias("name")).select("event_id", "name", C.name_date(F.col("name")).alias("day"))


_OFFSETS = "[" + ", ".join(str(x) for x in C.UTC_OFFSETS) + "]"


@query(f"""WITH p AS (SELECT event_id, {_N} AS n FROM events), d AS (SELECT event_id, CASE WHEN n % 2 = 0 THEN '-' ELSE '+' END AS s, n % 16 AS h, [0, 15, 30, 45][n // 16 % 4 + 1] AS m, CASE WHEN n % 3 = 0 THEN ':' ELSE '' END AS c FROM p),
v AS (SELECT event_id, s || printf('%02d', h) || c || printf('%02d', m) AS text, CASE WHEN s = '-' THEN -1 ELSE 1 END * (h * 60 + m) AS x FROM d) SELECT event_id, text, CASE WHEN list_contains({_OFFSETS}, x) THEN x END::INTEGER AS minutes FROM v""")
def offsets_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    quarter = F.element_at(F.array(*[F.lit(x) for x in (0, 15, 30, 45)]), (F.floor(n / 16) % 4 + 1).cast("int"))
    text = F.concat(F.when(n % 2 == 0, "-").otherwise("+"), _two(n % 16), F.when(n % 3 == 0, ":").otherwise(""), _two(quarter))
    return _events(spark, sf_dir).select("event_id", text.alias("text")).select("event_id", "text", C.offset_minutes(F.col("text")).cast("int").alias("minutes"))


@query(f"""WITH p AS (SELECT event_id, ({_N} % 1800 - 900) * 60 + {_N} % 97 - 48 AS d FROM events), q AS (SELECT event_id, d, round_even(d / 900.0::DOUBLE, 0)::BIGINT AS q FROM p)
SELECT event_id, CASE WHEN abs(d - q * 900) <= 30 AND list_contains({_OFFSETS}, q * 15) THEN q * 15 END AS minutes FROM q""")
def offsets_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = (F.col("n") % 1800 - 900) * 60 + F.col("n") % 97 - 48
    at = F.floor(F.col("us") / 1000000)
    return _events(spark, sf_dir).select("event_id", C.inferred_offset(at + delta, at).alias("minutes"))


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL 9 HOUR WHEN user_id % 3 = 1 THEN ts - INTERVAL 210 MINUTE ELSE ts END::DATE AS day FROM events""")
def capture_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.when(F.col("user_id") % 3 == 0, "Asia/Tokyo")
    offset = F.when(F.col("user_id") % 3 == 1, -210)
    return _events(spark, sf_dir).select("event_id", C.capture_date(F.col("ts").cast("timestamp"), zone, offset).alias("day"))


@query("""WITH a AS (SELECT event_id, epoch_us('2024-01-20 00:00:00'::TIMESTAMP) // 1000000 - epoch_us(ts) // 1000000 AS age FROM events)
SELECT event_id, CASE WHEN age < -3600 THEN 'future' WHEN age < 172800 THEN 'provisional' WHEN age < 604800 THEN 'recent' ELSE 'settled' END AS state FROM a""")
def weather_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.unix_micros(F.lit("2024-01-20 00:00:00").cast("timestamp")) / 1000000
    return _events(spark, sf_dir).select("event_id", C.freshness(F.floor(F.col("us") / 1000000), F.floor(now)).alias("state"))


_SUN = """t AS (SELECT event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, (user_id % 120 - 60)::DOUBLE AS lat, (user_id * 7 % 360 - 180)::DOUBLE AS lon FROM events),
j AS (SELECT *, (t / 86400.0::DOUBLE + 2440587.5::DOUBLE - 2451545.0::DOUBLE) / 36525.0::DOUBLE AS jc, t - floor(t / 86400.0::DOUBLE) * 86400.0::DOUBLE AS day FROM t),
a AS (SELECT *, radians((280.46646::DOUBLE + jc * (36000.76983::DOUBLE + jc * 0.0003032::DOUBLE)) - 360 * floor((280.46646::DOUBLE + jc * (36000.76983::DOUBLE + jc * 0.0003032::DOUBLE)) / 360)) AS l0, radians(357.52911::DOUBLE + jc * (35999.05029::DOUBLE - 0.0001537::DOUBLE * jc)) AS m,
0.016708634::DOUBLE - jc * (0.000042037::DOUBLE + 0.0000001267::DOUBLE * jc) AS e, radians(125.04::DOUBLE - 1934.136::DOUBLE * jc) AS o FROM j),
b AS (SELECT *, radians(degrees(l0) + sin(m) * (1.914602::DOUBLE - jc * (0.004817::DOUBLE + 0.000014::DOUBLE * jc)) + sin(2 * m) * (0.019993::DOUBLE - 0.000101::DOUBLE * jc) + sin(3 * m) * 0.000289::DOUBLE - 0.00569::DOUBLE - 0.00478::DOUBLE * sin(o)) AS l,
radians(23 + (26 + (21.448::DOUBLE - jc * (46.815::DOUBLE + jc * (0.00059::DOUBLE - jc * 0.001813::DOUBLE))) / 60) / 60 + 0.00256::DOUBLE * cos(o)) AS ob FROM a),
c AS (SELECT *, pow(tan(ob / 2), 2) AS y, asin(sin(ob) * sin(l)) AS d FROM b),
h AS (SELECT *, 4 * degrees(y * sin(2 * l0) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * l0) - 0.5::DOUBLE * y * y * sin(4 * l0) - 1.25::DOUBLE * e * e * sin(2 * m)) AS eq FROM c),
g AS (SELECT *, (day / 60 + eq + 4 * lon) - 1440 * floor((day / 60 + eq + 4 * lon) / 1440) AS s FROM h),
k AS (SELECT *, s / 4 - 180 AS ha, radians(lat) AS la FROM g), z AS (SELECT *, acos(greatest(-1, least(1, sin(la) * sin(d) + cos(la) * cos(d) * cos(radians(ha))))) AS z FROM k),
p AS (SELECT event_id, ha, degrees(d) AS dec, 90 - degrees(z) AS el, degrees(acos(greatest(-1, least(1, (sin(la) * cos(z) - sin(d)) / (cos(la) * sin(z)))))) AS az FROM z)"""


def _suns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = (F.col("user_id") % 120 - 60).cast("double"), (F.col("user_id") * 7 % 360 - 180).cast("double")
    return _events(spark, sf_dir).select("event_id", "us", lat.alias("lat"), lon.alias("lon"), K.sun(F.col("us") / 1e6, lat, lon).alias("sun"))


@query(f"WITH {_SUN} SELECT event_id, round(el, 4) AS elevation, round(CASE WHEN ha > 0 THEN (az + 180) - 360 * floor((az + 180) / 360) ELSE (540 - az) - 360 * floor((540 - az) / 360) END, 3) AS azimuth, round(ha, 4) AS hour_angle, round(dec, 4) AS declination FROM p")
def sun_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suns(spark, sf_dir).select("event_id", F.round("sun.elevation", 4).alias("elevation"), F.round("sun.azimuth", 3).alias("azimuth"), F.round("sun.hour_angle", 4).alias("hour_angle"), F.round("sun.declination", 4).alias("declination"))


@query(f"""WITH {_SUN} SELECT event_id, round(el + CASE WHEN el > 85 THEN 0 ELSE CASE WHEN el > 5 THEN 58.1::DOUBLE / tan(radians(el)) - 0.07::DOUBLE / pow(tan(radians(el)), 3) + 0.000086::DOUBLE / pow(tan(radians(el)), 5)
WHEN el > -0.575 THEN 1735 + el * (-518.2::DOUBLE + el * (103.4::DOUBLE + el * (-12.79::DOUBLE + el * 0.711::DOUBLE))) ELSE -20.772::DOUBLE / tan(radians(el)) END / 3600 END, 4) AS apparent,
CASE WHEN el >= 6 THEN 'day' WHEN el >= -4 THEN 'golden_hour' WHEN el >= -6 THEN 'blue_hour' WHEN el >= -12 THEN 'nautical_twilight' WHEN el >= -18 THEN 'astronomical_twilight' ELSE 'night' END AS light,
CASE WHEN el > -0.833 THEN 'day' WHEN el >= -6 THEN 'civil_twilight' WHEN el >= -12 THEN 'nautical_twilight' WHEN el >= -18 THEN 'astronomical_twilight' ELSE 'night' END AS twilight FROM p""")
def sun_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    el = F.col("sun.elevation")
    return _suns(spark, sf_dir).select("event_id", F.round(el + K.refraction(el), 4).alias("apparent"), K.light_phase(el).alias("light"), K.twilight_phase(el).alias("twilight"))


@query("""WITH j AS (SELECT event_id, (epoch_us(ts) / 1000000.0::DOUBLE / 86400.0::DOUBLE + 2440587.5::DOUBLE - 2451545.0::DOUBLE) / 36525.0::DOUBLE AS jc FROM events),
a AS (SELECT event_id, radians((297.8501921::DOUBLE + 445267.1114034::DOUBLE * jc) - 360 * floor((297.8501921::DOUBLE + 445267.1114034::DOUBLE * jc) / 360)) AS d, radians((357.5291092::DOUBLE + 35999.0502909::DOUBLE * jc) - 360 * floor((357.5291092::DOUBLE + 35999.0502909::DOUBLE * jc) / 360)) AS m,
radians((134.9633964::DOUBLE + 477198.8675055::DOUBLE * jc) - 360 * floor((134.9633964::DOUBLE + 477198.8675055::DOUBLE * jc) / 360)) AS p FROM j)
SELECT event_id, round((1 + cos(radians(180 - degrees(d) - 6.289::DOUBLE * sin(p) + 2.1::DOUBLE * sin(m) - 1.274::DOUBLE * sin(2 * d - p) - 0.658::DOUBLE * sin(2 * d) - 0.214::DOUBLE * sin(2 * p) - 0.110::DOUBLE * sin(d)))) / 2, 5) AS illuminated, sin(d) > 0 AS waxing FROM a""")
def moon_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", K.moon(F.col("us") / 1e6).alias("m")).select("event_id", F.round("m.illuminated", 5).alias("illuminated"), F.col("m.waxing").alias("waxing"))


@query()
def phase_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's hour by the minute: least and greatest elevation, the phases in order, seconds with the sun up."""
    lat, lon = F.lit(48.85), F.lit(2.35)
    hours = _events(spark, sf_dir).select(F.floor(F.col("us") / 3600000000).alias("hour")).distinct()
    steps = hours.select("hour", F.posexplode(F.sequence(F.lit(0), F.lit(59))).alias("k", "minute"))
    lit = steps.withColumn("el", K.sun((F.col("hour") * 3600 + F.col("minute") * 60 + 30).cast("double"), lat, lon)["elevation"])
    marked = lit.groupBy("hour").agg(F.round(F.min("el"), 4).alias("low"), F.round(F.max("el"), 4).alias("high"), F.sum((F.col("el") > K.SUNRISE).cast("long") * 60).alias("sun_up_s"), F.array_sort(F.collect_list(F.struct("minute", K.light_phase(F.col("el")).alias("phase")))).alias("seen"))
    return marked.select("hour", "low", "high", "sun_up_s", F.array_join(F.array_distinct(F.transform("seen", lambda x: x["phase"])), ">").alias("phases"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity - 10 AS el, CASE WHEN l_linenumber % 3 > 0 THEN l_discount * 36000 END AS sun, l_tax * 45000 AS up, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 10 END AS dif, CASE WHEN l_linenumber < 6 THEN l_quantity * 2 END AS cov FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN el < -0.833 THEN 'twilight' WHEN sun IS NOT NULL AND up >= 900 THEN
CASE WHEN least(1, sun / up) <= 0.1 OR (dif IS NOT NULL AND el >= 10 AND dif >= 0.8) THEN 'overcast' WHEN least(1, sun / up) >= 0.5 AND (NOT (dif IS NOT NULL AND el >= 10) OR dif <= 0.5) THEN 'sunlit' ELSE 'mixed' END
WHEN cov >= 85 THEN 'overcast' WHEN cov <= 25 THEN 'sunlit' WHEN cov IS NOT NULL THEN 'mixed' ELSE 'clear_assumed' END AS regime FROM l""")
def sky_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    regime = K.sky_regime(F.col("l_quantity") - 10, F.when(n % 3 > 0, F.col("l_discount") * 36000), F.col("l_tax") * 45000, F.when(n % 2 == 0, F.col("l_discount") * 10), F.when(n < 6, F.col("l_quantity") * 2))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", regime.alias("regime"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity / 2 - 5 AS t, l_quantity / 2 - 5 - l_discount * 100 AS dew, CASE WHEN l_linenumber % 4 > 0 THEN l_quantity * 7 END AS d0, l_discount * 60 AS s0, CASE WHEN l_linenumber % 5 > 0 THEN l_tax * 4000 END AS d1, l_tax * 50 AS s1, l_discount * 10 AS f FROM lineitem),
u AS (SELECT *, (1 - f) * -s0 * sin(radians(d0)) + f * -s1 * sin(radians(d1)) AS u, (1 - f) * -s0 * cos(radians(d0)) + f * -s1 * cos(radians(d1)) AS v FROM l)
SELECT l_orderkey, l_linenumber, round(greatest(0, least(100, 100 * exp(17.625::DOUBLE * dew / (dew + 243.04::DOUBLE)) / exp(17.625::DOUBLE * t / (t + 243.04::DOUBLE)))), 4) AS humidity,
round(CASE WHEN d0 IS NULL OR d1 IS NULL THEN CASE WHEN d0 IS NULL THEN CASE WHEN f >= 0.5 THEN d1 END WHEN f < 0.5 THEN d0 END WHEN sqrt(u * u + v * v) >= 0.5 THEN (degrees(atan2(-u, -v)) + 360) - 360 * floor((degrees(atan2(-u, -v)) + 360) / 360) END, 3) AS wind_from FROM u""")
def humidity_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    rows = load(spark, sf_dir, "lineitem")
    wind = K.wind_from(F.when(n % 4 > 0, q * 7), F.col("l_discount") * 60, F.when(n % 5 > 0, F.col("l_tax") * 4000), F.col("l_tax") * 50, F.col("l_discount") * 10)
    return rows.select("l_orderkey", "l_linenumber", F.round(K.humidity(q / 2 - 5, q / 2 - 5 - F.col("l_discount") * 100), 4).alias("humidity"), F.round(wind, 3).alias("wind_from"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, 0.2::DOUBLE + l_discount * 3 AS x, 0.25::DOUBLE + l_tax * 3 AS y FROM lineitem), n AS (SELECT *, (x - 0.3320::DOUBLE) / (0.1858::DOUBLE - y) AS n FROM l), k AS (SELECT l_orderkey, l_linenumber, 449 * pow(n, 3) + 3525 * pow(n, 2) + 6823.3::DOUBLE * n + 5520.33::DOUBLE AS k FROM n)
SELECT l_orderkey, l_linenumber, round(k, 3) AS kelvin, CASE WHEN k < 2000 THEN 'candle' WHEN k < 3000 THEN 'tungsten' WHEN k < 4000 THEN 'halogen' WHEN k < 5000 THEN 'fluorescent' WHEN k < 6500 THEN 'daylight' WHEN k < 8000 THEN 'overcast' WHEN k < 10000 THEN 'shade' ELSE 'blue_sky' END AS name FROM k""")
def colour_temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", K.colour_temperature(0.2 + F.col("l_discount") * 3, 0.25 + F.col("l_tax") * 3).alias("k"))
    return k.select("l_orderkey", "l_linenumber", F.round("k", 3).alias("kelvin"), K.kelvin_name(F.col("k")).alias("name"))

"""Sun, moon, light and air, as column expressions over Unix seconds and degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SUNRISE, GOLDEN_TOP, GOLDEN_BOTTOM, CIVIL, NAUTICAL, ASTRONOMICAL = -0.833, 6.0, -4.0, -6.0, -12.0, -18.0
OVERCAST_SUN, SUNLIT_SUN, OVERCAST_DIFFUSE, DIFFUSE_FROM, LEAST_SUN_UP_S = 0.1, 0.5, 0.8, 10.0, 900
CLOUDY, CLEAR, CALM_KMH = 85.0, 25.0, 0.5
KELVINS = ((2000, "candle"), (3000, "tungsten"), (4000, "halogen"), (5000, "fluorescent"), (6500, "daylight"), (8000, "overcast"), (10000, "shade"))


def century(seconds: Column) -> Column:
    """Julian centuries since 2000."""
    return (seconds / 86400.0 + 2440587.5 - 2451545.0) / 36525.0


def sun(seconds: Column, lat: Column, lon: Column) -> Column:
    """struct(elevation, azimuth, hour_angle, declination, equation): the sun's place in degrees, the equation of time in minutes.

    The stages are bound one after another, so that a long formula is made once a row.
    """

    def angles(x: Column) -> Column:
        jc, lat, lon, day = x["jc"], x["lat"], x["lon"], x["day"]
        l0 = F.pmod(280.46646 + jc * (36000.76983 + jc * 0.0003032), F.lit(360.0))
        m = F.radians(357.52911 + jc * (35999.05029 - 0.0001537 * jc))
        e = 0.016708634 - jc * (0.000042037 + 0.0000001267 * jc)
        center = F.sin(m) * (1.914602 - jc * (0.004817 + 0.000014 * jc)) + F.sin(2 * m) * (0.019993 - 0.000101 * jc) + F.sin(3 * m) * 0.000289
        omega = F.radians(125.04 - 1934.136 * jc)
        apparent = F.radians(l0 + center - 0.00569 - 0.00478 * F.sin(omega))
        oblique = F.radians(23 + (26 + (21.448 - jc * (46.815 + jc * (0.00059 - jc * 0.001813))) / 60) / 60 + 0.00256 * F.cos(omega))
        return F.struct(F.radians(l0).alias("l0"), m.alias("m"), e.alias("e"), oblique.alias("oblique"), apparent.alias("apparent"), lat.alias("lat"), lon.alias("lon"), day.alias("day"))

    def hours(x: Column) -> Column:
        y = F.pow(F.tan(x["oblique"] / 2), F.lit(2.0))
        equation = 4 * F.degrees(y * F.sin(2 * x["l0"]) - 2 * x["e"] * F.sin(x["m"]) + 4 * x["e"] * y * F.sin(x["m"]) * F.cos(2 * x["l0"]) - 0.5 * y * y * F.sin(4 * x["l0"]) - 1.25 * x["e"] * x["e"] * F.sin(2 * x["m"]))
        declination = F.asin(F.sin(x["oblique"]) * F.sin(x["apparent"]))
        hour_angle = F.pmod(x["day"] / 60.0 + equation + 4 * x["lon"], F.lit(1440.0)) / 4 - 180
        return F.struct(declination.alias("d"), hour_angle.alias("h"), F.radians(x["lat"]).alias("lat"), equation.alias("q"))

    def place(x: Column) -> Column:
        cosine = F.sin(x["lat"]) * F.sin(x["d"]) + F.cos(x["lat"]) * F.cos(x["d"]) * F.cos(F.radians(x["h"]))
        zenith = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
        return F.struct(zenith.alias("z"), x["d"].alias("d"), x["h"].alias("h"), x["lat"].alias("lat"), x["q"].alias("q"))

    def seen(x: Column) -> Column:
        below = F.cos(x["lat"]) * F.sin(x["z"])
        az = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.sin(x["lat"]) * F.cos(x["z"]) - F.sin(x["d"])) / below))))
        azimuth = F.when(F.abs(below) < 1e-12, F.when(x["lat"] > 0, 180.0).otherwise(0.0)).when(x["h"] > 0, F.pmod(az + 180, F.lit(360.0))).otherwise(F.pmod(540 - az, F.lit(360.0)))
        return F.struct((90 - F.degrees(x["z"])).alias("elevation"), azimuth.alias("azimuth"), x["h"].alias("hour_angle"), F.degrees(x["d"]).alias("declination"), x["q"].alias("equation"))

    bound = F.array(F.struct(century(seconds).alias("jc"), F.pmod(seconds, F.lit(86400.0)).alias("day"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon")))
    for stage in (angles, hours, place, seen):
        bound = F.transform(bound, stage)
    return F.get(bound, F.lit(0))


def refraction(elevation: Column) -> Column:
    """Degrees by which the air lifts what stands at an elevation."""
    tan, e = F.tan(F.radians(elevation)), elevation
    high = 58.1 / tan - 0.07 / F.pow(tan, F.lit(3.0)) + 0.000086 / F.pow(tan, F.lit(5.0))
    low = 1735 + e * (-518.2 + e * (103.4 + e * (-12.79 + e * 0.711)))
    return F.when(e > 85, 0.0).otherwise(F.when(e > 5, high).when(e > -0.575, low).otherwise(-20.772 / tan) / 3600)


def light_phase(elevation: Column) -> Column:
    return F.when(elevation >= GOLDEN_TOP, "day").when(elevation >= GOLDEN_BOTTOM, "golden_hour").when(elevation >= CIVIL, "blue_hour").when(elevation >= NAUTICAL, "nautical_twilight").when(elevation >= ASTRONOMICAL, "astronomical_twilight").otherwise("night")


def twilight_phase(elevation: Column) -> Column:
    return F.when(elevation > SUNRISE, "day").when(elevation >= CIVIL, "civil_twilight").when(elevation >= NAUTICAL, "nautical_twilight").when(elevation >= ASTRONOMICAL, "astronomical_twilight").otherwise("night")


def moon(seconds: Column) -> Column:
    """struct(illuminated, waxing) by the low-precision series."""
    jc = century(seconds)
    turn = lambda a, b: F.radians(F.pmod(a + b * jc, F.lit(360.0)))
    bound = F.array(F.struct(turn(297.8501921, 445267.1114034).alias("d"), turn(357.5291092, 35999.0502909).alias("m"), turn(134.9633964, 477198.8675055).alias("p")))

    def phase(x: Column) -> Column:
        d, m, p = x["d"], x["m"], x["p"]
        i = F.radians(180 - F.degrees(d) - 6.289 * F.sin(p) + 2.1 * F.sin(m) - 1.274 * F.sin(2 * d - p) - 0.658 * F.sin(2 * d) - 0.214 * F.sin(2 * p) - 0.110 * F.sin(d))
        return F.struct(((1 + F.cos(i)) / 2).alias("illuminated"), (F.sin(d) > 0).alias("waxing"))

    return F.get(F.transform(bound, phase), F.lit(0))


def sky_regime(elevation: Column, sunshine_s: Column, sun_up_s: Column, diffuse: Column, cover: Column) -> Column:
    """Was the sun out: by sunshine against the time it was up, with the diffuse share where the sun is high, else by cloud cover."""
    part, use = F.least(F.lit(1.0), sunshine_s / sun_up_s), diffuse.isNotNull() & (elevation >= DIFFUSE_FROM)
    by_sun = F.when((part <= OVERCAST_SUN) | (use & (diffuse >= OVERCAST_DIFFUSE)), "overcast").when((part >= SUNLIT_SUN) & (~use | (diffuse <= 0.5)), "sunlit").otherwise("mixed")
    by_cover = F.when(cover >= CLOUDY, "overcast").when(cover <= CLEAR, "sunlit").when(cover.isNotNull(), "mixed").otherwise("clear_assumed")
    return F.when(elevation < SUNRISE, "twilight").when(sunshine_s.isNotNull() & (sun_up_s >= LEAST_SUN_UP_S), by_sun).otherwise(by_cover)


def humidity(temperature: Column, dew_point: Column) -> Column:
    """Relative humidity in percent from the two temperatures (Magnus)."""
    vapour = lambda t: F.exp(17.625 * t / (t + 243.04))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * vapour(dew_point) / vapour(temperature)))


def between(a: Column, b: Column, f: Column) -> Column:
    """Linear between two samples; where one is missing the other counts in its own half only."""
    return F.when(a.isNotNull() & b.isNotNull(), a + (b - a) * f).when(a.isNull(), F.when(f >= 0.5, b)).when(f < 0.5, a)


def wind_from(d0: Column, s0: Column, d1: Column, s1: Column, f: Column) -> Column:
    """Direction between two samples, as vectors weighted by speed; none where they cancel out."""
    w0, w1 = F.coalesce(s0, F.lit(1.0)), F.coalesce(s1, F.lit(1.0))
    u = (1 - f) * -w0 * F.sin(F.radians(d0)) + f * -w1 * F.sin(F.radians(d1))
    v = (1 - f) * -w0 * F.cos(F.radians(d0)) + f * -w1 * F.cos(F.radians(d1))
    met = F.when(F.hypot(u, v) >= CALM_KMH, F.pmod(F.degrees(F.atan2(-u, -v)) + 360, F.lit(360.0)))
    return F.when(d0.isNull() | d1.isNull(), between(d0, d1, f)).otherwise(met)


def colour_temperature(x: Column, y: Column) -> Column:
    """Kelvin of a chromaticity (McCamy)."""
    n = (x - 0.3320) / (0.1858 - y)
    return 449 * F.pow(n, F.lit(3.0)) + 3525 * F.pow(n, F.lit(2.0)) + 6823.3 * n + 5520.33


def kelvin_name(kelvin: Column) -> Column:
    out = F.when(kelvin < KELVINS[0][0], KELVINS[0][1])
    for limit, name in KELVINS[1:]:
        out = out.when(kelvin < limit, name)
    return F.when(kelvin.isNotNull(), out.otherwise("blue_sky"))


def sun_crossings(start: Column, lat: Column, lon: Column, target: float = SUNRISE, hours: int = 24, step_s: int = 600, within_s: float = 0.5) -> Column:
    """struct(rise, set): when the sun's middle passes `target` degrees upwards and downwards in the `hours` from `start` (Unix seconds), the last of each; null where it does not, as on polar days and nights.

    The day is bracketed on a grid of step_s, and a bracket is halved until it is within within_s.
    """
    at = lambda s: sun(s, lat, lon)["elevation"] - target
    n = hours * 3600 // step_s
    seen = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((start + i * step_s).alias("t"), (at(start + i * step_s) > 0).alias("up")))
    halvings = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(step_s / within_s)))))

    def edges(all_: Column) -> Column:
        pairs = F.zip_with(F.slice(all_, 1, n), F.slice(all_, 2, n), lambda p, q: F.struct(p["t"].alias("low"), q["t"].alias("high"), p["up"].alias("was"), q["up"].alias("is")))
        last = lambda up: F.try_element_at(F.filter(pairs, lambda x: (x["is"] == F.lit(up)) & (x["was"] != F.lit(up))), F.lit(-1))
        return F.struct(last(True).alias("rise"), last(False).alias("set"))

    def root(bracket: Column) -> Column:
        def half(s: Column, _: Column) -> Column:
            middle = (s["low"] + s["high"]) / 2
            later = (at(middle) > 0) == bracket["was"]
            return F.struct(F.when(later, middle).otherwise(s["low"]).alias("low"), F.when(later, s["high"]).otherwise(middle).alias("high"))

        begin = F.struct(bracket["low"].cast("double").alias("low"), bracket["high"].cast("double").alias("high"))
        return F.when(bracket.isNotNull(), F.aggregate(halvings, begin, half, lambda s: (s["low"] + s["high"]) / 2))

    found = F.transform(F.transform(F.array(seen), edges), lambda x: F.struct(root(x["rise"]).alias("rise"), root(x["set"]).alias("set")))
    return F.get(found, F.lit(0))

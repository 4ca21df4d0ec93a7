"""Places, sun, weather and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def sun_elevation(seconds: Column, lat: Column, lon: Column) -> Column:
    """Degrees above the horizon at a Unix time, by the low-precision almanac series."""
    d = seconds / 86400.0 - 10957.5
    g = F.radians(357.529 + 0.98560028 * d)
    q = 280.459 + 0.98564736 * d
    ecliptic = F.radians(q + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    e = F.radians(23.439 - 0.00000036 * d)
    declination = F.asin(F.sin(e) * F.sin(ecliptic))
    right = F.degrees(F.atan2(F.cos(e) * F.sin(ecliptic), F.cos(ecliptic)))
    sidereal = 280.46061837 + 360.98564736629 * d
    hour = F.radians(sidereal + lon - right)
    return F.degrees(F.asin(F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(hour)))


def light_phase(elevation: Column) -> Column:
    return F.when(elevation < -18, "night").when(elevation < -12, "astronomical").when(elevation < -6, "nautical").when(elevation < -0.833, "civil").when(elevation < 6, "golden").otherwise("day")


def weather_category(code: Column) -> Column:
    """Groups of the WMO weather codes."""
    return F.when(code == 0, "clear").when(code <= 2, "partly").when(code == 3, "overcast").when(code.between(45, 48), "fog").when(code.between(51, 67), "rain").when(code.between(71, 77), "snow").when(code.between(80, 82), "showers").when(code >= 95, "storm").otherwise("other")


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    both = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = box_area(a) + box_area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# Fixed values.
PRESENT, NAMED, SCENERY, UNDESCRIBED, EACH_MORE, FULL_SIDE, SMALL, LEAVING, LEAVING_AREA, EDGE = 0.7, 0.55, 0.35, 0.5, 0.15, 0.4, 0.25, 0.6, 0.25, 0.02


def subject_presence(described: Column, named: Column, beings: Column) -> Column:
    """How well a frame shows a subject, from 0 to 1.

    described: boolean; named: number of main things that are no scenery; beings: array of boxes (x1, y1, x2, y2 in parts of
    the picture). More of either raise the score; beings that are small lower it, and so does a frame in which all of them
    are leaving: small at an edge. The better of the two counts, and scenery alone counts least.
    """
    boxes = F.coalesce(beings, F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))
    area = F.transform(boxes, box_area)
    several = lambda base, n: F.least(F.lit(1.0), base + EACH_MORE * (n - 1))
    size = F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), F.array_max(area))) / FULL_SIDE)
    leaving = F.forall(boxes, lambda b: ((F.least(b["x1"], b["y1"]) < EDGE) | (F.greatest(b["x2"], b["y2"]) > 1 - EDGE)) & (box_area(b) < LEAVING_AREA))
    alive = several(F.lit(PRESENT), F.size(boxes)) * (1 - SMALL * (1 - size)) * F.when(leaving, LEAVING).otherwise(1.0)
    things = F.when(F.coalesce(named, F.lit(0)) > 0, several(F.lit(NAMED), named)).otherwise(SCENERY)
    return F.when(~F.coalesce(described, F.lit(False)), UNDESCRIBED).when(F.size(boxes) > 0, F.greatest(things, alive)).otherwise(things)

"""Nearest places on the sphere, exactly.

Points and places are dealt to cubes that the sphere's unit vectors fall in, so that poles and the date line are like
any other place. A point looks into the 27 cubes around its own: what they do not hold is farther than a cube's side. A
point whose k-th place is within a side is done; the others go on with cubes of twice the side. So a point
goes on only where it has seen few places. The first side is one that holds about k places if they lie evenly, so that
more places make smaller cubes. Points of one position are looked up once, and of the places of one position only
the first k can be among the nearest.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.space import EARTH_KM, haversine_km


#: The smallest side to begin with: cubes are numbered by integers.
LEAST_SIDE_KM = 0.01


def _chord(km: float) -> float:
    return 2 * math.sin(min(math.pi / 2, km / (2 * EARTH_KM)))


def _vector(lat: Column, lon: Column) -> list[Column]:
    a, o = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)]


def _cube(v: Column, side: float) -> Column:
    return F.floor((v + 1) / side).cast("int")


def nearest_k(points: DataFrame, places: DataFrame, key: str, place: str, k: int, write: Callable[[DataFrame], DataFrame], max_km: float | None = None, side_km: float = 30.0) -> DataFrame:
    """(key, place, km, rank): the k nearest places (place, p_lat, p_lon) of each point (key, lat, lon), within max_km if given; ties by place.

    write(df) cuts the lineage of a round. Points or places without a position are left out.
    """
    known = points.where("lat is not null and lon is not null").select(key, "lat", "lon")
    open_ = write(known.select("lat", "lon").distinct().withColumn("__at", F.monotonically_increasing_id()))
    same = Window.partitionBy("p_lat", "p_lon").orderBy(place)
    there = places.where("p_lat is not null and p_lon is not null").select(place, "p_lat", "p_lon").withColumn("__r", F.row_number().over(same))
    there = write(there.where(F.col("__r") <= k).drop("__r"))
    near = _nearest(open_, there, "__at", place, k, write, math.pi * EARTH_KM + 1 if max_km is None else max_km, side_km)
    # Positions are few where many points share them, so that points go to their position's places, not to all.
    at = known.join(open_, (known["lat"] == open_["lat"]) & (known["lon"] == open_["lon"])).select(key, "__at")
    return at.join(near, "__at").select(key, place, "km", "rank")


def _nearest(open_: DataFrame, there: DataFrame, key: str, place: str, k: int, write: Callable[[DataFrame], DataFrame], limit: float, side_km: float) -> DataFrame:
    """nearest_k() of points and places that are written already."""
    even_km = EARTH_KM * math.sqrt(4 * math.pi * k / max(1, there.count()))
    done, side_km = [], min(side_km, limit, max(even_km, LEAST_SIDE_KM))
    while True:
        side = _chord(side_km)
        around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
        x, y, z = _vector(F.col("lat"), F.col("lon"))
        looked = open_.withColumns({"__x": F.explode(F.transform(around, lambda d: _cube(x, side) + d))}).withColumn("__y", F.explode(F.transform(around, lambda d: _cube(y, side) + d))).withColumn("__z", F.explode(F.transform(around, lambda d: _cube(z, side) + d)))
        dealt = there.withColumns({n: _cube(v, side) for n, v in zip(("__x", "__y", "__z"), _vector(F.col("p_lat"), F.col("p_lon")), strict=True)})
        km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")), 9)
        met = looked.join(dealt, ["__x", "__y", "__z"]).select(key, place, km.alias("km")).where(F.col("km") <= limit)
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("km", place))).where(F.col("rank") <= k)
        last = side_km >= limit or side >= 2
        # A little less than the side, for what rounding does to cubes and distances.
        near = write(ranked if last else ranked.where(F.col("km") <= side_km * (1 - 1e-9)))
        if last:
            return _union([*done, near])
        full = near.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select(key)
        done.append(near.join(full, key, "left_semi"))
        open_ = write(open_.join(full, key, "left_anti"))
        if open_.isEmpty():
            return _union(done)
        side_km = min(2 * side_km, limit)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def nearest_in_zone(points: DataFrame, places: DataFrame, key: str, place: str, zone: str, write: Callable[[DataFrame], DataFrame], k: int = 64, max_km: float = 30.0, side_km: float = 30.0) -> DataFrame:
    """points with the first of their k nearest places within max_km that is in their own zone: `place` and km, null where there is none."""
    near = nearest_k(points, places, key, place, k, write, max_km, side_km)
    own = points.select(key, F.col(zone).alias("__own"))
    same = near.join(places.select(place, F.col(zone).alias("__its")), place).join(own, key).where(F.col("__own").eqNullSafe(F.col("__its")))
    best = same.groupBy(key).agg(F.min_by(F.struct(place, "km"), "rank").alias("__best"))
    return points.join(best, key, "left").select(*points.columns, F.col(f"__best.{place}").alias(place), F.col("__best.km").alias("km"))

"""Facts of shots, frames, sky and boxes: aggregates, votes, verdicts, ranks and nested values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
OUTVOTE_WEIGHT, OUTVOTE_SHARE, CONFIDENT_VIEWS, SUNNY_HOUR, TRACE_MM = 3.0, 0.75, 2, 0.6, 0.1
CLOUDINESS = {"clear": 0, "partly_cloudy": 1, "overcast": 2}
WET = ("drizzle", "rain", "snow", "thunderstorm")
RATES = ((24000, 1001), (24, 1), (25, 1), (30000, 1001), (30, 1), (48000, 1001), (48, 1), (50, 1), (60000, 1001), (60, 1), (100, 1), (120000, 1001), (120, 1))
RATE_TOLERANCE = 0.005
MAIN_CROWD, MAIN_SHARE = 3, 0.4


def rate(num: int, den: int) -> float:
    return num / den


def standard_rate(fps: Column, variable: Column) -> Column:
    """'num/den' of the nearest standard rate within half a percent; variable 30 and 60 count as their NTSC neighbours."""
    near = F.array_min(F.array(*[F.struct(F.abs(F.lit(rate(n, d)) - fps).alias("off"), F.lit(i).alias("i"), F.lit(rate(n, d)).alias("r"), F.lit(f"{n}/{d}").alias("name")) for i, (n, d) in enumerate(RATES)]))
    name = F.when(variable & (near["name"] == "30/1"), "30000/1001").when(variable & (near["name"] == "60/1"), "60000/1001").otherwise(near["name"])
    return F.when((fps > 0) & (F.abs(near["r"] / fps - 1) <= RATE_TOLERANCE), name)


def answer_budget(slot: Column, prompt: Column) -> Column:
    """struct(answer, passages): a fifth of the slot for the answer (256 to 800), a twentieth as margin, the rest for passages."""
    answer = F.least(F.lit(800), F.greatest(F.lit(256), F.floor(slot / 5))).cast("long")
    return F.struct(answer.alias("answer"), F.greatest(F.lit(0), slot - answer - prompt - F.floor(slot / 20)).cast("long").alias("passages"))


def sky_verdict(model: Column, seen: Column, weight: Column, share: Column, views: Column, sunshine: Column, rain_mm: Column) -> Column:
    """struct(category, agreement, confidence): what two sources on the weather come to; null is a source that says nothing."""
    rank = F.create_map(*[F.lit(x) for kv in CLOUDINESS.items() for x in kv])
    a, b = rank[F.coalesce(model, F.lit(""))], rank[F.coalesce(seen, F.lit(""))]
    out = lambda c, g, k: F.struct(c.alias("category"), F.lit(g).alias("agreement"), k.alias("confidence"))
    low, medium, high = F.lit("low"), F.lit("medium"), F.lit("high")
    none = F.lit(None).cast("string")
    sure = F.when((views >= CONFIDENT_VIEWS) & (share >= OUTVOTE_SHARE), medium).otherwise(low)
    many = (weight >= OUTVOTE_WEIGHT) & (share >= OUTVOTE_SHARE)
    clouds = F.when((model == "overcast") & (F.coalesce(sunshine, F.lit(0.0)) >= SUNNY_HOUR), out(seen, "close", medium)).when(F.abs(a - b) == 1, out(F.lit("partly_cloudy"), "close", medium)).otherwise(out(F.when(many, seen).otherwise(model), "disagree", low))
    return (
        F.when(model.isNull() & seen.isNull(), out(none, "unknown", low)).when(model.isNull(), out(seen, "visual_only", sure)).when(seen.isNull(), out(model, "api_only", medium))
        .when(model == seen, out(model, "agree", high)).when(a.isNotNull() & b.isNotNull(), clouds).otherwise(out(model, "disagree", low))
    )


def light_verdict(measured_k: Column, low_k: Column, high_k: Column) -> Column:
    """Is a measured white point plausible under a light of low_k to high_k: consistent, warmer or cooler (in mireds, with tolerance)."""
    least, most, measured = 1e6 / high_k, 1e6 / low_k, 1e6 / measured_k
    lower = 153.8 + F.least(F.lit(0.0), least - 181.8) - 40.0
    upper = 153.8 + F.greatest(F.lit(0.0), most - 181.8) + 40.0
    return F.when(measured > upper, "warmer").when(measured < lower, "cooler").otherwise("consistent")


def source_wide(issues: DataFrame, video: str, frame: str, issue: str, share: float = 0.8, least: int = 5) -> DataFrame:
    """(video, issue): defects of nearly all frames of a video, of videos with enough frames. issues: a row a frame and issue (null: none)."""
    frames = issues.groupBy(video).agg(F.count_distinct(frame).alias("__frames")).where(F.col("__frames") >= least)
    counts = issues.where(F.col(issue).isNotNull()).select(video, frame, issue).distinct().groupBy(video, issue).agg(F.count(F.lit(1)).alias("__n"))
    return counts.join(frames, video).where(F.col("__n") / F.col("__frames") >= share).select(video, issue)


def scored(penalties: DataFrame, keys: Sequence[str], points: str, label: str, reasons: int = 3, least: float = 5.0) -> DataFrame:
    """(keys, score, reasons): 100 less all penalties, and the labels of the heaviest ones."""
    total = F.greatest(F.lit(0), F.bround(100 - F.sum(points))).cast("int")
    heavy = F.array_sort(F.collect_list(F.when(F.col(points) >= least, F.struct((-F.col(points)).alias("p"), F.col(label).alias("l")))))
    return penalties.groupBy(*keys).agg(total.alias("score"), F.slice(F.array_distinct(F.transform(heavy, lambda x: x["l"])), 1, reasons).alias("reasons"))


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """(keys, name): the mean by weight, the plain one where all weights are zero."""
    w = F.greatest(F.lit(0.0), F.col(weight))
    return df.groupBy(*keys).agg(F.when(F.sum(w) > 0, F.sum(F.col(value) * w) / F.sum(w)).otherwise(F.avg(value)).alias(name))


def track_stats(points: DataFrame, keys: Sequence[str], order: str, lat: str, lon: str, height: str) -> DataFrame:
    """(keys, meters, box, low, high, points) of tracks."""
    from ..functions.space import haversine_km

    w = Window.partitionBy(*keys).orderBy(order)
    step = haversine_km(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon)) * 1000
    return points.withColumn("__step", step).groupBy(*keys).agg(F.coalesce(F.sum("__step"), F.lit(0.0)).alias("meters"), F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"), F.min(height).alias("low"), F.max(height).alias("high"), F.count(F.lit(1)).alias("points"))


def nearest_places(points: DataFrame, places: DataFrame, key: str, limit_km: float = 30.0, degrees: float = 0.5) -> DataFrame:
    """points with the nearest place (p_id, p_lat, p_lon) within limit_km, null where there is none; ties by id.

    Both are dealt to cells of `degrees`; a point looks into the cells that its radius reaches (more of them near the
    poles, where a cell is narrow), so there is no cross join. limit_km must be below the height of a cell. Longitudes
    wrap around.
    """
    from ..functions.space import haversine_km

    if limit_km > degrees * 110.0:
        raise ValueError("limit_km reaches beyond the next cell")
    row = lambda lat: F.floor((lat + 90) / degrees)
    across = int(360 / degrees)
    # How many cells to each side the radius reaches at this latitude; all of them at a pole.
    reach = F.least(F.lit(across // 2), F.ceil(limit_km / (110.0 * degrees * F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.9), F.abs("lat") + degrees))))))).cast("int")
    sides = F.sequence(-reach, reach)
    cells = F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.transform(sides, lambda s: F.struct((row(F.col("lat")) + d).alias("__r"), F.pmod(F.floor((F.col("lon") + 180) / degrees) + s, F.lit(across)).alias("__c")))))
    near = points.select(key, "lat", "lon", F.inline(F.array_distinct(cells)))
    dealt = places.withColumns({"__r": row(F.col("p_lat")), "__c": F.pmod(F.floor((F.col("p_lon") + 180) / degrees), F.lit(across))})
    met = near.join(dealt, ["__r", "__c"]).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))).where(F.col("km") <= limit_km)
    best = met.groupBy(key).agg(F.min(F.struct(F.round("km", 9).alias("km"), "p_id")).alias("best"))
    return points.join(best, key, "left").select(*points.columns, F.col("best.p_id").alias("p_id"), F.col("best.km").alias("km"))


def competition(df: DataFrame, score: str, tolerance: float, name: str = "place") -> DataFrame:
    """df with places from 1: rows within `tolerance` of the best row of their place share it, and as many places are left out.

    A row opens a place if the gap to the row before is larger than the tolerance. The order is one sort of a score board.
    """
    w = Window.orderBy(F.desc(score))
    gap = F.lag(score).over(w) - F.col(score)
    marked = df.withColumn("__i", F.row_number().over(w)).withColumn("__new", F.when(gap.isNull() | (gap > tolerance), F.col("__i")))
    return marked.withColumn(name, F.last("__new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__i", "__new")


def main_flags(df: DataFrame, frame: str, flagged: str, area: str, score: str) -> DataFrame:
    """df with `main`: the flagged boxes, in a crowd of them the large ones only; where none is flagged, the best by score."""
    w = Window.partitionBy(frame)
    n, largest = F.sum(F.col(flagged).cast("int")).over(w), F.max(F.when(F.col(flagged), F.col(area))).over(w)
    best = F.max(F.struct(score, area)).over(w)
    marked = df.withColumns({"__n": n, "__largest": largest, "__best": best})
    main = F.when(F.col("__n") == 0, F.struct(score, area) == F.col("__best")).otherwise(F.col(flagged) & ((F.col("__n") < MAIN_CROWD) | (F.col(area) >= MAIN_SHARE * F.col("__largest"))))
    return marked.withColumn("main", main).drop("__n", "__largest", "__best")


def smallest_container(faces: DataFrame, people: DataFrame, frame: str) -> DataFrame:
    """(frame, face, person): each face goes to the smallest box that holds its centre, people take the best scored face.

    faces: (frame, face, x, y, score); people: (frame, person, x1, y1, x2, y2). They meet by frame, a few boxes each.
    """
    met = faces.join(people, frame).where((F.col("x1") <= F.col("x")) & (F.col("x") <= F.col("x2")) & (F.col("y1") <= F.col("y")) & (F.col("y") <= F.col("y2")))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    own = met.groupBy(frame, "face", "score").agg(F.min_by("person", F.struct(area.alias("a"), "person")).alias("person"))
    return own.groupBy(frame, "person").agg(F.max_by("face", F.struct("score", -F.col("face"))).alias("face"))


def kept_boxes(df: DataFrame, frame: str, order: str, box: str, kind: str, least: float = 0.8) -> DataFrame:
    """Boxes that repeat no earlier kept one of their kind by `least` of overlap: one fold over a frame's few boxes."""
    from ..functions.space import iou

    item = df.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(kind).alias("k"), F.col(box).alias("b")))).alias("__all"))
    none = F.slice("__all", 1, 0)
    fresh = lambda kept, x: F.when(F.exists(kept, lambda y: (y["k"] == x["k"]) & (iou(y["b"], x["b"]) >= least)), kept).otherwise(F.array_append(kept, x))
    return item.select(frame, F.explode(F.aggregate("__all", none, fresh)).alias("x")).select(frame, F.col("x.o").alias(order), F.col("x.k").alias(kind), F.col("x.b").alias(box))


def merged_tags(parts: Sequence[DataFrame], keys: Sequence[str], tag: str, order: str, limit: int) -> DataFrame:
    """(keys, tag, source): tags of several sources, each once under the first source that has it, in order, at most `limit`."""
    every = parts[0].select(*keys, F.lit(0).alias("source"), tag, order)
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.select(*keys, F.lit(i).alias("source"), tag, order))
    normal = F.trim(F.regexp_replace(F.lower(F.replace(F.col(tag), F.lit("_"), F.lit(" "))), r"\s+", " "))
    first = every.withColumn(tag, normal).where(F.col(tag) != "").groupBy(*keys, tag).agg(F.min(F.struct("source", order)).alias("__first"))
    w = Window.partitionBy(*keys).orderBy("__first", tag)
    return first.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).select(*keys, tag, F.col("__first.source").alias("source"))


def citations(answer: Column, passages: int) -> Column:
    """struct(text, cited, dropped): citations of real passages written as [1][3], the others taken out.

    A citation is a bracket of numbers and ranges; ranges of less than ten are spelled out, of others only the ends count.
    """
    group = r"\[\s*(\d{1,3}(?:\s*(?:[,;]|[-–])\s*\d{1,3})*)\s*\]"
    pieces = F.regexp_extract_all(answer, F.lit(rf"(?s)([ \t]*{group}|(?:(?![ \t]*{group}).)+)"), 1)

    def numbers(p: Column) -> Column:
        each = F.regexp_extract_all(p, F.lit(r"(\d{1,3}\s*[-–]\s*\d{1,3}|\d{1,3})"), 1)

        def spelled(x: Column) -> Column:
            a, b = F.regexp_extract(x, r"^(\d+)", 1).cast("int"), F.regexp_extract(x, r"(\d+)$", 1).cast("int")
            return F.when(x.rlike(r"[-–]"), F.when((a <= b) & (b - a < 10), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a, b))).otherwise(F.array(a))

        return F.flatten(F.transform(each, spelled))

    def read(p: Column) -> Column:
        cite = p.rlike(rf"^[ \t]*{group}$")
        n = F.when(cite, numbers(p)).otherwise(F.array().cast("array<int>"))
        valid = F.array_distinct(F.filter(n, lambda x: (x >= 1) & (x <= passages)))
        space = F.when(p.rlike(r"^[ \t]"), " ").otherwise("")
        text = F.when(~cite, p).when(F.size(valid) == 0, "").otherwise(F.concat(space, F.array_join(F.transform(valid, lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))), "")))
        return F.struct(text.alias("text"), valid.alias("valid"), F.size(F.filter(n, lambda x: (x < 1) | (x > passages))).alias("dropped"))

    def whole(all_: Column) -> Column:
        text = F.array_join(F.transform(all_, lambda x: x["text"]), "")
        return F.struct(F.btrim(text).alias("text"), F.array_distinct(F.flatten(F.transform(all_, lambda x: x["valid"]))).alias("cited"), F.aggregate(all_, F.lit(0), lambda a, x: a + x["dropped"]).alias("dropped"))

    return F.get(F.transform(F.array(F.transform(pieces, read)), whole), F.lit(0))

"""Library listings and their joins: members of bins, folders, moved files, targets by kind, unions, merges, plans."""

from __future__ import annotations

import re

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
OTHER_SCRIPTS = "[Ѐ-ӿ֐-׿؀-ۿऀ-ॿ฀-๿぀-ヿ㐀-䶿一-鿿가-힯]"
CJK = "[⺀-⿟　-〿぀-ヿ㐀-䶿一-鿿가-힯豈-﫿＀-￯]"


def device(make: Column, model: Column) -> Column:
    """Make and model as one name, either of which may be absent."""
    return F.trim(F.concat_ws(" ", F.trim(F.coalesce(make, F.lit(""))), F.trim(F.coalesce(model, F.lit("")))))


def direct_child(path: Column, folder: Column) -> Column:
    """Does a path stand in the folder itself, not below it?"""
    prefix = F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"))
    return F.startswith(path, prefix) & (F.instr(F.substring(path, F.length(prefix) + 1, F.length(path)), "/") == 0) & (F.length(path) > F.length(prefix))


def reusable(status: Column, key: Column, retry: Column) -> Column:
    """May the result of a run be taken again: it ended well, has a key, and does not ask for another try."""
    return status.isin("done", "skipped") & (key != "") & ~F.coalesce(retry, F.lit(False))


def keep_line(text: Column, score: Column) -> Column:
    """Is a recognised line worth keeping: three letters or digits at 0.8, or two at 0.9; East Asian characters do not count."""
    n = F.length(F.regexp_replace(F.regexp_replace(text, CJK, ""), r"[^\p{L}\p{N}]", ""))
    return F.when(n >= 3, score >= 0.8).otherwise((n == 2) & (score >= 0.9))


def clean_line(text: Column) -> Column:
    """Without East Asian, control and format characters; white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, CJK, ""), r"(?U)[\p{Cc}\p{Cf}&&[^\s]]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def plausible(source: Column, answer: Column) -> Column:
    """A translation: not empty, not much longer than its source, no script that the source does not use."""
    return (F.trim(answer) != "") & (F.length(answer) <= 3 * F.length(source) + 40) & ~(answer.rlike(OTHER_SCRIPTS) & ~source.rlike(OTHER_SCRIPTS))


def or_all(df: DataFrame, keys: Sequence[str], ok: Column) -> DataFrame:
    """Rows that are ok, or all rows of a key where none is."""
    return df.withColumn("__ok", F.coalesce(ok, F.lit(False))).withColumn("__any", F.max("__ok").over(Window.partitionBy(*keys))).where(F.col("__ok") | ~F.col("__any")).drop("__ok", "__any")


def moved(seen: DataFrame, known: DataFrame, mark: str, key: str) -> DataFrame:
    """(seen rows, was, state): known: the path is there; moved: an offline row has its mark; new: neither.

    known: (key, mark, offline). A mark of several offline rows gives the least key. Both joins are equi joins.
    """
    here = known.select(F.col(key), F.lit(True).alias("__here"))
    gone = known.where("offline").groupBy(mark).agg(F.min(key).alias("was"))
    rows = seen.join(here, key, "left").join(gone, mark, "left")
    state = F.when(F.col("__here"), "known").when(F.col("was").isNotNull(), "moved").otherwise("new")
    return rows.withColumn("state", state).withColumn("was", F.when(F.col("state") == "moved", F.col("was"))).drop("__here")


def relink(lost: DataFrame, files: DataFrame, size: str, mark: str, key: str, file: str) -> DataFrame:
    """(key, file): lost rows meet files of the same size and mark; each row and each file at most once, least ones first."""
    # The i-th row of a mark takes the i-th file: greedy in order, without a pair for each two.
    rows = lost.select(key, size, mark).withColumn("__i", F.row_number().over(Window.partitionBy(size, mark).orderBy(key)))
    there = files.select(file, size, mark).withColumn("__i", F.row_number().over(Window.partitionBy(size, mark).orderBy(file)))
    return rows.join(there, [size, mark, "__i"]).select(key, file)


def cascade(wanted: DataFrame, library: DataFrame, ways: Sequence[tuple[str, Sequence[str]]], key: str, found: str) -> DataFrame:
    """(key, found, way): each row of wanted by the first way that matches exactly one row; `ambiguous` where the first way that
    matches anything matches several, `missing` where none does.

    ways: (name, columns that must be equal, nulls match nothing). Matches are counted on the library side first.
    """
    out = wanted
    for name, columns in ways:
        side = library.groupBy(*columns).agg(F.count(F.lit(1)).alias(f"__n_{name}"), F.min(found).alias(f"__f_{name}"))
        out = out.join(side, list(columns), "left")
    hit = lambda n: F.coalesce(F.col(f"__n_{n}"), F.lit(0))
    way, value = F.lit("missing"), F.lit(None)
    for name, _ in reversed(ways):
        way = F.when(hit(name) == 1, name).when(hit(name) > 1, "ambiguous").otherwise(way)
        value = F.when(hit(name) == 1, F.col(f"__f_{name}")).when(hit(name) > 1, F.lit(None)).otherwise(value)
    return out.select(key, value.alias(found), way.alias("way"))


def union_scope(a_all: Column, a: Column, b_all: Column, b: Column) -> Column:
    """struct(everything, names): the union of two scopes; everything absorbs names."""
    every = F.coalesce(a_all, F.lit(False)) | F.coalesce(b_all, F.lit(False))
    none = F.array().cast("array<string>")
    return F.struct(every.alias("everything"), F.when(every, none).otherwise(F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))).alias("names"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; nothing is like nothing."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def path_key(path: Column) -> Column:
    """Comparison form of a path: slashes, no doubled ones, no . and .. parts, no trailing one, lower case."""
    text = F.replace(F.btrim(F.trim(path), F.lit('"')), F.lit("\\"), F.lit("/"))
    text = F.regexp_replace(F.regexp_replace(text, "(?i)^//[?]/unc/", "//"), "^//[?.]/", "")
    lead = F.when(F.startswith(text, F.lit("//")), "//").when(F.startswith(text, F.lit("/")), "/").otherwise("")
    parts = F.filter(F.split(text, "/"), lambda p: (p != "") & (p != "."))
    up = lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p))
    return F.lower(F.concat(lead, F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")))


def next_version(wanted: DataFrame, existing: DataFrame, name: str, mark: str, untitled: str) -> DataFrame:
    """(name, versioned): the name with one more than the highest version that exists of it.

    Versions end in ` - <mark> v<number>`; a name that is nothing else is called `untitled`.
    """
    ending = rf"^(.*?)\s*-\s*{re.escape(mark)} v(\d+)\s*$"
    base = lambda c: F.when(c.rlike(ending), F.trim(F.regexp_extract(c, ending, 1))).otherwise(F.trim(c))
    last = existing.where(F.col(name).rlike(ending)).groupBy(base(F.col(name)).alias("__base")).agg(F.max(F.regexp_extract(name, ending, 2).cast("long")).alias("__n"))
    return wanted.withColumn("__base", base(F.col(name))).join(last, "__base", "left").select(name, F.concat(F.when(F.col("__base") == "", untitled).otherwise(F.col("__base")), F.lit(f" - {mark} v"), (F.coalesce("__n", F.lit(0)) + 1).cast("string")).alias("versioned"))


def clean_fixed(c: Column) -> Column:
    """Text without controls, bidirectional formats and markup; markup that is made up by taking out other markup goes, too.

    A tag holds no angle bracket, so a text of n opening brackets is fixed after n rounds at most; rounds stop changing
    the text once no tag is left.
    """
    bare = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]|[​-‏‪-‮⁦-⁩]", "")
    tag = r"</?[A-Za-z][^<>]*>"
    once = lambda t: F.regexp_replace(t, tag, "")
    opened = F.length(bare) - F.length(F.replace(bare, F.lit("<"), F.lit("")))
    fixed = F.aggregate(F.sequence(F.lit(1), F.greatest(opened, F.lit(1))), once(bare), lambda t, _: F.when(t.rlike(tag), once(t)).otherwise(t))
    return F.trim(F.regexp_replace(fixed, r"[ \t\r\n]+", " "))


def closure(edges: DataFrame, a: str, b: str, write, most: int = 64) -> DataFrame:  # noqa: ANN001
    """(a, b): every pair that a path of edges joins; cycles end since a round adds new pairs only.

    Paths double each round, so a chain of n edges takes about log2(n) rounds. write(df) cuts the lineage of a round.
    """
    pairs = write(edges.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    for _ in range(most):
        step = pairs.select(a, F.col(b).alias("__m")).join(pairs.select(F.col(a).alias("__m"), b), "__m").select(a, b)
        more = write(step.distinct().join(pairs, [a, b], "left_anti"))
        if more.isEmpty():
            return pairs
        pairs = write(pairs.unionByName(more))
    raise ValueError(f"no fixed point in {most} rounds")


def merged_requests(df: DataFrame, target: str, order: str) -> DataFrame:
    """(target, everything, names, focus, requests): requests (target, order, everything, names, focus) queued for one target as one."""
    newest = F.max_by("focus", F.struct(order, "focus"))
    return df.groupBy(target).agg(F.bool_or("everything").alias("everything"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), newest.alias("focus"), F.count(F.lit(1)).alias("requests")).withColumn("names", F.when(F.col("everything"), F.array().cast("array<string>")).otherwise(F.col("names")))


def gaps(plan: DataFrame, runs: DataFrame, video: str, stage: str) -> DataFrame:
    """(video, missing, outdated, skipped): stages of the plan (stage, version) without a run, with an older one, or left out.

    runs: (video, stage, version, status), the latest of each. The plan is a few rows, repeated for each video.
    """
    every = runs.select(video).distinct().withColumn("__plan", F.lit(1)).join(F.broadcast(plan.withColumn("__plan", F.lit(1)).withColumnRenamed("version", "__wanted")), "__plan")
    state = F.when(F.col("status").isNull(), "missing").when(F.col("status") == "skipped", "skipped").when(F.col("version") < F.col("__wanted"), "outdated")
    marked = every.join(runs, [video, stage], "left").withColumn("state", state)
    return marked.groupBy(video).agg(*[F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col(stage)))).alias(s) for s in ("missing", "outdated", "skipped")])

"""Files that appear below a folder, as a stream: each is found once, whatever happens between two runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def discovered(spark: SparkSession, root: str, extensions: Sequence[str], excluded: Sequence[str] = (), files: int = 1000) -> DataFrame:
    """(path, modified, length) of new files below root, `files` a batch at most; run it with run_once() as often as wanted.

    Contents are not read. Hidden files and folders, empty files and paths that match a pattern of `excluded` are left out;
    extensions count without regard to case.
    """
    found = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).load(root)
    kept = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]) & ~F.col("path").rlike(r"/\.[^/]+") & (F.col("length") > 0)
    for pattern in excluded:
        kept = kept & ~F.col("path").rlike(pattern)
    return found.where(kept).select("path", F.col("modificationTime").alias("modified"), "length")


def new_roots(files: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """(root, files): the files of a batch by the deepest of the known roots (root) that holds them, and how many; files outside all are left out."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    met = files.select(path, F.explode(prefixes).alias(root)).join(roots.select(root).distinct(), root)
    deepest = met.groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return deepest.groupBy(root).agg(F.count(F.lit(1)).alias("files"))

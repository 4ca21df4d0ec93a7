"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

_lent: list[list[str]] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    for paths in _lent:
        paths.append(path)
    return path


def delete(spark: SparkSession, paths: Sequence[str]) -> None:
    """Deletes folders of the shared store."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def lent(spark: SparkSession) -> Iterator[list[str]]:
    """The list of the paths that scratch_path() gives meanwhile; at the end those that are in it still are deleted.

    For code that has written its result: what reads a deleted path afterwards fails.
    """
    paths: list[str] = []
    _lent.append(paths)
    try:
        yield paths
    finally:
        _lent.remove(paths)
        delete(spark, paths)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: ends the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def seeded(seed: int, *cols: Column | str) -> Column:
    """A 64-bit hash that differs by seed."""
    return F.xxhash64(F.lit(seed), *cols)


def unit(h: Column) -> Column:
    """A 64-bit hash as a double in [0, 1)."""
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashable(df: DataFrame) -> list[Column]:
    """All columns in a form that xxhash64 takes; names may hold dots."""
    return [F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else c for name, kind in df.dtypes for c in [F.col(f"`{name.replace('`', '``')}`")]]

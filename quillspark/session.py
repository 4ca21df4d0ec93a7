"""Sessions, and how the package reaches Python workers."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and local runs; on a cluster, take the session that spark-submit gives."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillspark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed but lies at the same path.

    Needed only where PYTHONPATH or --py-files do not name it.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


_local: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the folder that all executors share (spark.checkpoint.dir); a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _local.get(app) or tempfile.mkdtemp(prefix="spark-shared-")
        _local[app] = found
    return f"{found.rstrip('/')}/{name}"

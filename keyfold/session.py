"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# What the operators rely on. AQE sizes the reduce side from real shuffle
# statistics and splits skewed join partitions, so no partition count is
# written into any operator.
SETTINGS = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # call-site capture for error messages; it doubles the time to build a plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = 8, app: str = "keyfold", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SETTINGS,
        "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": str(cores if str(cores).isdigit() else 8),
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder path under the shared folder the session names.

    ``spark.checkpoint.dir`` is used when set. Only a local master may fall back
    to a temporary folder: on a cluster executors could not see it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    name = f"{purpose}-{uuid.uuid4().hex}"
    if shared:
        return os.path.join(shared, "keyfold", name)
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return os.path.join(tempfile.mkdtemp(prefix="keyfold-"), name)

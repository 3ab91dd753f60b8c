"""Session settings the library is written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime settings, valid for any session.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles methods above 8000 bytes, and cleaning a wide table in one
    # generated method runs interpreted. Above the limit Spark splits the projection.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A stored board page holds hundreds of items: a batch of 4096 pages, decoded at once, is
    # some GB. Tables without nested columns are still read in batches.
    "spark.sql.parquet.enableNestedColumnVectorizedReader": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that someone else has built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """Single-machine session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("bizmetrics")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's checkpoint folder.

    Only where none is set (by ``spark.checkpoint.dir`` or on the context) and the master is
    local, a fresh temporary folder is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="bizmetrics-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder

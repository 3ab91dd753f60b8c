"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizmetrics.session import shared_folder

# Rows per Arrow batch: texts are a few KB, so that a batch stays at a few MB.
BATCH_ROWS = "256"
# Bytes, for rows that hold more: both sides keep a batch at a time.
BATCH_BYTES = "8m"
PART = 1 << 20  # bytes of a stored table of links or roots that a task takes
LONG = 1.0  # seconds of a job whose shuffle files are worth a look
# Shuffle files go when the execution that wrote them ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Batch size, and this package on the executors' path (once an application)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if spark.sparkContext.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "bizmetrics-package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(spark.sparkContext.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, listed for ``taken``."""
    path = f"{shared_folder(spark)}/llm-scratch/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema, started = df.schema, time.monotonic()
    with once(spark):
        df.write.option("compression", "zstd").parquet(path)
    if time.monotonic() - started > LONG:
        release(spark)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def once(spark: SparkSession) -> Iterator[None]:
    """What is planned and executed within leaves no shuffle files behind. Not for a
    ``DataFrame`` that a caller gets: it may be executed twice."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def size(table: DataFrame) -> int:
    """Bytes of a stored table."""
    spark, path = table.sparkSession, _folder(table)
    if not path:
        return 0
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def narrowed(df: DataFrame, data: int) -> DataFrame:
    """``df`` in as many partitions as ``data`` bytes are worth, one a core at least: a small
    table that goes through many rounds is a few files then, whatever the session's number of
    shuffle partitions is."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, data // PART + 1))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over. It does when their plans are
    garbage, which a driver with memory to spare does not look for."""
    spark.sparkContext._jvm.System.gc()


def mark() -> int:
    """How many scratch paths there are: for ``taken``."""
    return len(_written)


def taken(since: int) -> list[str]:
    """The scratch paths made since ``mark``; whoever takes them deletes them."""
    own = _written[since:]
    del _written[since:]
    return own


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        path = _folder(table)
        if path:
            delete(table.sparkSession, [path])


def _folder(table: DataFrame) -> str | None:
    files = table.inputFiles()
    return os.path.dirname(files[0]) if files else None


def delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = hadoop(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A stored copy with a unique ``rid``: unlike the id column, never null or repeated."""
    return store(df.withColumn("rid", F.monotonically_increasing_id()), name)

"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A table written there outlives any executor, and reading it back cuts the
lineage, so a stage that is costly (a Python pass over the corpus) is never
computed twice.  Superseded tables of an iteration are removed.
"""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wardlens.session import ensure_checkpoint_dir, ship_package

#: The most bytes of a table that is broadcast; a larger one goes by a shuffle.
BROADCAST_BYTES = 32 << 20


#: Whether Spark removes the shuffle files of a finished query instead of leaving them to the driver's garbage collection.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows and bytes of one Arrow batch, lest a batch of long texts fill an executor.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def ready(spark: SparkSession) -> None:
    """What the operators need of a session: the shared folder, this package on the executors, bounded Arrow batches."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _released(spark: SparkSession):
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back; the write's shuffle files go as soon as it is done."""
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    with _released(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


class Buckets:
    """A table in the shared folder that is written part by part, in buckets by a column, so that a join by it need not shuffle the table."""

    def __init__(self, spark: SparkSession, name: str, key: str, n: int):
        self.spark, self.key, self.n = spark, key, n
        self.path = scratch_path(spark, name)
        self.name = self.path.rsplit("/", 1)[1].replace("-", "_")

    def add(self, df: DataFrame) -> None:
        with _released(self.spark):
            df.write.mode("append").format("parquet").bucketBy(self.n, self.key).option("path", self.path).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def discard(self) -> None:
        self.spark.sql(f"drop table {self.name}")
        _remove(self.spark, self.path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Remove a table made by ``stored`` that nothing will read again."""
    path = getattr(df, "_stored_at", None)
    if path is None:
        return
    _remove(df.sparkSession, path)


def give_back() -> None:
    """Return to the system what a task's Python has freed.  A worker is kept for later tasks, and what it holds counts against its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table of rows of about ``row_bytes`` may be broadcast."""
    return df.count() * row_bytes <= limit

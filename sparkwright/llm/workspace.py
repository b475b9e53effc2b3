"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table and reading it back: the files survive the loss of any executor, columns can be
pruned, and a later join of two such tables has an exchange on both sides, which adaptive execution can split on skew.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few fixed-width columns is broadcast (some tens of MB); beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of an Arrow batch that is sent to a Python worker.
BATCH_BYTES = "8m"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = getattr(spark, "_sparkwright_dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark._sparkwright_dir = "file://" + tempfile.mkdtemp(prefix="sparkwright-")
    return path.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_sparkwright_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="sparkwright-code-")) / "sparkwright_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._sparkwright_shipped = True


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run):
    """A function of Arrow batches that gives freed memory back to the system when its task ends: Spark keeps Python
    workers for later tasks, and several may be idle at once."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = BATCH_BYTES):
    """For actions inside: Arrow batches of at most so many bytes, so that long texts don't fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Workspace:
    """A folder of intermediate tables; deleted by ``drop`` or when the driver's process ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        ship(spark)
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def file(self, name: str) -> str:
        return f"{self.path}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table once and read it back with its known schema."""
        path = self.file(name)
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, name: str) -> None:
        self._delete(self.file(name))

    def drop(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # noqa: BLE001  the session may be gone already when the process ends
            pass

    def _delete(self, path: str) -> None:
        jvm, jsc = self.spark._jvm, self.spark._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a broadcast hint if it has at most so many rows, else as it is: Spark then joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_n(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in the given order (a bounded training sample)."""
    return df.orderBy(*order).limit(n)

"""Intermediate tables in the folder that driver and executors share, and broadcasts of a checked size."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table is broadcast (some tens of MB); beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session's own under ``spark.checkpoint.dir``; a temporary one only where that is unset and the
    master is local. It is deleted when the driver's process ends."""
    path = getattr(spark, "_sparkwright_folder", None)
    if path:
        return path
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparkwright-")
    path = spark._sparkwright_folder = f"{path.rstrip('/')}/library-{uuid.uuid4().hex}"

    def drop() -> None:
        with contextlib.suppress(Exception):  # the session may be gone already
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    atexit.register(drop)
    return path


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_sparkwright_library_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sparkwright-code-")) / "sparkwright_library.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._sparkwright_library_shipped = True


def new_path(spark: SparkSession, label: str) -> str:
    """A path that no other run writes to."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Write a table once and read it back: the lineage is cut, and the files survive lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the table has at most so many rows, else the table as it is: Spark then joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

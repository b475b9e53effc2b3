"""Structured Streaming forms of the incremental operators: windows with a watermark, online moments, stateful folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.storage import new_path


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A file source over Parquet events; the schema is read once from the files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count and sum per event type and (tumbling or sliding) event-time window; rows later than ``late`` are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(stream: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    rows = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def running_moments(stream: DataFrame) -> DataFrame:
    """Mergeable moments per event type, updated with every batch."""
    return stream.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))


def distinct_events(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """First arrival of every event id within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drain_cusum(stream: DataFrame, target: float, slack: float, checkpoint: str | None = None) -> DataFrame:
    """(user_id, event_id, cusum) of all that is there now: a per-key fold s = max(0, s + x - target - slack), one row per
    event. Rows of a batch are folded in the order of ts and event_id, nulls last, batches in the order they come; a null
    value leaves s as it is. The state, one number per key, is a table beside the batch's rows: s is the running sum less
    its lowest value below zero, so windows of the engine, which spill, do the fold."""
    folder = checkpoint or new_path(stream.sparkSession, "cusum")

    def step(batch: DataFrame, number: int) -> None:
        spark, kind = batch.sparkSession, dict(batch.dtypes)["user_id"]
        rows = batch.select("user_id", "event_id", "ts", (F.col("value") - (target + slack)).alias("x"))
        old = spark.read.schema(f"key {kind}, s double").parquet(f"{folder}/state/{number - 1}") if number else spark.createDataFrame([], f"key {kind}, s double")
        rows = rows.join(old, F.col("user_id").eqNullSafe(F.col("key")), "left") if number else rows.withColumn("s", F.lit(None).cast("double"))
        order = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
        run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        gain = F.sum("x").over(run)
        total = rows.select("user_id", "event_id", "ts", F.coalesce(F.col("s") + F.coalesce(gain, F.lit(0.0)), gain).alias("total"))
        folded = total.select("user_id", "event_id", (F.col("total") - F.least(F.min("total").over(run), F.lit(0.0))).alias("cusum"), F.lead(F.lit(True)).over(order).isNull().alias("last"))
        folded.write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        ends = spark.read.schema(folded.schema).parquet(f"{folder}/rows/{number}").where("last and cusum is not null").select(F.col("user_id").alias("key"), F.col("cusum").alias("s"))
        kept = old.alias("o").join(ends.select(F.col("key").alias("end")), F.col("key").eqNullSafe(F.col("end")), "left_anti")
        ends.unionByName(kept).write.mode("overwrite").parquet(f"{folder}/state/{number}")

    return _each_batch(stream, "append", folder, step).select("user_id", "event_id", "cusum")


def drain_distinct(stream: DataFrame, key: str, checkpoint: str | None = None) -> DataFrame:
    """(key) once for each of its values in all that is there now, however far apart they come; nulls are left out. Each
    batch adds the values that no batch before it had; they are tables, so neither state nor driver holds them."""
    folder = checkpoint or new_path(stream.sparkSession, "distinct")

    def step(batch: DataFrame, number: int) -> None:
        new = batch.select(key).where(F.col(key).isNotNull()).distinct()
        if number:
            seen = batch.sparkSession.read.schema(new.schema).parquet(*(f"{folder}/rows/{k}" for k in range(number)))
            new = new.join(seen, key, "left_anti")
        new.write.mode("overwrite").parquet(f"{folder}/rows/{number}")

    return _each_batch(stream, "append", folder, step)


def _each_batch(stream: DataFrame, mode: str, folder: str, step: Callable[[DataFrame, int], None]) -> DataFrame:
    """Run a stream over all that is there now by a step that writes each batch to rows/<number> in the folder, which
    also holds the checkpoint, and return all rows. A repeated batch overwrites its rows."""
    query = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/rows/*")


def drain(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there now, into files that driver and executors share, and return the final table.
    In complete mode a batch replaces the rows of the one before."""
    folder = checkpoint or new_path(stream.sparkSession, "drained")

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{0 if mode == 'complete' else number}")

    return _each_batch(stream, mode, folder, step)

"""File sources and sinks of one interface, grids and ranges, and seeded synthetic tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators.tests import keyed_uniform

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table from files. CSV and JSON need a schema: inferring one reads the data twice."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format}")
    if format in ("csv", "json") and schema is None:
        raise ValueError(f"{format} files need a schema")
    reader = spark.read.format(format).options(**options)
    if format == "csv":
        reader = reader.option("header", options.get("header", "true"))
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite", **options: str) -> None:
    writer = df.write.format(format).mode(mode).options(**options)
    if format == "csv":
        writer = writer.option("header", options.get("header", "true"))
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def linspace(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """(i, x): n points with both ends; the last is exactly ``high``."""
    step = (high - low) / max(n - 1, 1)
    return spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") == n - 1, F.lit(float(high if n > 1 else low))).otherwise(low + F.col("id") * step).alias("x"))


def logspace(spark: SparkSession, low: float, high: float, n: int, base: float = 10.0) -> DataFrame:
    return linspace(spark, low, high, n).select("i", F.pow(F.lit(base), F.col("x")).alias("x"))


def arange(spark: SparkSession, start: float, stop: float, step: float) -> DataFrame:
    n = max(0, math.ceil((stop - start) / step))
    return spark.range(n).select(F.col("id").alias("i"), (start + F.col("id") * step).alias("x"))


def meshgrid(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """(i, j) of a grid from one range, so no join is needed."""
    return spark.range(nx * ny).select(F.floor(F.col("id") / ny).alias("i"), (F.col("id") % ny).alias("j"))


def normal(key: Column, seed: int) -> Column:
    """Standard normal by Box and Muller from two keyed uniforms."""
    u = F.greatest(keyed_uniform(key, seed), F.lit(2.0**-53))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * keyed_uniform(key, seed + 1))


def blobs(spark: SparkSession, n: int, centres: list[list[float]], spread: float, seed: int = 0) -> DataFrame:
    """(id, label, x...): points around stated centres; row i is the same in any partitioning."""
    k = len(centres)
    label = (F.col("id") % k).cast("int")
    rows = spark.range(n).select("id", label.alias("label"))
    at = [F.element_at(F.array(*(F.lit(float(c[j])) for c in centres)), F.col("label") + 1) + spread * normal(F.col("id") * 31 + j, seed + 2 * j) for j in range(len(centres[0]))]
    return rows.select("id", "label", *(x.alias(f"x{j}") for j, x in enumerate(at)))


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement with chances by weight: the smallest of -ln(u) / w (exponential races)."""
    race = -F.log(F.greatest(keyed_uniform(F.col(key), seed), F.lit(2.0**-53))) / F.col(weight)
    return df.where(F.col(weight) > 0).withColumn("_race", race).orderBy("_race", key).limit(n).drop("_race")


def permutation(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in a random order that depends on keys and seed only."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key)

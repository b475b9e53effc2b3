"""Queries that run as streams over the ``events`` file; their SQL states the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.registry import REGISTRY
from sparkwright.streaming import events as S


def _events(spark: SparkSession, d: str) -> DataFrame:
    return S.event_stream(spark, f"{d}/events.parquet")


@REGISTRY.add("stream_windows", "2.9", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    got = S.drain(S.windowed_counts(_events(spark, d)), "complete")
    return got.select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@REGISTRY.add("stream_moments", "2.9", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events GROUP BY 1")
def stream_moments(spark: SparkSession, d: str) -> DataFrame:
    got = S.drain(S.running_moments(_events(spark, d)), "complete")
    return got.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@REGISTRY.add(
    "stream_cusum",
    "2.9",
    """WITH s AS (SELECT user_id, event_id, ts, sum(value - 60) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)
    SELECT user_id, event_id, round(s - least(min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0), 4) AS cusum FROM s""",
)
def stream_cusum(spark: SparkSession, d: str) -> DataFrame:
    got = S.drain_cusum(_events(spark, d), 55.0, 5.0)
    return got.select("user_id", "event_id", F.round("cusum", 4).alias("cusum"))


@REGISTRY.add("stream_distinct", "2.9", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    return S.drain_distinct(_events(spark, d), "event_id").agg(F.count("*").alias("n"))

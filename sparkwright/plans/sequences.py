"""Queries of ordered operators over ``events``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.operators import sequences as Q
from sparkwright.plans.stats import rounded
from sparkwright.registry import REGISTRY
from sparkwright.session import table

#: Orders per day, with a gap-free index.
_DAYS = """d AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY 1), t AS (SELECT day, date_diff('day', DATE '1992-01-01', day) AS i, x FROM d)"""


def _days(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("x"))
    return days.select("day", F.datediff("day", F.lit("1992-01-01").cast("date")).cast("long").alias("i"), "x")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", "ts", F.col("value").alias("x"))


@REGISTRY.add(
    "seq_running",
    "2.5",
    "SELECT user_id, event_id, value AS x, count(*) OVER w AS n, round(avg(value) OVER w + 1e-9, 6) AS mean, round(var_pop(value) OVER w + 1e-9, 4) AS variance, min(value) OVER w AS low, max(value) OVER w AS high, round(sum(value) OVER w, 4) AS cumsum FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
)
def seq_running(spark: SparkSession, d: str) -> DataFrame:
    r = Q.running(_events(spark, d), ["user_id"], ["ts", "event_id"], "x").drop("ts")
    return r.withColumns({"mean": F.round(F.col("mean") + 1e-9, 6), "variance": F.round(F.col("variance") + 1e-9, 4), "cumsum": F.round("cumsum", 4)})


@REGISTRY.add(
    "seq_sliding",
    "2.5",
    "WITH s AS (SELECT user_id, event_id, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT user_id, event_id, round(mean, 5) AS mean, round(std, 4) AS std FROM s WHERE n = 5",
)
def seq_sliding(spark: SparkSession, d: str) -> DataFrame:
    r = Q.sliding(_events(spark, d), ["user_id"], ["ts", "event_id"], "x", 5)
    return r.select("user_id", "event_id", F.round("mean", 5).alias("mean"), F.round("std", 4).alias("std"))


@REGISTRY.add(
    "seq_difference",
    "2.5",
    "WITH s AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS difference FROM events) SELECT user_id, event_id, round(difference, 6) AS difference FROM s WHERE difference IS NOT NULL",
)
def seq_difference(spark: SparkSession, d: str) -> DataFrame:
    return Q.difference(_events(spark, d), ["user_id"], ["ts", "event_id"], "x").select("user_id", "event_id", F.round("difference", 6).alias("difference"))


@REGISTRY.add(
    "seq_acf",
    "2.5",
    f"""WITH {_DAYS}, c AS (SELECT row_number() OVER (ORDER BY i) AS k, x - avg(x) OVER () AS c FROM t), s AS (SELECT CAST(l AS INTEGER) AS lag, (SELECT sum(a.c * b.c) FROM c a JOIN c b ON b.k = a.k + l) AS s FROM (SELECT unnest(range(0, 8)) AS l)), v AS (SELECT sum(c * c) AS s0, count(*) AS n FROM c)
    SELECT 'all' AS series, lag, round(s / n, 6) AS autocovariance, round(s / s0, 6) AS autocorrelation FROM s, v""",
)
def seq_acf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.autocorrelation(_days(spark, d).withColumn("series", F.lit("all")), ["series"], ["i"], "x", 7))


@REGISTRY.add(
    "seq_decompose",
    "2.5",
    """WITH h AS (SELECT event_type, CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) AS i, CAST(sum(value) AS DOUBLE) AS x FROM events GROUP BY 1, 2), g AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY i) - 1 AS i, x FROM h),
    t AS (SELECT event_type, i, x, i % 24 AS phase, CASE WHEN count(*) OVER w = 25 THEN (sum(x) OVER w - (lag(x, 12) OVER o + lead(x, 12) OVER o) / 2) / 24 END AS trend FROM g WINDOW o AS (PARTITION BY event_type ORDER BY i), w AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
    s AS (SELECT event_type, phase, avg(x - trend) AS raw FROM t WHERE trend IS NOT NULL GROUP BY 1, 2), c AS (SELECT *, raw - avg(raw) OVER (PARTITION BY event_type) AS seasonal FROM s)
    SELECT t.event_type, t.i, round(x, 4) AS x, round(trend + 1e-8, 4) AS trend, round(seasonal + 1e-8, 4) AS seasonal, round(x - trend - seasonal + 1e-8, 4) AS remainder FROM t LEFT JOIN c USING (event_type, phase)""",
)
def seq_decompose(spark: SparkSession, d: str) -> DataFrame:
    hours = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.sum("value").alias("x"))
    indexed = hours.select("event_type", (F.row_number().over(Window.partitionBy("event_type").orderBy("h")) - 1).cast("long").alias("i"), "x")
    r = Q.decompose(indexed, ["event_type"], "i", "x", 24)
    return r.select("event_type", "i", F.round("x", 4).alias("x"), *(F.round(F.col(c) + 1e-8, 4).alias(c) for c in ("trend", "seasonal", "remainder")))


_SURVIVAL = "s AS (SELECT o_orderpriority, greatest(date_diff('day', CAST(o_orderdate AS DATE), CAST(min(l_shipdate) AS DATE)), 0) AS days, CAST(min(l_linestatus) = 'F' AS INTEGER) AS event FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate)"


@REGISTRY.add(
    "surv_kaplan_meier",
    "2.5",
    f"""WITH {_SURVIVAL}, c AS (SELECT o_orderpriority, days, sum(event) AS d, count(*) AS c FROM s GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY o_orderpriority ORDER BY days DESC) AS n FROM c)
    SELECT o_orderpriority, days, CAST(n AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS d, round(CASE WHEN max(CAST(n = d AS INTEGER)) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN n > d THEN ln((n - d) / CAST(n AS DOUBLE)) ELSE 0 END) OVER w) END, 6) AS survival, round(sum(d / CAST(n AS DOUBLE)) OVER w, 6) AS hazard FROM r WHERE d > 0 WINDOW w AS (PARTITION BY o_orderpriority ORDER BY days)""",
)
def surv_kaplan_meier(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"), F.min("l_linestatus").alias("status"))
    s = table(spark, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    s = s.select("o_orderpriority", F.greatest(F.datediff("ship", "o_orderdate"), F.lit(0)).cast("long").alias("days"), (F.col("status") == "F").cast("int").alias("event"))
    return rounded(Q.kaplan_meier(s, ["o_orderpriority"], "days", "event"))


@REGISTRY.add(
    "test_adjusted_p",
    "2.5",
    """WITH p AS (SELECT l_returnflag, extract(year FROM l_shipdate) * 100 + extract(month FROM l_shipdate) AS k, round(1 / (1 + avg(l_quantity)), 6) AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY p, k) AS r, count(*) OVER (PARTITION BY l_returnflag) AS m FROM p)
    SELECT l_returnflag, p, round(least(min(p * m / r) OVER u, 1), 6) AS bh, round(least(max(p * (m - r + 1)) OVER w, 1), 6) AS holm, round(least(min(p * (m - r + 1)) OVER u, 1), 6) AS hochberg, round(least(p * m, 1), 6) AS bonferroni, round(least(min(p * m / r) OVER u * h, 1), 6) AS "by"
    FROM (SELECT *, sum(1.0::DOUBLE / r) OVER (PARTITION BY l_returnflag) AS h FROM r) AS r WINDOW u AS (PARTITION BY l_returnflag ORDER BY r DESC ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY l_returnflag ORDER BY r ROWS UNBOUNDED PRECEDING)""",
)
def test_adjusted_p(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy("l_returnflag", F.date_format("l_shipdate", "yyyyMM").alias("k")).agg(F.round(1 / (1 + F.avg("l_quantity")), 6).alias("p"))
    return rounded(Q.adjusted_p(p.drop("k"), ["l_returnflag"], "p"))


@REGISTRY.add(
    "seq_cusum",
    "2.9",
    """WITH m AS (SELECT avg(value) AS t FROM events), s AS (SELECT user_id, event_id, ts, sum(value - t - 5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events, m)
    SELECT user_id, event_id, round(s - least(min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0), 4) AS cusum FROM s""",
)
def seq_cusum(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    e = e.crossJoin(F.broadcast(e.agg(F.avg("x").alias("t"))))
    return Q.cusum(e, ["user_id"], ["ts", "event_id"], "x", "t", 5.0).select("user_id", "event_id", F.round("cusum", 4).alias("cusum"))


@REGISTRY.add(
    "seq_sessions",
    "2.9",
    """WITH c AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('microsecond', lag(ts) OVER w, ts) > 3600000000 THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM c) SELECT user_id, CAST(session AS BIGINT) AS session, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS "end", count(*) AS n FROM s GROUP BY 1, 2""",
)
def seq_sessions(spark: SparkSession, d: str) -> DataFrame:
    return Q.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 3600).select("user_id", "session", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")

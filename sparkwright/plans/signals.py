"""Queries of filters, correlations, tails and profiles of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import signals as S
from sparkwright.plans.sequences import _DAYS, _days
from sparkwright.plans.stats import rounded
from sparkwright.registry import REGISTRY
from sparkwright.session import table

_WEEKS = "w AS (SELECT o_orderpriority AS p, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) // 7 AS i, CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY 1, 2), n AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY i) - 1 AS i, x FROM w)"


def _weeks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))
    w = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.floor(day / 7).alias("week")).agg(F.count("*").cast("double").alias("x"))
    return w.select("p", (F.row_number().over(Window.partitionBy("p").orderBy("week")) - 1).cast("long").alias("i"), "x")


@REGISTRY.add(
    "series_savgol",
    "2.5",
    f"WITH {_WEEKS}, s AS (SELECT p, i, x, (-3 * lag(x, 2) OVER o + 12 * lag(x) OVER o + 17 * x + 12 * lead(x) OVER o - 3 * lead(x, 2) OVER o) / 35 AS s FROM n WINDOW o AS (PARTITION BY p ORDER BY i)) SELECT p, i, round(s, 5) AS smooth FROM s WHERE s IS NOT NULL",
)
def series_savgol(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.savgol(_weeks(spark, d), ["p"], "i", "x", 5, 2), 5)


@REGISTRY.add(
    "series_pacf",
    "2.5",
    f"""WITH {_DAYS}, c AS (SELECT row_number() OVER (ORDER BY i) AS k, x - avg(x) OVER () AS c FROM t), r AS (SELECT l, (SELECT sum(a.c * b.c) FROM c a JOIN c b ON b.k = a.k + l) / (SELECT sum(c * c) FROM c) AS r FROM (SELECT unnest(range(1, 4)) AS l)), p AS (SELECT max(r) FILTER (l = 1) AS a, max(r) FILTER (l = 2) AS b, max(r) FILTER (l = 3) AS c FROM r)
    SELECT 1 AS lag, round(a, 6) AS partial FROM p UNION ALL SELECT 2, round((b - a * a) / (1 - a * a), 6) FROM p UNION ALL SELECT 3, round((c - 2 * a * b + a * a * a - a * a * c + a * b * b) / (1 - 2 * a * a + 2 * a * a * b - b * b), 6) FROM p""",
)
def series_pacf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.partial_autocorrelation(_days(spark, d).withColumn("series", F.lit("all")), ["series"], ["i"], "x", 3).drop("series"))


@REGISTRY.add(
    "series_cross_correlation",
    "2.5",
    f"""WITH {_WEEKS}, b AS (SELECT a.i, a.x, z.x AS y FROM n a JOIN n z ON z.i = a.i AND a.p = '1-URGENT' AND z.p = '5-LOW'), c AS (SELECT i, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM b), l AS (SELECT unnest(range(-3, 4)) AS l)
    SELECT CAST(l AS INTEGER) AS lag, round((SELECT sum(u.x * v.y) FROM c u JOIN c v ON v.i = u.i + l) / sqrt((SELECT sum(x * x) FROM c) * (SELECT sum(y * y) FROM c)), 6) AS correlation FROM l""",
)
def series_cross_correlation(spark: SparkSession, d: str) -> DataFrame:
    w = _weeks(spark, d)
    both = w.where("p = '1-URGENT'").select("i", "x").join(w.where("p = '5-LOW'").select("i", F.col("x").alias("y")), "i")
    return rounded(S.cross_correlation(both, "i", "x", "y", 3))


@REGISTRY.add(
    "stats_mean_excess",
    "2.5",
    "WITH u AS (SELECT unnest([100000.0, 200000.0, 300000.0, 400000.0])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (o_totalprice > threshold) AS n, round(avg(o_totalprice - threshold) FILTER (o_totalprice > threshold), 4) AS mean_excess FROM orders, u GROUP BY 1",
)
def stats_mean_excess(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.mean_excess(table(spark, d, "orders"), "o_totalprice", [100000.0, 200000.0, 300000.0, 400000.0]), 4)


_PROFILE = f"""{_WEEKS}, v AS (SELECT p, i, list(x) OVER o AS l, avg(x) OVER o AS m, stddev_pop(x) OVER o AS s, count(*) OVER o AS c FROM n WINDOW o AS (PARTITION BY p ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)), z AS (SELECT p, i, list_transform(l, lambda e: CASE WHEN s > 0 THEN (e - m) / s ELSE 0 END) AS z FROM v WHERE c = 8),
    q AS (SELECT a.p, a.i, b.i AS j, round(sqrt(list_sum(list_transform(list_zip(a.z, b.z), lambda t: (t[1] - t[2]) * (t[1] - t[2])))), 6) AS distance FROM z a JOIN z b ON a.p = b.p AND abs(a.i - b.i) > 4), r AS (SELECT p, i, arg_min(j, (distance, j)) AS nearest, min(distance) AS distance FROM q GROUP BY 1, 2)"""


@REGISTRY.add("series_matrix_profile", "2.16", f"WITH {_PROFILE} SELECT p, i, distance FROM r")
def series_matrix_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.matrix_profile(_weeks(spark, d), "p", "i", "x", 8)).drop("nearest")


@REGISTRY.add("series_discords", "2.6", f"WITH {_PROFILE} SELECT p, max(distance) AS discord, min(distance) AS motif FROM r GROUP BY 1")
def series_discords(spark: SparkSession, d: str) -> DataFrame:
    """The distances of the oddest subsequence and of the closest pair of each series."""
    profile = rounded(S.matrix_profile(_weeks(spark, d), "p", "i", "x", 8))
    return profile.groupBy("p").agg(F.max("distance").alias("discord"), F.min("distance").alias("motif"))


@REGISTRY.add(
    "series_holt",
    "2.5",
    f"""WITH RECURSIVE {_WEEKS}, h(p, i, level, trend) AS (SELECT a.p, a.i, a.x, b.x - a.x FROM n a JOIN n b ON b.p = a.p AND a.i = 0 AND b.i = 1 UNION ALL SELECT n.p, n.i, 0.3::DOUBLE * n.x + 0.7::DOUBLE * (level + trend), 0.1::DOUBLE * (0.3::DOUBLE * n.x + 0.7::DOUBLE * (level + trend) - level) + 0.9::DOUBLE * trend FROM h JOIN n ON n.p = h.p AND n.i = h.i + 1) SELECT p, i, round(level, 5) AS level, round(trend, 5) AS trend FROM h""",
)
def series_holt(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.holt(_weeks(spark, d), ["p"], "i", "x", 0.3, 0.1), 5)


@REGISTRY.add(
    "series_lms",
    "2.9",
    f"""WITH RECURSIVE {_WEEKS}, s AS (SELECT p, i, x / 100 AS y, lag(x) OVER (PARTITION BY p ORDER BY i) / 100 AS a, lag(x, 2) OVER (PARTITION BY p ORDER BY i) / 100 AS b FROM n),
    f(p, i, w1, w2, error) AS (SELECT p, 1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM s WHERE i = 1 UNION ALL SELECT s.p, s.i, w1 + 0.05::DOUBLE * (y - w1 * a - w2 * b) * a, w2 + 0.05::DOUBLE * (y - w1 * a - w2 * b) * b, y - w1 * a - w2 * b FROM f JOIN s ON s.p = f.p AND s.i = f.i + 1) SELECT p, i, round(error, 6) AS error FROM f WHERE i > 1""",
)
def series_lms(spark: SparkSession, d: str) -> DataFrame:
    w = _weeks(spark, d).withColumn("x", F.col("x") / 100)
    return rounded(S.lms(w, ["p"], "i", "x", 2, 0.05))

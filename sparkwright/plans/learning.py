"""Queries of splitters, linear models, cross-validation, naive Bayes and further metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import learning as L
from sparkwright.plans.stats import rounded
from sparkwright.registry import REGISTRY
from sparkwright.session import table


@REGISTRY.add(
    "tab_group_folds",
    "2.17",
    "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey) - 1 AS p FROM c) SELECT o_custkey, n, CAST(CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS INTEGER) AS fold FROM p",
)
def tab_group_folds(spark: SparkSession, d: str) -> DataFrame:
    return L.group_folds(table(spark, d, "orders"), "o_custkey", 5)


_MONTH = "(extract(year FROM o_orderdate) - 1992) * 12 + extract(month FROM o_orderdate)"


def _months(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")).alias("m"))


for _name, _from in (("expanding", "true"), ("sliding", "m >= 12 + 6 * f - 12")):

    def _plan(spark: SparkSession, d: str, expanding: bool = _name == "expanding") -> DataFrame:
        return L.rolling_origin(_months(spark, d), "m", 12, 3, 6, 5, expanding)

    REGISTRY.add(
        f"tab_rolling_{_name}",
        "2.17",
        f"WITH o AS (SELECT {_MONTH} AS m FROM orders), f AS (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS f) SELECT f AS fold, count(*) FILTER (m < 12 + 6 * f AND {_from}) AS train, count(*) FILTER (m >= 12 + 6 * f AND m < 15 + 6 * f) AS test FROM o, f GROUP BY 1",
    )(_plan)


_CROSS = """f AS (SELECT extract(month FROM o_orderdate) % 4 AS fold, CAST(o_custkey AS DOUBLE) AS c, o_totalprice / 1000 AS y, CAST(extract(day FROM o_orderdate) AS DOUBLE) AS x FROM orders), g AS (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS fold), q AS (SELECT unnest([0.0, 1000.0, 100000.0])::DOUBLE AS penalty),
    t AS (SELECT penalty, g.fold, covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + penalty) AS slope, avg(y) AS my, avg(x) AS mx FROM f, g, q WHERE f.fold <> g.fold GROUP BY 1, 2), c AS (SELECT t.penalty, t.fold, any_value(slope) AS slope, any_value(my - slope * mx) AS intercept, avg(power(y - (my - slope * mx) - slope * x, 2)) AS mse FROM t JOIN f USING (fold) GROUP BY 1, 2)"""


def _cross(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return L.cross_validated_line(o, (F.month("o_orderdate") % 4).cast("int"), F.dayofmonth("o_orderdate"), F.col("o_totalprice") / 1000, [0.0, 1000.0, 100000.0])


@REGISTRY.add("ml_cross_validate", "2.17", f"WITH {_CROSS} SELECT penalty, CAST(fold AS INTEGER) AS fold, round(slope, 5) AS slope, round(intercept, 4) AS intercept, round(mse, 2) AS mse FROM c")
def ml_cross_validate(spark: SparkSession, d: str) -> DataFrame:
    """Total price by day of the month, with quarters of the months as folds."""
    return _cross(spark, d).select("penalty", "fold", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("mse", 2).alias("mse"))


@REGISTRY.add("ml_grid_search", "2.17", f"WITH {_CROSS}, m AS (SELECT penalty, avg(mse) AS mse FROM c GROUP BY 1) SELECT penalty, round(mse, 2) AS mse FROM m ORDER BY m.mse, penalty LIMIT 1")
def ml_grid_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.grid_search(_cross(spark, d)), 2)


@REGISTRY.add(
    "ml_linear",
    "2.17",
    """WITH s AS (SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, covar_pop(l_discount, l_discount) AS c, covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_discount, l_extendedprice) AS q, avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_extendedprice) AS mp FROM lineitem),
    k AS (SELECT (p * c - q * b) / (a * c - b * b) AS kq, (a * q - b * p) / (a * c - b * b) AS kd, mq, md, mp FROM s)
    SELECT 'intercept' AS term, round(mp - kq * mq - kd * md, 2) AS coefficient FROM k UNION ALL SELECT 'l_quantity', round(kq, 2) FROM k UNION ALL SELECT 'l_discount', round(kd, 2) FROM k""",
)
def ml_linear(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.linear_regression(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_extendedprice"), ["l_quantity", "l_discount"], "l_extendedprice"), 2)


@REGISTRY.add(
    "ml_naive_bayes",
    "2.17",
    """WITH x AS (SELECT row_number() OVER () AS id, l_quantity, l_tax FROM lineitem), m AS (SELECT l_returnflag AS c, count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE) AS p, avg(l_quantity) AS mq, var_pop(l_quantity) AS vq, avg(l_tax) AS mt, var_pop(l_tax) AS vt FROM lineitem GROUP BY 1), w AS (SELECT 1e-9 * greatest(var_pop(l_quantity), var_pop(l_tax)) AS w FROM lineitem),
    s AS (SELECT id, c, ln(p) - 0.5 * (ln(2 * pi() * (vq + w)) + power(l_quantity - mq, 2) / (vq + w)) - 0.5 * (ln(2 * pi() * (vt + w)) + power(l_tax - mt, 2) / (vt + w)) AS s FROM x, m, w),
    b AS (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY s DESC, c) AS r FROM s) SELECT c AS prediction, count(*) AS n FROM b WHERE r = 1 GROUP BY 1""",
)
def ml_naive_bayes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    model = L.naive_bayes(li, "l_returnflag", ["l_quantity", "l_tax"])
    return L.predict_naive_bayes(li, model, "l_returnflag", ["l_quantity", "l_tax"], ["l_orderkey"]).groupBy("prediction").agg(F.count("*").alias("n"))


@REGISTRY.add(
    "metric_silhouette",
    "2.14",
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS s, count(*) AS n FROM v a, v b GROUP BY 1, 2, 3),
    m AS (SELECT vec_id, max(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b, max(CASE WHEN own = other THEN n END) AS n FROM d GROUP BY 1)
    SELECT vec_id, round(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END, 5) AS silhouette FROM m""",
)
def metric_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.silhouette(table(spark, d, "embeddings"), "label", "embedding", "vec_id"), 5)


@REGISTRY.add(
    "metric_krippendorff",
    "2.14",
    """WITH c AS (SELECT l_orderkey AS u, l_returnflag AS v, CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY 1, 2), m AS (SELECT u, sum(c) AS m, sum(c * c) AS q FROM c GROUP BY 1 HAVING sum(c) > 1), n AS (SELECT v, sum(c) AS n FROM c WHERE u IN (SELECT u FROM m) GROUP BY 1),
    o AS (SELECT sum((m * m - q) / (m - 1)) AS o, sum(m) AS t FROM m), e AS (SELECT sum(n * n) AS q FROM n) SELECT round(o / t, 6) AS observed, round((t * t - q) / (t * (t - 1)), 6) AS expected, round(1 - (o / t) / ((t * t - q) / (t * (t - 1))), 6) AS alpha FROM o, e""",
)
def metric_krippendorff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.krippendorff_alpha(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag"))


@REGISTRY.add(
    "metric_detection_ap",
    "2.14",
    """WITH b AS (SELECT l_orderkey AS k, l_linenumber AS box, l_quantity AS x FROM lineitem WHERE l_returnflag = 'R'), t AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity AS u, l_extendedprice AS s FROM lineitem WHERE l_linestatus = 'F'),
    p AS (SELECT t.k, t.i, t.s, b.box, coalesce(greatest(10 - abs(b.x - t.u), 0) / (20 - greatest(10 - abs(b.x - t.u), 0)), 0) AS o FROM t LEFT JOIN b USING (k)), r AS (SELECT k, i, s, arg_min(box, (-o, box)) AS box, max(o) AS o FROM p GROUP BY 1, 2, 3),
    h AS (SELECT s, o, CASE WHEN o >= 0.5 AND row_number() OVER (PARTITION BY k, box ORDER BY o < 0.5, s DESC, i) = 1 THEN 1 ELSE 0 END AS hit FROM r), g AS (SELECT s, sum(hit) AS hits, count(*) AS n FROM h GROUP BY 1), c AS (SELECT hits, n, sum(hits) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS a FROM g)
    SELECT (SELECT count(*) FROM b) AS boxes, CAST(sum(n) AS BIGINT) AS detections, CAST(sum(hits) AS BIGINT) AS hits, round(sum(hits * tp / CAST(a AS DOUBLE)) / (SELECT count(*) FROM b), 6) AS average_precision FROM c""",
)
def metric_detection_ap(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of width 10 in the images (orders): returned lines are boxes, finished ones detections scored by price."""
    li = table(spark, d, "lineitem")
    boxes = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("box"), F.col("l_quantity").alias("x"))
    found = li.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("u"), F.col("l_extendedprice").alias("s"))
    common = F.greatest(10 - F.abs(F.col("x") - F.col("u")), F.lit(0.0))
    return rounded(L.average_precision(found, boxes, "k", "s", "i", common / (20 - common)))

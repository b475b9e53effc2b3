"""Queries of multiclass and agreement metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import agreement as A
from sparkwright.plans.metrics import _SCORED, _scored
from sparkwright.plans.stats import rounded
from sparkwright.registry import REGISTRY
from sparkwright.session import table

_CLASSES = "p AS (SELECT l_returnflag AS y, CASE WHEN l_shipdate < TIMESTAMP '1995-06-17' THEN CASE WHEN l_quantity < 25 THEN 'A' ELSE 'R' END ELSE 'N' END AS g FROM lineitem)"


@REGISTRY.add(
    "metric_multiclass",
    "2.14",
    f"""WITH {_CLASSES}, k AS (SELECT y AS c FROM p UNION SELECT g FROM p), s AS (SELECT c, CAST((SELECT count(*) FROM p WHERE y = c) AS DOUBLE) AS t, CAST((SELECT count(*) FROM p WHERE g = c) AS DOUBLE) AS g, CAST((SELECT count(*) FROM p WHERE y = c AND p.g = c) AS DOUBLE) AS tp FROM k),
    r AS (SELECT *, CASE WHEN g > 0 THEN tp / g ELSE 0 END AS pr, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS rc, CASE WHEN t + g > 0 THEN 2 * tp / (t + g) ELSE 0 END AS f FROM s), z AS (SELECT sum(t) AS n, sum(tp) AS h, sum(t * g) AS x FROM s)
    SELECT round(any_value(h / n), 6) AS accuracy, round(avg(pr), 6) AS macro_precision, round(avg(rc), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(f * t) / any_value(n), 6) AS weighted_f1, round(avg(rc) FILTER (t > 0), 6) AS balanced, round(any_value((h / n - x / (n * n)) / (1 - x / (n * n))), 6) AS kappa FROM r, z""",
)
def metric_multiclass(spark: SparkSession, d: str) -> DataFrame:
    early = F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp_ntz")
    guess = F.when(early, F.when(F.col("l_quantity") < 25, "A").otherwise("R")).otherwise("N")
    return rounded(A.multiclass(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), guess.alias("g")), "y", "g"))


@REGISTRY.add(
    "metric_fleiss_kappa",
    "2.14",
    """WITH c AS (SELECT l_orderkey AS i, l_returnflag AS k, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT i, sum(n) AS m, sum(n * n) AS q FROM c GROUP BY 1 HAVING sum(n) > 1), o AS (SELECT avg((q - m) / (m * (m - 1))) AS o FROM m),
    h AS (SELECT k, sum(n) AS n FROM c WHERE i IN (SELECT i FROM m) GROUP BY 1), e AS (SELECT sum(n * n) / power(sum(n), 2) AS e FROM h) SELECT round(o, 6) AS observed, round(e, 6) AS chance, round((o - e) / (1 - e), 6) AS kappa FROM o, e""",
)
def metric_fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as raters of its return flag."""
    return rounded(A.fleiss_kappa(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag"))


@REGISTRY.add("metric_reliability", "2.14", f"WITH {_SCORED} SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(score), 6) AS confidence, round(avg(y), 6) AS share FROM s GROUP BY 1")
def metric_reliability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.reliability(_scored(spark, d), "score", "y"))


@REGISTRY.add(
    "metric_box_iou",
    "2.14",
    """WITH b AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity AS x, l_discount * 100 AS y, l_quantity + 10 AS x2, l_discount * 100 + 5 AS y2 FROM lineitem),
    p AS (SELECT a.k, a.i, b.i AS j, greatest(least(a.x2, b.x2) - greatest(a.x, b.x), 0) * greatest(least(a.y2, b.y2) - greatest(a.y, b.y), 0) AS o FROM b a JOIN b ON a.k = b.k AND a.i < b.i) SELECT k, i, j, round(o / (100 - o), 6) AS iou FROM p""",
)
def metric_box_iou(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of one image (order) against each other."""
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    o = b.select("k", F.col("i").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"))
    p = b.join(o, "k").where("i < j")
    return rounded(p.select("k", "i", "j", A.box_iou([F.col("x"), F.col("y"), F.col("x") + 10, F.col("y") + 5], [F.col("u"), F.col("v"), F.col("u") + 10, F.col("v") + 5]).alias("iou")))


@REGISTRY.add(
    "metric_lift",
    "2.14",
    f"""WITH {_SCORED}, t AS (SELECT y, ntile(10) OVER (ORDER BY score DESC, doc_id) AS g FROM s), c AS (SELECT CAST(g AS INTEGER) AS "group", count(*) AS n, CAST(sum(y) AS BIGINT) AS hits FROM t GROUP BY 1)
    SELECT "group", n, hits, round(hits / n, 6) AS share, round(hits / n / (sum(hits) OVER () / sum(n) OVER ()), 6) AS lift, round(sum(hits) OVER (ORDER BY "group") / sum(hits) OVER (), 6) AS gain FROM c""",
)
def metric_lift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.lift_table(_scored(spark, d), "score", "y", "doc_id"))


@REGISTRY.add("metric_inequality", "2.14", "SELECT l_returnflag, round(avg(l_extendedprice * ln(l_extendedprice)) / avg(l_extendedprice) - ln(avg(l_extendedprice)), 6) AS theil, round(1 - exp(avg(ln(l_extendedprice))) / avg(l_extendedprice), 6) AS atkinson FROM lineitem GROUP BY 1")
def metric_inequality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.theil(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice"))


@REGISTRY.add(
    "metric_novelty",
    "2.14",
    """WITH l AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 50), p AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t, count(*) AS items FROM p), r AS (SELECT user_id, event_type, n, t, items FROM l JOIN p USING (event_type), t)
    SELECT user_id, round(avg(-log2(n / t)), 6) AS novelty, (SELECT round(count(DISTINCT event_type) / CAST(max(items) AS DOUBLE), 6) FROM r) AS coverage FROM r GROUP BY 1""",
)
def metric_novelty(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    lists = e.where("value > 50").select("user_id", "event_type").distinct()
    return rounded(A.list_diversity(lists, "user_id", "event_type", e.groupBy("event_type").agg(F.count("*").alias("n"))))

"""Queries of tests, information measures, privacy and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import tests as H
from sparkwright.plans.stats import rounded
from sparkwright.registry import REGISTRY
from sparkwright.session import table


@REGISTRY.add(
    "test_welch_t",
    "2.13",
    """WITH s AS (SELECT avg(o_totalprice) FILTER (o_orderstatus = 'O') AS ma, avg(o_totalprice) FILTER (o_orderstatus <> 'O') AS mb, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') / count(*) FILTER (o_orderstatus = 'O') AS ea, var_samp(o_totalprice) FILTER (o_orderstatus <> 'O') / count(*) FILTER (o_orderstatus <> 'O') AS eb, count(*) FILTER (o_orderstatus = 'O') AS na, count(*) FILTER (o_orderstatus <> 'O') AS nb FROM orders)
    SELECT round(ma - mb, 4) AS estimate, round((ma - mb) / sqrt(ea + eb), 6) AS t, round(power(ea + eb, 2) / (ea * ea / (na - 1) + eb * eb / (nb - 1)), 3) AS freedom FROM s""",
)
def test_welch_t(spark: SparkSession, d: str) -> DataFrame:
    r = H.welch_t(table(spark, d, "orders"), F.col("o_orderstatus") == "O", "o_totalprice")
    return r.select(F.round("estimate", 4).alias("estimate"), F.round("t", 6).alias("t"), F.round("freedom", 3).alias("freedom"))


@REGISTRY.add(
    "test_anova",
    "2.13",
    """WITH g AS (SELECT l_shipdate IS NULL, l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(n) AS t, count(*) AS k, sum(n * m * m) - power(sum(n * m), 2) / sum(n) AS b, sum(n * v) AS w FROM g)
    SELECT round((b / (k - 1)) / (w / (t - k)), 5) AS f, k - 1 AS d1, CAST(t - k AS BIGINT) AS d2, round(b / (b + w), 6) AS eta_squared FROM s""",
)
def test_anova(spark: SparkSession, d: str) -> DataFrame:
    r = H.one_way_anova(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")
    return r.select(F.round("f", 5).alias("f"), "d1", "d2", F.round("eta_squared", 6).alias("eta_squared"))


@REGISTRY.add(
    "test_ks",
    "2.13",
    """WITH c AS (SELECT l_quantity AS x, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1), s AS (SELECT abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS d, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c WINDOW w AS (ORDER BY x))
    SELECT round(max(d), 6) AS d, CAST(max(na) AS BIGINT) AS na, CAST(max(nb) AS BIGINT) AS nb FROM s""",
)
def test_ks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.ks_two_sample(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", "l_quantity"))


@REGISTRY.add(
    "test_mann_whitney",
    "2.13",
    """WITH r AS (SELECT l_returnflag = 'R' AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem), t AS (SELECT sum(power(c, 3) - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY l_quantity)),
    s AS (SELECT sum(r) FILTER (g) AS ra, CAST(count(*) FILTER (g) AS DOUBLE) AS na, CAST(count(*) FILTER (NOT g) AS DOUBLE) AS nb FROM r)
    SELECT ra - na * (na + 1) / 2 AS u, round((ra - na * (na + 1) / 2 - na * nb / 2) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))), 5) AS z FROM s, t""",
)
def test_mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    return H.mann_whitney(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", "l_quantity").select("u", F.round("z", 5).alias("z"))


@REGISTRY.add(
    "test_proportions",
    "2.13",
    """WITH s AS (SELECT CAST(count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'N') AS DOUBLE) AS xa, count(*) FILTER (l_linestatus = 'F') AS na, CAST(count(*) FILTER (l_linestatus <> 'F' AND l_returnflag = 'N') AS DOUBLE) AS xb, count(*) FILTER (l_linestatus <> 'F') AS nb FROM lineitem)
    SELECT round(xa / na, 6) AS pa, round(xb / nb, 6) AS pb, round((xa / na - xb / nb) / sqrt((xa + xb) / (na + nb) * (1 - (xa + xb) / (na + nb)) * (1.0 / na + 1.0 / nb)), 4) AS z FROM s""",
)
def test_proportions(spark: SparkSession, d: str) -> DataFrame:
    r = H.two_proportions(table(spark, d, "lineitem"), F.col("l_linestatus") == "F", F.col("l_returnflag") == "N")
    return r.select(F.round("pa", 6).alias("pa"), F.round("pb", 6).alias("pb"), F.round("z", 4).alias("z"))


@REGISTRY.add(
    "test_wilson",
    "2.13",
    """WITH s AS (SELECT o_orderpriority, avg(CAST(o_orderstatus = 'F' AS INTEGER)) AS p, count(*) AS n, 1.959963984540054 AS z FROM orders GROUP BY 1)
    SELECT o_orderpriority, round(p, 6) AS p, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS high FROM s""",
)
def test_wilson(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.wilson_interval(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F"))


@REGISTRY.add("test_p_values", "2.13")
def test_p_values(spark: SparkSession, d: str) -> DataFrame:
    """p-values of the statistics above, one row per test."""
    li, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    t = H.welch_t(orders, F.col("o_orderstatus") == "O", "o_totalprice").select(F.lit("welch t").alias("test"), F.col("t").alias("statistic"), H.p_t(F.col("t"), F.col("freedom")).alias("p"))
    f = H.one_way_anova(li, "l_returnflag", "l_quantity").select(F.lit("anova"), "f", H.p_f(F.col("f"), F.col("d1"), F.col("d2")))
    k = H.ks_two_sample(li, F.col("l_returnflag") == "R", "l_quantity")
    k = k.select(F.lit("ks"), "d", H.p_kolmogorov(F.col("d") * F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))))
    m = H.mann_whitney(li, F.col("l_returnflag") == "R", "l_quantity").select(F.lit("mann-whitney"), "z", H.p_normal(F.col("z")))
    return t.union(f).union(k).union(m)


@REGISTRY.add(
    "info_entropy_mi",
    "2.13",
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c),
    j AS (SELECT -sum(n / t * ln(n / t)) AS joint FROM c, t), a AS (SELECT -sum(n / t * ln(n / t)) AS ha FROM (SELECT a, sum(n) AS n FROM c GROUP BY 1), t), b AS (SELECT -sum(n / t * ln(n / t)) AS hb FROM (SELECT b, sum(n) AS n FROM c GROUP BY 1), t)
    SELECT round(ha, 6) AS ha, round(hb, 6) AS hb, round(joint, 6) AS joint, round(joint - ha, 6) AS b_given_a, round(ha + hb - joint, 6) AS mutual_information FROM j, a, b""",
)
def info_entropy_mi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.information(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@REGISTRY.add(
    "info_divergences",
    "2.13",
    """WITH c AS (SELECT p_size, CAST(count(*) FILTER (p_brand < 'Brand#3') AS DOUBLE) AS a, CAST(count(*) FILTER (p_brand >= 'Brand#3') AS DOUBLE) AS b FROM part GROUP BY 1), t AS (SELECT sum(a) AS ta, sum(b) AS tb, count(*) AS k FROM c),
    r AS (SELECT a / ta AS p, b / tb AS q, (a / ta + b / tb) / 2 AS m, (a + 0.5) / (ta + 0.5 * k) AS sp, (b + 0.5) / (tb + 0.5 * k) AS sq FROM c, t)
    SELECT round(sum(abs(p - q)) / 2, 6) AS total_variation, round(sqrt(greatest(1 - sum(sqrt(p * q)), 0)), 6) AS hellinger, round(sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2, 6) AS jensen_shannon, round(sum(sp * ln(sp / sq)), 6) AS kl FROM r""",
)
def info_divergences(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.divergences(table(spark, d, "part"), "p_size", F.col("p_brand") < "Brand#3"))


@REGISTRY.add("privacy_laplace", "2.13")
def privacy_laplace(spark: SparkSession, d: str) -> DataFrame:
    return H.laplace_counts(table(spark, d, "events"), ["event_type"], 1.0)


@REGISTRY.add("bootstrap_ci", "2.13")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    means = H.poisson_bootstrap(table(spark, d, "orders"), "o_orderkey", "o_totalprice", 200)
    return means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"), F.stddev("mean").alias("error"))


@REGISTRY.add("sample_keyed", "2.6")
def sample_keyed(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the rows, the same ones whatever the partitions."""
    return table(spark, d, "lineitem").where(H.keyed_uniform(F.xxhash64("l_orderkey", "l_linenumber"), 1) < 0.1)

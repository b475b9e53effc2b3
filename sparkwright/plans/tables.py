"""Queries of table machinery and mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import tables as B
from sparkwright.plans.stats import rounded
from sparkwright.registry import REGISTRY
from sparkwright.session import table

_SCALES = {
    "standard": ("avg({0})", "stddev_pop({0})"),
    "minmax": ("min({0})", "max({0}) - min({0})"),
    "robust": ("quantile_cont({0}, 0.5)", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"),
}
for _how, (_c, _s) in _SCALES.items():

    def _plan(spark: SparkSession, d: str, how: str = _how) -> DataFrame:
        return rounded(B.scale(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], how))

    REGISTRY.add(f"tab_scale_{_how}", "2.17", f"SELECT c_custkey, round((c_acctbal - (SELECT {_c.format('c_acctbal')} FROM customer)) / (SELECT {_s.format('c_acctbal')} FROM customer), 6) AS c_acctbal FROM customer")(_plan)


@REGISTRY.add("tab_ordinal", "2.17", "SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def tab_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return B.ordinal_encode(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code")


@REGISTRY.add("tab_one_hot", "2.17", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O FROM orders")
def tab_one_hot(spark: SparkSession, d: str) -> DataFrame:
    return B.one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"]).drop("o_orderstatus")


@REGISTRY.add("tab_frequency", "2.17", "SELECT c_mktsegment, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE), 6) AS share FROM customer GROUP BY 1")
def tab_frequency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.frequency_encode(table(spark, d, "customer"), "c_mktsegment"))


@REGISTRY.add("tab_target_encode", "2.17", "SELECT l_shipdate.year() AS y, round((sum(l_quantity) + 10 * (SELECT avg(l_quantity) FROM lineitem)) / (count(*) + 10), 6) AS encoded FROM lineitem GROUP BY 1")
def tab_target_encode(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.year("l_shipdate").cast("long").alias("y"), "l_quantity")
    return rounded(B.target_encode(li, "y", "l_quantity", 10.0))


@REGISTRY.add(
    "tab_impute",
    "2.17",
    "WITH h AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS x FROM customer) SELECT c_custkey, round(coalesce(x, avg(x) OVER (PARTITION BY c_mktsegment)), 6) AS by_mean, round(coalesce(x, (SELECT quantile_cont(x, 0.5) FROM h)), 6) AS by_median FROM h",
)
def tab_impute(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    h = table(spark, d, "customer").select("c_custkey", "c_mktsegment", x.alias("by_mean"), x.alias("by_median"))
    return rounded(B.impute(B.impute(h, "by_mean", "mean", ["c_mktsegment"]), "by_median", "median").drop("c_mktsegment"))


@REGISTRY.add("tab_kfold", "2.17", "SELECT doc_id, CAST(ntile(5) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS fold FROM labels")
def tab_kfold(spark: SparkSession, d: str) -> DataFrame:
    return B.k_folds(table(spark, d, "labels").select("doc_id"), "doc_id", 5)


@REGISTRY.add("tab_stratified", "2.17", "SELECT doc_id, toxic, CAST(ntile(4) OVER (PARTITION BY toxic ORDER BY doc_id) - 1 AS INTEGER) AS fold FROM labels")
def tab_stratified(spark: SparkSession, d: str) -> DataFrame:
    return B.k_folds(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", 4, ["toxic"])


@REGISTRY.add("tab_polynomial", "2.17", 'SELECT l_orderkey, l_linenumber, round(l_quantity * l_quantity, 4) AS qq, round(l_quantity * l_discount, 4) AS qd, round(l_discount * l_discount, 4) AS dd FROM lineitem')
def tab_polynomial(spark: SparkSession, d: str) -> DataFrame:
    li = B.polynomial(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d")), ["q", "d"])
    return li.select("l_orderkey", "l_linenumber", F.round("`q*q`", 4).alias("qq"), F.round("`q*d`", 4).alias("qd"), F.round("`d*d`", 4).alias("dd"))


@REGISTRY.add("tab_undersample", "2.17", "SELECT toxic, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)) AS n FROM labels GROUP BY 1")
def tab_undersample(spark: SparkSession, d: str) -> DataFrame:
    return B.undersample(table(spark, d, "labels"), "toxic", "doc_id").groupBy("toxic").agg(F.count("*").alias("n"))


@REGISTRY.add("tab_discretise", "2.2", "SELECT CAST(CAST(l_quantity >= 10 AS INTEGER) + CAST(l_quantity >= 25 AS INTEGER) + CAST(l_quantity >= 40 AS INTEGER) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def tab_discretise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(B.discretise(F.col("l_quantity"), [10.0, 25.0, 40.0]).alias("bin")).agg(F.count("*").alias("n"))


_CONDITIONS = {"quantity >= 25": "l_quantity >= 25", "discount < 0.05": "l_discount < 0.05", "status = F": "l_linestatus = 'F'", "line = 1": "l_linenumber = 1"}


def _subgroup_sql() -> str:
    from itertools import combinations

    named = [(a,) for a in _CONDITIONS] + list(combinations(_CONDITIONS, 2))
    rows = [f"SELECT '{' and '.join(n)}' AS description, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS hits FROM lineitem WHERE {' AND '.join(_CONDITIONS[x] for x in n)}" for n in named]
    return f"WITH s AS ({' UNION ALL '.join(rows)}), t AS (SELECT CAST(count(*) AS DOUBLE) AS t, count(*) FILTER (l_returnflag = 'R') AS p FROM lineitem) SELECT description, n, hits, round(hits / n, 6) AS share, round(n / t * (hits / n - p / t), 6) AS wracc, round(hits / n / (p / t), 6) AS lift FROM s, t WHERE n > 0"


@REGISTRY.add("mine_subgroups", "2.2", _subgroup_sql())
def mine_subgroups(spark: SparkSession, d: str) -> DataFrame:
    conditions = {k: F.expr(v) for k, v in _CONDITIONS.items()}
    return rounded(B.subgroups(table(spark, d, "lineitem"), conditions, F.col("l_returnflag") == "R"))


@REGISTRY.add(
    "mine_pairs",
    "2.17",
    """WITH r AS (SELECT DISTINCT l_orderkey AS k, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), t AS (SELECT CAST(count(DISTINCT k) AS DOUBLE) AS t FROM r), c AS (SELECT i, count(*) AS c FROM r GROUP BY 1),
    p AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM r x JOIN r y ON x.k = y.k AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 40)
    SELECT p.a, p.b, n, round(n / t, 6) AS support, round(n / ca.c, 6) AS confidence, round(n / ca.c / (cb.c / t), 6) AS lift, round(n / t - ca.c / t * cb.c / t, 6) AS leverage, round((1 - cb.c / t) / (1 - n / ca.c), 6) AS conviction FROM p JOIN c ca ON ca.i = p.a JOIN c cb ON cb.i = p.b, t""",
)
def mine_pairs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_brand").alias("i"))
    return rounded(B.item_pairs(li, "l_orderkey", "i", 40))


@REGISTRY.add("mine_fpgrowth", "2.17")
def mine_fpgrowth(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.fpm import FPGrowth

    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    baskets = li.groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("items"))
    return FPGrowth(itemsCol="items", minSupport=0.01, minConfidence=0.05).fit(baskets).freqItemsets.select(F.sort_array("items").alias("items"), "freq")


@REGISTRY.add("rollup_prefix", "2.4", "SELECT p_brand, p_type, p_size, count(*) AS n, round(avg(p_retailprice) + 1e-8, 4) AS price FROM part GROUP BY ROLLUP (p_brand, p_type, p_size)")
def rollup_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").rollup("p_brand", "p_type", "p_size").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice") + 1e-8, 4).alias("price"))

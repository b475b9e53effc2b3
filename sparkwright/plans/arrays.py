"""Queries of sources, array operators, reductions, scans, complex numbers and selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions import guards as G
from sparkwright.operators import arrays as A
from sparkwright.plans.stats import rounded
from sparkwright.registry import REGISTRY
from sparkwright.session import table


@REGISTRY.add("src_arange", "2.1", "SELECT CAST(i AS BIGINT) AS i, 2 + i * 0.5::DOUBLE AS x FROM (SELECT unnest(range(0, 7)) AS i)")
def src_arange(spark: SparkSession, d: str) -> DataFrame:
    return A.arange(spark, 2.0, 5.5, 0.5)


@REGISTRY.add("src_full", "2.1", "SELECT CAST(i AS BIGINT) AS i, v::DOUBLE AS x FROM (SELECT unnest(range(0, 6)) AS i), (SELECT unnest([0.0, 1.0, 2.5]) AS v)")
def src_full(spark: SparkSession, d: str) -> DataFrame:
    """Zeros, ones and a constant."""
    return A.filled(spark, 6, 0).unionAll(A.filled(spark, 6, 1)).unionAll(A.filled(spark, 6, 2.5))


@REGISTRY.add("src_eye", "2.1", "SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS j, 1.0::DOUBLE AS x FROM (SELECT unnest(range(0, 5)) AS i)")
def src_eye(spark: SparkSession, d: str) -> DataFrame:
    return A.eye(spark, 5)


@REGISTRY.add("src_interactions", "2.1", "SELECT o_custkey AS customer, l_suppkey AS supplier, count(*) AS n, sum(l_quantity) AS amount FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def src_interactions(spark: SparkSession, d: str) -> DataFrame:
    """The interaction matrix of customers and suppliers in long form."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return li.groupBy(F.col("o_custkey").alias("customer"), F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("amount"))


@REGISTRY.add("arr_scatter_add", "2.2", "SELECT c_custkey, round(c_acctbal + coalesce(s, 0), 2) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def arr_scatter_add(spark: SparkSession, d: str) -> DataFrame:
    add = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"))
    return rounded(A.scatter_add(table(spark, d, "customer").select("c_custkey", "c_acctbal"), add, "c_custkey", "c_acctbal"), 2)


@REGISTRY.add("arr_set", "2.2", "SELECT c_custkey, coalesce(m, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def arr_set(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"))
    return A.set_values(table(spark, d, "customer").select("c_custkey", "c_acctbal"), new, "c_custkey", "c_acctbal")


@REGISTRY.add("arr_product", "2.4", "SELECT p_brand, round(exp(sum(ln(p_retailprice / 1000))), 6) AS product FROM part GROUP BY 1")
def arr_product(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "part").groupBy("p_brand").agg(A.product(F.col("p_retailprice") / 1000).alias("product")))


@REGISTRY.add("arr_logsumexp", "2.4", "SELECT l_returnflag, round(max(l_quantity) + ln(sum(exp(l_quantity - 50))) - (max(l_quantity) - 50), 6) AS logsumexp FROM lineitem GROUP BY 1")
def arr_logsumexp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.log_sum_exp(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity"))


@REGISTRY.add("arr_norms", "2.4", "SELECT c_nationkey, round(sum(abs(c_acctbal)), 4) AS l1, round(sqrt(sum(c_acctbal * c_acctbal)), 4) AS l2, max(abs(c_acctbal)) AS l_inf FROM customer GROUP BY 1")
def arr_norms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.norms(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal"), 4)


@REGISTRY.add("arr_argmax", "2.4", "SELECT c_nationkey, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS argmax, arg_min(c_custkey, (c_acctbal, c_custkey)) AS argmin FROM customer GROUP BY 1")
def arr_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the largest and the smallest value, ties to the smaller key."""
    c = table(spark, d, "customer")
    return c.groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct(-F.col("c_acctbal"), "c_custkey")).alias("argmax"), F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("argmin"))


@REGISTRY.add("arr_expectile", "2.4")
def arr_expectile(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_totalprice")
    return spark.createDataFrame([(t, A.expectile(o, "o_totalprice", t)) for t in (0.1, 0.5, 0.9)], "tau double, expectile double")


@REGISTRY.add(
    "arr_elementwise",
    "2.8",
    "SELECT p_partkey, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tanh(p_size / 25.0), 6) AS t, greatest(p_size * 30.0::DOUBLE, p_retailprice) AS high, least(p_size * 30.0::DOUBLE, p_retailprice) AS low, sign(p_size - 25)::DOUBLE AS sgn, abs(p_size - 25)::DOUBLE AS a FROM part",
)
def arr_elementwise(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_size").cast("double")
    high, low = A.extremes(x * 30, F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", F.round(F.sin(x), 6).alias("s"), F.round(F.cos(x), 6).alias("c"), F.round(F.tanh(x / 25), 6).alias("t"), high.alias("high"), low.alias("low"), F.signum(x - 25).alias("sgn"), F.abs(x - 25).alias("a"))


@REGISTRY.add(
    "arr_comparisons",
    "2.2",
    """WITH x AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE sqrt(c_acctbal) END AS a, c_nationkey * 4.0::DOUBLE AS b FROM customer)
    SELECT c_custkey, coalesce(a < b, false) AS less, coalesce(a <= b, false) AS less_equal, coalesce(a > b, false) AS greater, coalesce(a >= b, false) AS greater_equal, coalesce(a = b, false) AS equal, coalesce(a <> b, true) AS not_equal FROM x""",
)
def arr_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """The square root of a negative balance is NaN, which compares as floating-point numbers do."""
    both = A.compare(F.sqrt("c_acctbal"), F.col("c_nationkey") * 4.0)
    return table(spark, d, "customer").select("c_custkey", *(c.alias(k) for k, c in both.items()))


@REGISTRY.add(
    "arr_complex",
    "2.8",
    """WITH z AS (SELECT s_suppkey, s_acctbal / 1000 AS a, s_nationkey - 12.0::DOUBLE AS b, 1.5::DOUBLE AS c, s_nationkey / 10.0::DOUBLE AS e FROM supplier)
    SELECT s_suppkey, round(a * c - b * e, 6) AS product_re, round(a * e + b * c, 6) AS product_im, round((a * c + b * e) / (c * c + e * e), 6) AS quotient_re, round((b * c - a * e) / (c * c + e * e), 6) AS quotient_im, round(sqrt(a * a + b * b), 6) AS modulus, round(atan2(b, a), 6) AS argument, round(exp(c) * cos(e), 6) AS exp_re, round(exp(c) * sin(e), 6) AS exp_im FROM z""",
)
def arr_complex(spark: SparkSession, d: str) -> DataFrame:
    z = A.Complex(F.col("s_acctbal") / 1000, F.col("s_nationkey") - F.lit(12.0))
    w = A.Complex(F.lit(1.5), F.col("s_nationkey") / 10.0)
    product, quotient, power = z * w, z / w, w.exp()
    named = {"product_re": product.re, "product_im": product.im, "quotient_re": quotient.re, "quotient_im": quotient.im, "modulus": z.modulus(), "argument": z.argument(), "exp_re": power.re, "exp_im": power.im}
    return table(spark, d, "supplier").select("s_suppkey", *(F.round(c, 6).alias(k) for k, c in named.items()))


@REGISTRY.add(
    "arr_scans",
    "2.5",
    """SELECT user_id, event_id, round(sum(value) OVER w, 4) AS sums, round(exp(sum(ln(0.5 + value / 100)) OVER w), 5) AS products, min(value) OVER w AS minima, max(value) OVER w AS maxima FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING)""",
)
def arr_scans(spark: SparkSession, d: str) -> DataFrame:
    """Scans from each user's last event back; the product is that of half plus a hundredth of the value."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "value", (0.5 + F.col("value") / 100).alias("x"))
    plain = A.scan(e.select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value", reverse=True)
    products = A.scan(e.select("user_id", "event_id", "ts", "x"), ["user_id"], ["ts", "event_id"], "x", reverse=True).select("event_id", F.col("products").alias("p"))
    both = plain.join(products, "event_id")
    return both.select("user_id", "event_id", F.round("sums", 4).alias("sums"), F.round("p", 5).alias("products"), "minima", "maxima")


@REGISTRY.add("arr_undifference", "2.5", "SELECT user_id, event_id, round(value, 4) AS series FROM events")
def arr_undifference(spark: SparkSession, d: str) -> DataFrame:
    """The differences of each user's values, summed up again."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0)).alias("x"), F.first("value").over(w).alias("start"))
    r = A.undifference(e, ["user_id"], ["ts", "event_id"], "x", F.col("start"))
    return r.select("user_id", "event_id", F.round("series", 4).alias("series"))


@REGISTRY.add("tab_selector", "2.2", "SELECT p_partkey, p_size, p_retailprice FROM part")
def tab_selector(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(*A.select_columns(p, {"number"}, "p_.*"))


@REGISTRY.add("tab_columns", "2.2", "SELECT round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal, c_custkey, c_mktsegment FROM customer")
def tab_columns(spark: SparkSession, d: str) -> DataFrame:
    """The balance scaled, the key passed, name and nation dropped, the remainder passed."""
    from sparkwright.operators.tables import scale

    return rounded(A.transform_columns(table(spark, d, "customer"), [(["c_acctbal"], scale), (["c_custkey"], "pass"), (["c_name", "c_nationkey"], "drop")], remainder="pass"))


@REGISTRY.add(
    "tab_cut_points",
    "2.2",
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders)
    SELECT 'width' AS how, CAST(k - 1 AS INTEGER) AS k, round(lo + (hi - lo) * k / 5, 4) AS cut FROM e, (SELECT unnest(range(1, 5)) AS k) UNION ALL SELECT 'frequency', CAST(k - 1 AS INTEGER), round(q[k], 4) FROM e, (SELECT unnest(range(1, 5)) AS k)""",
)
def tab_cut_points(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    both = [A.cut_points(o, "o_totalprice", 5, how).select(F.lit(how).alias("how"), "k", F.round("cut", 4).alias("cut")) for how in ("width", "frequency")]
    return both[0].unionAll(both[1])


@REGISTRY.add(
    "arr_skyline",
    "2.3",
    "WITH p AS (SELECT p_partkey, p_size, p_retailprice FROM part) SELECT p_partkey, p_size, p_retailprice FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.p_size >= p.p_size AND q.p_retailprice >= p.p_retailprice AND (q.p_size > p.p_size OR q.p_retailprice > p.p_retailprice))",
)
def arr_skyline(spark: SparkSession, d: str) -> DataFrame:
    return A.skyline(table(spark, d, "part"), ["p_partkey"], ["p_size", "p_retailprice"])


@REGISTRY.add(
    "arr_losses",
    "2.8",
    """WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS y, (l_quantity - 25) / 10 AS f FROM lineitem), p AS (SELECT *, 1 / (1 + exp(-y * f)) AS p FROM m)
    SELECT l_orderkey, l_linenumber, round(greatest(1 - y * f, 0), 6) AS hinge, round(power(greatest(1 - y * f, 0), 2), 6) AS squared_hinge, round(-power(1 - p, 2) * ln(p), 6) AS focal FROM p""",
)
def arr_losses(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).alias("y"), ((F.col("l_quantity") - 25) / 10).alias("f"))
    m = F.col("y") * F.col("f")
    return li.select("l_orderkey", "l_linenumber", F.round(G.hinge(m), 6).alias("hinge"), F.round(G.hinge(m) * G.hinge(m), 6).alias("squared_hinge"), F.round(G.focal(m, 2.0), 6).alias("focal"))


@REGISTRY.add("arr_inverse_transforms", "2.8", "SELECT o_orderkey, round(o_totalprice, 3) AS box_cox, round(o_totalprice, 3) AS yeo_johnson, round(-o_totalprice, 3) AS yeo_johnson_negative FROM orders")
def arr_inverse_transforms(spark: SparkSession, d: str) -> DataFrame:
    """The power transforms, taken back."""
    x = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.round(G.box_cox_inverse(G.box_cox(x, 0.5), 0.5), 3).alias("box_cox"),
        F.round(G.yeo_johnson_inverse(G.yeo_johnson(x, 0.5), 0.5), 3).alias("yeo_johnson"),
        F.round(G.yeo_johnson_inverse(G.yeo_johnson(-x, 0.5), 0.5), 3).alias("yeo_johnson_negative"),
    )

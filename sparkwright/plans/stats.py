"""Queries of descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import stats as S
from sparkwright.registry import REGISTRY
from sparkwright.session import table


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@REGISTRY.add(
    "stats_moments",
    "2.4",
    """
    WITH m AS (SELECT l_returnflag, avg(l_quantity) AS mu FROM lineitem GROUP BY 1),
    p AS (SELECT l.l_returnflag, count(*) AS n, avg(l_quantity) AS mean, avg(power(l_quantity - mu, 2)) AS v, avg(power(l_quantity - mu, 3)) AS c3, avg(power(l_quantity - mu, 4)) AS c4
          FROM lineitem l JOIN m USING (l_returnflag) GROUP BY 1)
    SELECT l_returnflag, n, round(mean, 6) AS mean, round(v, 6) AS variance, round(sqrt(v), 6) AS std, round(c3 / power(v, 1.5), 6) AS skewness, round(c4 / (v * v) - 3, 6) AS kurtosis FROM p
    """,
)
def stats_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.moments(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity"))


@REGISTRY.add(
    "stats_weighted",
    "2.4",
    """
    WITH s AS (SELECT l_returnflag, sum(l_quantity) AS w1, sum(l_quantity * l_quantity) AS w2, sum(l_quantity * l_extendedprice) AS s1, sum(l_quantity * l_extendedprice * l_extendedprice) AS s2 FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(s1 / w1, 4) AS mean, round((s2 - s1 * s1 / w1) / w1, 0) AS population, round((s2 - s1 * s1 / w1) / (w1 - 1), 0) AS frequency, round((s2 - s1 * s1 / w1) / (w1 - w2 / w1), 0) AS reliability FROM s
    """,
)
def stats_weighted(spark: SparkSession, d: str) -> DataFrame:
    got = S.weighted_moments(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return got.select("l_returnflag", F.round("mean", 4).alias("mean"), *(F.round(c, 0).alias(c) for c in ("population", "frequency", "reliability")))


@REGISTRY.add(
    "stats_quantile_linear",
    "2.4",
    """
    WITH q AS (SELECT o_orderpriority, unnest([0.1, 0.5, 0.9]) AS q, unnest(quantile_cont(o_totalprice, [0.1, 0.5, 0.9])) AS value FROM orders GROUP BY 1)
    SELECT o_orderpriority, CAST(q AS DOUBLE) AS q, round(value, 4) AS value FROM q
    """,
)
def stats_quantile_linear(spark: SparkSession, d: str) -> DataFrame:
    """The exact percentile aggregate of Spark has the linear definition."""
    levels = [0.1, 0.5, 0.9]
    got = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.percentile("o_totalprice", levels).alias("v"))
    pairs = F.inline(F.arrays_zip(F.array(*map(F.lit, levels)).alias("q"), F.col("v").alias("value")))
    return got.select("o_orderpriority", pairs).select("o_orderpriority", "q", F.round("value", 4).alias("value"))


_PLACES = {
    "linear": "(n - 1) * q",
    "interpolated": "n * q - 1",
    "hazen": "n * q - 0.5",
    "weibull": "(n + 1) * q - 1",
    "median_unbiased": "(n + 1.0/3) * q - 2.0/3",
    "normal_unbiased": "(n + 0.25) * q - 0.625",
}


def _quantile_sql(method: str) -> str:
    if method in _PLACES:
        lo, part = "floor(p)", "p - floor(p)"
        place = _PLACES[method]
    else:
        place = {"inverted": "n * q - 1", "averaged_inverted": "n * q - 1", "closest": "n * q - 1.5"}.get(method, "(n - 1) * q")
        up = "floor(p) + CASE WHEN p > floor(p) THEN 1 ELSE 0 END"
        lo, part = {
            "inverted": (up, "0"),
            "averaged_inverted": (up, "CASE WHEN p > floor(p) THEN 0 ELSE 0.5 END"),
            "closest": ("floor(p) + CASE WHEN p > floor(p) OR CAST(floor(p) AS BIGINT) % 2 <> 0 THEN 1 ELSE 0 END", "0"),
            "lower": ("floor(p)", "0"),
            "higher": ("ceil(p)", "0"),
            "nearest": ("CASE WHEN p - floor(p) < 0.5 THEN floor(p) WHEN p - floor(p) > 0.5 THEN floor(p) + 1 WHEN CAST(floor(p) AS BIGINT) % 2 = 0 THEN floor(p) ELSE floor(p) + 1 END", "0"),
            "midpoint": ("floor(p)", "CASE WHEN p > floor(p) THEN 0.5 ELSE 0 END"),
        }[method]
    return f"""
    WITH s AS (SELECT o_orderstatus, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
    a AS (SELECT DISTINCT o_orderstatus, n, CAST(q AS DOUBLE) AS q FROM s, (SELECT unnest([0.0, 0.25, 0.5, 0.9, 1.0]) AS q)),
    b AS (SELECT *, CAST({place} AS DOUBLE) AS p FROM a),
    c AS (SELECT o_orderstatus, q, least(greatest({lo}, 0), n - 1) AS lo, least(greatest({lo} + 1, 0), n - 1) AS hi, {part} AS part FROM b)
    SELECT c.o_orderstatus, c.q, '{method}' AS method, round(CASE WHEN part > 0 THEN u.x + (v.x - u.x) * part ELSE u.x END, 4) AS value
    FROM c JOIN s u ON u.o_orderstatus = c.o_orderstatus AND u.i = c.lo JOIN s v ON v.o_orderstatus = c.o_orderstatus AND v.i = c.hi
    """


for _method in (*S.CONTINUOUS, *S.DISCRETE):

    def _plan(spark: SparkSession, d: str, method: str = _method) -> DataFrame:
        got = S.quantiles(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", [0.0, 0.25, 0.5, 0.9, 1.0], method)
        return got.select("o_orderstatus", "q", F.lit(method).alias("method"), F.round("value", 4).alias("value"))

    REGISTRY.add(f"stats_quantile_{_method}" if _method != "linear" else "stats_quantile_hf7", "2.4", _quantile_sql(_method))(_plan)


@REGISTRY.add(
    "stats_mode",
    "2.4",
    "WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS k FROM c) SELECT p_brand, p_size AS mode, n FROM r WHERE k = 1",
)
def stats_mode(spark: SparkSession, d: str) -> DataFrame:
    return S.mode(table(spark, d, "part"), ["p_brand"], "p_size")


@REGISTRY.add(
    "stats_ranks",
    "2.5",
    """
    WITH c AS (SELECT c_custkey, c_mktsegment, round(c_acctbal / 100) AS b FROM customer)
    SELECT c_custkey, c_mktsegment, b, rank() OVER w + (count(*) OVER (PARTITION BY c_mktsegment, b) - 1) / 2.0 AS average, rank() OVER w AS min_rank,
           rank() OVER w + count(*) OVER (PARTITION BY c_mktsegment, b) - 1 AS max_rank, dense_rank() OVER w AS dense, row_number() OVER (PARTITION BY c_mktsegment ORDER BY b, c_custkey) AS ordinal
    FROM c WINDOW w AS (PARTITION BY c_mktsegment ORDER BY b)
    """,
)
def stats_ranks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.round(F.col("c_acctbal") / 100).alias("b"))
    return S.ranks(c, ["c_mktsegment"], "b", "c_custkey")


@REGISTRY.add(
    "stats_correlation",
    "2.4",
    "SELECT l_returnflag, round(covar_pop(l_quantity, l_extendedprice), 3) AS covariance, round(covar_samp(l_quantity, l_extendedprice), 3) AS sample_covariance, round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem GROUP BY 1",
)
def stats_correlation(spark: SparkSession, d: str) -> DataFrame:
    got = S.correlation(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return got.select("l_returnflag", F.round("covariance", 3).alias("covariance"), F.round("sample_covariance", 3).alias("sample_covariance"), F.round("pearson", 6).alias("pearson"))


@REGISTRY.add(
    "stats_spearman",
    "2.5",
    """
    WITH r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS a,
                      rank() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY c_mktsegment, o_totalprice) - 1) / 2.0 AS b
               FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT c_mktsegment, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1
    """,
)
def stats_spearman(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(S.spearman(both, ["c_mktsegment"], "c_acctbal", "o_totalprice"))


@REGISTRY.add(
    "stats_kendall",
    "2.5",
    """
    WITH s AS (SELECT s_suppkey AS k, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier),
    p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS c, a.x = b.x AS tx, a.y = b.y AS ty FROM s a JOIN s b ON a.k < b.k)
    SELECT round(sum(c) / sqrt(CAST(count(*) FILTER (WHERE NOT tx) AS DOUBLE) * count(*) FILTER (WHERE NOT ty)), 6) AS tau_b FROM p
    """,
)
def stats_kendall(spark: SparkSession, d: str) -> DataFrame:
    """Tau-b over all pairs of suppliers: a quadratic statistic, so for tables of bounded size."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    b = s.select(F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = s.join(b, F.col("k") < F.col("k2"))
    c = F.signum(F.col("x") - F.col("x2")) * F.signum(F.col("y") - F.col("y2"))
    den = F.sqrt(F.count_if(F.col("x") != F.col("x2")).cast("double") * F.count_if(F.col("y") != F.col("y2")))
    return pairs.agg(F.round(F.sum(c) / den, 6).alias("tau_b"))


@REGISTRY.add(
    "stats_histogram",
    "2.4",
    """
    WITH b AS (SELECT CASE WHEN l_extendedprice BETWEEN 1000 AND 80000 THEN least(floor((l_extendedprice - 1000) / 7900.0), 9) ELSE -1 END AS bin FROM lineitem),
    c AS (SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY 1)
    SELECT r.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(-1, 10)) AS bin) r LEFT JOIN c USING (bin)
    """,
)
def stats_histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.histogram(table(spark, d, "lineitem"), "l_extendedprice", 1000.0, 80000.0, 10)


@REGISTRY.add(
    "stats_ecdf",
    "2.4",
    "WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_quantity, round(sum(c) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / sum(c) OVER (PARTITION BY l_returnflag), 6) AS probability FROM c",
)
def stats_ecdf(spark: SparkSession, d: str) -> DataFrame:
    got = S.ecdf(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")
    return got.withColumn("probability", F.round("probability", 6))


@REGISTRY.add(
    "stats_kde_grid",
    "2.4",
    "SELECT x AS grid, round(avg(exp(-power((x - o_totalprice) / 20000, 2) / 2) / (20000 * sqrt(2 * pi()))) * 1e6, 6) AS density FROM orders, (SELECT CAST(unnest(range(0, 500000, 50000)) AS DOUBLE) AS x) GROUP BY 1",
)
def stats_kde_grid(spark: SparkSession, d: str) -> DataFrame:
    got = S.kde(table(spark, d, "orders"), "o_totalprice", [float(x) for x in range(0, 500000, 50000)], 20000.0)
    return got.select(F.col("at").alias("grid"), F.round(F.col("density") * 1e6, 6).alias("density"))


@REGISTRY.add(
    "stats_zscore",
    "2.4",
    "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag)) / stddev_pop(l_quantity) OVER (PARTITION BY l_returnflag), 5) AS z FROM lineitem",
)
def stats_zscore(spark: SparkSession, d: str) -> DataFrame:
    got = S.zscore(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", ["l_orderkey", "l_linenumber"])
    return got.withColumn("z", F.round("z", 5))


@REGISTRY.add(
    "stats_transforms",
    "2.8",
    """
    SELECT o_orderkey, round((power(o_totalprice, 0.5) - 1) / 0.5, 4) AS box_cox, round(ln(o_totalprice + 1), 6) AS yeo_johnson,
           round(1 / (1 + exp(-(o_totalprice - 150000) / 50000)), 6) AS sigmoid,
           round(CASE WHEN abs(o_totalprice - 150000) <= 1000 THEN 0.5 * power(o_totalprice - 150000, 2) ELSE 1000 * (abs(o_totalprice - 150000) - 500) END, 2) AS huber,
           round(greatest(0.9 * (o_totalprice - 150000), -0.1 * (o_totalprice - 150000)), 4) AS pinball
    FROM orders
    """,
)
def stats_transforms(spark: SparkSession, d: str) -> DataFrame:
    from sparkwright.functions import guards as G

    x = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.round(G.box_cox(x, 0.5), 4).alias("box_cox"),
        F.round(G.yeo_johnson(x, 0.0), 6).alias("yeo_johnson"),
        F.round(G.sigmoid((x - 150000) / 50000), 6).alias("sigmoid"),
        F.round(G.huber(x - 150000, 1000.0), 2).alias("huber"),
        F.round(G.pinball(x - 150000, 0.9), 4).alias("pinball"),
    )

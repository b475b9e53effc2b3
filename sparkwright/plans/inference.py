"""Queries of paired, rank, contingency and sequential tests, survival comparison, privacy and keyed randomisation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import inference as I
from sparkwright.operators import sequences as Q
from sparkwright.plans.sequences import _DAYS, _days
from sparkwright.plans.stats import rounded
from sparkwright.registry import REGISTRY
from sparkwright.session import table


def _u(key: str, seed: str) -> str:
    """md5_uniform in DuckDB."""
    return f"(CAST(concat('0x', substring(md5(concat(CAST({key} AS VARCHAR), '-{seed}')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


@REGISTRY.add("test_paired_t", "2.13", "WITH s AS (SELECT count(*) AS n, avg(l_discount - l_tax) AS mean, stddev_samp(l_discount - l_tax) AS sd FROM lineitem) SELECT n, round(mean, 6) AS mean, round(mean * sqrt(n) / sd, 4) AS t, n - 1 AS freedom FROM s")
def test_paired_t(spark: SparkSession, d: str) -> DataFrame:
    r = I.paired_t(table(spark, d, "lineitem"), "l_discount", "l_tax")
    return r.select("n", F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"), "freedom")


@REGISTRY.add(
    "test_wilcoxon",
    "2.13",
    """WITH x AS (SELECT round(100 * (l_discount - l_tax)) AS d FROM lineitem), c AS (SELECT abs(d) AS a, CAST(count(*) AS DOUBLE) AS c, CAST(count(*) FILTER (d > 0) AS DOUBLE) AS up FROM x WHERE d <> 0 GROUP BY 1), r AS (SELECT c, up, sum(c) OVER (ORDER BY a) - (c - 1) / 2 AS r FROM c),
    s AS (SELECT sum(c) AS n, sum(up * r) AS wp, sum((c - up) * r) AS wm, sum(power(c, 3) - c) AS ties FROM r)
    SELECT CAST(n AS BIGINT) AS n, wp AS w_plus, wm AS w_minus, round((wp - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 5) AS z FROM s""",
)
def test_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.wilcoxon_signed_rank(table(spark, d, "lineitem"), F.round(100 * (F.col("l_discount") - F.col("l_tax")))), 5)


@REGISTRY.add(
    "test_fisher",
    "2.13",
    """WITH t AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic <> 1) AS b, count(*) FILTER (quality <> 1 AND toxic = 1) AS c, count(*) FILTER (quality <> 1 AND toxic <> 1) AS e FROM labels),
    x AS (SELECT a, b, c, e, unnest(range(greatest(a + b + a + c - (a + b + c + e), 0), least(a + b, a + c) + 1)) AS x FROM t),
    l AS (SELECT a, b, c, e, x, lgamma(a + b + 1) + lgamma(c + e + 1) + lgamma(a + c + 1) + lgamma(b + e + 1) - lgamma(a + b + c + e + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(e - a + x + 1) AS l FROM x)
    SELECT a AS n11, b AS n10, c AS n01, e AS n00, CASE WHEN b * c > 0 THEN round(a * e / CAST(b * c AS DOUBLE), 6) ELSE 'nan'::DOUBLE END AS odds_ratio, round(sum(exp(l)) FILTER (l <= (SELECT max(l) FROM l m WHERE m.x = m.a) + 1e-7), 8) AS p FROM l GROUP BY a, b, c, e""",
)
def test_fisher(spark: SparkSession, d: str) -> DataFrame:
    r = I.fisher_exact(table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return r.withColumns({"odds_ratio": F.round("odds_ratio", 6), "p": F.round("p", 8)})


@REGISTRY.add("test_mcnemar", "2.13", "WITH s AS (SELECT count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') AS b, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS c FROM lineitem) SELECT b, c, round(power(greatest(abs(b - c) - 1, 0), 2) / (b + c), 5) AS statistic FROM s")
def test_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.mcnemar(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"), 5)


@REGISTRY.add(
    "test_friedman",
    "2.13",
    """WITH m AS (SELECT l_suppkey AS s, l_returnflag AS t, round(avg(l_quantity), 1) AS x FROM lineitem GROUP BY 1, 2), r AS (SELECT s, t, rank() OVER (PARTITION BY s ORDER BY x) + (count(*) OVER (PARTITION BY s, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY s) AS k, CAST(count(*) OVER (PARTITION BY s, x) AS DOUBLE) AS ties FROM m), f AS (SELECT * FROM r WHERE k = (SELECT max(k) FROM r)),
    g AS (SELECT t, sum(r) AS s, CAST(count(*) AS DOUBLE) AS n FROM f GROUP BY 1), q AS (SELECT max(n) AS n, CAST(count(*) AS DOUBLE) AS m, sum(s * s) AS q FROM g), c AS (SELECT sum(ties * ties - 1) AS c FROM f)
    SELECT CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS k, round((12 * q / (n * m * (m + 1)) - 3 * n * (m + 1)) / (1 - c / (n * m * (m * m - 1))), 5) AS statistic FROM q, c""",
)
def test_friedman(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as blocks, return flags as treatments, mean quantities as values."""
    m = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_quantity"), 1).alias("x"))
    return rounded(I.friedman(m, "l_suppkey", "l_returnflag", "x"), 5)


@REGISTRY.add(
    "test_ljung_box",
    "2.13",
    f"""WITH {_DAYS}, c AS (SELECT row_number() OVER (ORDER BY i) AS k, x - avg(x) OVER () AS c FROM t), r AS (SELECT l, (SELECT sum(a.c * b.c) FROM c a JOIN c b ON b.k = a.k + l) / (SELECT sum(c * c) FROM c) AS rho FROM (SELECT unnest(range(1, 6)) AS l)), n AS (SELECT count(*) AS n FROM c)
    SELECT count(*) AS lags, round(any_value(n) * (any_value(n) + 2) * sum(rho * rho / (n - l)), 4) AS statistic FROM r, n""",
)
def test_ljung_box(spark: SparkSession, d: str) -> DataFrame:
    days = _days(spark, d).withColumn("series", F.lit("all"))
    return rounded(I.ljung_box(Q.autocorrelation(days, ["series"], ["i"], "x", 5), days.count(), 5), 4)


@REGISTRY.add(
    "surv_log_rank",
    "2.13",
    """WITH c AS (SELECT l_quantity AS t, CAST(count(*) AS DOUBLE) AS c, CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) AS cg, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS d, CAST(count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS DOUBLE) AS dg FROM lineitem GROUP BY 1),
    r AS (SELECT d, dg, sum(c) OVER (ORDER BY t DESC) AS n, sum(cg) OVER (ORDER BY t DESC) AS ng FROM c), s AS (SELECT sum(dg) AS o, sum(d * ng / n) AS e, sum(CASE WHEN n > 1 THEN d * (ng / n) * (1 - ng / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM r WHERE d > 0)
    SELECT o AS observed, round(e, 4) AS expected, round(v, 4) AS variance, round(power(o - e, 2) / v, 4) AS statistic FROM s""",
)
def surv_log_rank(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("event", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(I.log_rank(li, F.col("l_linestatus") == "F", "l_quantity", "event"), 4)


_P0, _P1 = 0.4, 0.6
_UP, _DOWN = math.log(0.95 / 0.05), math.log(0.05 / 0.95)


@REGISTRY.add(
    "seq_sprt",
    "2.9",
    f"""WITH r AS (SELECT user_id, sum(CASE WHEN value > 50 THEN {math.log(_P1 / _P0)!r}::DOUBLE ELSE {math.log((1 - _P1) / (1 - _P0))!r}::DOUBLE END) OVER w AS ratio, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT user_id, coalesce(min(n) FILTER (ratio >= {_UP!r}::DOUBLE OR ratio <= {_DOWN!r}::DOUBLE), max(n)) AS n FROM r GROUP BY 1)
    SELECT user_id, n, round(ratio, 6) AS ratio, CASE WHEN ratio >= {_UP!r}::DOUBLE THEN 'p1' WHEN ratio <= {_DOWN!r}::DOUBLE THEN 'p0' ELSE 'open' END AS decision FROM r JOIN f USING (user_id, n)""",
)
def seq_sprt(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.sequential_ratio(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 50, _P0, _P1, 0.05, 0.05))


@REGISTRY.add(
    "seq_confidence",
    "2.9",
    """WITH r AS (SELECT user_id, event_id, count(*) OVER w AS n, avg(CAST(value > 50 AS INTEGER)) OVER w AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id, event_id, n, round(mean, 6) AS mean, round(mean - sqrt(ln(2.0::DOUBLE * n * (n + 1) / 0.05) / (2.0 * n)), 5) AS lower, round(mean + sqrt(ln(2.0::DOUBLE * n * (n + 1) / 0.05) / (2.0 * n)), 5) AS upper FROM r""",
)
def seq_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("hit", (F.col("value") > 50).cast("int"))
    r = I.confidence_sequence(e, ["user_id"], ["ts", "event_id"], "hit", 0.0, 1.0, 0.05)
    return r.select("user_id", "event_id", "n", F.round("mean", 6).alias("mean"), F.round("lower", 5).alias("lower"), F.round("upper", 5).alias("upper"))


@REGISTRY.add(
    "test_sign_flip",
    "2.13",
    f"""WITH x AS (SELECT c_custkey AS k, c_acctbal - 4500 AS d FROM customer), b AS (SELECT unnest(range(0, 51)) AS b), s AS (SELECT b, sum(d * CASE WHEN b = 0 OR {_u("CAST(k AS VARCHAR) || '/' || CAST(b AS VARCHAR)", "flip")} < 0.5 THEN 1 ELSE -1 END) AS s FROM x, b GROUP BY 1), o AS (SELECT s AS own FROM s WHERE b = 0)
    SELECT round(any_value(own), 2) AS statistic, round(count(*) FILTER (abs(s) >= abs(own) - 1e-9) / 51.0, 6) AS p FROM s, o""",
)
def test_sign_flip(spark: SparkSession, d: str) -> DataFrame:
    r = I.sign_flip_test(table(spark, d, "customer"), "c_custkey", F.col("c_acctbal") - 4500, 50)
    return r.select(F.round("statistic", 2).alias("statistic"), F.round("p", 6).alias("p"))


_KEEP = math.exp(1.0) / (1 + math.exp(1.0))


@REGISTRY.add(
    "privacy_randomised_response",
    "2.13",
    f"WITH s AS (SELECT CASE WHEN {_u('o_orderkey', 'response')} < {_KEEP!r}::DOUBLE THEN o_orderstatus = 'F' ELSE o_orderstatus <> 'F' END AS said FROM orders), a AS (SELECT count(*) AS n, avg(CAST(said AS INTEGER)) AS r FROM s) SELECT n, round(r, 6) AS reported, round((r - {1 - _KEEP!r}::DOUBLE) / {2 * _KEEP - 1!r}::DOUBLE, 6) AS estimate FROM a",
)
def privacy_randomised_response(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.randomised_response(table(spark, d, "orders"), "o_orderkey", F.col("o_orderstatus") == "F", 1.0))


@REGISTRY.add(
    "privacy_noisy_sums",
    "2.13",
    f"""WITH s AS (SELECT c_mktsegment, sum(greatest(least(c_acctbal, 5000), -5000)) AS s FROM customer GROUP BY 1)
    SELECT c_mktsegment, round(s + 2.0 * 5000 * sqrt(-2 * ln(greatest({_u("c_mktsegment", "noisea")}, power(2.0, -33)))) * cos(2 * pi() * {_u("c_mktsegment", "noiseb")}), 3) AS total FROM s""",
)
def privacy_noisy_sums(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.clipped_noisy_sums(table(spark, d, "customer"), ["c_mktsegment"], "c_custkey", "c_acctbal", 5000.0, 2.0), 3)


@REGISTRY.add("sample_permutation", "2.6", f"SELECT s_suppkey, row_number() OVER (ORDER BY {_u('s_suppkey', 'shuffle')}, s_suppkey) AS place FROM supplier")
def sample_permutation(spark: SparkSession, d: str) -> DataFrame:
    """A keyed permutation, equal keyed numbers in the order of the key; ranges of the number are numbered each by itself."""
    from sparkwright.operators.running import running_totals
    from sparkwright.storage import stored

    s = stored(table(spark, d, "supplier").select("s_suppkey", I.md5_uniform(F.col("s_suppkey"), "shuffle").alias("u"), F.lit(1).alias("one")), "permutation")
    return running_totals(s, "u", ["one"], then=["s_suppkey"]).select("s_suppkey", F.col("upto_one").alias("place"))


@REGISTRY.add("sample_choice", "2.6", f"SELECT p_partkey FROM part ORDER BY {_u('p_partkey', 'choice')}, p_partkey LIMIT 25")
def sample_choice(spark: SparkSession, d: str) -> DataFrame:
    """Twenty-five parts without replacement (a sampling operator)."""
    return table(spark, d, "part").orderBy(I.md5_uniform(F.col("p_partkey"), "choice"), "p_partkey").limit(25).select("p_partkey")


@REGISTRY.add("tab_shuffle_split", "2.17", f"SELECT doc_id, {_u('doc_id', 'split')} < 0.25 AS test FROM labels")
def tab_shuffle_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", (I.md5_uniform(F.col("doc_id"), "split") < 0.25).alias("test"))


@REGISTRY.add(
    "tab_oversample",
    "2.17",
    f"""WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), m AS (SELECT max(n) AS m FROM c), r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {_u('doc_id', 'over')}, doc_id) - 1 AS r FROM labels)
    SELECT doc_id, toxic, CAST(m // n + CASE WHEN r < m % n THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r JOIN c USING (toxic), m""",
)
def tab_oversample(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each class repeated until all classes are as large as the largest, evenly, in a keyed order."""
    from pyspark.sql import Window

    rows = table(spark, d, "labels").select("doc_id", "toxic")
    counts = rows.groupBy("toxic").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("m"))
    r = rows.withColumn("r", F.row_number().over(Window.partitionBy("toxic").orderBy(I.md5_uniform(F.col("doc_id"), "over"), "doc_id")) - 1)
    both = r.join(counts, "toxic").crossJoin(F.broadcast(most))
    return both.select("doc_id", "toxic", (F.expr("m div n") + F.when(F.col("r") < F.col("m") % F.col("n"), 1).otherwise(0)).alias("copies"))


@REGISTRY.add("graph_erdos_renyi", "2.15", f"SELECT a.i AS src, b.i AS dst FROM (SELECT unnest(range(0, 60)) AS i) a JOIN (SELECT unnest(range(0, 60)) AS i) b ON a.i < b.i WHERE {_u('a.i * 60 + b.i', 'er')} < 0.1")
def graph_erdos_renyi(spark: SparkSession, d: str) -> DataFrame:
    """A random graph of 60 nodes: each pair is an edge with probability 0.1."""
    n = 60
    p = spark.range(n * n).select(F.floor(F.col("id") / n).alias("src"), (F.col("id") % n).alias("dst"), "id").where("src < dst")
    return p.where(I.md5_uniform(F.col("id"), "er") < 0.1).select("src", "dst")


@REGISTRY.add(
    "graph_block_model",
    "2.15",
    f"SELECT a.i AS src, b.i AS dst, a.i // 20 = b.i // 20 AS inside FROM (SELECT unnest(range(0, 60)) AS i) a JOIN (SELECT unnest(range(0, 60)) AS i) b ON a.i < b.i WHERE {_u('a.i * 60 + b.i', 'sbm')} < CASE WHEN a.i // 20 = b.i // 20 THEN 0.4 ELSE 0.02 END",
)
def graph_block_model(spark: SparkSession, d: str) -> DataFrame:
    """Three blocks of 20 nodes: pairs inside a block are edges with probability 0.4, others with 0.02."""
    n, size = 60, 20
    p = spark.range(n * n).select(F.floor(F.col("id") / n).alias("src"), (F.col("id") % n).alias("dst"), "id").where("src < dst")
    p = p.withColumn("inside", F.floor(F.col("src") / size) == F.floor(F.col("dst") / size))
    return p.where(I.md5_uniform(F.col("id"), "sbm") < F.when(F.col("inside"), 0.4).otherwise(0.02)).select("src", "dst", "inside")

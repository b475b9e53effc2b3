"""Hypothesis tests: statistics from one aggregation, p-values from special functions on the result."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.functions.guards import entropy_term


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def incomplete_gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(s, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1.0 / s
        for k in range(1, 2000):
            term *= x / (s + k)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - front * total)
    b, c, d = x + 1 - s, 1e300, 1.0 / (x + 1 - s)
    h = d
    for k in range(1, 2000):
        a = -k * (k - s)
        b += 2
        d, c = 1.0 / (a * d + b), b + a / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_two_sided(t: float, freedom: float) -> float:
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, freedom: float) -> float:
    return incomplete_gamma_upper(freedom / 2, x / 2)


def kolmogorov_upper(x: float) -> float:
    """Limit law of the two-sample statistic."""
    return 1.0 if x <= 0 else max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def _udf(law, *columns: Column) -> Column:
    """A law over one or a few rows of statistics."""

    @F.pandas_udf(T.DoubleType())
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([law(*map(float, row)) if all(v is not None and v == v for v in row) else float("nan") for row in zip(*series, strict=True)])

    return run(*columns)


def p_normal(z: Column) -> Column:
    return _udf(normal_two_sided, z)


def p_t(t: Column, freedom: Column) -> Column:
    return _udf(t_two_sided, t, freedom)


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _udf(f_upper, f, d1, d2)


def p_chi2(x: Column, freedom: Column) -> Column:
    return _udf(chi2_upper, x, freedom)


def p_kolmogorov(x: Column) -> Column:
    return _udf(kolmogorov_upper, x)


def welch_t(df: DataFrame, group: Column, x: str) -> DataFrame:
    """Two-sample t statistic of rows where ``group`` is true against the others, unequal variances."""
    a, b = F.when(group, F.col(x)), F.when(~group, F.col(x))
    s = df.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    return s.select((F.col("ma") - F.col("mb")).alias("estimate"), ((F.col("ma") - F.col("mb")) / F.sqrt(ea + eb)).alias("t"), (F.pow(ea + eb, F.lit(2.0)) / (ea * ea / (F.col("na") - 1) + eb * eb / (F.col("nb") - 1))).alias("freedom"))


def one_way_anova(df: DataFrame, group: str, x: str) -> DataFrame:
    g = df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    s = g.agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("s2") - F.col("s1") * F.col("s1") / F.col("total")
    d1, d2 = F.col("k") - 1, F.col("total") - F.col("k")
    return s.select(((between / d1) / (F.col("within") / d2)).alias("f"), d1.alias("d1"), d2.alias("d2"), (between / (between + F.col("within"))).alias("eta_squared"))


def ks_two_sample(df: DataFrame, group: Column, x: str) -> DataFrame:
    """Largest difference of two empirical distribution functions, over the distinct values."""
    c = df.groupBy(x).agg(F.count_if(group).alias("a"), F.count_if(~group).alias("b"))
    w, every = Window.orderBy(x), Window.partitionBy()
    d = F.abs(F.sum("a").over(w) / F.sum("a").over(every) - F.sum("b").over(w) / F.sum("b").over(every))
    r = c.select(d.alias("d"), F.sum("a").over(every).alias("na"), F.sum("b").over(every).alias("nb"))
    return r.agg(F.max("d").alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))


def mann_whitney(df: DataFrame, group: Column, x: str) -> DataFrame:
    """U of the rows where ``group`` is true, and its normal score with the correction for ties. Distinct values carry
    counts, so ranks need no sort of the rows."""
    c = df.groupBy(x).agg(F.count_if(group).cast("double").alias("a"), F.count("*").cast("double").alias("c"))
    upto = F.sum("c").over(Window.orderBy(x))
    r = c.select("a", "c", (upto - (F.col("c") - 1) / 2).alias("rank"))
    s = r.agg(F.sum(F.col("a") * F.col("rank")).alias("ra"), F.sum("a").alias("na"), F.sum(F.col("c") - F.col("a")).alias("nb"), F.sum(F.pow("c", F.lit(3.0)) - F.col("c")).alias("ties"))
    n = F.col("na") + F.col("nb")
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    spread = F.sqrt(F.col("na") * F.col("nb") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return s.select(u.alias("u"), ((u - F.col("na") * F.col("nb") / 2) / spread).alias("z"))


def two_proportions(df: DataFrame, group: Column, hit: Column) -> DataFrame:
    s = df.agg(F.count_if(group & hit).cast("double").alias("xa"), F.count_if(group).alias("na"), F.count_if(~group & hit).cast("double").alias("xb"), F.count_if(~group).alias("nb"))
    pa, pb, p = F.col("xa") / F.col("na"), F.col("xb") / F.col("nb"), (F.col("xa") + F.col("xb")) / (F.col("na") + F.col("nb"))
    return s.select(pa.alias("pa"), pb.alias("pb"), ((pa - pb) / F.sqrt(p * (1 - p) * (1 / F.col("na") + 1 / F.col("nb")))).alias("z"))


def wilson_interval(df: DataFrame, by: list[str], hit: Column, z: float = 1.959963984540054) -> DataFrame:
    s = df.groupBy(*by).agg(F.avg(hit.cast("int")).alias("p"), F.count("*").alias("n"))
    mid = (F.col("p") + z * z / (2 * F.col("n"))) / (1 + z * z / F.col("n"))
    arm = z / (1 + z * z / F.col("n")) * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))
    return s.select(*by, "p", (mid - arm).alias("low"), (mid + arm).alias("high"))


def information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Entropies, joint and conditional entropy and mutual information in nats."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    t = F.broadcast(cells.agg(F.sum("n").alias("t")))
    h = lambda d: d.crossJoin(t).agg(F.sum(entropy_term(F.col("n") / F.col("t"))).alias("h"))
    joint = h(cells).withColumnRenamed("h", "joint")
    ha = h(cells.groupBy(a).agg(F.sum("n").alias("n"))).withColumnRenamed("h", "ha")
    hb = h(cells.groupBy(b).agg(F.sum("n").alias("n"))).withColumnRenamed("h", "hb")
    r = joint.crossJoin(ha).crossJoin(hb)
    return r.select("ha", "hb", "joint", (F.col("joint") - F.col("ha")).alias("b_given_a"), (F.col("ha") + F.col("hb") - F.col("joint")).alias("mutual_information"))


def divergences(df: DataFrame, value: str, group: Column) -> DataFrame:
    """Between the distributions of a value in two groups: total variation, Hellinger, Jensen-Shannon, smoothed KL (nats)."""
    c = df.groupBy(value).agg(F.count_if(group).alias("a"), F.count_if(~group).alias("b"))
    t = F.broadcast(c.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count("*").alias("k")))
    p, q = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log(F.when(x > 0, x) / m)).otherwise(0.0)
    sp, sq = (F.col("a") + 0.5) / (F.col("ta") + 0.5 * F.col("k")), (F.col("b") + 0.5) / (F.col("tb") + 0.5 * F.col("k"))
    return c.crossJoin(t).agg(
        (F.sum(F.abs(p - q)) / 2).alias("total_variation"),
        F.sqrt(F.greatest(1 - F.sum(F.sqrt(p * q)), F.lit(0.0))).alias("hellinger"),
        (F.sum(part(p) + part(q)) / 2).alias("jensen_shannon"),
        F.sum(sp * F.log(sp / sq)).alias("kl"),
    )


def keyed_uniform(key: Column, seed: int) -> Column:
    """Uniform in [0, 1) that depends on the key and seed only, not on partitions or order."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def laplace_counts(df: DataFrame, by: list[str], epsilon: float, seed: int = 0) -> DataFrame:
    """Counts with Laplace noise of scale 1 / epsilon, drawn by the group's key."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    u = keyed_uniform(F.xxhash64(*by), seed) - 0.5
    return counts.withColumn("noisy", F.col("n") - F.signum(u) * F.log(1 - 2 * F.abs(u) + 1e-300) / epsilon)


def poisson_bootstrap(df: DataFrame, key: str, x: str, repeats: int, seed: int = 0) -> DataFrame:
    """Bootstrap means with Poisson(1) weights keyed by row and repeat: one pass, no resampled copies."""
    u = keyed_uniform(F.xxhash64(key, "b"), seed)
    # fixed values: the Poisson(1) distribution function
    weight = F.lit(0)
    for bound in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183):
        weight = weight + F.when(u >= bound, 1).otherwise(0)
    rows = df.select(key, x, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("b")).withColumn("w", weight)
    return rows.groupBy("b").agg((F.sum(F.col("w") * F.col(x)) / F.sum("w")).alias("mean"))

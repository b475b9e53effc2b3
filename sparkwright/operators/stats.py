"""Descriptive statistics: moments, quantiles, ranks, correlation, histograms and densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.guards import NAN, ratio

#: (alpha, beta) of the continuous quantile definitions: position n q + alpha + q (1 - alpha - beta) - 1, from 0.
CONTINUOUS = {
    "linear": (1.0, 1.0),
    "interpolated": (0.0, 1.0),
    "hazen": (0.5, 0.5),
    "weibull": (0.0, 0.0),
    "median_unbiased": (1 / 3, 1 / 3),
    "normal_unbiased": (3 / 8, 3 / 8),
}
#: Methods that take one of the sorted values.
DISCRETE = ("inverted", "averaged_inverted", "closest", "lower", "higher", "nearest", "midpoint")


def moments(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """n, mean, population variance and deviation, skewness g1, excess kurtosis g2 per group; NaN for constant groups."""
    spread = F.stddev_pop(x) > 0
    return df.groupBy(*by).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.var_pop(x).alias("variance"),
        F.stddev_pop(x).alias("std"),
        F.when(spread, F.skewness(x)).otherwise(NAN).alias("skewness"),
        F.when(spread, F.kurtosis(x)).otherwise(NAN).alias("kurtosis"),
    )


def weighted_moments(df: DataFrame, by: list[str], x: str, w: str) -> DataFrame:
    """Weighted mean and its population, frequency and reliability variances, from power sums."""
    c, k = F.col(x), F.col(w)
    s = df.groupBy(*by).agg(F.sum(k).alias("w1"), F.sum(k * k).alias("w2"), F.sum(k * c).alias("s1"), F.sum(k * c * c).alias("s2"))
    mean = ratio(F.col("s1"), F.col("w1"))
    around = F.col("s2") - F.col("s1") * mean
    return s.select(
        *by,
        mean.alias("mean"),
        ratio(around, F.col("w1")).alias("population"),
        ratio(around, F.col("w1") - 1).alias("frequency"),
        ratio(around, F.col("w1") - ratio(F.col("w2"), F.col("w1"))).alias("reliability"),
    )


def mode(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """The most frequent value, the smallest of several, with its count."""
    counts = df.groupBy(*by, x).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.max(F.struct("n", (-F.col(x)).alias("neg"))).alias("best")).select(*by, (-F.col("best.neg")).alias("mode"), F.col("best.n").alias("n"))


def quantiles(df: DataFrame, by: list[str], x: str, qs: list[float], method: str = "linear") -> DataFrame:
    """Quantiles by any of the 13 definitions, one row per group and level. Distinct values carry counts, so a value's
    repeats cost one row; places are found from running counts."""
    if method not in CONTINUOUS and method not in DISCRETE:
        raise ValueError(f"unknown quantile method {method}")
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(x)
    run = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*by))).withColumn("from", F.col("upto") - F.col("c"))
    levels = F.explode(F.array(*(F.lit(float(q)) for q in qs)))
    asked = run.withColumn("q", levels)
    n, q = F.col("n"), F.col("q")
    if method in CONTINUOUS:
        a, b = CONTINUOUS[method]
        place = n * q + a + q * (1 - a - b) - 1
        lo, hi, part = F.floor(place), F.floor(place) + 1, place - F.floor(place)
    else:
        place = {"inverted": n * q - 1, "averaged_inverted": n * q - 1, "closest": n * q - 1.5}.get(method, (n - 1) * q)
        below, over = F.floor(place), place - F.floor(place)
        even = below % 2 == 0
        if method == "inverted":
            lo, part = below + F.when(over > 0, 1).otherwise(0), F.lit(0.0)
        elif method == "averaged_inverted":
            lo, part = below + F.when(over > 0, 1).otherwise(0), F.when(over > 0, 0.0).otherwise(0.5)
        elif method == "closest":
            lo, part = below + F.when((over > 0) | (below % 2 != 0), 1).otherwise(0), F.lit(0.0)
        elif method == "lower":
            lo, part = below, F.lit(0.0)
        elif method == "higher":
            lo, part = F.ceil(place), F.lit(0.0)
        elif method == "nearest":
            lo, part = F.when(over < 0.5, below).when(over > 0.5, below + 1).when(even, below).otherwise(below + 1), F.lit(0.0)
        else:
            lo, part = below, F.when(over > 0, 0.5).otherwise(0.0)
        hi = lo + 1
    last = n - 1
    lo, hi = (F.least(F.greatest(v, F.lit(0)), last) for v in (lo, hi))
    held = asked.select(*by, "q", x, "from", "upto", lo.alias("lo"), hi.alias("hi"), part.alias("part"))

    def at(place: str) -> Column:
        return F.max(F.when((F.col("from") <= F.col(place)) & (F.col(place) < F.col("upto")), F.col(x)))

    both = held.groupBy(*by, "q").agg(at("lo").alias("a"), at("hi").alias("b"), F.first("part").alias("part"))
    return both.select(*by, "q", F.when(F.col("part") > 0, F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).otherwise(F.col("a")).alias("value"))


def ranks(df: DataFrame, by: list[str], x: str, order: str) -> DataFrame:
    """Five tie policies: average, min, max, dense, ordinal (ties in the order of ``order``)."""
    w = Window.partitionBy(*by).orderBy(x)
    ties = F.count("*").over(Window.partitionBy(*by, x))
    low = F.rank().over(w)
    return df.select(
        "*",
        (low + (ties - 1) / 2.0).alias("average"),
        low.cast("long").alias("min_rank"),
        (low + ties - 1).alias("max_rank"),
        F.dense_rank().over(w).cast("long").alias("dense"),
        F.row_number().over(Window.partitionBy(*by).orderBy(x, order)).cast("long").alias("ordinal"),
    )


def correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Population and sample covariance and Pearson correlation; NaN if a side is constant."""
    apart = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return df.groupBy(*by).agg(
        F.covar_pop(x, y).alias("covariance"),
        F.covar_samp(x, y).alias("sample_covariance"),
        F.when(apart, F.corr(x, y)).otherwise(NAN).alias("pearson"),
    )


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks."""

    def rank_of(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0

    ranked = df.select(*by, rank_of(x).alias("rx"), rank_of(y).alias("ry"))
    return correlation(ranked, by, "rx", "ry").select(*by, F.col("pearson").alias("spearman"))


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """Counts of equal bins of [low, high], the last closed; bin -1 holds what was dropped (outside or NaN). Empty bins
    are present."""
    c = F.col(x)
    inside = (c >= low) & (c <= high) & ~F.isnan(c)
    place = F.when(inside, F.least(F.floor((c - low) / ((high - low) / bins)), F.lit(bins - 1))).otherwise(-1)
    counts = df.where(c.isNotNull()).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(-1, bins).withColumnRenamed("id", "bin")
    return frame.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def ecdf(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """The steps of the empirical distribution function: value and probability."""
    counts = df.groupBy(*by, x).agg(F.count("*").alias("c"))
    run = F.sum("c").over(Window.partitionBy(*by).orderBy(x))
    return counts.select(*by, x, (run / F.sum("c").over(Window.partitionBy(*by))).alias("probability"))


def kde(df: DataFrame, x: str, grid: list[float], bandwidth: float) -> DataFrame:
    """Gaussian kernel density on a stated grid: every row adds to each grid point in one aggregation."""
    scale = bandwidth * (2 * 3.141592653589793) ** 0.5
    points = F.array(*(F.lit(float(g)) for g in grid))
    rows = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x"), F.explode(points).alias("at"))
    kernel = F.exp(-F.pow((F.col("at") - F.col("x")) / bandwidth, F.lit(2.0)) / 2) / scale
    return rows.groupBy("at").agg(F.avg(kernel).alias("density"))


def zscore(df: DataFrame, by: list[str], x: str, keep: list[str]) -> DataFrame:
    """(x - mean) / population deviation of the group; 0 for constant groups. Group sums are joined, not windowed."""
    sums = df.groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    return df.join(sums, by).select(*keep, F.when(F.col("_s") > 0, (F.col(x) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s"))).otherwise(0.0).alias("z"))

"""Ordered operators per key: running and sliding moments, lags, differencing, decomposition, survival, multiple testing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.guards import ratio
from sparkwright.storage import sized


def running(df: DataFrame, key: list[str], order: list[str], x: str) -> DataFrame:
    """Expanding count, mean, population variance, minimum and maximum."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", F.count(x).over(w).alias("n"), F.avg(x).over(w).alias("mean"), F.var_pop(x).over(w).alias("variance"), F.min(x).over(w).alias("low"), F.max(x).over(w).alias("high"), F.sum(x).over(w).alias("cumsum"))


def sliding(df: DataFrame, key: list[str], order: list[str], x: str, m: int) -> DataFrame:
    """Mean and population deviation of windows of m rows that start here; incomplete windows are left out."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(0, m - 1)
    return df.select("*", F.avg(x).over(w).alias("mean"), F.stddev_pop(x).over(w).alias("std"), F.count("*").over(w).alias("_n")).where(F.col("_n") == m).drop("_n")


def difference(df: DataFrame, key: list[str], order: list[str], x: str, lag: int = 1) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("difference", F.col(x) - F.lag(x, lag).over(w)).where(F.col("difference").isNotNull())


def autocorrelation(df: DataFrame, key: list[str], order: list[str], x: str, lags: int) -> DataFrame:
    """Autocovariance (denominator n) and autocorrelation at lags 0 to ``lags`` per key: one window pass, one aggregation."""
    whole = Window.partitionBy(*key)
    w = whole.orderBy(*order)
    c = df.select(*key, *order, (F.col(x) - F.avg(x).over(whole)).alias("c"))
    shifted = c.select(*key, "c", *(F.lag("c", k).over(w).alias(f"c{k}") for k in range(1, lags + 1)))
    sums = shifted.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s0"), *(F.coalesce(F.sum(F.col("c") * F.col(f"c{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(1, lags + 1)))
    rows = sums.select(*key, "n", "s0", F.posexplode(F.array(*(F.col(f"s{k}") for k in range(lags + 1)))).alias("lag", "s"))
    return rows.select(*key, "lag", (F.col("s") / F.col("n")).alias("autocovariance"), ratio(F.col("s"), F.col("s0")).alias("autocorrelation"))


def decompose(df: DataFrame, key: list[str], order: str, x: str, period: int) -> DataFrame:
    """Classical additive decomposition: centred moving average (half weights at the ends for even periods), seasonal
    means of the detrended values centred on zero, remainder. ``order`` is an integer index."""
    half = period // 2
    w = Window.partitionBy(*key).orderBy(order)
    inner = F.sum(x).over(w.rowsBetween(-half, half))
    if period % 2 == 0:
        inner = inner - (F.lag(x, half).over(w) + F.lead(x, half).over(w)) / 2
    full = F.count("*").over(w.rowsBetween(-half, half)) == 2 * half + 1
    t = df.select(*key, order, x, F.when(full, inner / period).alias("trend"), (F.col(order) % period).alias("phase"))
    season = t.where("trend is not null").groupBy(*key, "phase").agg(F.avg(F.col(x) - F.col("trend")).alias("raw"))
    season = season.withColumn("seasonal", F.col("raw") - F.avg("raw").over(Window.partitionBy(*key))).drop("raw")
    return t.join(sized(season), [*key, "phase"], "left").select(*key, order, x, "trend", "seasonal", (F.col(x) - F.col("trend") - F.col("seasonal")).alias("remainder"))


def kaplan_meier(df: DataFrame, by: list[str], time: str, event: str) -> DataFrame:
    """Survival and Nelson-Aalen cumulative hazard at each event time; ``event`` is 0 for censored rows."""
    counts = df.groupBy(*by, time).agg(F.sum(event).alias("d"), F.count("*").alias("c"))
    down = Window.partitionBy(*by).orderBy(F.desc(time))
    up = Window.partitionBy(*by).orderBy(time)
    risk = counts.withColumn("at_risk", F.sum("c").over(down)).where("d > 0")
    live = F.col("at_risk") - F.col("d")
    dead = F.max(F.when(live == 0, 1).otherwise(0)).over(up)
    logs = F.sum(F.when(live > 0, F.log(F.when(live > 0, live / F.col("at_risk")))).otherwise(0.0)).over(up)
    return risk.select(*by, time, "at_risk", "d", F.when(dead == 1, 0.0).otherwise(F.exp(logs)).alias("survival"), F.sum(F.col("d") / F.col("at_risk")).over(up).alias("hazard"))


def adjusted_p(df: DataFrame, by: list[str], p: str) -> DataFrame:
    """Benjamini-Hochberg, Holm, Hochberg, Bonferroni and Benjamini-Yekutieli adjusted p-values."""
    up = Window.partitionBy(*by).orderBy(p)
    whole = Window.partitionBy(*by)
    r = df.withColumn("_m", F.count("*").over(whole)).withColumn("_r", F.row_number().over(up))
    step_up = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step_down = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = lambda c: F.least(c, F.lit(1.0))
    rest = F.col("_m") - F.col("_r") + 1
    harmonic = F.sum(1.0 / F.col("_r")).over(whole)
    return r.select(
        *df.columns,
        one(F.min(F.col(p) * F.col("_m") / F.col("_r")).over(step_up)).alias("bh"),
        one(F.max(F.col(p) * rest).over(step_down)).alias("holm"),
        one(F.min(F.col(p) * rest).over(step_up)).alias("hochberg"),
        one(F.col(p) * F.col("_m")).alias("bonferroni"),
        one(F.min(F.col(p) * F.col("_m") * harmonic / F.col("_r")).over(step_up)).alias("by"),
    ).drop("_m", "_r")


def cusum(df: DataFrame, key: list[str], order: list[str], x: str, target: str, slack: float) -> DataFrame:
    """One-sided upper cumulative sum max(0, s + x - target - slack), as running sum less its running minimum."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = df.withColumn("_s", F.sum(F.col(x) - F.col(target) - slack).over(w))
    return s.withColumn("cusum", F.col("_s") - F.least(F.min("_s").over(w), F.lit(0.0))).drop("_s")


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions of a key, cut where the gap to the row before exceeds the given seconds."""
    w = Window.partitionBy(key).orderBy(ts)
    cut = F.when(F.lag(ts).over(w).isNull() | ((F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) > gap_seconds * 1_000_000), 1).otherwise(0)
    numbered = df.withColumn("_cut", cut).withColumn("session", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))

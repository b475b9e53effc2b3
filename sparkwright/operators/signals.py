"""Filters, correlations, tails and profiles of series. Folds over an order run in Arrow-fed pandas, a series a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.guards import ratio
from sparkwright.operators.sequences import autocorrelation


def savgol(df: DataFrame, key: list[str], order: str, x: str, window: int, degree: int) -> DataFrame:
    """(key, order, smooth): the value at the centre of the least-squares polynomial of each window; ends are left out."""
    half = window // 2
    design = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    weights = np.linalg.pinv(design)[0]
    w = Window.partitionBy(*key).orderBy(order)
    value = F.lit(0.0)
    for k, c in zip(range(-half, half + 1), weights, strict=True):
        value = value + F.lit(float(c)) * (F.lag(x, -k).over(w) if k < 0 else F.lead(x, k).over(w) if k else F.col(x))
    return df.select(*key, order, value.alias("smooth")).where("smooth is not null")


def partial_autocorrelation(df: DataFrame, key: list[str], order: list[str], x: str, lags: int) -> DataFrame:
    """(key, lag, partial) by the Durbin-Levinson recursion over the autocorrelations."""
    acf = autocorrelation(df, key, order, x, lags).where("lag > 0")
    rows = acf.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("lag", "autocorrelation"))).alias("r")).select(*key, F.col("r.autocorrelation").alias("r"))

    @F.pandas_udf("array<double>")
    def levinson(series: pd.Series) -> pd.Series:
        def one(r) -> list[float]:
            phi, out = np.zeros(0), []
            for k in range(len(r)):
                below = 1 - phi @ r[:k] if k else 1.0
                new = (r[k] - phi @ r[:k][::-1]) / below if below else float("nan")
                phi = np.append(phi - new * phi[::-1], new)
                out.append(float(new))
            return out

        return series.map(lambda r: one(np.asarray(r, dtype=float)))

    return rows.select(*key, F.posexplode(levinson("r")).alias("lag", "partial")).withColumn("lag", F.col("lag") + 1)


def cross_correlation(df: DataFrame, order: str, x: str, y: str, lags: int) -> DataFrame:
    """(lag, correlation) of x at t with y at t + lag, for lags to both sides, by an equality join on shifted times."""
    m = df.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    c = df.crossJoin(F.broadcast(m)).select(F.col(order).alias("t"), (F.col(x) - F.col("_mx")).alias("a"), (F.col(y) - F.col("_my")).alias("b"))
    size = c.agg(F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b"))).alias("size"))
    shifted = c.select("a", F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag"), "t").select("a", "lag", (F.col("t") + F.col("lag")).alias("t"))
    sums = shifted.join(c.select("t", "b"), "t").groupBy("lag").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    return sums.crossJoin(F.broadcast(size)).select("lag", ratio(F.col("s"), F.col("size")).alias("correlation"))


def mean_excess(df: DataFrame, x: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n, mean_excess) of the values above each threshold; NaN if there are none."""
    rows = df.select(F.col(x).alias("x"), F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    above = F.when(F.col("x") > F.col("threshold"), F.col("x") - F.col("threshold"))
    return rows.groupBy("threshold").agg(F.count(above).alias("n"), F.coalesce(F.avg(above), F.lit(float("nan"))).alias("mean_excess"))


def matrix_profile(df: DataFrame, key: str, order: str, x: str, m: int) -> DataFrame:
    """(key, order, nearest, distance): for every subsequence of m values the closest other one of its series, both
    z-normalised, that starts more than m / 2 places away. Rows of products are computed a block at a time."""
    types = dict(df.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        values, at = frame[x].to_numpy(dtype=float), frame[order].to_numpy()
        n = len(values) - m + 1
        if n < 1:
            return pd.DataFrame({key: [], order: [], "nearest": [], "distance": []})
        view = np.lib.stride_tricks.sliding_window_view(values, m)
        spread = view.std(axis=1, keepdims=True)
        z = np.where(spread > 1e-12, (view - view.mean(axis=1, keepdims=True)) / np.where(spread > 1e-12, spread, 1), 0.0)
        near, least = np.full(n, -1), np.full(n, np.inf)
        for lo in range(0, n, 256):
            d = ((z[lo : lo + 256, None, :] - z[None, :, :]) ** 2).sum(axis=2)
            d[np.abs(np.arange(lo, min(n, lo + 256))[:, None] - np.arange(n)[None, :]) <= m // 2] = np.inf
            best = d.argmin(axis=1)
            near[lo : lo + 256], least[lo : lo + 256] = best, np.sqrt(d[np.arange(len(d)), best])
        has = np.isfinite(least)
        return pd.DataFrame({key: frame[key].iloc[0], order: at[:n][has], "nearest": at[near[has]], "distance": least[has]})

    return df.select(key, order, x).groupBy(key).applyInPandas(run, f"{key} {types[key]}, {order} {types[order]}, nearest {types[order]}, distance double")


def holt(df: DataFrame, key: list[str], order: str, x: str, alpha: float, beta: float) -> DataFrame:
    """(key, order, level, trend) of double exponential smoothing, from the first value and the first difference."""
    types = dict(df.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        v = frame[x].to_numpy(dtype=float)
        level, trend = np.empty(len(v)), np.empty(len(v))
        level[0], trend[0] = v[0], v[1] - v[0] if len(v) > 1 else 0.0
        for t in range(1, len(v)):
            level[t] = alpha * v[t] + (1 - alpha) * (level[t - 1] + trend[t - 1])
            trend[t] = beta * (level[t] - level[t - 1]) + (1 - beta) * trend[t - 1]
        return frame[[*key, order]].assign(level=level, trend=trend)

    return df.select(*key, order, x).groupBy(*key).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in [*key, order]) + ", level double, trend double")


def lms(df: DataFrame, key: list[str], order: str, x: str, taps: int, rate: float, normalised: bool = False) -> DataFrame:
    """(key, order, error) of the least-mean-squares predictor from the ``taps`` values before; weights start at 0."""
    types = dict(df.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        v, w = frame[x].to_numpy(dtype=float), np.zeros(taps)
        error = np.zeros(max(0, len(v) - taps))
        for t in range(taps, len(v)):
            past = v[t - taps : t][::-1]
            error[t - taps] = v[t] - w @ past
            w = w + rate * error[t - taps] * past / (past @ past + 1e-12 if normalised else 1)
        return frame[[*key, order]].iloc[taps:].assign(error=error)

    return df.select(*key, order, x).groupBy(*key).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in [*key, order]) + ", error double")

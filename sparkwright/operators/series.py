"""Signal and time-series kernels: one series per group, exact kernels in Arrow-fed pandas where an order is folded."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def periodogram(df: DataFrame, key: str, index: str, x: str, n: int) -> DataFrame:
    """(key, k, power) of the first n/2 + 1 frequencies of series of length n: power |sum x exp(-2 pi i k t / n)|^2 / n.
    One pass of sums, without collecting the series."""
    ks = F.explode(F.sequence(F.lit(0), F.lit(n // 2)))
    rows = df.where((F.col(index) >= 0) & (F.col(index) < n)).select(key, index, F.col(x).cast("double").alias("x"), ks.alias("k"))
    turn = F.lit(2 * np.pi / n) * ((F.col("k") * F.col(index)) % n)
    s = rows.groupBy(key, "k").agg(F.sum(F.col("x") * F.cos(turn)).alias("re"), F.sum(F.col("x") * F.sin(turn)).alias("im"))
    return s.select(key, "k", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / n).alias("power"))


def exponential_smoothing(df: DataFrame, key: list[str], order: list[str], x: str, alpha: float) -> DataFrame:
    """s_0 = x_0, s_t = alpha x_t + (1 - alpha) s_{t-1}, folded over each key's ordered rows in time linear in them."""
    types = dict(df.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        values, s = frame[x].to_numpy(dtype=float), None
        out = np.empty(len(values))
        for i, v in enumerate(values):
            s = v if s is None else alpha * v + (1 - alpha) * s
            out[i] = s
        return frame[[*key, *order]].assign(smooth=out)

    return df.select(*key, *order, x).groupBy(*key).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in [*key, *order]) + ", smooth double")


def envelope(df: DataFrame, key: list[str], order: list[str], x: str, reach: int) -> DataFrame:
    """Rolling minimum and maximum within ``reach`` rows to either side."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-reach, reach)
    return df.select("*", F.min(x).over(w).alias("lower"), F.max(x).over(w).alias("upper"))


def median_filter(df: DataFrame, key: list[str], order: list[str], x: str, reach: int) -> DataFrame:
    """Median of the window; shorter windows at the ends."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-reach, reach)
    return df.withColumn("median", F.percentile(x, 0.5).over(w))


def _dtw(a: np.ndarray, b: np.ndarray, band: int | None) -> float:
    n, m = len(a), len(b)
    reach = max(band if band is not None else max(n, m), abs(n - m))
    row = np.full(m + 1, np.inf)
    row[0] = 0.0
    for i in range(1, n + 1):
        before, row = row, np.full(m + 1, np.inf)
        for j in range(max(1, i - reach), min(m, i + reach) + 1):
            row[j] = abs(a[i - 1] - b[j - 1]) + min(before[j], row[j - 1], before[j - 1])
    return float(row[m])


def dtw_to(df: DataFrame, key: str, order: str, x: str, reference: list[float], band: int | None = None) -> DataFrame:
    """(key, distance): dynamic time warping of every key's series to a stated reference."""
    target = np.asarray(reference, dtype=float)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values(order)[x].to_numpy(dtype=float)
        return pd.DataFrame({key: [frame[key].iloc[0]], "distance": [_dtw(values, target, band)]})

    return df.select(key, order, x).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, distance double")


def kalman_level(df: DataFrame, key: str, order: str, x: str, process: float, noise: float) -> DataFrame:
    """Filtered level and variance of a local-level model per key, from the first value."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        level, variance, out = None, noise, []
        for v in frame[x]:
            if level is None:
                level = v
            else:
                variance += process
                gain = variance / (variance + noise)
                level, variance = level + gain * (v - level), (1 - gain) * variance
            out.append((level, variance))
        return pd.DataFrame({key: frame[key], order: frame[order], "level": [o[0] for o in out], "variance": [o[1] for o in out]})

    types = dict(df.dtypes)
    return df.select(key, order, x).groupBy(key).applyInPandas(run, f"{key} {types[key]}, {order} {types[order]}, level double, variance double")


def elo(games: DataFrame, pool: str, order: str, a: str, b: str, won: str, k: float = 32.0, start: float = 1500.0) -> DataFrame:
    """(pool, player, rating) after the ordered games of each pool; ``won`` is 1, 0.5 or 0 for player a."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rating: dict = {}
        for r in frame.sort_values(order).itertuples(index=False):
            x, y = rating.get(getattr(r, a), start), rating.get(getattr(r, b), start)
            change = k * (getattr(r, won) - 1 / (1 + 10 ** ((y - x) / 400)))
            rating[getattr(r, a)], rating[getattr(r, b)] = x + change, y - change
        return pd.DataFrame({pool: frame[pool].iloc[0], "player": list(rating), "rating": list(rating.values())})

    types = dict(games.dtypes)
    return games.select(pool, order, a, b, won).groupBy(pool).applyInPandas(run, f"{pool} {types[pool]}, player {types[a]}, rating double")


def sax(df: DataFrame, key: str, order: str, x: str, segments: int) -> DataFrame:
    """(key, word): z-normalised segment means of each series as letters a to d by the quartiles of the normal law."""
    whole = Window.partitionBy(key)
    w = whole.orderBy(order)
    spread = F.stddev_pop(x).over(whole)
    z = F.when(spread > 0, (F.col(x) - F.avg(x).over(whole)) / F.when(spread > 0, spread)).otherwise(0.0)
    place = F.floor((F.row_number().over(w) - 1) * segments / F.count("*").over(whole))
    means = df.select(key, z.alias("z"), place.alias("segment")).groupBy(key, "segment").agg(F.avg("z").alias("m"))
    # fixed values: quartiles of the normal law
    letter = F.when(F.col("m") < -0.6744897501960817, "a").when(F.col("m") < 0.0, "b").when(F.col("m") < 0.6744897501960817, "c").otherwise("d")
    return means.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", letter.alias("l")))), lambda s: s["l"]), "").alias("word"))

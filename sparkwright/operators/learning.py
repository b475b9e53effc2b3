"""Splitters, linear models from one pass of sums, cross-validation and naive Bayes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.guards import ratio


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, n, fold): whole groups dealt to folds by falling size, there and back again, ties to the smaller group."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), group)) - 1
    turn = F.floor(place / k) % 2
    return counts.select(group, "n", F.when(turn == 0, place % k).otherwise(k - 1 - place % k).cast("int").alias("fold"))


def rolling_origin(df: DataFrame, time: str, first: int, horizon: int, step: int, folds: int, expanding: bool = True) -> DataFrame:
    """(fold, train, test): rows before each origin (or the ``first`` last periods before it) and in the horizon after it,
    counted from an integer time."""
    origins = F.explode(F.array(*(F.struct(F.lit(i).alias("fold"), F.lit(first + i * step).alias("origin")) for i in range(folds)))).alias("o")
    t = F.col(time)
    rows = df.select(time, origins).select(time, "o.fold", "o.origin")
    begin = F.lit(float("-inf")) if expanding else F.col("origin") - first
    return rows.groupBy("fold").agg(F.count_if((t < F.col("origin")) & (t >= begin)).alias("train"), F.count_if((t >= F.col("origin")) & (t < F.col("origin") + horizon)).alias("test"))


_SUMS = ("n", "sx", "sy", "sxx", "sxy", "syy")


def _sums(x: Column, y: Column) -> list[Column]:
    return [F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy")]


def _line(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, penalty: float = 0.0) -> tuple[Column, Column]:
    slope = ratio(sxy - sx * sy / n, sxx - sx * sx / n + penalty, 0.0)
    return slope, sy / n - slope * sx / n


def cross_validated_line(df: DataFrame, fold: Column, x: Column, y: Column, penalties: list[float]) -> DataFrame:
    """(penalty, fold, slope, intercept, mse) of a ridge line fitted without the fold and tested on it, for every penalty.

    Sums per fold are all that is needed: those of the training rows are the totals less the fold's, and the error on the
    fold follows from its sums. So the rows are read once, whatever the number of folds and penalties."""
    own = df.select(fold.alias("fold"), x.cast("double").alias("x"), y.cast("double").alias("y")).groupBy("fold").agg(*_sums(F.col("x"), F.col("y")))
    whole = own.agg(*(F.sum(c).alias(f"all_{c}") for c in _SUMS))
    both = own.crossJoin(F.broadcast(whole)).withColumn("penalty", F.explode(F.array(*(F.lit(float(p)) for p in penalties))))
    train = {c: F.col(f"all_{c}") - F.col(c) for c in _SUMS}
    n = train["n"]
    slope = ratio(train["sxy"] - train["sx"] * train["sy"] / n, train["sxx"] - train["sx"] * train["sx"] / n + F.col("penalty"), 0.0)
    fitted = both.withColumn("slope", slope).withColumn("intercept", train["sy"] / n - F.col("slope") * train["sx"] / n)
    a, b = F.col("slope"), F.col("intercept")
    error = F.col("syy") + a * a * F.col("sxx") + b * b * F.col("n") - 2 * a * F.col("sxy") - 2 * b * F.col("sy") + 2 * a * b * F.col("sx")
    return fitted.select("penalty", "fold", "slope", "intercept", (error / F.col("n")).alias("mse"))


def grid_search(cross: DataFrame) -> DataFrame:
    """(penalty, mse) of the smallest mean error over the folds, ties to the smaller penalty."""
    mean = cross.groupBy("penalty").agg(F.avg("mse").alias("mse"))
    return mean.agg(F.min(F.struct("mse", "penalty")).alias("b")).select("b.penalty", "b.mse")


def linear_regression(df: DataFrame, features: list[str], target: str, penalty: float = 0.0) -> DataFrame:
    """(term, coefficient) of least squares with intercept: one aggregation of centred products, and a system of as many
    equations as features on the driver."""
    import numpy as np

    names = [*features, target]
    means = df.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in names))
    c = {x: F.col(x) - F.col(f"m_{x}") for x in names}
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]] + [(a, target) for a in features]
    row = df.crossJoin(F.broadcast(means)).agg(*(F.max(f"m_{x}").alias(f"m_{x}") for x in names), *(F.sum(c[a] * c[b]).alias(f"p{i}") for i, (a, b) in enumerate(pairs))).first()
    at = {f: i for i, f in enumerate(features)}
    gram, moment = np.zeros((len(features), len(features))), np.zeros(len(features))
    for i, (a, b) in enumerate(pairs):
        if b == target:
            moment[at[a]] = row[f"p{i}"]
        else:
            gram[at[a], at[b]] = gram[at[b], at[a]] = row[f"p{i}"]
    coefficients = np.linalg.lstsq(gram + penalty * np.eye(len(features)), moment, rcond=None)[0]
    intercept = row[f"m_{target}"] - sum(b * row[f"m_{f}"] for f, b in zip(features, coefficients, strict=True))
    return df.sparkSession.createDataFrame([("intercept", float(intercept)), *((f, float(b)) for f, b in zip(features, coefficients, strict=True))], "term string, coefficient double")


def naive_bayes(df: DataFrame, label: str, features: list[str], smoothing: float = 1e-9) -> DataFrame:
    """(label, prior, mean and variance of each feature): the Gaussian model, one row per class."""
    whole = df.agg(F.count("*").alias("_t"), *(F.var_pop(c).alias(f"_v_{c}") for c in features))
    by = df.groupBy(label).agg(F.count("*").alias("_n"), *(F.avg(c).alias(f"mean_{c}") for c in features), *(F.var_pop(c).alias(f"raw_{c}") for c in features))
    most = F.greatest(*(F.col(f"_v_{c}") for c in features), F.lit(0.0))
    return by.crossJoin(F.broadcast(whole)).select(label, (F.col("_n") / F.col("_t")).alias("prior"), *(F.col(f"mean_{c}") for c in features), *((F.col(f"raw_{c}") + smoothing * most).alias(f"var_{c}") for c in features))


def predict_naive_bayes(df: DataFrame, model: DataFrame, label: str, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, prediction): the likeliest class of every row, ties to the smaller. The classes are a few rows, so each row
    scores all of them where it is read."""
    rows = model.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), *(c for c in model.columns if c != label)))).alias("model"))

    def score(m: Column) -> Column:
        s = F.log(m["prior"])
        for c in features:
            s = s - 0.5 * (F.log(2 * 3.141592653589793 * m[f"var_{c}"]) + F.pow(F.col(c) - m[f"mean_{c}"], F.lit(2.0)) / m[f"var_{c}"])
        return s

    scored = F.transform("model", lambda m: F.struct((-score(m)).alias("loss"), m["label"].alias("label")))
    return df.crossJoin(F.broadcast(rows)).select(*keys, F.array_min(scored)["label"].alias("prediction"))


def silhouette(df: DataFrame, label: str, vector: str, id_col: str) -> DataFrame:
    """(id, silhouette) with squared Euclidean distances. The mean distance of a point to a cluster follows from the
    cluster's size, sum of vectors and sum of squares, so no pairs are formed; clusters are few rows."""
    import numpy as np
    import pandas as pd

    parts = df.select(label, F.posexplode(vector).alias("k", "x")).groupBy(label, "k").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    rows = parts.groupBy(label).agg(F.max("n").alias("n"), F.sum("q").alias("q"), F.sort_array(F.collect_list(F.struct("k", "s"))).alias("s")).select(label, "n", "q", F.col("s.s").alias("s")).orderBy(label).collect()
    names = [r[0] for r in rows]
    n, q, s = np.array([r["n"] for r in rows], float), np.array([r["q"] for r in rows], float), np.array([r["s"] for r in rows], float)

    def run(batches):
        for frame in batches:
            x = np.stack(frame[vector].to_numpy()).astype(float)
            own = np.array([names.index(v) for v in frame[label]])
            sums = n * (x * x).sum(axis=1, keepdims=True) - 2 * x @ s.T + q
            a = sums[np.arange(len(x)), own] / np.maximum(n[own] - 1, 1)
            other = sums / n
            other[np.arange(len(x)), own] = np.inf
            b = other.min(axis=1)
            yield pd.DataFrame({id_col: frame[id_col], "silhouette": np.where((n[own] > 1) & np.isfinite(b), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)})

    return df.select(id_col, label, F.transform(vector, lambda v: v.cast("double")).alias(vector)).mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, silhouette double")


def krippendorff_alpha(df: DataFrame, unit: str, value: str) -> DataFrame:
    """(observed, expected, alpha) of nominal values; units with one value don't count; NaN if all values are one."""
    cells = df.where(F.col(value).isNotNull()).groupBy(unit, value).agg(F.count("*").cast("double").alias("c"))
    units = cells.groupBy(unit).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q")).where("m > 1")
    held = cells.join(units.select(unit), unit, "left_semi").groupBy(value).agg(F.sum("c").alias("n"))
    o = units.agg(F.sum((F.col("m") * F.col("m") - F.col("q")) / (F.col("m") - 1)).alias("o"), F.sum("m").alias("t"))
    e = held.agg(F.sum(F.col("n") * F.col("n")).alias("q"))
    t = F.col("t")
    s = o.crossJoin(F.broadcast(e)).select((F.col("o") / t).alias("observed"), ((t * t - F.col("q")) / (t * (t - 1))).alias("expected"))
    return s.select("observed", "expected", (1 - ratio(F.col("observed"), F.col("expected"))).alias("alpha"))


def average_precision(detections: DataFrame, boxes: DataFrame, image: str, score: str, key: str, overlap: Column, least: float = 0.5) -> DataFrame:
    """(boxes, detections, hits, average_precision): a detection hits the box of its image with the largest overlap, if
    that reaches ``least`` and no detection of a higher score has the box already. ``overlap`` is over the columns of
    both; ``boxes`` has (image, box, ...). Precision is averaged over the boxes at each hit."""
    total = boxes.agg(F.count("*").alias("boxes"))
    pairs = detections.join(boxes, image, "left").withColumn("_o", F.coalesce(overlap, F.lit(0.0)))
    best = pairs.groupBy(image, key, score).agg(F.max_by("box", F.struct("_o", -F.col("box"))).alias("box"), F.max("_o").alias("o"))
    first = F.row_number().over(Window.partitionBy(image, "box").orderBy(F.col("o") < least, F.desc(score), key)) == 1
    hits = best.withColumn("hit", (first & (F.col("o") >= least)).cast("int")).groupBy(score).agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    down = Window.orderBy(F.desc(score))
    run = hits.select("hits", "n", F.sum("hits").over(down).alias("tp"), F.sum("n").over(down).alias("all"))
    s = run.agg(F.sum("n").alias("detections"), F.sum("hits").alias("hits"), F.sum(F.col("hits") * F.col("tp") / F.col("all")).alias("a"))
    return s.crossJoin(F.broadcast(total)).select("boxes", "detections", "hits", ratio(F.col("a"), F.col("boxes")).alias("average_precision"))

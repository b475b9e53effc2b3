"""Table machinery: encoders, scalers, imputation, splits, resampling, rules and subgroups."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.guards import ratio
from sparkwright.operators.running import running_totals
from sparkwright.operators.tests import keyed_uniform
from sparkwright.storage import sized, stored


def scale(df: DataFrame, columns: list[str], how: str = "standard") -> DataFrame:
    """Columns scaled by population moments ("standard"), range ("minmax") or median and quartiles ("robust"), from one
    aggregation; a constant column is only centred."""
    stats = {
        "standard": lambda c: (F.avg(c), F.stddev_pop(c)),
        "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)),
        "robust": lambda c: (F.percentile(c, 0.5), F.percentile(c, 0.75) - F.percentile(c, 0.25)),
    }[how]
    parts = [e.alias(f"_{k}_{c}") for c in columns for k, e in zip("cs", stats(c), strict=True)]
    both = df.crossJoin(F.broadcast(df.agg(*parts)))
    own = {c: (F.col(c) - F.col(f"_c_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return both.select(*(own[c].alias(c) if c in own else F.col(c) for c in df.columns))


def ordinal_encode(df: DataFrame, column: str, into: str) -> DataFrame:
    """Places of the sorted distinct values; unknown (null) is -1."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = running_totals(stored(values.withColumn("_one", F.lit(1)), "ordinal"), column, ["_one"]).select(column, (F.col("upto__one") - 1).cast("int").alias(into))
    return df.join(sized(codes), column, "left").withColumn(into, F.coalesce(into, F.lit(-1)))


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One 0/1 column per stated value, named column_value; others give zeros."""
    return df.select("*", *((F.coalesce(F.col(column) == v, F.lit(False))).cast("int").alias(f"{column}_{v}") for v in values))


def frequency_encode(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share)."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_t")))).select(column, "n", (F.col("n") / F.col("_t")).alias("share"))


def target_encode(df: DataFrame, column: str, target: str, smooth: float) -> DataFrame:
    """(value, encoded): the value's mean target, drawn to the overall mean by ``smooth`` rows."""
    counts = df.groupBy(column).agg(F.count(target).alias("n"), F.sum(target).alias("s"))
    whole = counts.agg((F.sum("s") / F.sum("n")).alias("m"))
    return counts.crossJoin(F.broadcast(whole)).select(column, ((F.col("s") + smooth * F.col("m")) / (F.col("n") + smooth)).alias("encoded"))


def impute(df: DataFrame, column: str, how: str, by: list[str] | None = None) -> DataFrame:
    """Nulls and NaN replaced by the mean, median or most frequent value (ties to the smallest), of the group if given."""
    by = by or []
    x = F.when(~F.isnan(column), F.col(column))
    if how == "most_frequent":
        counts = df.where(x.isNotNull()).groupBy(*by, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
        fill = counts.groupBy(*by).agg(F.min_by("_v", F.struct(-F.col("_n"), "_v")).alias("_fill"))
    else:
        fill = df.groupBy(*by).agg((F.avg(x) if how == "mean" else F.percentile(x, 0.5)).alias("_fill"))
    both = df.join(sized(fill), by, "left") if by else df.crossJoin(F.broadcast(fill))
    return both.select(*(F.coalesce(x, "_fill").alias(column) if c == column else F.col(c) for c in df.columns))


def k_folds(df: DataFrame, key: str, k: int, strata: list[str] | None = None) -> DataFrame:
    """Folds of sizes that differ by at most one (per stratum), in the order of the key."""
    return df.withColumn("fold", (F.ntile(k).over(Window.partitionBy(*(strata or [])).orderBy(key)) - 1).cast("int"))


def hashed_split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Marks about ``share`` of the keys as test; rows of one key stay together, and no exchange is needed."""
    return df.withColumn("test", keyed_uniform(F.col(key), seed) < share)


def undersample(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """As many rows of each class as the smallest has, those of the smallest hash."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    least = counts.agg(F.min("_n").alias("_least"))
    w = Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return df.withColumn("_r", F.row_number().over(w)).crossJoin(F.broadcast(least)).where("_r <= _least").drop("_r", "_least")


def polynomial(df: DataFrame, columns: list[str]) -> DataFrame:
    """Squares and products of pairs, named a*b."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return df.select("*", *((F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs))


def discretise(x: Column, cuts: list[float]) -> Column:
    """The number of cuts at or below x."""
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(x >= c, 1).otherwise(0)
    return out


def subgroups(df: DataFrame, conditions: dict[str, Column], target: Column, depth: int = 2) -> DataFrame:
    """(description, n, hits, share, wracc, lift) of all conjunctions of up to ``depth`` conditions: all covers are
    counted in one aggregation over the rows."""
    named = [(a,) for a in conditions] + [p for k in range(2, depth + 1) for p in combinations(conditions, k)]

    def cover(names: tuple[str, ...]) -> Column:
        c = conditions[names[0]]
        for n in names[1:]:
            c = c & conditions[n]
        return c

    parts = [F.count("*").alias("t"), F.count_if(target).alias("p")]
    for i, names in enumerate(named):
        parts += [F.count_if(cover(names)).alias(f"n{i}"), F.count_if(cover(names) & target).alias(f"h{i}")]
    one = df.agg(*parts)
    rows = F.explode(F.array(*(F.struct(F.lit(" and ".join(names)).alias("description"), F.col(f"n{i}").alias("n"), F.col(f"h{i}").alias("hits")) for i, names in enumerate(named))))
    s = one.select("t", "p", rows.alias("r")).select("t", "p", "r.*").where("n > 0")
    base = F.col("p") / F.col("t")
    share = F.col("hits") / F.col("n")
    return s.select("description", "n", "hits", share.alias("share"), (F.col("n") / F.col("t") * (share - base)).alias("wracc"), ratio(share, base).alias("lift"))


def item_pairs(df: DataFrame, basket: str, item: str, min_support: int) -> DataFrame:
    """(a, b, n, support, confidence, lift, leverage, conviction) of frequent pairs: infrequent items go before the join."""
    rows = df.select(basket, item).distinct()
    total = rows.select(basket).distinct().agg(F.count("*").alias("t"))
    counts = rows.groupBy(item).agg(F.count("*").alias("c")).where(F.col("c") >= min_support)
    kept = rows.join(counts, item).select(basket, F.col(item).alias("i"), "c")
    a, b = kept.select(basket, F.col("i").alias("a"), F.col("c").alias("ca")), kept.select(basket, F.col("i").alias("b"), F.col("c").alias("cb"))
    pairs = a.join(b, basket).where("a < b").groupBy("a", "b", "ca", "cb").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    p = pairs.crossJoin(F.broadcast(total))
    sup, conf, pb = F.col("n") / F.col("t"), F.col("n") / F.col("ca"), F.col("cb") / F.col("t")
    return p.select("a", "b", "n", sup.alias("support"), conf.alias("confidence"), (conf / pb).alias("lift"), (sup - F.col("ca") / F.col("t") * pb).alias("leverage"), ratio(1 - pb, 1 - conf, float("inf")).alias("conviction"))

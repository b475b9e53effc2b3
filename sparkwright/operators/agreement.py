"""Multiclass averages, rater agreement, calibration tables, box overlap, and list diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.guards import ratio


def multiclass(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """accuracy, macro, micro and weighted precision, recall and F1, balanced accuracy and Cohen's kappa. Classes of
    either column count; an undefined rate is 0."""
    cells = df.groupBy(truth, guess).agg(F.count("*").cast("double").alias("n"))
    own = cells.groupBy(F.col(truth).alias("c")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0.0)).alias("tp"))
    said = cells.groupBy(F.col(guess).alias("c")).agg(F.sum("n").alias("g"))
    c = own.join(said, "c", "full").na.fill(0.0, ["t", "tp", "g"])
    p, r = ratio(F.col("tp"), F.col("g"), 0.0), ratio(F.col("tp"), F.col("t"), 0.0)
    f = ratio(2 * F.col("tp"), F.col("t") + F.col("g"), 0.0)
    s = c.select("t", "tp", "g", p.alias("p"), r.alias("r"), f.alias("f")).agg(
        F.sum("t").alias("n"),
        F.sum("tp").alias("hits"),
        F.avg("p").alias("macro_precision"),
        F.avg("r").alias("macro_recall"),
        F.avg("f").alias("macro_f1"),
        F.sum(F.col("f") * F.col("t")).alias("wf"),
        F.avg(F.when(F.col("t") > 0, F.col("r"))).alias("balanced"),
        F.sum(F.col("t") * F.col("g")).alias("chance"),
    )
    chance = F.col("chance") / (F.col("n") * F.col("n"))
    accuracy = F.col("hits") / F.col("n")
    return s.select(accuracy.alias("accuracy"), "macro_precision", "macro_recall", "macro_f1", (F.col("wf") / F.col("n")).alias("weighted_f1"), "balanced", ratio(accuracy - chance, 1 - chance).alias("kappa"))


def fleiss_kappa(df: DataFrame, item: str, category: str) -> DataFrame:
    """Agreement of several ratings per item (rows); items with one rating are left out."""
    cells = df.groupBy(item, category).agg(F.count("*").cast("double").alias("n"))
    items = cells.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("q")).where("m > 1")
    observed = items.agg(F.avg((F.col("q") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("observed"))
    kept = cells.join(items.select(item), item, "left_semi").groupBy(category).agg(F.sum("n").alias("n"))
    chance = kept.agg(F.sum(F.col("n") * F.col("n")).alias("q"), F.sum("n").alias("t")).select((F.col("q") / (F.col("t") * F.col("t"))).alias("chance"))
    return observed.crossJoin(chance).select("observed", "chance", ratio(F.col("observed") - F.col("chance"), 1 - F.col("chance")).alias("kappa"))


def reliability(df: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, share) of equal bins of scores in [0, 1], the last closed; empty bins are left out."""
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    return df.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(truth).alias("share"))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (left, top, right, bottom); 0 for two empty boxes."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return ratio(w * h, union, 0.0)


def lift_table(df: DataFrame, score: str, truth: str, key: str, groups: int = 10) -> DataFrame:
    """(group, n, hits, share, lift, gain): rows by falling score in equal groups, ties in the order of the key."""
    placed = df.select(truth, F.ntile(groups).over(Window.orderBy(F.desc(score), key)).alias("group"))
    g = placed.groupBy("group").agg(F.count("*").alias("n"), F.sum(truth).alias("hits"))
    every, upto = Window.partitionBy(), Window.orderBy("group")
    base = F.sum("hits").over(every) / F.sum("n").over(every)
    return g.select("group", "n", "hits", (F.col("hits") / F.col("n")).alias("share"), ratio(F.col("hits") / F.col("n"), base).alias("lift"), ratio(F.sum("hits").over(upto), F.sum("hits").over(every)).alias("gain"))


def list_diversity(lists: DataFrame, query: str, item: str, popularity: DataFrame) -> DataFrame:
    """Per list: mean self-information -log2(share) of its items (novelty), and the catalogue coverage of all lists."""
    total = popularity.agg(F.sum("n").alias("t"), F.count("*").alias("items"))
    rows = lists.join(popularity, item).crossJoin(F.broadcast(total))
    novelty = rows.groupBy(query).agg(F.avg(-F.log2(F.col("n") / F.col("t"))).alias("novelty"))
    covered = rows.agg((F.count_distinct(item) / F.max("items")).alias("coverage"))
    return novelty.crossJoin(F.broadcast(covered))


def theil(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """Theil index and Atkinson index (1) of positive values."""
    s = df.where(F.col(x) > 0).groupBy(*group).agg(F.avg(x).alias("m"), F.avg(F.log(x)).alias("l"), F.avg(F.col(x) * F.log(x)).alias("xl"))
    return s.select(*group, (F.col("xl") / F.col("m") - F.log("m")).alias("theil"), (1 - F.exp(F.col("l")) / F.col("m")).alias("atkinson"))

"""Evaluation metrics from one pass of counts or cumulative windows. Zero denominators give NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.guards import NAN, entropy_term, ratio
from sparkwright.operators.running import running_totals
from sparkwright.storage import sized, stored


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """All cells of the confusion matrix over the classes of either column, zeros included."""
    counts = df.groupBy(truth, guess).agg(F.count("*").alias("n"))
    classes = df.select(F.explode(F.array(truth, guess)).alias("c")).distinct()
    # all cells are the result, so classes are crossed: they must be few
    frame = classes.withColumnRenamed("c", truth).crossJoin(sized(classes.withColumnRenamed("c", guess), 10_000))
    return frame.join(counts, [truth, guess], "left").select(truth, guess, F.coalesce("n", F.lit(0)).alias("n"))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    total = tp + fp + fn + tn
    agree = ratio(tp + tn, total)
    chance = ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), total * total)
    return {
        "accuracy": agree,
        "precision": precision,
        "recall": recall,
        "specificity": ratio(tn, tn + fp),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "kappa": ratio(agree - chance, 1 - chance),
        "balanced": (recall + ratio(tn, tn + fp)) / 2,
    }


def binary_rates(df: DataFrame, by: list[str], truth: str, guess: str) -> DataFrame:
    """Rates of a 0/1 prediction per group."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    counts = df.groupBy(*by).agg(*(F.count_if(c).cast("double").alias(k) for k, c in (("tp", t & g), ("fp", ~t & g), ("fn", t & ~g), ("tn", ~t & ~g))))
    return counts.select(*by, *(c.alias(k) for k, c in _rates(*(F.col(k) for k in ("tp", "fp", "fn", "tn"))).items()))


def curve(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(threshold, tp, fp, p, n) by falling score; rows of equal score make one point; a point counts score >= threshold."""
    points = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(truth) == 1).alias("own"), F.count_if(F.col(truth) != 1).alias("other"))
    points = stored(points, "curve")
    whole = points.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("p"), F.coalesce(F.sum("other"), F.lit(0)).alias("n"))
    run = running_totals(points, "threshold", ["own", "other"], descending=True)
    return run.crossJoin(F.broadcast(whole)).select("threshold", F.col("upto_own").alias("tp"), F.col("upto_other").alias("fp"), "p", "n", F.col("own").alias("dt"), F.col("other").alias("df"))


def ranking_quality(df: DataFrame, score: str, truth: str) -> DataFrame:
    """auroc (average ranks, from the points of the curve), average precision and the largest F1."""
    step = curve(df, score, truth)
    area = F.sum(F.col("df") * (F.col("tp") - F.col("dt") / 2.0))
    return step.agg(
        ratio(area, F.max("p").cast("double") * F.max("n")).alias("auroc"),
        ratio(F.sum(F.col("dt") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("p")).alias("average_precision"),
        F.max(2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))).alias("best_f1"),
        F.max(ratio(F.col("tp"), F.col("p")) - ratio(F.col("fp"), F.col("n"))).alias("ks"),
    )


def probability_scores(df: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """Log loss (clipped at 1e-15), Brier score and expected calibration error over equal bins, the last closed."""
    p, y = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15)), F.col(truth)
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    cells = df.groupBy(place.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean"), F.avg(y).alias("share"), F.sum(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("loss"), F.sum((F.col(score) - y) * (F.col(score) - y)).alias("square")
    )
    n = F.sum("n")
    return cells.agg((F.sum("loss") / n).alias("log_loss"), (F.sum("square") / n).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("mean") - F.col("share"))) / n).alias("ece"))


def regression(df: DataFrame, by: list[str], truth: str, guess: str) -> DataFrame:
    """mse, rmse, mae, bias, mape (rows of truth 0 left out), R2, explained variance, median absolute error."""
    y, e = F.col(truth), F.col(truth) - F.col(guess)
    return (
        df.groupBy(*by)
        .agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.avg(F.when(y != 0, F.abs(e / F.when(y != 0, y)))).alias("mape"), F.var_pop(y).alias("v"), F.var_pop(e).alias("ve"), F.percentile(F.abs(e), 0.5).alias("median_ae"))
        .select(*by, "mse", F.sqrt("mse").alias("rmse"), "mae", "bias", "mape", (1 - ratio(F.col("mse"), F.col("v"))).alias("r2"), (1 - ratio(F.col("ve"), F.col("v"))).alias("explained"), "median_ae")
    )


def ranked_lists(df: DataFrame, query: str, item: str, score: str, gain: str, k: int) -> DataFrame:
    """Per query: precision, recall, average precision, reciprocal rank and NDCG at k (gain > 0 is relevant, 2^gain - 1
    over log2(rank + 1)); ties in score go to the smaller item."""
    w = Window.partitionBy(query).orderBy(F.desc(score), item)
    best = Window.partitionBy(query).orderBy(F.desc(gain), item)
    rows = df.select(query, gain, F.row_number().over(w).alias("r"), F.row_number().over(best).alias("i"), F.sum((F.col(gain) > 0).cast("int")).over(w).alias("hits"))
    hit, inside = F.col(gain) > 0, F.col("r") <= k
    value = F.pow(F.lit(2.0), F.col(gain)) - 1
    return (
        rows.groupBy(query)
        .agg(
            (F.count_if(hit & inside) / float(k)).alias("precision"),
            ratio(F.count_if(hit & inside), F.count_if(hit)).alias("recall"),
            ratio(F.sum(F.when(hit & inside, F.col("hits") / F.col("r"))), F.least(F.count_if(hit), F.lit(k)), 0.0).alias("ap"),
            F.coalesce(F.max(F.when(hit & inside, 1.0 / F.col("r"))), F.lit(0.0)).alias("rr"),
            ratio(F.sum(F.when(inside, value / F.log2(F.col("r") + 1.0))), F.sum(F.when(F.col("i") <= k, value / F.log2(F.col("i") + 1.0))), 0.0).alias("ndcg"),
        )
        .select(query, "precision", "recall", F.coalesce("ap", F.lit(0.0)).alias("ap"), "rr", "ndcg")
    )


def clusterings(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rand and adjusted Rand index, mutual information (nats), normalised (mean of entropies), homogeneity,
    completeness and V-measure, purity: all from the contingency table."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda x: x * (x - 1) / 2
    total = cells.agg(F.sum("n").alias("t"), F.sum(pairs(F.col("n"))).alias("both"))
    of_a = cells.groupBy(a).agg(F.sum("n").alias("na"), F.max("n").alias("top"))
    of_b = cells.groupBy(b).agg(F.sum("n").alias("nb"))
    one = total.crossJoin(F.broadcast(of_a.agg(F.sum(pairs(F.col("na"))).alias("pa"), F.sum("top").alias("top")))).crossJoin(F.broadcast(of_b.agg(F.sum(pairs(F.col("nb"))).alias("pb"))))
    n_total = F.broadcast(total.select("t"))
    ha = of_a.crossJoin(n_total).agg(F.sum(entropy_term(F.col("na") / F.col("t"))).alias("ha"))
    hb = of_b.crossJoin(n_total).agg(F.sum(entropy_term(F.col("nb") / F.col("t"))).alias("hb"))
    mi = cells.join(of_a, a).join(of_b, b).crossJoin(n_total).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    r = one.crossJoin(ha).crossJoin(hb).crossJoin(mi)
    allp = pairs(F.col("t"))
    expected = F.col("pa") * F.col("pb") / allp
    return r.select(
        ((allp + 2 * F.col("both") - F.col("pa") - F.col("pb")) / allp).alias("rand"),
        ratio(F.col("both") - expected, (F.col("pa") + F.col("pb")) / 2 - expected).alias("adjusted_rand"),
        F.col("mi").alias("mutual_information"),
        ratio(2 * F.col("mi"), F.col("ha") + F.col("hb")).alias("nmi"),
        ratio(F.col("mi"), F.col("ha")).alias("homogeneity"),
        ratio(F.col("mi"), F.col("hb")).alias("completeness"),
        (F.col("top") / F.col("t")).alias("purity"),
    )


def gini(df: DataFrame, x: str) -> DataFrame:
    """Gini coefficient of non-negative values, over counted distinct values; NaN if all are zero."""
    counts = stored(df.groupBy(F.col(x).cast("double").alias("x")).agg(F.count("*").alias("c")), "gini")
    r = running_totals(counts, "x", ["c"]).withColumnRenamed("upto_c", "upto")
    # the mean rank of c equal values that end at rank upto
    rank = F.col("upto") - (F.col("c") - 1) / 2.0
    s = r.agg(F.sum("c").cast("double").alias("n"), F.sum(F.col("x") * F.col("c")).alias("s"), F.sum(F.col("x") * F.col("c") * rank).alias("rs"))
    return s.select(ratio(2 * F.col("rs") - (F.col("n") + 1) * F.col("s"), F.col("n") * F.col("s")).alias("gini"))


def fairness(df: DataFrame, group: str, truth: str, guess: str) -> DataFrame:
    """Demographic parity, equal opportunity and equalised odds differences, and the parity ratio, over groups."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    r = df.groupBy(group).agg(F.avg(g.cast("int")).alias("rate"), F.avg(F.when(t, g.cast("int"))).alias("tpr"), F.avg(F.when(~t, g.cast("int"))).alias("fpr"))
    gap = lambda c: F.max(c) - F.min(c)
    return r.agg(gap("rate").alias("parity_difference"), ratio(F.min("rate"), F.max("rate")).alias("parity_ratio"), gap("tpr").alias("opportunity_difference"), F.greatest(gap("tpr"), gap("fpr")).alias("odds_difference"))


def off_policy(df: DataFrame, reward: str, logged: str, target: str, model: str) -> DataFrame:
    """Inverse propensity, self-normalised and doubly robust value estimates, and the effective sample size."""
    w = F.col(target) / F.col(logged)
    s = df.agg(F.avg(w * F.col(reward)).alias("ips"), F.sum(w * F.col(reward)).alias("wr"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.avg(F.col(model) + w * (F.col(reward) - F.col(model))).alias("dr"))
    return s.select("ips", ratio(F.col("wr"), F.col("w")).alias("snips"), "dr", ratio(F.col("w") * F.col("w"), F.col("w2")).alias("ess"))


def conformal_quantile(df: DataFrame, by: list[str], score: str, alpha: float) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score per group; infinity if there are too few."""
    counts = df.groupBy(*by, score).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(score)
    r = counts.select(*by, score, F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy(*by)).alias("n"))
    need = F.ceil((F.col("n") + 1) * F.lit(1 - alpha))
    return r.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("upto") >= need, F.col(score))), F.lit(float("inf"))).alias("quantile"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-squared statistic of independence, degrees of freedom and Cramer's V."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    ra, rb = cells.groupBy(a).agg(F.sum("n").alias("na")), cells.groupBy(b).agg(F.sum("n").alias("nb"))
    t = cells.agg(F.sum("n").alias("t"))
    # the sum over all cells of (n - e)^2 / e is t * (sum of n^2 / (na * nb) - 1), over the cells that have rows
    frame = cells.join(ra, a).join(rb, b)
    s = frame.agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("q"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    s = s.crossJoin(F.broadcast(t)).withColumn("chi2", F.col("t") * (F.col("q") - 1))
    least = F.least("ka", "kb") - 1
    return s.select("chi2", ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("freedom"), F.when(least > 0, F.sqrt(F.col("chi2") / (F.col("t") * F.when(least > 0, least)))).otherwise(NAN).alias("cramers_v"))


def ngram_overlap(df: DataFrame, key: str, reference: Column, candidate: Column, n: int) -> DataFrame:
    """Clipped n-gram matches per pair: (key, matched, of_reference, of_candidate, precision, recall, f1)."""
    r = df.select(key, F.explode(reference).alias("g")).groupBy(key, "g").agg(F.count("*").alias("r"))
    c = df.select(key, F.explode(candidate).alias("g")).groupBy(key, "g").agg(F.count("*").alias("c"))
    both = r.join(c, [key, "g"], "full").groupBy(key).agg(F.sum(F.least(F.coalesce("r", F.lit(0)), F.coalesce("c", F.lit(0)))).alias("matched"), F.sum("r").alias("of_reference"), F.sum("c").alias("of_candidate"))
    m, a, b = F.col("matched"), F.coalesce("of_reference", F.lit(0)), F.coalesce("of_candidate", F.lit(0))
    return both.select(key, "matched", a.alias("of_reference"), b.alias("of_candidate"), ratio(m, b, 0.0).alias("precision"), ratio(m, a, 0.0).alias("recall"), ratio(2 * m, a + b, 0.0).alias("f1"))

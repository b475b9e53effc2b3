"""Paired, rank and contingency tests, survival comparison, sequential tests and keyed randomisation.

Random choices come from md5 of a row's key and a seed, so they depend on the rows alone and any engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.guards import ratio


def md5_uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 8 hex digits of md5(key-seed)."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean, t, freedom) of the differences a - b."""
    d = (F.col(a) - F.col(b)).cast("double")
    s = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    return s.select("n", "mean", ratio(F.col("mean") * F.sqrt(F.col("n").cast("double")), F.col("sd")).alias("t"), (F.col("n") - 1).alias("freedom"))


def wilcoxon_signed_rank(df: DataFrame, difference: Column) -> DataFrame:
    """(n, w_plus, w_minus, z): zero differences are left out, ties of size share the mean rank; z by the normal law with
    ties corrected. Sizes are counted first, so ranks are sums over distinct sizes."""
    rows = df.select(difference.alias("d")).where("d <> 0").groupBy(F.abs("d").alias("size")).agg(F.count("*").cast("double").alias("c"), F.count_if(F.col("d") > 0).cast("double").alias("up"))
    upto = F.sum("c").over(Window.orderBy("size"))
    ranked = rows.withColumn("rank", upto - (F.col("c") - 1) / 2)
    s = ranked.agg(F.sum("c").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum((F.col("c") - F.col("up")) * F.col("rank")).alias("w_minus"), F.sum(F.pow("c", F.lit(3.0)) - F.col("c")).alias("ties"))
    n = F.col("n")
    spread = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return s.select(n.cast("long").alias("n"), "w_plus", "w_minus", ratio(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(spread)).alias("z"))


def fisher_exact(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(n11, n10, n01, n00, odds_ratio, p): the two-sided p-value of a 2 x 2 table, the sum of all tables at most as likely."""
    cells = df.agg(*(F.count_if(c).alias(k) for k, c in (("n11", a & b), ("n10", a & ~b), ("n01", ~a & b), ("n00", ~a & ~b))))
    r, c, n = F.col("n11") + F.col("n10"), F.col("n11") + F.col("n01"), F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    logs = cells.withColumns({"r": r, "c": c, "n": n})
    # logarithms of factorials by prefix sums: n! for n up to the table's total
    logs = logs.withColumn("f", F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest("n", F.lit(1))), F.array(F.lit(0.0)), lambda s, k: F.array_append(s, F.get(s, F.size(s) - 1) + F.log(k.cast("double")))))
    f = lambda k: F.get("f", k.cast("int"))
    chance = lambda x: f(F.col("r")) + f(F.col("n") - F.col("r")) + f(F.col("c")) + f(F.col("n") - F.col("c")) - f(F.col("n")) - f(x) - f(F.col("r") - x) - f(F.col("c") - x) - f(F.col("n") - F.col("r") - F.col("c") + x)
    xs = F.sequence(F.greatest(F.col("r") + F.col("c") - F.col("n"), F.lit(0).cast("long")), F.least("r", "c"))
    own = chance(F.col("n11"))
    p = F.aggregate(F.transform(xs, lambda x: F.when(chance(x) <= own + 1e-7, F.exp(chance(x))).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    odds = ratio(F.col("n11") * F.col("n00").cast("double"), (F.col("n10") * F.col("n01")).cast("double"))
    return logs.select("n11", "n10", "n01", "n00", odds.alias("odds_ratio"), F.least(p, F.lit(1.0)).alias("p"))


def mcnemar(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(b, c, statistic): discordant counts and the chi-squared statistic with continuity correction; NaN without any."""
    s = df.agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    gap = F.greatest(F.abs(F.col("b") - F.col("c")) - 1.0, F.lit(0.0))
    return s.select("b", "c", ratio(gap * gap, F.col("b") + F.col("c")).alias("statistic"))


def friedman(df: DataFrame, block: str, treatment: str, x: str) -> DataFrame:
    """(n, k, statistic) of ranks within complete blocks, ties sharing the mean rank and corrected."""
    w = Window.partitionBy(block)
    rank = F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(block, x)) - 1) / 2.0
    ranked = df.select(block, treatment, rank.alias("r"), F.count("*").over(w).alias("k"), F.count("*").over(Window.partitionBy(block, x)).cast("double").alias("t"))
    k = ranked.agg(F.max("k").alias("k")).first()["k"]
    full = ranked.where(F.col("k") == k)
    sums = full.groupBy(treatment).agg(F.sum("r").alias("s"), F.count("*").cast("double").alias("n"))
    ties = full.agg(F.sum(F.col("t") * F.col("t") - 1).alias("ties"))  # the sum of t^3 - t over groups of ties
    s = sums.agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"), F.count("*").cast("double").alias("m")).crossJoin(F.broadcast(ties))
    n, m = F.col("n"), F.col("m")
    plain = 12 * F.col("q") / (n * m * (m + 1)) - 3 * n * (m + 1)
    return s.select(n.cast("long").alias("n"), m.cast("long").alias("k"), ratio(plain, 1 - F.col("ties") / (n * m * (m * m - 1))).alias("statistic"))


def ljung_box(acf: DataFrame, n: int, lags: int) -> DataFrame:
    """(lags, statistic) from the autocorrelations (lag, autocorrelation) of a series of length n."""
    rho = F.col("autocorrelation")
    return acf.where(F.col("lag").between(1, lags)).agg(F.count("*").alias("lags"), (n * (n + 2) * F.sum(rho * rho / (n - F.col("lag")))).alias("statistic"))


def log_rank(df: DataFrame, group: Column, time: str, event: str) -> DataFrame:
    """(observed, expected, variance, statistic) of the rows of ``group`` against the others, over the event times."""
    counts = df.withColumn("_g", group.cast("int")).groupBy(time).agg(F.count("*").alias("c"), F.sum("_g").alias("cg"), F.sum(event).alias("d"), F.sum(F.col(event) * F.col("_g")).alias("dg"))
    down = Window.orderBy(F.desc(time))
    risk = counts.select("d", "dg", F.sum("c").over(down).cast("double").alias("n"), F.sum("cg").over(down).cast("double").alias("ng")).where("d > 0")
    share = F.col("ng") / F.col("n")
    v = F.when(F.col("n") > 1, F.col("d") * share * (1 - share) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    s = risk.agg(F.sum("dg").cast("double").alias("observed"), F.sum(F.col("d") * share).alias("expected"), F.sum(v).alias("variance"))
    return s.select("observed", "expected", "variance", ratio(F.pow(F.col("observed") - F.col("expected"), F.lit(2.0)), F.col("variance")).alias("statistic"))


def sequential_ratio(df: DataFrame, key: list[str], order: list[str], hit: Column, p0: float, p1: float, alpha: float, beta: float) -> DataFrame:
    """(key, n, ratio, decision) of Wald's test of p0 against p1 per key: at the first row where the log likelihood ratio
    leaves the bounds ("p1" above, "p0" below), else at the last ("open")."""
    import math

    upper, lower = math.log((1 - beta) / alpha), math.log(beta / (1 - alpha))
    step = F.when(hit, math.log(p1 / p0)).otherwise(math.log((1 - p1) / (1 - p0)))
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = df.select(*key, F.sum(step).over(w).alias("ratio"), F.count("*").over(w).alias("n"))
    out = (F.col("ratio") >= upper) | (F.col("ratio") <= lower)
    # the first row that is out comes before all others; without one the last row does
    one = run.groupBy(*key).agg(F.min_by(F.struct("n", "ratio"), F.struct((~out).cast("int"), F.when(out, F.col("n")).otherwise(-F.col("n")))).alias("s")).select(*key, "s.n", "s.ratio")
    return one.withColumn("decision", F.when(F.col("ratio") >= upper, "p1").when(F.col("ratio") <= lower, "p0").otherwise("open"))


def confidence_sequence(df: DataFrame, key: list[str], order: list[str], x: str, low: float, high: float, alpha: float) -> DataFrame:
    """Running mean with bounds that hold at all times at once for values in [low, high]: Hoeffding's bound at level
    alpha / (n (n + 1)), whose sum over n is alpha."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count("*").over(w)
    r = df.select(*key, *order, n.alias("n"), F.avg(x).over(w).alias("mean"))
    reach = (high - low) * F.sqrt(F.log(2.0 * F.col("n") * (F.col("n") + 1) / alpha) / (2.0 * F.col("n")))
    return r.select(*key, *order, "n", "mean", (F.col("mean") - reach).alias("lower"), (F.col("mean") + reach).alias("upper"))


def sign_flip_test(df: DataFrame, key: str, difference: Column, rounds: int, seed: str = "flip") -> DataFrame:
    """(statistic, p): the sum of differences against its law under keyed random signs. Each row adds to all rounds in
    one map-side aggregation."""
    rows = df.select(F.col(key).alias("k"), difference.cast("double").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("b"))
    sign = F.when((F.col("b") == 0) | (md5_uniform(F.concat(F.col("k").cast("string"), F.lit("/"), F.col("b").cast("string")), seed) < 0.5), 1.0).otherwise(-1.0)
    sums = rows.groupBy("b").agg(F.sum(sign * F.col("d")).alias("s"))
    own = sums.agg(F.max(F.when(F.col("b") == 0, F.col("s"))).alias("statistic"))
    both = sums.crossJoin(F.broadcast(own))
    # the tolerance keeps sums that differ by rounding alone together
    return both.groupBy("statistic").agg((F.count_if(F.abs("s") >= F.abs("statistic") - 1e-9) / (rounds + 1.0)).alias("p"))


def randomised_response(df: DataFrame, key: str, answer: Column, epsilon: float, seed: str = "response") -> DataFrame:
    """(n, reported, estimate): each row answers truly with probability e^eps / (1 + e^eps), else the opposite; the
    estimate takes the noise out of the reported share."""
    import math

    p = math.exp(epsilon) / (1 + math.exp(epsilon))
    said = F.when(md5_uniform(F.col(key), seed) < p, answer).otherwise(~answer)
    s = df.agg(F.count("*").alias("n"), F.avg(said.cast("int")).alias("reported"))
    return s.select("n", "reported", ((F.col("reported") - (1 - p)) / (2 * p - 1)).alias("estimate"))


def clipped_noisy_sums(df: DataFrame, by: list[str], key: str, x: str, bound: float, sigma: float, seed: str = "noise") -> DataFrame:
    """Sums of values clipped to [-bound, bound] plus normal noise of deviation sigma * bound, keyed by the group."""
    s = df.groupBy(*by).agg(F.sum(F.greatest(F.least(F.col(x).cast("double"), F.lit(bound)), F.lit(-bound))).alias("_s"))
    name = F.concat_ws("/", *(F.col(c).cast("string") for c in by))
    u = F.greatest(md5_uniform(name, f"{seed}a"), F.lit(2.0**-33))
    normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * md5_uniform(name, f"{seed}b"))
    return s.select(*by, (F.col("_s") + sigma * bound * normal).alias("total"))

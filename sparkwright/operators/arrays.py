"""Array and table operators in long form: sources, indexed writes, reductions, scans, complex numbers, selectors."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.functions.guards import NAN


def arange(spark: SparkSession, start: float, stop: float, step: float) -> DataFrame:
    """(i, x): start, start + step, ... below stop (above it for a negative step)."""
    if step == 0:
        raise ValueError("the step must not be 0")
    n = max(0, -int(-(stop - start) // step))
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("x"))


def filled(spark: SparkSession, n: int, value: float) -> DataFrame:
    """(i, x) with one value everywhere: zeros, ones and full."""
    return spark.range(n).select(F.col("id").alias("i"), F.lit(float(value)).alias("x"))


def eye(spark: SparkSession, n: int) -> DataFrame:
    """(i, j, x) of the identity matrix, its zeros left out."""
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("x"))


def set_values(base: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` of ``base`` replaced where ``updates`` (key, column) names the key; of repeated keys the largest wins."""
    one = updates.groupBy(key).agg(F.max(column).alias("_new"))
    return base.join(one, key, "left").select(*(F.coalesce("_new", column).alias(column) if c == column else F.col(c) for c in base.columns))


def scatter_add(base: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` of ``base`` plus the sum of the updates of its key; updates of unknown keys are dropped."""
    sums = updates.groupBy(key).agg(F.sum(column).alias("_add"))
    return base.join(sums, key, "left").select(*((F.col(column) + F.coalesce("_add", F.lit(0))).alias(column) if c == column else F.col(c) for c in base.columns))


def product(x: Column) -> Column:
    """The product of a group: 0 if a value is 0, else the sign by the count of negative values and the sum of logarithms."""
    sign = F.when(F.count_if(x < 0) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(F.count_if(x == 0) > 0, 0.0).otherwise(sign * F.exp(F.coalesce(F.sum(F.when(x != 0, F.log(F.abs(F.when(x != 0, x))))), F.lit(0.0))))


def log_sum_exp(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """ln(sum(exp(x))) per group, shifted by the maximum."""
    top = df.groupBy(*by).agg(F.max(x).alias("_m"))
    both = df.join(top, by)
    return both.groupBy(*by, "_m").agg(F.sum(F.exp(F.col(x) - F.col("_m"))).alias("_s")).select(*by, (F.col("_m") + F.log("_s")).alias("logsumexp"))


def norms(df: DataFrame, by: list[str], x: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(F.abs(x)).alias("l1"), F.sqrt(F.sum(F.col(x) * F.col(x))).alias("l2"), F.max(F.abs(x)).alias("l_inf"))


def expectile(df: DataFrame, x: str, tau: float, rounds: int = 100, tolerance: float = 1e-12) -> float:
    """The value m with tau * sum(max(x - m, 0)) = (1 - tau) * sum(max(m - x, 0)): asymmetric means to the fixpoint. One
    row reaches the driver a round."""
    m = df.agg(F.avg(x)).first()[0]
    for _ in range(rounds):
        if m is None:
            return float("nan")
        w = F.when(F.col(x) > m, tau).otherwise(1 - tau)
        new = df.agg(F.sum(w * F.col(x)) / F.sum(F.when(F.col(x).isNotNull(), w))).first()[0]
        if abs(new - m) <= tolerance * max(1.0, abs(m)):
            return new
        m = new
    return m


def scan(df: DataFrame, key: list[str], order: list[str], x: str, reverse: bool = False) -> DataFrame:
    """Prefix sums, products, minima and maxima of each key's ordered values, from the end if ``reverse``. Each of them is
    an associative scan; the product goes over signs and logarithms, as ``product`` does."""
    o = [F.desc(c) for c in order] if reverse else [F.asc(c) for c in order]
    w = Window.partitionBy(*key).orderBy(*o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = F.col(x)
    logs = F.sum(F.log(F.abs(F.when(c != 0, c)))).over(w)
    sign = F.when(F.sum(F.when(c < 0, 1).otherwise(0)).over(w) % 2 == 1, -1.0).otherwise(1.0)
    zero = F.max(F.when(c == 0, 1).otherwise(0)).over(w) == 1
    return df.select("*", F.sum(x).over(w).alias("sums"), F.when(zero, 0.0).otherwise(sign * F.exp(F.coalesce(logs, F.lit(0.0)))).alias("products"), F.min(x).over(w).alias("minima"), F.max(x).over(w).alias("maxima"))


def undifference(df: DataFrame, key: list[str], order: list[str], x: str, start: Column) -> DataFrame:
    """The series whose differences are x: ``start`` plus the prefix sums."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("series", start + F.sum(x).over(w))


class Complex:
    """Complex numbers as pairs of columns."""

    def __init__(self, re: Column, im: Column):
        self.re, self.im = re, im

    def __add__(self, other: Complex) -> Complex:
        return Complex(self.re + other.re, self.im + other.im)

    def __sub__(self, other: Complex) -> Complex:
        return Complex(self.re - other.re, self.im - other.im)

    def __mul__(self, other: Complex) -> Complex:
        return Complex(self.re * other.re - self.im * other.im, self.re * other.im + self.im * other.re)

    def __truediv__(self, other: Complex) -> Complex:
        n = F.when((other.re != 0) | (other.im != 0), other.re * other.re + other.im * other.im)
        both = self * other.conjugate()
        return Complex(F.coalesce(both.re / n, F.lit(NAN)), F.coalesce(both.im / n, F.lit(NAN)))

    def conjugate(self) -> Complex:
        return Complex(self.re, -self.im)

    def modulus(self) -> Column:
        return F.hypot(self.re, self.im)

    def argument(self) -> Column:
        return F.atan2(self.im, self.re)

    def exp(self) -> Complex:
        size = F.exp(self.re)
        return Complex(size * F.cos(self.im), size * F.sin(self.im))


def compare(a: Column, b: Column) -> dict[str, Column]:
    """The six comparisons as floating-point numbers have them: with NaN on a side all but "not equal" are false."""
    odd = F.isnan(a) | F.isnan(b)
    plain = {"less": a < b, "less_equal": a <= b, "greater": a > b, "greater_equal": a >= b, "equal": a == b}
    return {k: ~odd & c for k, c in plain.items()} | {"not_equal": odd | (a != b)}


def extremes(a: Column, b: Column) -> tuple[Column, Column]:
    """Elementwise maximum and minimum; NaN on a side gives NaN."""
    odd = F.isnan(a) | F.isnan(b)
    return F.when(odd, F.lit(NAN)).otherwise(F.greatest(a, b)), F.when(odd, F.lit(NAN)).otherwise(F.least(a, b))


def select_columns(df: DataFrame, types: set[str] | None = None, name: str | None = None, leave_out: set[str] = frozenset()) -> list[str]:
    """Names of the columns of the given kinds ("number", "text", "time") whose name matches a pattern."""
    kinds = {"number": r"tinyint|smallint|int|bigint|float|double|decimal.*", "text": "string", "time": "timestamp.*|date"}
    fits = lambda t: types is None or any(re.fullmatch(kinds[k], t) for k in types)
    return [c for c, t in df.dtypes if fits(t) and (name is None or re.fullmatch(name, c)) and c not in leave_out]


def transform_columns(df: DataFrame, steps: list[tuple[list[str], Callable[[DataFrame, list[str]], DataFrame] | str]], remainder: str = "drop") -> DataFrame:
    """Applies each step to its columns: a function of (table, columns) that returns the table with those replaced, "pass"
    or "drop". Columns that no step names are kept or dropped by ``remainder`` ("pass" or "drop")."""
    named, kept = set(), []
    for columns, step in steps:
        named |= set(columns)
        if step == "drop":
            continue
        if step != "pass":
            df = step(df, columns)
        kept += columns
    rest = [c for c in df.columns if c not in named] if remainder == "pass" else []
    return df.select(*kept, *rest)


def cut_points(df: DataFrame, x: str, bins: int, how: str = "width") -> DataFrame:
    """(k, cut) of the inner borders of ``bins`` bins of equal width, or of equal counts ("frequency")."""
    if how == "width":
        ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
        cuts = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / bins)
        return ends.select(F.posexplode(cuts).alias("k", "cut"))
    return df.agg(F.percentile(x, [k / bins for k in range(1, bins)]).alias("cuts")).select(F.posexplode("cuts").alias("k", "cut"))


def skyline(df: DataFrame, keys: list[str], better_high: list[str]) -> DataFrame:
    """The rows that no other row dominates: at least as high everywhere and higher somewhere.

    Each distinct point is compared with the points that survive a first pass inside its hash part, so most go before
    anything is joined."""
    points = df.select(*better_high).distinct()

    def kept(own: DataFrame, part: Column | None) -> DataFrame:
        a = own.withColumn("_p", part if part is not None else F.lit(0)).alias("a")
        b = own.withColumn("_p", part if part is not None else F.lit(0)).alias("b")
        at_least = F.col("a._p") == F.col("b._p")
        higher = F.lit(False)
        for c in better_high:
            at_least = at_least & (F.col(f"b.{c}") >= F.col(f"a.{c}"))
            higher = higher | (F.col(f"b.{c}") > F.col(f"a.{c}"))
        return a.join(b, at_least & higher, "left_anti").select(*better_high)

    # each part keeps the rows that lead in it by the sum of ranks; a point below such a leader goes at once
    lead = df.select(*better_high).orderBy(*(F.desc(c) for c in better_high)).limit(1)
    other = df.select(*better_high).orderBy(*(F.desc(c) for c in reversed(better_high))).limit(1)
    leaders = lead.unionByName(other).distinct()
    a, b = points.alias("a"), F.broadcast(leaders).alias("b")
    at_least, higher = F.lit(True), F.lit(False)
    for c in better_high:
        at_least = at_least & (F.col(f"b.{c}") >= F.col(f"a.{c}"))
        higher = higher | (F.col(f"b.{c}") > F.col(f"a.{c}"))
    few = a.join(b, at_least & higher, "left_anti").select(*better_high)
    best = kept(kept(few, F.pmod(F.hash(*better_high), F.lit(64))), None)
    return df.join(best, better_high, "left_semi").select(*keys, *better_high)

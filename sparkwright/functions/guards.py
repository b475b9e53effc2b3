"""Arithmetic with stated rules for zero denominators, logarithms and NaN (Spark's ANSI mode raises where these don't)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def ratio(num: Column, den: Column, empty: float | None = NAN) -> Column:
    """num / den; ``empty`` where den is 0 or null."""
    return F.when(den != 0, num / F.when(den != 0, den)).otherwise(F.lit(empty).cast("double"))


def safe_log(x: Column) -> Column:
    """Natural logarithm as IEEE has it: -inf at 0, NaN below."""
    return F.when(x > 0, F.log(F.when(x > 0, x))).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(NAN)).otherwise(x.cast("double"))


def nan_max(x: Column) -> Column:
    """Aggregate: NaN if any value is NaN."""
    return F.max(x)


def nan_min(x: Column) -> Column:
    """Aggregate: NaN if any value is NaN (Spark's min orders NaN last)."""
    return F.when(F.max(F.isnan(x)), F.lit(NAN)).otherwise(F.min(x))


def entropy_term(p: Column) -> Column:
    """-p ln p, 0 at 0."""
    return F.when(p > 0, -p * F.log(F.when(p > 0, p))).otherwise(0.0)


def clip(x: Column, low: float, high: float) -> Column:
    """Into [low, high]; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-F.abs(x)))).otherwise(F.exp(-F.abs(x)) / (1 + F.exp(-F.abs(x))))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def box_cox(x: Column, lam: float) -> Column:
    """(x^lam - 1) / lam, ln x at 0; NaN for x <= 0."""
    own = F.log(F.when(x > 0, x)) if lam == 0 else (F.pow(F.when(x > 0, x), F.lit(lam)) - 1) / lam
    return F.when(x > 0, own).otherwise(F.lit(NAN))


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(F.greatest(x, F.lit(0.0))) if lam == 0 else (F.pow(F.greatest(x, F.lit(0.0)) + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(F.greatest(-x, F.lit(0.0))) if lam == 2 else -(F.pow(F.greatest(-x, F.lit(0.0)) + 1, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def huber(error: Column, delta: float = 1.0) -> Column:
    return F.when(F.abs(error) <= delta, 0.5 * error * error).otherwise(delta * (F.abs(error) - 0.5 * delta))


def pinball(error: Column, q: float) -> Column:
    """Loss of the residual y - prediction at level q."""
    return F.greatest(q * error, (q - 1) * error)


def log_cosh(error: Column) -> Column:
    a = F.abs(error)
    return a + F.log1p(F.exp(-2 * a)) - 0.6931471805599453


def hinge(margin: Column) -> Column:
    """Loss of the signed margin y * f."""
    return F.greatest(1 - margin, F.lit(0.0))


def focal(margin: Column, gamma: float) -> Column:
    """-(1 - p)^gamma ln p of p = sigmoid(y * f)."""
    return F.pow(1 - sigmoid(margin), F.lit(gamma)) * softplus(-margin)


def box_cox_inverse(y: Column, lam: float) -> Column:
    """The x whose transform is y; NaN where there is none."""
    if lam == 0:
        return F.exp(y)
    base = lam * y + 1
    return F.when(base > 0, F.pow(F.when(base > 0, base), F.lit(1 / lam))).otherwise(F.lit(NAN))


def yeo_johnson_inverse(y: Column, lam: float) -> Column:
    up = F.expm1(F.greatest(y, F.lit(0.0))) if lam == 0 else F.pow(F.greatest(lam * F.greatest(y, F.lit(0.0)) + 1, F.lit(0.0)), F.lit(1 / lam)) - 1
    low = F.greatest(-y, F.lit(0.0))
    down = -F.expm1(low) if lam == 2 else 1 - F.pow(F.greatest((2 - lam) * low + 1, F.lit(0.0)), F.lit(1 / (2 - lam)))
    return F.when(y >= 0, up).otherwise(down)

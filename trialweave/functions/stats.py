"""Statistics as Column expressions: they stay inside the JVM and whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
Z_95 = 1.959963984540054
TWO_DECIMAL_THRESHOLD = 0.595  # what formats to 0.60 or more with two decimals lies above this double


def wilson(successes: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """The Wilson interval without continuity correction, clamped to [0, 1]; null where n is null or below 1."""
    x, n = successes.cast("double"), n.cast("double")
    n = F.when(n >= 1, n)
    p, z2 = x / n, F.lit(z * z)
    scale = F.lit(1.0) + z2 / n
    centre = (p + z2 / (F.lit(2.0) * n)) / scale
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + z2 / (F.lit(4.0) * n * n)) / scale
    low, high = (F.when(n.isNotNull(), v) for v in (F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)))
    return low, high


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The unbiased estimate 1 - C(n-c, k) / C(n, k) as a product; null where n < k, 1 where n - c < k."""
    miss = F.lit(1.0)
    for i in range(k):
        miss = miss * (n - c - i).cast("double") / F.nullif((n - i).cast("double"), F.lit(0.0))
    return F.when(n < k, F.lit(None).cast("double")).when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - miss)


def reaches_threshold(value: Column) -> Column:
    """Whether the value, formatted to two decimals, is at least 0.60."""
    return value > TWO_DECIMAL_THRESHOLD


def rate(flag: Column, prefix: str) -> list[Column]:
    """Aggregates of a three-valued flag: numerator, denominator (flag known), excluded (flag null)."""
    return [
        F.count_if(flag).alias(f"{prefix}_num"),
        F.count(flag).alias(f"{prefix}_den"),
        (F.count(F.lit(1)) - F.count(flag)).alias(f"{prefix}_excluded"),
    ]


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double"))


def within(metric: Column, value: Column, threshold: Column) -> Column:
    """A correlation must reach its threshold; a difference must not pass it."""
    return F.when(metric == "pcc", value >= threshold).otherwise(value <= threshold)


def any_true_all_false(*flags: Column) -> Column:
    """1.0 if any flag is true, 0.0 if all are false, else null: SQL's three-valued OR."""
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out.cast("double")


def pearson(x: str, y: str) -> Column:
    """Correlation aggregate: 1 for equal sides, 0 for a constant side, else the clamped correlation."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    dx = F.regr_sxx(a, b), F.regr_syy(a, b)
    r = F.regr_sxy(a, b) / F.sqrt(F.nullif(dx[0], F.lit(0.0))) / F.sqrt(F.nullif(dx[1], F.lit(0.0)))
    return F.when(F.bool_and(a.eqNullSafe(b)), F.lit(1.0)).when(flat, F.lit(0.0)).otherwise(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)), F.lit(0.0)))

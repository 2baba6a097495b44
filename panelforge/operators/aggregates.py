"""Aggregate columns shared by the quality and evaluation jobs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pearson(x: Column, y: Column, *, min_rows: int = 1, tiny: float = 1e-12) -> Column:
    """Pairwise-complete Pearson correlation from six sums, combined before the shuffle.

    NULL when fewer than ``min_rows`` complete pairs exist or either population variance
    is at most ``tiny``; unlike ``corr`` it never divides by zero under ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    n = F.count(F.when(both, F.lit(1))).cast("double")
    sx, sy = F.sum(F.when(both, x)), F.sum(F.when(both, y))
    sxx, syy = F.sum(F.when(both, x * x)), F.sum(F.when(both, y * y))
    sxy = F.sum(F.when(both, x * y))
    var_x = sxx - sx * sx / F.nullif(n, F.lit(0.0))
    var_y = syy - sy * sy / F.nullif(n, F.lit(0.0))
    usable = (n >= F.lit(float(min_rows))) & (var_x > n * F.lit(tiny)) & (var_y > n * F.lit(tiny))
    return F.when(usable, (sxy - sx * sy / F.nullif(n, F.lit(0.0))) / F.sqrt(var_x * var_y))


def weighted_mean(x: Column, w: Column, *, count_missing: bool = False) -> Column:
    """Σ x·w / Σ w. ``count_missing`` keeps the weight of NULL values in the denominator."""
    weight = w if count_missing else F.when(x.isNotNull(), w)
    top = F.sum(x * w)
    if count_missing:
        top = F.coalesce(top, F.lit(0.0))
    return top / F.nullif(F.sum(weight), F.lit(0.0))


def share(condition: Column) -> Column:
    """Share of true over all rows; a NULL condition counts as false."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def information_ratio(x: Column) -> Column:
    spread = F.stddev_samp(x)
    return F.when(spread > 0, F.avg(x) / spread)

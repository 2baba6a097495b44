"""Scalar functions as Column builders; missing means NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed values.
DIVISOR_FLOOR = 1e-8
MAX_ABS = 1e6


def missing_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def missing_if_infinite(x: Column) -> Column:
    """Keep finite values only."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def clip(x: Column, bound: float = MAX_ABS) -> Column:
    """Clip to ±bound; infinities become ±bound, missing stays missing."""
    limited = F.greatest(F.least(x, F.lit(float(bound))), F.lit(-float(bound)))
    return F.when(x.isNotNull() & ~F.isnan(x), limited)


def fixed(x: Column, digits: int) -> Column:
    """Round half up in plain double arithmetic, so every engine gets the same double."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)) / scale


def negate(x: Column) -> Column:
    return -x


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_sqrt(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def signed_power(x: Column, power: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(float(power)))


def guarded_divide(a: Column, b: Column, floor: float = DIVISOR_FLOOR) -> Column:
    """a / b where |b| > floor, else NULL."""
    return F.when(F.abs(b) > F.lit(floor), a / b)


def lower_of(a: Column, b: Column) -> Column:
    """Smaller value, NULL when either side is missing (``least`` would skip NULLs)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def higher_of(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def signal(rank: Column, mode: str = "linear") -> Column:
    """Turn a percentile rank into a vote in [-1, 1]."""
    linear = rank * F.lit(2.0) - F.lit(1.0)
    if mode == "linear":
        return linear
    if mode == "binary":
        return F.signum(linear)
    if mode == "tanh":
        return F.tanh(linear * F.lit(2.0)) / F.tanh(F.lit(2.0))
    raise ValueError(f"unknown signal mode: {mode}")


def half_life_weight(age: Column, half_life: float) -> Column:
    """0.5^(age / half_life); a half-life of zero weighs every age alike."""
    return F.pow(F.lit(0.5), age / F.lit(float(half_life))) if half_life else F.lit(1.0)


def gain(relevance: Column) -> Column:
    return F.pow(F.lit(2.0), relevance.cast("double")) - F.lit(1.0)


def discount(position: Column) -> Column:
    return F.lit(1.0) / F.log2(position.cast("double") + F.lit(1.0))


def floor_bin(rank: Column, bins: int) -> Column:
    """Bin number of a rank in [0, 1]; rounding first keeps edges such as 0.7 stable."""
    return F.least(F.floor(F.round(rank * F.lit(float(bins)), 9)), F.lit(bins - 1)).cast("int")


def relevance_by_edges(rank: Column, edges: Sequence[float]) -> Column:
    """Number of edges reached by the rank; missing ranks have relevance 0."""
    total = F.lit(0)
    for edge in edges:
        total = total + F.when(rank >= F.lit(float(edge)), 1).otherwise(0)
    return total.cast("int")


def relevance_deciles(rank: Column) -> Column:
    return F.least(F.floor(F.round(rank * F.lit(10.0), 9)), F.lit(9)).cast("int")


def seeded_hash(code: Column, seed: int) -> Column:
    """Stable sampling key: hex MD5 of ``seed:code``, compared as text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), code.cast("string")))

"""Pooled, pairwise-complete correlation of daily ranks between many expression columns.

Tasks add up six products per batch or date and only those sums are shuffled: no pairs of
rows or cells are emitted.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from panelforge.operators.daily import CELLS
from panelforge.operators.ranks import average_ranks
from panelforge.session import group_limit

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
_SCHEMA = "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS)


def _products(x: np.ndarray) -> np.ndarray:
    """n, Σx, Σy, Σx², Σy², Σxy of every column pair over rows where both are present."""
    here = ~np.isnan(x)
    x, m = np.where(here, x, 0.0), here.astype("float64")
    xx = x * x
    return np.stack([m.T @ m, x.T @ m, m.T @ x, xx.T @ m, m.T @ xx, x.T @ x])


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """n, Σx, Σy, Σx², Σy², Σxy of every column of x with every column of y."""
    here, there = ~np.isnan(x), ~np.isnan(y)
    x, y, m, o = np.where(here, x, 0.0), np.where(there, y, 0.0), here.astype("float64"), there.astype("float64")
    return np.stack([m.T @ o, x.T @ o, m.T @ y, (x * x).T @ o, m.T @ (y * y), x.T @ y])


def _upper(sums: np.ndarray):
    import pandas as pd

    left, right = np.triu_indices(sums.shape[1])
    return pd.DataFrame({"i": left, "j": right, **{s: sums[q, left, right] for q, s in enumerate(_SUMS)}})


def correlations(partial: DataFrame, names: Sequence[str]) -> DataFrame:
    total = partial.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.nullif(F.col("n"), F.lit(0.0))
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    proper = (vx > F.col("n") * 1e-12) & (vy > F.col("n") * 1e-12)
    labels = F.array(*[F.lit(x) for x in names])
    return total.select(
        F.element_at(labels, F.col("i") + 1).alias("left"),
        F.element_at(labels, F.col("j") + 1).alias("right"),
        F.col("n").cast("long").alias("n"),
        F.when(proper, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy)).alias("correlation"),
    )


def gram_correlation(ranks: DataFrame, names: Sequence[str]) -> DataFrame:
    """(left, right, n, correlation) of rank columns, whatever the layout of the rows."""
    names = list(names)

    def add_up(batches):
        sums = np.zeros((len(_SUMS), len(names), len(names)))
        for batch in batches:
            sums += _products(batch[names].to_numpy(dtype="float64"))
        yield _upper(sums)

    return correlations(ranks.select(*names).mapInPandas(add_up, _SCHEMA), names)


def rank_correlation(wide: DataFrame, names: Sequence[str], *, widest: int) -> DataFrame:
    """Rank every column per date, then correlate.

    Dates that fit a task are ranked and multiplied together after one exchange; larger
    dates use the rank windows, which split them.
    """
    names = list(names)
    if widest * len(names) > CELLS or widest > group_limit(wide.sparkSession):
        wide = average_ranks(wide, ["trade_date"], {n: f"__{n}" for n in names}, widest=widest)
        return gram_correlation(wide.select(*[F.col(f"__{n}").alias(n) for n in names]), names)

    def one_date(frame):
        return _upper(_products(frame[names].rank(pct=True).to_numpy(dtype="float64")))

    return correlations(wide.select("trade_date", *names).groupBy("trade_date").applyInPandas(one_date, _SCHEMA), names)

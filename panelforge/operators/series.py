"""Row windows along each entity's own series.

A panel holds one row per (entity, date), so a series has at most one row per calendar
date; every window here shares one partitioning and one sort.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelforge.functions.scalar import missing_if_infinite

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Names of the backward-looking operators.
TEMPORAL = ("delta_5", "slope_5", "mean_5", "std_20", "zscore_20", "ts_rank_20")
FLAT = 1e-12

def _series():
    return Window.partitionBy("entity").orderBy("trade_date")


def _last(rows: int):
    return _series().rowsBetween(1 - rows, 0)


def lagged(x: Column, rows: int) -> Column:
    return F.lag(x, rows).over(_series())


def led(x: Column, rows: int) -> Column:
    return F.lead(x, rows).over(_series())


def rolling_sum(x: Column, rows: int) -> Column:
    return F.sum(x).over(_last(rows))


# Window primitives: each is computed once per feature, whatever formulas share it.
_WINDOWS = {
    "lag1": lambda x: lagged(x, 1),
    "lag3": lambda x: lagged(x, 3),
    "lag4": lambda x: lagged(x, 4),
    "lag5": lambda x: lagged(x, 5),
    "n5": lambda x: F.count(x).over(_last(5)),
    "mean5": lambda x: F.avg(x).over(_last(5)),
    "n20": lambda x: F.count(x).over(_last(20)),
    "mean20": lambda x: F.avg(x).over(_last(20)),
    "std20": lambda x: F.stddev_samp(x).over(_last(20)),
    "seen20": lambda x: F.collect_list(x).over(_last(20)),  # at most 20 values, NULLs dropped
}


def _slope(x: Column, w: dict[str, Column]) -> Column:
    """Least-squares slope over the last five rows; NULL if a used row is missing."""
    return (x * 2.0 + w["lag1"] - w["lag3"] - w["lag4"] * 2.0) / F.lit(10.0)


def _recent_rank(x: Column, w: dict[str, Column]) -> Column:
    """Average-tie percentile rank of the current value among its last values."""
    size = F.size(w["seen20"])
    below = F.size(F.filter(w["seen20"], lambda v: v < x))
    equal = F.size(F.filter(w["seen20"], lambda v: v == x))
    return F.when(x.isNotNull() & (size >= 5), (below + (equal + 1) / F.lit(2.0)) / size)


# Operator -> (window primitives, formula over the feature and those columns).
_FORMULAS = {
    "delta_5": (("lag5",), lambda x, w: x - w["lag5"]),
    "slope_5": (("lag1", "lag3", "lag4"), _slope),
    "mean_5": (("n5", "mean5"), lambda x, w: F.when(w["n5"] >= 3, w["mean5"])),
    "std_20": (("n20", "std20"), lambda x, w: F.when(w["n20"] >= 5, w["std20"])),
    "zscore_20": (
        ("n20", "mean20", "std20"),
        lambda x, w: F.when((w["n20"] >= 5) & (w["std20"] > F.lit(FLAT)), (x - w["mean20"]) / w["std20"]),
    ),
    "ts_rank_20": (("seen20",), _recent_rank),
}


def temporal_column(name: str, feature: str) -> str:
    return f"{name}__{feature}"


def with_temporals(panel: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Add one column per (operator, feature); needs the full history of every entity.

    All windows share one partitioning and sort, so any number of pairs costs one exchange.
    """
    wanted = sorted(set(pairs))
    if not wanted:
        return panel
    made = {(w, f) for op, f in wanted for w in _FORMULAS[op][0]}
    windows = panel.select(
        "*", *[_WINDOWS[w](F.col(f).cast("double")).alias(f"__{w}__{f}") for w, f in sorted(made)]
    )
    columns = []
    for op, feature in wanted:
        needs, formula = _FORMULAS[op]
        value = formula(F.col(feature).cast("double"), {w: F.col(f"__{w}__{feature}") for w in needs})
        columns.append(missing_if_infinite(value).alias(temporal_column(op, feature)))
    return windows.select(*panel.columns, *columns)


# Rows that the widest window sees.
_REACH = 20


def _behind(x: np.ndarray, place: np.ndarray, rows: int) -> np.ndarray:
    """The value ``rows`` rows before in the same series; NaN before its first row."""
    out = np.full(len(x), np.nan)
    if rows < len(x):
        out[rows:] = np.where(place[rows:] >= rows, x[: len(x) - rows], np.nan)
    return out


def series_columns(x: np.ndarray, place: np.ndarray, names: Iterable[str]) -> dict[str, np.ndarray]:
    """The named operators over many series that follow each other; ``place`` counts the rows of each from 0.

    Sums and moments are added up from the oldest row on, as the SQL windows add them.
    """
    names, out = set(names), {}
    lag = {k: _behind(x, place, k) for k in range(_REACH)}
    with np.errstate(all="ignore"):
        if "delta_5" in names:
            out["delta_5"] = x - lag[5]
        if "slope_5" in names:
            out["slope_5"] = (x * 2.0 + lag[1] - lag[3] - lag[4] * 2.0) / 10.0
        for rows, wanted in ((5, {"mean_5"}), (_REACH, {"std_20", "zscore_20"})):
            if not wanted & names:
                continue
            n, total, mean, squares = (np.zeros(len(x)) for _ in range(4))
            for k in range(rows - 1, -1, -1):
                there = ~np.isnan(lag[k])
                v = np.where(there, lag[k], 0.0)
                n += there
                total += v
                if rows == _REACH:
                    delta = np.where(there, v - mean, 0.0)
                    part = delta / np.maximum(n, 1.0)
                    mean += part
                    squares += delta * (delta - part)
            if rows == 5:
                out["mean_5"] = np.where(n >= 3, total / n, np.nan)
                continue
            std = np.where(n >= 5, np.sqrt(squares / (n - 1.0)), np.nan)
            out["std_20"] = std
            out["zscore_20"] = np.where(std > FLAT, (x - total / n) / std, np.nan)
        if "ts_rank_20" in names:
            below, equal, n = (np.zeros(len(x)) for _ in range(3))
            for k in range(_REACH):
                below += lag[k] < x
                equal += lag[k] == x
                n += ~np.isnan(lag[k])
            out["ts_rank_20"] = np.where((n >= 5) & ~np.isnan(x), (below + (equal + 1.0) / 2.0) / n, np.nan)
    return {name: np.where(np.isfinite(out[name]), out[name], np.nan) for name in names}


def temporals_by_series(panel: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """:func:`with_temporals` for many pairs: after the same exchange and sort, Arrow batches with many
    series each are computed by NumPy, a feature at a time. The last rows of a batch are carried on."""
    wanted = sorted(set(pairs))
    if not wanted:
        return panel
    features: dict[str, list[str]] = {}
    for op, feature in wanted:
        features.setdefault(feature, []).append(op)
    columns, made = panel.columns, [temporal_column(op, f) for f, ops in features.items() for op in ops]
    doubles = [F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)]
    rows = panel.select("*", *doubles).repartition("entity").sortWithinPartitions("entity", "trade_date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_entity = [np.zeros(0) for _ in features], pa.array([], pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            entity = batch.column("entity")
            before = len(held_entity)
            joined = pa.concat_arrays([held_entity.cast(entity.type), entity])
            codes = joined.dictionary_encode(null_encoding="encode").indices.to_numpy()
            index = np.arange(len(codes))
            place = index - np.maximum.accumulate(np.where(np.append(True, codes[1:] != codes[:-1]), index, 0))
            found = []
            for i, (old, ops) in enumerate(zip(held, features.values())):
                x = np.concatenate((old, batch.column(f"__x{i}").to_numpy(zero_copy_only=False)))
                made_of = series_columns(x, place, ops)
                found += [pa.array(made_of[op][before:], pa.float64(), from_pandas=True) for op in ops]
                held[i] = x[-_REACH:]
            held_entity = joined[-_REACH:]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *found], names=[*columns, *made])

    schema = T.StructType([*panel.schema.fields, *(T.StructField(c, T.DoubleType()) for c in made)])
    return rows.mapInArrow(run, schema).select(*columns, *[temporal_column(op, f) for op, f in wanted])

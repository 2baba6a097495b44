"""Per-date statistics of many expression columns at once.

One row per (entity, date) carries all expressions of a batch, and NumPy ranks the columns of
a date together. Spark shuffles by date and chunk of columns: a chunk holds as many columns as
keep a date's cells within ``CELLS``, so a task's memory is bounded however many expressions
there are, and rows are repeated once per chunk, not once per expression.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TINY = 1e-12
# 4.2 million doubles are 34 MB per date and chunk.
CELLS = 4_200_000
STATISTICS = ["factor", "trade_date", "names", "n", "total", "scatter", "pos", "neg"]
SCHEMA = "factor int, trade_date string, names bigint, n bigint, total double, scatter double, pos double"


def _ranks(values: np.ndarray) -> np.ndarray:
    """Average ranks of every column; missing values are neither ranked nor counted."""
    out = np.full(values.shape, np.nan, order="F")
    for c in range(values.shape[1]):
        column = np.ascontiguousarray(values[:, c])
        known = ~np.isnan(column)
        column = column[known]
        if not len(column):
            continue
        order = np.argsort(column)  # rows of one value share a rank, so their order is free
        there = column[order]
        first = np.flatnonzero(np.concatenate(([True], there[1:] != there[:-1])))
        last = np.append(first[1:], len(there))
        ranks = np.empty(len(there))
        ranks[order] = np.repeat((first + 1 + last) / 2.0, last - first)
        out[known, c] = ranks
    return out


def _correlate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Column-wise Pearson over rows where both are present; NaN when one side is flat."""
    both = ~(np.isnan(x) | np.isnan(y))
    n = np.maximum(both.sum(0), 1)
    x, y = np.where(both, x, 0.0), np.where(both, y, 0.0)
    sx, sy = x.sum(0), y.sum(0)
    vx, vy = (x * x).sum(0) - sx * sx / n, (y * y).sum(0) - sy * sy / n
    flat = (vx <= n * TINY) | (vy <= n * TINY)
    root = np.sqrt(np.where(flat, 1.0, vx * vy))
    return np.where(flat, np.nan, ((x * y).sum(0) - sx * sy / n) / root)


def _leading(values: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest values in order, equal ones by position; missing values are last.

    The k-th value is found without a sort of the rest.
    """
    if len(values) > k:
        cut = np.partition(values, k - 1)[k - 1]
        if not np.isnan(cut):
            below = np.flatnonzero(values < cut)
            kept = np.concatenate((below, np.flatnonzero(values == cut)[: k - len(below)]))
            return kept[np.argsort(values[kept], kind="stable")]
    return np.argsort(values, kind="stable")[:k]


def _ndcg(values: np.ndarray, gains: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """NDCG@k of the highest and of the lowest values; missing values sort last."""
    high, low, ideal = (np.zeros((min(k, len(values)), values.shape[1])) for _ in range(3))
    best = np.argsort(-gains, kind="stable")
    for c in range(values.shape[1]):
        column = np.ascontiguousarray(values[:, c])
        high[:, c], low[:, c] = gains[_leading(-column, k)], gains[_leading(column, k)]
        seen, some = 4 * k, []
        while len(some) < k:  # the best gains of present rows, seldom beyond the first few
            some = best[:seen][~np.isnan(column[best[:seen]])][:k]
            if seen >= len(best):
                break
            seen *= 4
        ideal[: len(some), c] = gains[some]
    weights = 1.0 / np.log2(np.arange(2, k + 2))[: len(high), None]
    total = (ideal * weights).sum(0)
    total = np.where(total > 0, total, np.nan)
    return (high * weights).sum(0) / total, (low * weights).sum(0) / total


def _moments(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, total, scatter) of the present values of every column, a column at a time."""
    n, total, scatter = np.zeros(values.shape[1], "i8"), np.zeros(values.shape[1]), np.zeros(values.shape[1])
    for c in range(values.shape[1]):
        column = values[:, c]
        column = column[~np.isnan(column)]
        n[c], total[c] = len(column), column.sum()
        if len(column):
            column -= total[c] / len(column)
            scatter[c] = np.dot(column, column)
    return n, total, scatter


def column_statistics(values: np.ndarray, target: np.ndarray, relevance: np.ndarray, kind: str, k: int, least: int) -> tuple:
    """(names, n, total, scatter, pos, neg) of every column of one date, whose rows are in order of entity.

    Columns are taken one after the other, so the steps of a column stay in the cache.
    """
    labelled = ~np.isnan(target)
    size, total, scatter = _moments(values)
    if kind == "prerank":
        complete = (~np.isnan(values[labelled])).sum(0)
        usable = complete >= least
        pos = _correlate(_ranks(values), np.broadcast_to(target[:, None], values.shape))
        neg = -pos
    else:
        complete, around = size, scatter
        if not labelled.all():
            values, target, relevance = np.asfortranarray(values[labelled]), target[labelled], relevance[labelled]
            complete, _, around = _moments(values)
        usable = (complete >= least) & (np.sqrt(around / np.maximum(complete, 1)) >= TINY)
        if kind == "ic":
            pos = _correlate(_ranks(values), _ranks(np.where(np.isnan(values), np.nan, target[:, None])))
            neg = -pos
        else:
            pos, neg = _ndcg(values, np.exp2(relevance) - 1.0, k)
    return complete, size, total, scatter, np.where(usable, pos, np.nan), np.where(usable, neg, np.nan)


def daily_statistics(
    wide: DataFrame, names: Sequence[str], kind: str, *, k: int = 50, least: int = 1, widest: int | None = None
) -> DataFrame:
    """(factor, trade_date, names, n, total, scatter, pos, neg) for every expression column.

    ``kind`` is ``prerank`` (IC against the given target_rank), ``ic`` (both sides ranked
    over complete rows) or ``ndcg``. ``names`` counts complete rows; n, total and scatter
    describe the non-missing values; pos and neg are NULL below ``least`` complete rows.
    ``widest`` is the panel's measured widest date; without it all columns go together.
    """
    names = list(names)
    schema = SCHEMA + ", neg double"
    width = max(1, min(len(names), CELLS // max(1, widest or 1)))

    def one_date(key, frame):
        import pandas as pd

        frame = frame.sort_values("entity", kind="stable")
        values = np.stack(frame["cells"].to_numpy()).astype("float64") if width < len(names) else frame[names].to_numpy(dtype="float64")
        first = int(frame["chunk"].iloc[0]) * width if width < len(names) else 0
        target, relevance = (frame[c].to_numpy(dtype="float64") for c in ("target_rank", "relevance"))
        found = column_statistics(values, target, relevance, kind, k, least)
        return pd.DataFrame({"factor": np.arange(first, first + values.shape[1]), "trade_date": key[0], **dict(zip(STATISTICS[2:], found))})

    keys = ["entity", "trade_date", "target_rank", "relevance"]
    if width < len(names):
        cell = lambda n: F.col(n).cast("double")
        parts = [
            F.struct(F.lit(i).alias("chunk"), F.array(*[cell(n) for n in names[s : s + width]]).alias("cells"))
            for i, s in enumerate(range(0, len(names), width))
        ]
        rows = wide.select(*keys, F.inline(F.array(*parts)))
        found = rows.groupBy("trade_date", "chunk").applyInPandas(one_date, schema)
    else:
        found = wide.select(*keys, *names).groupBy("trade_date").applyInPandas(one_date, schema)
    return named_statistics(found, names)


def named_statistics(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """Statistics with the names of the columns that their numbers stand for."""
    present = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    labels = F.array(*[F.lit(n) for n in names])
    return found.select(
        F.element_at(labels, F.col("factor") + 1).alias("factor"), "trade_date", "names", "n", "total", "scatter",
        present("pos"), present("neg"),
    )


SIGNALS = {"linear": lambda x: x, "binary": np.sign, "tanh": lambda x: np.tanh(x * 2.0) / np.tanh(2.0)}


def _rounded(x: np.ndarray) -> np.ndarray:
    """To nine digits, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e9 + 0.5) / 1e9, x) + 0.0


def daily_score_quality(
    rows: DataFrame, factors: Sequence[str], votes: DataFrame, label: str, *, modes: Sequence[str], tail: float, least: int, ranked: bool
) -> DataFrame:
    """(trade_date, slot, ic, spread) of the votes of every date, mode after mode.

    ``votes`` has an array per date, one weight per factor for every combination in turn. ``rows`` holds
    percentile ranks or, unless ``ranked``, values that are ranked here. A date is dealt once, by its
    factors; its scores are formed, ranked and dropped one combination at a time.
    """
    factors, n = list(factors), len(factors)

    def one_date(table: pa.Table, votes: pa.Table) -> pa.Table:
        doubles = lambda c: np.array(table.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy())
        y = doubles(label)
        known, ranks, ics, spreads = ~np.isnan(y), [], [], []
        y = y[known]
        if not len(y) or not votes.num_rows:
            return pa.table({"trade_date": pa.array([], pa.string()), "slot": pa.array([], pa.int32()), "ic": pa.array([], pa.float64()), "spread": pa.array([], pa.float64())})
        for c in factors:
            x = doubles(c)
            if not ranked:
                x = _ranks(x[:, None])[:, 0] / max(1, np.count_nonzero(~np.isnan(x)))
            ranks.append(x[known] * 2.0 - 1.0)
        weights = np.array(votes.column("votes")[0].as_py()).reshape(-1, n)
        target = _ranks(y[:, None])
        for mode in modes:
            signals = [np.nan_to_num(SIGNALS[mode](x), nan=0.0) for x in ranks]
            for own in weights.tolist():
                score = np.zeros(len(y))
                for x, w in zip(signals, own):
                    score += x * w
                place = _ranks(_rounded(score)[:, None])
                ics.append(float(_correlate(place, target)[0]) if len(y) >= least else np.nan)
                pct = place[:, 0] / len(y)
                high, low = y[pct >= 1.0 - tail], y[pct <= tail]
                spreads.append(high.mean() - low.mean() if len(high) and len(low) else np.nan)
        date = table.column("trade_date")[0].as_py()
        return pa.table({"trade_date": [date] * len(ics), "slot": pa.array(range(len(ics)), pa.int32()), "ic": np.array(ics), "spread": np.array(spreads)})

    dated = rows.select("trade_date", label, *factors).groupBy("trade_date")
    found = dated.cogroup(votes.select("trade_date", "votes").groupBy("trade_date")).applyInArrow(one_date, "trade_date string, slot int, ic double, spread double")
    present = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select("trade_date", "slot", present("ic"), present("spread"))


def value_spread(daily: DataFrame) -> DataFrame:
    """Sample standard deviation of each factor's values, merged from the daily moments."""
    kept = daily.where(F.col("n") > 0)
    n, total = F.sum("n"), F.sum("total")
    squares = F.sum("scatter") + F.sum(F.col("total") * F.col("total") / F.col("n")) - total * total / n
    return kept.groupBy("factor").agg(
        F.when(n > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (n - 1))).alias("value_std")
    )

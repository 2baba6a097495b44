"""Ranks inside groups (usually one date) that stay distributed when a group is huge.

Two physical forms give identical results:

* groups known to hold at most ``group_limit`` rows use one window per group;
* larger groups are cut into value-ordered slices. The cut points come from a
  hash sample, so they are repeatable; any cut points give exact ranks because the
  rows before a slice are counted and added. A value that is itself a cut point has a
  slice of its own whose rows share one average rank, so a value held by a large part
  of all rows needs no sort and is spread by a salt.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelforge.session import broadcast_checked, group_limit, materialize

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLES_PER_SLICE = 16
SALTS = 64
# Cells of 8 bytes that one task may hold of a group.
GROUP_CELLS = 16_000_000


def widest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; the count is combined before the shuffle."""
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return int(top or 0)


def average_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    *,
    pct: bool = True,
    identity: Sequence[str] = ("entity",),
    widest: int | None = None,
) -> DataFrame:
    """Ascending rank with ties averaged; NULL values are neither ranked nor counted."""
    limit = group_limit(df.sparkSession)
    widest = widest_group(df, keys) if widest is None else widest
    if widest > limit:
        return _average_rank_sliced(df, keys, value, out, pct, identity, limit)
    order = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    size = F.count(value).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rank = (F.rank().over(order) + F.count(value).over(order)) / F.lit(2.0)
    rank = rank / size if pct else rank
    return df.withColumn(out, F.when(F.col(value).isNotNull(), rank))


def ranks_among(few: DataFrame, df: DataFrame, keys: Sequence[str], value: str, out: str, *, pct: bool = True) -> DataFrame:
    """:func:`average_rank` of the rows ``few`` of ``df``, at most some thousands per group, among all its rows.

    The values of ``few`` are the cut points, so every row of ``few`` lies in a slice of equal values, whose
    rows are counted where they are: what is shuffled are counts, whatever the size of a group.
    """
    filled, here = F.col(value).isNotNull(), F.struct(F.col(value).alias("v"))
    cuts = few.where(filled).groupBy(*keys).agg(F.array_sort(F.collect_set(here)).alias("__cuts"))
    cuts = materialize(_two_levels(cuts))
    # Groups without a row of few are left out by the join.
    counted = df.select(*keys, value).join(broadcast_checked(cuts.select(*keys)), list(keys), "left_semi")
    steps = materialize(_steps(_placed(counted, cuts, keys, here, filled), keys, filled))
    joined = _placed(few, cuts, keys, here, filled).join(broadcast_checked(steps), [*keys, "__slice"], "left")
    rank = F.col("__before") + (F.col("__rows") + 1) / F.lit(2.0)
    rank = rank / F.col("__size") if pct else rank
    return joined.select(*few.columns, F.when(filled, rank).alias(out))


def average_ranks(
    df: DataFrame,
    keys: Sequence[str],
    outs: Mapping[str, str],
    *,
    pct: bool = True,
    identity: Sequence[str] = ("entity",),
    widest: int | None = None,
) -> DataFrame:
    """:func:`average_rank` of several columns, given as value -> output name.

    Groups of up to ``GROUP_CELLS`` cells are ranked by NumPy, all columns together, after one
    exchange and one sort by the keys. Larger ones that fit a task take a window, that is a sort of
    whole rows, per column. Beyond, only keys and
    values are laid out as one row per column, cut and ranked together, and joined back
    once, so the number of tables written does not depend on the number of columns.
    """
    limit = group_limit(df.sparkSession)
    widest = widest_group(df, keys) if widest is None else widest
    numeric = (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)
    small = widest <= limit and widest * (len(df.columns) + len(outs)) <= GROUP_CELLS
    if len(outs) > 1 and small and all(isinstance(df.schema[v].dataType, numeric) for v in outs):
        return _ranked_together(df, keys, outs, pct)
    if widest <= limit or len(outs) == 1:
        for value, out in outs.items():
            df = average_rank(df, keys, value, out, pct=pct, identity=identity, widest=widest)
        return df
    cells = [F.struct(F.lit(i).alias("__column"), F.col(v).cast("double").alias("__value")) for i, v in enumerate(outs)]
    long = df.select(*keys, *identity, F.inline(F.array(*cells)))
    long = _average_rank_sliced(long, [*keys, "__column"], "__value", "__rank", pct, identity, limit)
    back = long.groupBy(*keys, *identity).agg(
        *[F.max(F.when(F.col("__column") == i, F.col("__rank"))).alias(out) for i, out in enumerate(outs.values())]
    )
    return df.join(back, [*keys, *identity])


def ranks_of(values: np.ndarray, pct: bool) -> np.ndarray:
    """Average ranks of the values; NaN is largest and equals itself."""
    order = np.argsort(values, kind="stable")
    there = values[order]
    new = np.ones(len(there), bool)
    new[1:] = (there[1:] != there[:-1]) & ~(np.isnan(there[1:]) & np.isnan(there[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(there))
    out = np.empty(len(there))
    out[order] = np.repeat((first + 1 + last) / 2.0, last - first)
    return out / len(there) if pct else out


def _ranked_together(df: DataFrame, keys: Sequence[str], outs: Mapping[str, str], pct: bool) -> DataFrame:
    def rank(rows: pa.Table) -> pa.Table:
        for value, out in outs.items():
            column = rows.column(value)
            known = pc.is_valid(column).to_numpy()
            ranks = np.full(len(known), np.nan)
            ranks[known] = ranks_of(column.drop_null().to_numpy().astype("f8"), pct)
            rows = rows.append_column(out, pa.array(ranks, pa.float64(), mask=~known))
        return rows

    schema = T.StructType([*df.schema.fields, *(T.StructField(out, T.DoubleType()) for out in outs.values())])
    return df.groupBy(*keys).applyInArrow(rank, schema)


def ordinal_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    *,
    descending: bool = False,
    pct: bool = False,
    tie: str = "entity",
    widest: int | None = None,
) -> DataFrame:
    """Position 1..n with ties broken by ``tie`` ascending; NULL values get NULL."""
    limit = group_limit(df.sparkSession)
    widest = widest_group(df, keys) if widest is None else widest
    if widest > limit:
        return _ordinal_rank_sliced(df, keys, value, out, descending, pct, tie, limit)
    first = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    order = Window.partitionBy(*keys).orderBy(first, F.col(tie).asc())
    size = F.count(value).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rank = F.row_number().over(order)
    rank = rank / size if pct else rank
    return df.withColumn(out, F.when(F.col(value).isNotNull(), rank))


def top_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    out: str = "position",
) -> DataFrame:
    """First ``k`` rows of each group.

    The filter on ``row_number`` becomes a group limit applied before the shuffle, so at
    most k rows per group leave each task whatever the group's size.
    """
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= k)


def _cut_points(df: DataFrame, keys: Sequence[str], order: Sequence[Column], filled: Column,
                identity: Sequence[str], limit: int) -> DataFrame:
    """Sorted distinct cut points of every group above ``limit`` rows, one row per group."""
    present = df.where(filled)
    hot = materialize(present.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit))
    slices = F.ceil(F.col("__n") * 2 / F.lit(float(limit)))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / (slices * SAMPLES_PER_SLICE)))
    sampled = present.join(broadcast_checked(hot), list(keys)).where(
        F.pmod(F.xxhash64(*keys, *identity), step) == 0
    )
    points = sampled.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("__cuts"))
    every = F.filter("__cuts", lambda cut, i: i % SAMPLES_PER_SLICE == SAMPLES_PER_SLICE // 2)
    return materialize(_two_levels(points.select(*keys, F.array_distinct(every).alias("__cuts"))))


def _two_levels(cuts: DataFrame) -> DataFrame:
    """Every so many cut points once more, which keeps the search of a row's slice at about 2·sqrt(cut points) comparisons."""
    return cuts.withColumn(
        "__step", F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("__cuts").cast("double")))).cast("int")
    ).withColumn("__coarse", F.filter("__cuts", lambda cut, i: i % F.col("__step") == F.col("__step") - 1))


def _placed(df: DataFrame, cuts: DataFrame, keys: Sequence[str], here: Column, filled: Column) -> DataFrame:
    """Add ``__slice``, monotone in the order of ``here``; odd slices hold what equals a cut point."""
    return (
        df.join(broadcast_checked(cuts), list(keys), "left")
        .withColumn("__skip", F.size(F.filter("__coarse", lambda c: c < here)) * F.col("__step"))
        .withColumn("__near", F.slice("__cuts", F.col("__skip") + 1, F.col("__step")))
        .withColumn(
            "__slice",
            F.when(
                F.col("__cuts").isNotNull() & filled,
                2 * (F.col("__skip") + F.size(F.filter("__near", lambda c: c < here)))
                + F.array_contains("__near", here).cast("int"),
            ).otherwise(0),
        )
        .drop("__cuts", "__step", "__coarse", "__skip", "__near")
    )


def _steps(placed: DataFrame, keys: Sequence[str], filled: Column) -> DataFrame:
    """Rows of every slice, rows before it and rows of its group."""
    counts = placed.where(filled).groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__rows"))
    ladder = Window.partitionBy(*keys).orderBy("__slice")
    whole = Window.partitionBy(*keys)
    return counts.select(
        *keys,
        "__slice",
        "__rows",
        (F.sum("__rows").over(ladder) - F.col("__rows")).alias("__before"),
        F.sum("__rows").over(whole).alias("__size"),
    )


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column], filled: Column,
            identity: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Add ``__slice`` (monotone in ``order``; odd = equal to a cut point) and count slices.

    The rows are written first: they are read to count, to sample, to place and to rank.
    """
    df = materialize(df)
    cuts = _cut_points(df, keys, order, filled, identity, limit)
    cut = _placed(df, cuts, keys, F.struct(*order), filled)
    return cut, broadcast_checked(materialize(_steps(cut, keys, filled)))


def _average_rank_sliced(df, keys, value, out, pct, identity, limit):
    cut, steps = _sliced(df, keys, [F.col(value).alias("v")], F.col(value).isNotNull(), identity, limit)
    tied = F.col("__slice") % 2 == 1
    # Rows that need no sort (ties at a cut point, missing values) are spread by the salt.
    spread = F.when(
        tied | F.col(value).isNull(), F.pmod(F.xxhash64(*keys, *identity), F.lit(SALTS)) + 1
    ).otherwise(0)
    order = Window.partitionBy(*keys, "__slice", "__salt").orderBy(F.col(value).asc_nulls_last())
    local = cut.withColumn("__salt", spread).withColumn(
        "__local", (F.rank().over(order) + F.count(value).over(order)) / F.lit(2.0)
    )
    joined = local.join(steps, [*keys, "__slice"], "left")
    rank = F.col("__before") + F.when(tied, (F.col("__rows") + 1) / F.lit(2.0)).otherwise(F.col("__local"))
    rank = rank / F.col("__size") if pct else rank
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), rank)).select(*df.columns, out)


def _ordinal_rank_sliced(df, keys, value, out, descending, pct, tie, limit):
    signed = -F.col(value) if descending else F.col(value)
    order = [signed.alias("v"), F.col(tie).alias("t")]
    cut, steps = _sliced(df, keys, order, F.col(value).isNotNull(), [tie], limit)
    spread = F.when(F.col(value).isNull(), F.pmod(F.xxhash64(*keys, tie), F.lit(SALTS)) + 1).otherwise(0)
    first = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    local = cut.withColumn("__salt", spread).withColumn(
        "__local",
        F.row_number().over(Window.partitionBy(*keys, "__slice", "__salt").orderBy(first, F.col(tie).asc())),
    )
    joined = local.join(steps, [*keys, "__slice"], "left")
    rank = F.col("__before") + F.col("__local")
    rank = rank / F.col("__size") if pct else rank
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), rank)).select(*df.columns, out)

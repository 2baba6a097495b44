"""Labels and deterministic samples (table to table)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelforge.functions.scalar import relevance_by_edges, seeded_hash
from panelforge.operators.ranks import average_rank, ordinal_rank, ranks_among, top_rows

# Default label settings.
RELEVANCE_EDGES = (0.90, 0.95, 0.98, 0.99)
TOP_K = 50


def with_target_rank(panel: DataFrame, label: str, *, widest: int | None = None) -> DataFrame:
    return average_rank(panel, ["trade_date"], label, "target_rank", widest=widest)


def flag_top(df: DataFrame, value: str, k: int, out: str, *, tie: str = "entity", among: DataFrame | None = None) -> DataFrame:
    """1 for the k best rows of each date, else 0, without ranking all rows.

    The k-th row of every date (a calendar-sized table found by a group limit) is the cut. ``df`` may
    hold some rows only of the panel ``among``, whose best are meant.
    """
    best = top_rows(
        (df if among is None else among).where(F.col(value).isNotNull()).select("trade_date", tie, value),
        ["trade_date"],
        [F.col(value).desc(), F.col(tie).asc()],
        k,
    )
    cut = best.groupBy("trade_date").agg(
        F.max_by(F.struct(F.col(value).alias("v"), F.col(tie).alias("t")), "position").alias("__cut")
    )
    inside = (F.col(value) > F.col("__cut.v")) | (
        (F.col(value) == F.col("__cut.v")) & (F.col(tie) <= F.col("__cut.t"))
    )
    return df.join(F.broadcast(cut), "trade_date", "left").select(
        *df.columns, F.when(inside, 1).otherwise(0).alias(out)
    )


def add_labels(
    panel: DataFrame,
    label: str = "future_ret",
    k: int = TOP_K,
    edges: Sequence[float] = RELEVANCE_EDGES,
    *,
    position: bool = True,
    widest: int | None = None,
) -> DataFrame:
    """target_rank, relevance, target_position and is_target_topk per date.

    ``position=False`` leaves out the full ordinal and finds the top k by a cut instead.
    """
    df = with_target_rank(panel, label, widest=widest)
    df = df.withColumn("relevance", relevance_by_edges(F.col("target_rank"), edges))
    if not position:
        return flag_top(df, label, k, "is_target_topk")
    df = ordinal_rank(df, ["trade_date"], label, "target_position", descending=True, widest=widest)
    return df.withColumn("is_target_topk", F.when(F.col("target_position") <= k, 1).otherwise(0))


def labels_among(few: DataFrame, panel: DataFrame, label: str = "future_ret", edges: Sequence[float] = RELEVANCE_EDGES) -> DataFrame:
    """target_rank and relevance of the rows ``few`` of a panel among all rows of their dates; the panel is only counted."""
    ranked = ranks_among(few, panel, ["trade_date"], label, "target_rank")
    return ranked.withColumn("relevance", relevance_by_edges(F.col("target_rank"), edges))


def flag_entities(panel: DataFrame, n: int, seed: int, out: str = "in_sample", *, label: str | None = None) -> DataFrame:
    """True for the ``n`` lowest-hash entities of each date; the hash does not depend on the
    date, so an entity present on two dates is treated alike. With ``label``, rows without one
    are left out before the ``n`` are taken."""
    keyed = panel.withColumn("__hash", seeded_hash(F.col("entity"), seed))
    known = F.col(label).isNotNull() if label else F.lit(True)
    lowest = top_rows(
        keyed.where(known).select("trade_date", "__hash", "entity"), ["trade_date"], [F.asc("__hash"), F.asc("entity")], n
    )
    cut = lowest.groupBy("trade_date").agg(F.max(F.struct("__hash", "entity")).alias("__cut"))
    inside = known & F.coalesce(F.struct("__hash", "entity") <= F.col("__cut"), F.lit(False))
    return keyed.join(F.broadcast(cut), "trade_date", "left").select(*panel.columns, inside.alias(out))


def sample_entities(panel: DataFrame, n: int, seed: int) -> DataFrame:
    return flag_entities(panel, n, seed, "__in").where("__in").drop("__in")


def sample_months(panel: DataFrame, m: int, seed: int) -> DataFrame:
    """``m`` distinct months in seeded hash order (a calendar-sized table)."""
    months = panel.select(F.substring("trade_date", 1, 6).alias("month")).distinct()
    return months.orderBy(seeded_hash(F.col("month"), seed), "month").limit(m)


def search_mask(
    panel: DataFrame, n: int, seed: int, months: int | None = None, out: str = "in_search", *, label: str | None = None
) -> DataFrame:
    """Boolean column entity-sample AND month-sample; all rows are kept so that backward
    windows still see full histories. With ``label``, both samples are taken of labelled rows."""
    df = flag_entities(panel, n, seed, "__entity", label=label)
    if months is None:
        return df.withColumnRenamed("__entity", out)
    known = panel.where(F.col(label).isNotNull()) if label else panel
    chosen = sample_months(known, months, seed).withColumn("__month", F.lit(True))
    return (
        df.withColumn("month", F.substring("trade_date", 1, 6))
        .join(F.broadcast(chosen), "month", "left")
        .withColumn(out, F.col("__entity") & F.coalesce("__month", F.lit(False)))
        .drop("month", "__month", "__entity")
    )

"""Comparing experiments: winner choice, ablation, gap and importance tables, audits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from panelforge.operators.calendar import PanelShape
from panelforge.sources.store import audit_columns


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column))


def align_scores(validation: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Full outer alignment of two score vectors, missing as 0, with the difference."""
    joined = validation.join(test, key, "full_outer").na.fill(0.0, ["validation", "test"])
    return joined.withColumn("change", F.col("test") - F.col("validation"))


def importance_shift(validation: DataFrame, test: DataFrame, top: int = 10) -> DataFrame:
    """Normalised importances of two (factor, importance) tables; the ``top`` largest test values."""

    def normal(df, name):
        total = F.broadcast(df.agg(F.sum("importance").alias("total")))  # one row
        share = F.when(F.col("total") > 0, F.col("importance") / F.col("total")).otherwise(F.col("importance"))
        return df.crossJoin(total).select("factor", share.alias(name))

    aligned = align_scores(normal(validation, "validation"), normal(test, "test"), "factor")
    return aligned.orderBy(F.desc("test"), F.asc("factor")).limit(top)


def select_winner(
    results: DataFrame,
    *,
    years: Iterable[str],
    baseline_ndcg: float | None = None,
    min_win_rate: float = 0.55,
) -> DataFrame:
    """Best row with an ``eligible`` flag.

    Rows passing every gate come first; if none does, rows passing the NDCG gates; if none,
    all. Within the pool: median monthly excess, NDCG, then lower turnover.
    """
    beats = F.coalesce(F.col("ndcg"), F.lit(-1.0)) > F.coalesce(F.col("random_ndcg"), F.lit(0.0))
    if baseline_ndcg is not None:
        beats = beats & (F.coalesce(F.col("ndcg"), F.lit(-1.0)) > F.lit(float(baseline_ndcg)))
    gates = F.coalesce(F.col("monthly_win_rate"), F.lit(0.0)) >= F.lit(float(min_win_rate))
    for year in years:
        gates = gates & (F.coalesce(F.col(f"topk_excess_{year}"), F.lit(-1.0)) > 0)
    tier = F.when(gates & beats, 0).when(beats, 1).otherwise(2)
    return (
        results.withColumn("tier", tier)
        .orderBy(
            "tier",
            F.desc_nulls_last("monthly_median_excess"),
            F.desc_nulls_last("ndcg"),
            F.asc_nulls_last("turnover"),
            F.asc("experiment_id"),
        )
        .limit(1)
        .withColumn("eligible", F.col("tier") == 0)
        .drop("tier")
    )


def category_ablation(library: DataFrame, removed: str | None) -> DataFrame:
    """Library without one category; ``None`` keeps all."""
    return library if removed is None else library.where(~F.col("category").eqNullSafe(F.lit(removed)))


def validation_test_gap(validation: DataFrame, test: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """Per metric: both values, their difference and ratio (NULL when validation is 0)."""
    names = list(metrics)

    def melted(df, name):
        return df.select(*[F.col(m).cast("double").alias(m) for m in names]).unpivot([], names, "metric", name)

    joined = melted(validation, "validation").join(melted(test, "test"), "metric")
    return joined.select(
        "metric",
        "validation",
        "test",
        (F.col("test") - F.col("validation")).alias("absolute_gap"),
        (F.col("test") / F.nullif(F.col("validation"), F.lit(0.0))).alias("retention"),
    )


def audit_label_leakage(models: DataFrame, calendar: DataFrame, shape: PanelShape, *, horizon: int) -> DataFrame:
    """Refits that saw labels not yet known on their date; no rows means the audit passes."""
    placed = audit_columns(models, calendar, shape)
    return placed.where(F.col("train_position") > F.col("date_position") - F.lit(horizon + 1))


def audit_topk_complete(topk: DataFrame, k: int) -> DataFrame:
    """Dates whose selection is not exactly k distinct names."""
    counts = topk.groupBy("trade_date").agg(F.count("*").alias("rows"), F.countDistinct("entity").alias("names"))
    return counts.where((F.col("rows") != k) | (F.col("names") != k))


def union_results(results: Mapping[str, DataFrame]) -> DataFrame:
    """Summaries of several experiments as one table keyed by experiment_id."""
    merged = None
    for name, summary in results.items():
        row = summary.withColumn("experiment_id", F.lit(name))
        merged = row if merged is None else merged.unionByName(row, allowMissingColumns=True)
    return merged

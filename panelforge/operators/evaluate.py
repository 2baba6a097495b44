"""Evaluation of predictions: daily, monthly and summary tables.

A prediction row has entity, trade_date, score, the label, and for the top-k metrics
target_rank, relevance and is_target_topk.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.functions.scalar import discount, gain
from panelforge.operators.aggregates import information_ratio, pearson, share
from panelforge.operators.labels import flag_top, labels_among
from panelforge.operators.quality import daily_rank_ic
from panelforge.operators.ranks import average_rank, ordinal_rank, top_rows
from panelforge.session import materialize

DATE = ["trade_date"]
MONTHLY_METRICS = ("topk_excess", "topk_return", "ndcg", "precision", "rank_ic", "turnover")
YEARLY_METRICS = ("topk_return", "topk_excess", "topk_mean_percentile", "precision", "ndcg", "turnover", "rank_ic")


class Evaluation(NamedTuple):
    ranked: DataFrame
    daily: DataFrame
    monthly: DataFrame
    summary: DataFrame


def scored_rows(pred: DataFrame, label: str) -> DataFrame:
    return pred.na.drop(subset=["score", label])


def select_topk(pred: DataFrame, k: int) -> DataFrame:
    """Best k rows of each date by score, ties by entity."""
    return top_rows(pred, DATE, [F.desc("score"), F.asc("entity")], k, "pred_position")


def rank_predictions(pred: DataFrame, label: str, k: int, *, widest: int | None = None) -> DataFrame:
    """All scored rows with pred_position and is_pred_topk."""
    ranked = ordinal_rank(scored_rows(pred, label), DATE, "score", "pred_position", descending=True, widest=widest)
    return ranked.withColumn("is_pred_topk", F.col("pred_position") <= k)


def daily_universe(pred: DataFrame, label: str) -> DataFrame:
    return pred.groupBy(*DATE).agg(
        F.count("*").alias("names"),
        F.avg(label).alias("universe_return"),
        F.avg(gain(F.col("relevance"))).alias("mean_gain"),
    )


def daily_rank_corr(pred: DataFrame, label: str, *, widest: int | None = None) -> DataFrame:
    """Spearman of score and label per date; NULL when either side is constant."""
    ranked = average_rank(pred.select("entity", *DATE, "score", label), DATE, "score", "__x", pct=False, widest=widest)
    ranked = average_rank(ranked, DATE, label, "__y", pct=False, widest=widest)
    return ranked.groupBy(*DATE).agg(pearson(F.col("__x"), F.col("__y")).alias("rank_ic"))


def daily_topk(pred: DataFrame, label: str, k: int) -> DataFrame:
    return _topk_means(select_topk(pred, k), label)


def _topk_means(top: DataFrame, label: str) -> DataFrame:
    weighted = gain(F.col("relevance")) * discount(F.col("pred_position"))
    return top.groupBy(*DATE).agg(
        F.avg(label).alias("topk_return"),
        F.avg("target_rank").alias("topk_mean_percentile"),
        F.avg(F.col("is_target_topk").cast("double")).alias("precision"),
        F.sum(weighted).alias("dcg"),
    )


def daily_ideal(pred: DataFrame, k: int) -> DataFrame:
    best = top_rows(
        pred.select(*DATE, "entity", "relevance"), DATE, [F.desc("relevance"), F.asc("entity")], k, "ideal_position"
    )
    return best.groupBy(*DATE).agg(
        F.sum(gain(F.col("relevance")) * discount(F.col("ideal_position"))).alias("ideal_dcg")
    )


def ndcg(pred: DataFrame, k: int) -> DataFrame:
    """NDCG@k per date; NULL when the ideal is zero."""
    weighted = gain(F.col("relevance")) * discount(F.col("pred_position"))
    dcg = select_topk(pred, k).groupBy(*DATE).agg(F.sum(weighted).alias("dcg"))
    return dcg.join(daily_ideal(pred, k), DATE).select(
        *DATE, F.when(F.col("ideal_dcg") > 0, F.col("dcg") / F.col("ideal_dcg")).alias("ndcg")
    )


def discount_total(names: Column, k: int) -> Column:
    """Sum of the first min(k, names) discounts."""
    return F.aggregate(
        F.sequence(F.lit(1), F.least(names, F.lit(k)).cast("int")), F.lit(0.0), lambda total, p: total + discount(p)
    )


def turnover(pred: DataFrame, k: int) -> DataFrame:
    """1 − |today ∩ previous date| / k per date; NULL on the first date."""
    return _turnover(materialize(select_topk(pred, k).select(*DATE, "entity")), k)


def _turnover(top: DataFrame, k: int) -> DataFrame:
    """``top`` has k rows per date and is read three times, so callers pass a written table."""
    top = top.select(*DATE, "entity")
    # Calendar-sized: one row per date that has predictions.
    order = top.select(*DATE).distinct().withColumn("previous", F.lag("trade_date").over(Window.orderBy("trade_date")))
    today = top.join(F.broadcast(order), "trade_date")
    before = top.select(F.col("trade_date").alias("previous"), "entity", F.lit(1).alias("kept"))
    joined = today.join(before, ["previous", "entity"], "left")
    kept = F.sum(F.coalesce("kept", F.lit(0)))
    return joined.groupBy(*DATE).agg(
        F.when(F.max("previous").isNotNull(), F.lit(1.0) - kept / F.lit(float(k))).alias("turnover")
    )


def daily_table(pred: DataFrame, label: str, k: int, *, widest: int | None = None) -> DataFrame:
    """One row per date. The selected rows (k per date) are written once; every part is
    grouped by date, so the joins are between calendar-sized tables."""
    top = materialize(select_topk(pred, k))
    table = (
        daily_universe(pred, label)
        .join(_topk_means(top, label), DATE)
        .join(daily_ideal(pred, k), DATE)
        .join(_turnover(top, k), DATE)
        .join(daily_rank_corr(pred, label, widest=widest), DATE)
    )
    shown = F.least(F.col("names"), F.lit(k))
    # Summation noise must not turn a zero excess (all names selected) into a win or a loss.
    excess = F.round(F.col("topk_return") - F.col("universe_return"), 12)
    proper = F.col("ideal_dcg") > 0
    return table.select(
        *DATE,
        "topk_return",
        "universe_return",
        excess.alias("topk_excess"),
        "topk_mean_percentile",
        "precision",
        (shown / F.col("names")).alias("random_precision"),
        F.when(proper, F.col("dcg") / F.col("ideal_dcg")).alias("ndcg"),
        F.when(proper, F.col("mean_gain") * discount_total(F.col("names"), k) / F.col("ideal_dcg")).alias("random_ndcg"),
        "turnover",
        "rank_ic",
        F.substring("trade_date", 1, 6).alias("month"),
        F.substring("trade_date", 1, 4).alias("year"),
    )


def daily_top_table(pred: DataFrame, label: str, k: int, edges: Sequence[float]) -> DataFrame:
    """The columns of :func:`daily_table` that rest on the selected rows, from entity, trade_date, score and
    label of all rows; label ranks are not asked for.

    Selected and best rows are found by group limits and ranked by counting (:func:`labels_among`), so
    that at most 2k rows of a date leave their tasks. Relevance grows with the label, hence the k best
    labels hold the k best relevances.
    """
    scored = scored_rows(pred.select("entity", *DATE, "score", label), label)
    best = top_rows(scored, DATE, [F.desc(label), F.asc("entity")], k, "pred_position")
    few = select_topk(scored, k).unionByName(best.withColumn("pred_position", F.lit(None).cast("int")))
    few = labels_among(materialize(few), pred, label, edges)
    few = materialize(flag_top(few, label, k, "is_target_topk", among=pred))
    top, best = few.where("pred_position IS NOT NULL"), few.where("pred_position IS NULL")
    universe = scored.groupBy(*DATE).agg(F.avg(label).alias("universe_return"))
    table = universe.join(_topk_means(top, label), DATE).join(daily_ideal(best, k), DATE).join(_turnover(top, k), DATE)
    return table.select(
        *DATE,
        "topk_return",
        "universe_return",
        F.round(F.col("topk_return") - F.col("universe_return"), 12).alias("topk_excess"),
        "topk_mean_percentile",
        "precision",
        F.when(F.col("ideal_dcg") > 0, F.col("dcg") / F.col("ideal_dcg")).alias("ndcg"),
        "turnover",
        F.substring("trade_date", 1, 6).alias("month"),
        F.substring("trade_date", 1, 4).alias("year"),
    )


def monthly_table(daily: DataFrame) -> DataFrame:
    """Means per month of the metrics that ``daily`` has."""
    return daily.groupBy("month").agg(*[F.avg(m).alias(m) for m in MONTHLY_METRICS if m in daily.columns])


def summary_table(daily: DataFrame, monthly: DataFrame) -> DataFrame:
    """One row: means over days of the metrics that ``daily`` has, shares and median over months."""
    over_days = daily.agg(
        F.count("*").alias("days"),
        *[
            F.avg(m).alias(m)
            for m in (
                "topk_return",
                "topk_excess",
                "topk_mean_percentile",
                "precision",
                "random_precision",
                "ndcg",
                "random_ndcg",
                "turnover",
                "rank_ic",
            )
            if m in daily.columns
        ],
    )
    over_months = monthly.agg(
        share(F.col("topk_excess") > 0).alias("monthly_win_rate"),
        F.median("topk_excess").alias("monthly_median_excess"),
        F.min("topk_excess").alias("worst_month_excess"),
    )
    return over_days.crossJoin(F.broadcast(over_months))  # one row each


def yearly_table(daily: DataFrame) -> DataFrame:
    return daily.groupBy("year").agg(*[F.avg(m).alias(m) for m in YEARLY_METRICS])


def yearly_columns(daily: DataFrame, years: list[str]) -> DataFrame:
    """One row with metric_YYYY columns; the pivot values are given, so no extra job runs."""
    wide = daily.groupBy().pivot("year", years).agg(*[F.avg(m).alias(m) for m in YEARLY_METRICS])
    return wide.select(*[F.col(f"{y}_{m}").alias(f"{m}_{y}") for y in years for m in YEARLY_METRICS])


def evaluate_predictions(pred: DataFrame, label: str = "future_ret", k: int = 50, *, widest: int | None = None) -> Evaluation:
    scored = scored_rows(pred, label)
    daily = materialize(daily_table(scored, label, k, widest=widest))  # one row per date, read several times
    monthly = monthly_table(daily)
    return Evaluation(
        rank_predictions(pred, label, k, widest=widest), daily, monthly, summary_table(daily, monthly)
    )


def quantile_backtest_daily(
    pred: DataFrame,
    label: str,
    *,
    top: float = 0.1,
    bottom: float = 0.1,
    ties: str = "average",
    widest: int | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Rank IC and mean label of both score tails per date.

    ``ties="first"`` gives strict tails for scores with many ties (tree leaves).
    """
    keys = keys or DATE
    scored = scored_rows(pred, label).select(*keys, "entity", "score", label)
    if ties == "first":
        scored = ordinal_rank(scored, keys, "score", "__pct", pct=True, widest=widest)
    else:
        scored = average_rank(scored, keys, "score", "__pct", widest=widest)
    scored = average_rank(scored, keys, "score", "__x", pct=False, widest=widest)
    scored = average_rank(scored, keys, label, "__y", pct=False, widest=widest)
    daily = scored.groupBy(*keys).agg(
        pearson(F.col("__x"), F.col("__y")).alias("rank_ic"),
        F.avg(F.when(F.col("__pct") >= 1.0 - top, F.col(label))).alias("top_return"),
        F.avg(F.when(F.col("__pct") <= bottom, F.col(label))).alias("bottom_return"),
    )
    return daily.withColumn("long_short", F.col("top_return") - F.col("bottom_return"))


def backtest_summary(
    pred: DataFrame,
    daily: DataFrame,
    label: str,
    *,
    min_names: int,
    missing_is_loss: bool = True,
    widest: int | None = None,
) -> DataFrame:
    """One row; ``missing_is_loss`` counts days without a spread as losses in the win rate."""
    ic = daily_rank_ic(scored_rows(pred, label), label, value="score", min_names=min_names, keys=DATE, widest=widest)
    quality = ic.agg(F.avg("ic").alias("mean_rank_ic"), information_ratio(F.col("ic")).alias("rank_ic_ir"))
    won = F.col("long_short") > 0
    rate = share(won) if missing_is_loss else F.avg(won.cast("double"))
    tails = daily.agg(
        F.count("*").alias("test_days"),
        F.avg("top_return").alias("mean_top_return"),
        F.avg("bottom_return").alias("mean_bottom_return"),
        F.avg("long_short").alias("mean_long_short"),
        rate.alias("long_short_win_rate"),
    )
    return tails.crossJoin(F.broadcast(quality))  # one row each

"""Factor quality: rank IC, NDCG of both tails, monthly scores and fitness.

Functions take the long form (factor, entity, trade_date, value, label columns) and score all
factors in one job. ``factor_ics`` and ``factor_sides`` take one column per factor and hold a date's
columns in a task while dates fit, which ranks without a row per factor.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelforge.functions.expressions import node_count, parse, to_long
from panelforge.functions.scalar import discount, gain
from panelforge.operators.aggregates import pearson
from panelforge.operators.daily import daily_statistics
from panelforge.operators.ranks import average_rank, top_rows
from panelforge.session import group_limit, materialize, small_table

GROUP = ["factor", "trade_date"]
# Scoring constants.
WORST = -1e9
VOLATILITY_PENALTY = 0.05
COMPLEXITY_PENALTY = 0.0005
MIN_FACTOR_STD = 1e-6
MIN_MONTH_DAYS = 12
TOP_MONTHS = 3
MIN_DAILY_NAMES = 200


def daily_rank_ic(
    long: DataFrame,
    label: str,
    *,
    value: str = "value",
    min_names: int = MIN_DAILY_NAMES,
    widest: int | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Spearman IC per group over complete rows; both sides ranked after dropping NULLs.

    Absolute ranks are half-integers, so the six sums are exact and order-free.
    """
    keys = keys or GROUP
    complete = long.where(F.col(value).isNotNull() & F.col(label).isNotNull()).select(*keys, "entity", value, label)
    ranked = average_rank(complete, keys, value, "__x", pct=False, widest=widest)
    ranked = average_rank(ranked, keys, label, "__y", pct=False, widest=widest)
    daily = ranked.groupBy(*keys).agg(
        F.count("*").alias("names"), pearson(F.col("__x"), F.col("__y")).alias("ic")
    )
    return daily.where(F.col("names") >= min_names)


def daily_rank_ic_preranked(
    long: DataFrame,
    label_rank: str = "target_rank",
    *,
    value: str = "value",
    min_names: int = MIN_DAILY_NAMES,
    widest: int | None = None,
) -> DataFrame:
    """IC against a label rank computed once on all rows (differs when the factor has NULLs)."""
    ranked = average_rank(long, GROUP, value, "__x", widest=widest)
    x, y = F.col("__x"), F.col(label_rank)
    return ranked.groupBy(*GROUP).agg(
        F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("names"),
        pearson(x, y, min_rows=min_names).alias("ic"),
    )


def _fits(rows: DataFrame, widest: int | None) -> bool:
    return widest is not None and widest <= group_limit(rows.sparkSession)


def factor_ics(
    wide: DataFrame, names: Sequence[str], *, complete: bool = False, min_names: int = MIN_DAILY_NAMES, widest: int | None = None
) -> DataFrame:
    """(factor, trade_date, names, ic) of all factor columns, without one row per factor.

    As :func:`daily_rank_ic_preranked`, or with ``complete`` as :func:`daily_rank_ic` (both sides
    ranked over complete rows). Dates beyond the group limit take those long forms.
    """
    if not _fits(wide, widest):
        long = to_long(wide, names, ["target_rank"])
        if complete:
            return daily_rank_ic(long, "target_rank", min_names=min_names, widest=widest)
        return daily_rank_ic_preranked(long, min_names=min_names, widest=widest)
    daily = daily_statistics(wide, names, "ic" if complete else "prerank", least=min_names, widest=widest)
    daily = daily.where(F.col("names") >= min_names) if complete else daily
    return daily.select("factor", "trade_date", F.col("names").cast("long").alias("names"), F.col("pos").alias("ic"))


def factor_sides(
    wide: DataFrame, names: Sequence[str], kind: str, *, k: int = 50, min_valid: int = 100, widest: int | None = None
) -> DataFrame:
    """:func:`daily_ndcg_sides` or :func:`daily_ic_sides` of all factor columns."""
    if not _fits(wide, widest):
        form = daily_ic_sides if kind == "ic" else daily_ndcg_sides
        return form(to_long(wide, names, ["target_rank", "relevance"]), k=k, min_valid=min_valid, widest=widest)
    daily = daily_statistics(wide, names, kind, k=k, least=max(min_valid, k), widest=widest)
    return daily.where("names > 0").select(*GROUP, "pos", "neg")


def column_spread(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """(factor, value_std) of all factor columns from one aggregate."""
    cells = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("value_std")) for n in names])
    return wide.agg(*[F.stddev_samp(n).alias(n) for n in names]).select(F.inline(cells))


def monthly_ic(daily: DataFrame, *, min_days: int = MIN_MONTH_DAYS, keys: tuple[str, ...] = ("factor",)) -> DataFrame:
    return (
        daily.where(F.col("ic").isNotNull())
        .groupBy(*keys, F.substring("trade_date", 1, 6).alias("month"))
        .agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("days"))
        .where(F.col("days") >= min_days)
    )


def top_months(monthly: DataFrame, score: str, n: int = TOP_MONTHS) -> DataFrame:
    """The n best months of each factor, earliest month first among ties."""
    order = Window.partitionBy("factor").orderBy(F.desc(score), F.asc("month"))
    return monthly.withColumn("month_rank", F.row_number().over(order)).where(F.col("month_rank") <= n)


def expression_sizes(spark, expressions: Mapping[str, str]) -> DataFrame:
    """(factor, nodes): one row per candidate held by the caller, so bounded by the batch."""
    sizes = [node_count(parse(text)) for text in expressions.values()]
    return small_table(spark, factor=list(expressions), nodes=sizes)


def ic_fitness(
    long: DataFrame,
    sizes: DataFrame,
    label_rank: str = "target_rank",
    *,
    min_names: int = MIN_DAILY_NAMES,
    min_days: int = MIN_MONTH_DAYS,
    n_months: int = TOP_MONTHS,
    min_std: float = MIN_FACTOR_STD,
    widest: int | None = None,
) -> DataFrame:
    """Phase-wise IC fitness, one row per factor of ``sizes``.

    mean of the best months' |IC| − 0.05·std(daily IC) − 0.0005·nodes; −1e9 when the factor
    is empty, flat, or has no qualifying month.
    """
    spread = long.groupBy("factor").agg(F.stddev_samp("value").alias("value_std"))
    daily = daily_rank_ic_preranked(long, label_rank, min_names=min_names, widest=widest)
    return ic_fitness_of(materialize(daily), spread, sizes, min_days=min_days, n_months=n_months, min_std=min_std)


def ic_fitness_of(
    daily: DataFrame,
    spread: DataFrame,
    sizes: DataFrame,
    *,
    min_days: int = MIN_MONTH_DAYS,
    n_months: int = TOP_MONTHS,
    min_std: float = MIN_FACTOR_STD,
) -> DataFrame:
    """The fitness from daily ICs (factor, trade_date, ic) and value_std per factor."""
    volatility = daily.groupBy("factor").agg(F.stddev_samp("ic").alias("daily_ic_std"))
    months = monthly_ic(daily, min_days=min_days).withColumn("abs_ic", F.abs("mean_ic"))
    valid = months.groupBy("factor").agg(F.count("*").alias("valid_months"))
    best = top_months(months, "abs_ic", n_months).groupBy("factor").agg(
        F.max("abs_ic").alias("best_month_abs_ic"),
        F.avg("abs_ic").alias("mean_top_abs_ic"),
        F.min_by("month", "month_rank").alias("peak_month"),
    )
    found = spread.join(volatility, "factor", "left").join(valid, "factor", "left").join(best, "factor", "left")
    joined = sizes.join(F.broadcast(found), "factor", "left")  # one row per factor of the batch
    usable = (F.col("value_std") >= min_std) & F.col("mean_top_abs_ic").isNotNull()
    score = (
        F.col("mean_top_abs_ic")
        - VOLATILITY_PENALTY * F.coalesce("daily_ic_std", F.lit(0.0))
        - COMPLEXITY_PENALTY * F.col("nodes")
    )
    return joined.select(
        "factor",
        "nodes",
        F.when(usable, score).otherwise(F.lit(WORST)).alias("score"),
        F.when(usable, F.col("best_month_abs_ic")).otherwise(0.0).alias("best_month_abs_ic"),
        F.when(usable, F.col("mean_top_abs_ic")).otherwise(0.0).alias("mean_top_abs_ic"),
        F.when(F.col("value_std") >= min_std, F.coalesce("daily_ic_std", F.lit(0.0))).otherwise(0.0).alias("daily_ic_std"),
        F.when(usable, F.col("valid_months")).otherwise(0).cast("int").alias("valid_months"),
        F.when(usable, F.col("peak_month")).otherwise("").alias("peak_month"),
    )


def daily_ndcg_sides(
    long: DataFrame,
    *,
    k: int = 50,
    min_valid: int = 100,
    flat: float = 1e-12,
    widest: int | None = None,
) -> DataFrame:
    """NDCG@k of the highest-k rows (pos) and of the lowest-k taken ascending (neg).

    Groups known to fit one task are ordered three times after one exchange. Otherwise
    each selection is a group limit, so at most k rows per factor-date and task are
    shuffled. Ties are broken by entity.
    """
    valid = long.where(F.col("value").isNotNull() & F.col("target_rank").isNotNull())
    slim = valid.select(*GROUP, "entity", "value", "relevance")
    orders = {
        "dcg_high": [F.desc("value"), F.asc("entity")],
        "dcg_low": [F.asc("value"), F.asc("entity")],
        "dcg_ideal": [F.desc("relevance"), F.asc("entity")],
    }
    size = [F.count("*").alias("names"), F.stddev_pop("value").alias("spread")]
    weighted = lambda position: gain(F.col("relevance")) * discount(F.col(position))
    if widest is not None and widest <= group_limit(long.sparkSession):
        placed = slim.select(
            "*", *[F.row_number().over(Window.partitionBy(*GROUP).orderBy(*o)).alias(f"__{n}") for n, o in orders.items()]
        )
        day = placed.groupBy(*GROUP).agg(
            *size, *[F.sum(F.when(F.col(f"__{n}") <= k, weighted(f"__{n}"))).alias(n) for n in orders]
        )
    else:
        slim = materialize(slim)  # read four times below
        day = slim.groupBy(*GROUP).agg(*size)
        for name, order in orders.items():
            top = top_rows(slim, GROUP, order, k)
            day = day.join(top.groupBy(*GROUP).agg(F.sum(weighted("position")).alias(name)), GROUP)
    usable = (F.col("names") >= max(min_valid, k)) & (F.col("spread") >= flat) & (F.col("dcg_ideal") > 0)
    return day.select(
        *GROUP,
        F.when(usable, F.col("dcg_high") / F.col("dcg_ideal")).alias("pos"),
        F.when(usable, F.col("dcg_low") / F.col("dcg_ideal")).alias("neg"),
    )


def daily_ic_sides(
    long: DataFrame,
    *,
    k: int = 50,
    min_valid: int = 100,
    flat: float = 1e-12,
    widest: int | None = None,
) -> DataFrame:
    """Spearman correlation with the label rank (pos) and its negative (neg)."""
    complete = long.where(F.col("value").isNotNull() & F.col("target_rank").isNotNull())
    complete = complete.select(*GROUP, "entity", "value", "target_rank")
    ranked = average_rank(complete, GROUP, "value", "__x", pct=False, widest=widest)
    ranked = average_rank(ranked, GROUP, "target_rank", "__y", pct=False, widest=widest)
    daily = ranked.groupBy(*GROUP).agg(
        F.stddev_pop("value").alias("spread"),
        pearson(F.col("__x"), F.col("__y"), min_rows=max(min_valid, k)).alias("ic"),
    )
    pos = F.when(F.col("spread") >= flat, F.col("ic"))
    return daily.select(*GROUP, pos.alias("pos"), (-pos).alias("neg"))


def directional_months(daily: DataFrame, *, min_days: int = MIN_MONTH_DAYS) -> DataFrame:
    """Month means of both sides; the larger is the month's score and sets its direction."""
    months = (
        daily.groupBy("factor", F.substring("trade_date", 1, 6).alias("month"))
        .agg(F.avg("pos").alias("pos"), F.avg("neg").alias("neg"), F.count("pos").alias("days"))
        .where(F.col("days") >= min_days)
    )
    return months.select(
        "*",
        F.greatest("pos", "neg").alias("score"),
        F.when(F.col("pos") >= F.col("neg"), 1).otherwise(-1).alias("direction"),
    )


def chosen_side_volatility(daily: DataFrame) -> DataFrame:
    """Population std per factor of the better side of each day."""
    side = F.when(F.col("pos") >= F.col("neg"), F.col("pos")).otherwise(F.col("neg"))
    return daily.groupBy("factor").agg(F.stddev_pop(side).alias("volatility"))


def _overall(selected: DataFrame, raw, peak) -> DataFrame:
    return selected.groupBy("factor").agg(
        raw.alias("raw"),
        peak.alias("peak_month"),
        F.when(F.avg("pos") >= F.avg("neg"), 1).otherwise(-1).alias("direction"),
    )


def top_objective(months: DataFrame, n: int = TOP_MONTHS) -> DataFrame:
    """Mean of the n best month scores; the peak is the best month."""
    return _overall(top_months(months, "score", n), F.avg("score"), F.min_by("month", "month_rank"))


def contiguous_objective(months: DataFrame) -> DataFrame:
    """Best mean over two successive qualifying months; the peak is the later one.

    A factor with a single qualifying month has no pair and is absent.
    """
    order = Window.partitionBy("factor").orderBy("month")
    pair = order.rowsBetween(-1, 0)
    rolled = months.withColumn(
        "pair", F.when(F.count("score").over(pair) == 2, F.avg("score").over(pair))
    ).withColumn("index", F.row_number().over(order))
    first = Window.partitionBy("factor").orderBy(F.desc("pair"), F.asc("month"))
    end = (
        rolled.where(F.col("pair").isNotNull())
        .withColumn("r", F.row_number().over(first))
        .where("r = 1")
        .select("factor", F.col("index").alias("end"))
    )
    chosen = rolled.join(end, "factor").where(F.col("index").between(F.col("end") - 1, F.col("end")))
    return _overall(chosen, F.avg("score"), F.max("month"))


def directional_fitness(
    long: DataFrame,
    sizes: DataFrame,
    *,
    objective: str = "top3_ndcg",
    k: int = 50,
    min_valid: int = 100,
    min_days: int = MIN_MONTH_DAYS,
    widest: int | None = None,
) -> DataFrame:
    """raw − 0.05·volatility − 0.0005·nodes with peak month and direction per factor.

    ``objective`` is one of top3_ic, top3_ndcg, contiguous_ic, contiguous_ndcg.
    """
    if objective.endswith("_ic"):
        daily = daily_ic_sides(long, k=k, min_valid=min_valid, widest=widest)
    else:
        daily = daily_ndcg_sides(long, k=k, min_valid=min_valid, widest=widest)
    return directional_fitness_of(materialize(daily), sizes, objective=objective, min_days=min_days)


def directional_fitness_of(
    daily: DataFrame, sizes: DataFrame, *, objective: str, min_days: int = MIN_MONTH_DAYS
) -> DataFrame:
    """The fitness from daily sides (factor, trade_date, pos, neg)."""
    months = directional_months(daily, min_days=min_days)
    overall = contiguous_objective(months) if objective.startswith("contiguous") else top_objective(months)
    found = overall.join(chosen_side_volatility(daily), "factor")
    joined = sizes.join(F.broadcast(found), "factor", "left")
    score = F.col("raw") - VOLATILITY_PENALTY * F.col("volatility") - COMPLEXITY_PENALTY * F.col("nodes")
    return joined.select(
        "factor",
        "nodes",
        F.coalesce(score, WORST - COMPLEXITY_PENALTY * F.col("nodes")).alias("score"),
        F.coalesce("raw", F.lit(WORST)).alias("raw"),
        F.coalesce("volatility", F.lit(0.0)).alias("volatility"),
        F.coalesce("peak_month", F.lit("")).alias("peak_month"),
        F.coalesce("direction", F.lit(1)).alias("direction"),
    )


def validate_library(
    long: DataFrame,
    label_rank: str = "target_rank",
    *,
    min_names: int = MIN_DAILY_NAMES,
    min_days: int = MIN_MONTH_DAYS,
    strong: float = 0.05,
    widest: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Full-history review of every factor: (one row per factor, long monthly table)."""
    daily = daily_rank_ic_preranked(long, label_rank, min_names=min_names, widest=widest)
    return review_of(daily, min_days=min_days, strong=strong)


def review_of(daily: DataFrame, *, min_days: int = MIN_MONTH_DAYS, strong: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The review from daily ICs (factor, trade_date, ic)."""
    months = materialize(monthly_ic(daily, min_days=min_days).withColumn("abs_ic", F.abs("mean_ic")))
    best = top_months(months, "abs_ic").groupBy("factor").agg(
        F.min_by("month", "month_rank").alias("full_peak_month"),
        F.max("abs_ic").alias("full_best_month_abs_ic"),
        F.avg("abs_ic").alias("full_top3_month_abs_ic"),
    )
    whole = months.groupBy("factor").agg(
        F.avg("abs_ic").alias("full_mean_abs_month_ic"),
        F.sum(F.when(F.col("abs_ic") >= strong, 1).otherwise(0)).alias("full_months_abs_ic_ge_005"),
    )
    monthly = months.select("factor", "month", F.col("mean_ic").alias("mean_rank_ic"), F.col("days").alias("valid_days"))
    return best.join(whole, "factor"), monthly

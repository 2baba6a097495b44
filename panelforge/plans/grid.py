"""One entry point for every walk-forward model, and grids of configurations over it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelforge.operators.calendar import PanelShape, prune_dates
from panelforge.operators.evaluate import Evaluation, evaluate_predictions
from panelforge.plans import models as md
from panelforge.plans import walkforward as wf
from panelforge.plans.experiments import union_results
from panelforge.plans.lambdarank import rolling_lambdarank
from panelforge.session import materialize

# The configurations compared stage by stage.
MODEL_GRID = {
    "M00": dict(model="ic_vote"),
    "M01-10": dict(model="binning", bins=10),
    "M01-20": dict(model="binning", bins=20),
    "M02": dict(model="regression"),
    "M03": dict(model="classifier"),
    "M04": dict(model="lambdarank"),
}
VALIDATION_DATES = {30: 5, 60: 10, 120: 20}
WINDOW_GRID = {
    f"W{lookback}-{update}": dict(lookback=lookback, update=update, validation=VALIDATION_DATES[lookback])
    for lookback in (30, 60, 120)
    for update in (5, 1)
}
DECAY_GRID = {"D00": dict(half_life=0.0), "D10": dict(half_life=10.0), "D20": dict(half_life=20.0)}
ABLATION_GRID = {"A00": None, "A01": "price_tech", "A02": "moneyflow", "A03": "valuation"}


def walk_forward(
    frame: DataFrame,
    factors: Sequence[str],
    calendar: DataFrame,
    shape: PanelShape,
    *,
    model: str,
    start: str,
    end: str,
    label: str = "future_ret",
    horizon: int = 5,
    lookback: int = 60,
    validation: int = 10,
    update: int = 5,
    half_life: float = 10.0,
    bins: int = 10,
    k: int = 50,
    require_full: bool = True,
    options: Mapping | None = None,
) -> md.WalkForward:
    """Score [start, end] with one of ic_vote, binning, tree, regression, classifier, lambdarank.

    ``frame`` is the ranked factor frame with target_rank, relevance and is_target_topk. Refits
    without a full window are left out, or with ``require_full`` off learn from what there is.
    """
    options = dict(options or {})
    frame = prune_dates(frame, calendar, start, end, horizon=horizon, lookback=lookback)
    blocks = wf.rebalance_calendar(calendar, start, end, update)
    windows = wf.history_windows(blocks, calendar, horizon=horizon, lookback=lookback, require_full=require_full)
    if model in ("ic_vote", "binning"):
        if model == "ic_vote":
            _, scored = wf.ic_vote(frame, factors, windows, blocks, shape, half_life=half_life)
        else:
            scored = wf.binning_score(frame, factors, windows, blocks, shape, bins=bins)
        spans = md.plan_blocks(windows, blocks, validation)
        records = [
            {"rebalance_date": b.rebalance_date, "train_start": b.train_start, "train_end": b.train_end, "best_iteration": 0}
            for b in spans
        ]
        return md.WalkForward(scored, records, None)
    ready = md.assemble(frame, factors, calendar, shape, options.get("settings", options).get("bins", md.BOOST["bins"]))
    spans = md.plan_blocks(windows, blocks, validation)
    if model == "tree":
        return md.rolling_tree(ready, factors, spans, label=label, **options)
    if model == "regression":
        return md.rolling_boost_regression(ready, factors, spans, label=label, half_life=half_life, **options)
    if model == "classifier":
        return md.rolling_topk_classifier(ready, factors, spans, label=label, half_life=half_life, **options)
    if model == "lambdarank":
        return rolling_lambdarank(
            ready, factors, spans, label=label, half_life=half_life, k=k, widest=shape.widest, dates=shape.dates, **options
        )
    raise ValueError(f"unknown model: {model}")


def evaluate_walk(
    result: md.WalkForward, *, label: str, k: int, shape: PanelShape, years: Sequence[str], digits: int | None = None
) -> Evaluation:
    """Evaluation whose summary also carries the yearly columns that winner selection reads.

    Scores rounded to ``digits`` tie when they differ by the order of a sum only.
    """
    from panelforge.operators.evaluate import yearly_columns

    scored = result.predictions
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits) + F.lit(0.0))
    whole = evaluate_predictions(materialize(scored), label, k, widest=shape.widest)
    summary = whole.summary.crossJoin(F.broadcast(yearly_columns(whole.daily, list(years))))  # one row each
    return whole._replace(summary=summary)


def run_grid(
    frame: DataFrame,
    factors: Sequence[str],
    calendar: DataFrame,
    shape: PanelShape,
    grid: Mapping[str, Mapping],
    *,
    label: str,
    k: int,
    years: Sequence[str],
    common: Mapping,
    digits: int | None = None,
) -> DataFrame:
    """One summary row per configuration; the ranked frame is written once and shared."""
    shared = materialize(frame)
    rows = {}
    for name, change in grid.items():
        settings = {**common, **change}
        chosen = settings.pop("factors", factors)
        result = walk_forward(shared, chosen, calendar, shape, label=label, k=k, **settings)
        summary = evaluate_walk(result, label=label, k=k, shape=shape, years=years, digits=digits).summary
        rows[name] = summary.withColumn("model", F.lit(settings["model"])).withColumn("factor_count", F.lit(len(chosen)))
    return union_results(rows)


def ablation_grid(library: DataFrame, categories: Mapping[str, str | None] = ABLATION_GRID) -> dict[str, dict]:
    """Factor subsets without one category each, read from the library table."""
    from panelforge.plans.experiments import category_ablation

    return {
        name: dict(factors=[x["name"] for x in category_ablation(library, removed).select("name").orderBy("name").collect()])
        for name, removed in categories.items()
    }

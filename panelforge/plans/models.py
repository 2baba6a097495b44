"""Tree models refitted on every walk-forward window.

All refits grow together (:mod:`panelforge.plans.lockstep`): the number of jobs depends on rounds
and depth, not on the number of refits. Trees are written as tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelforge.operators.calendar import PanelShape
from panelforge.plans import lockstep as ls
from panelforge.session import broadcast_within, drop_table, materialize, table_at
from panelforge.sources.bydate import write_whole

# Default model settings.
TREE_DEPTHS = (1, 2, 3)
TREE_LEAF_SHARES = (0.03, 0.05, 0.10)
TREE_MIN_GAIN = 1e-5
BOOST = dict(
    max_iter=200, step=0.03, depth=3, bins=63, min_rows=3000, leaves=7, min_gain=0.0, row_share=0.8, feature_share=0.8, l1=0.1, l2=10.0, seed=42,
)
BOOST_CANDIDATES = (dict(depth=2, leaves=4, min_rows=5000), dict(depth=3, leaves=7, min_rows=3000))
POSITIVE_WEIGHT = 50.0
# Boosting stops after so many trees without a better validation loss.
PATIENCE = 15


class WalkForward(NamedTuple):
    """Scored test rows, one record per refit and the models (none for votes and bins)."""

    predictions: DataFrame
    records: list[dict]
    models: ls.TreeModels | None


@dataclass(frozen=True)
class Block:
    """Dates of one refit; all bounds are inclusive."""

    rebalance_date: str
    train_start: str
    train_end: str
    validation_start: str
    test_end: str


def plan_blocks(windows: DataFrame, blocks: DataFrame, validation: int) -> list[Block]:
    """One entry per refit (calendar-sized), from the embargoed windows."""
    spans = windows.groupBy("rebalance_date").agg(
        F.min("trade_date").alias("train_start"),
        F.max("trade_date").alias("train_end"),
        F.min(F.when(F.col("age") < validation, F.col("trade_date"))).alias("validation_start"),
    )
    ends = blocks.groupBy("rebalance_date").agg(F.max("trade_date").alias("test_end"))
    rows = spans.join(ends, "rebalance_date").orderBy("rebalance_date").collect()
    return [Block(x.rebalance_date, x.train_start, x.train_end, x.validation_start, x.test_end) for x in rows]


def assemble(frame: DataFrame, factors: Sequence[str], calendar: DataFrame, shape: PanelShape, bins: int = BOOST["bins"]) -> DataFrame:
    """Frame with calendar positions and the factors' bins, written once for all refits."""
    placed = frame.join(broadcast_within(calendar, shape.dates), "trade_date")
    return materialize(ls.packed_bins(placed, factors, bins))


def validation_baseline(frame: DataFrame, windows: DataFrame, validation: int, target: str = "target_rank") -> DataFrame:
    """Error of the constant 0.5 on each block's validation dates, from daily sums."""
    daily = frame.where(F.col(target).isNotNull()).groupBy("trade_date").agg(
        F.sum(F.abs(F.col(target) - F.lit(0.5))).alias("error"), F.count("*").alias("n")
    )
    return (
        windows.where(F.col("age") < validation)
        .join(F.broadcast(daily), "trade_date")
        .groupBy("rebalance_date")
        .agg((F.sum("error") / F.sum("n")).alias("validation_baseline_mae"))
    )


def baselines(frame: DataFrame, blocks: Sequence[Block]) -> dict[str, float]:
    """Error of the constant 0.5 on the validation dates of every refit, from daily sums."""
    daily = frame.where(F.col("target_rank").isNotNull()).groupBy("trade_date").agg(
        F.sum(F.abs(F.col("target_rank") - F.lit(0.5))).alias("error"), F.count("*").alias("n")
    )
    rows = sorted((r.trade_date, r.error, r.n) for r in daily.collect())  # one row per date
    out = {}
    for b in blocks:
        some = [(e, n) for d, e, n in rows if b.validation_start <= d <= b.train_end]
        total = sum(n for _, n in some)
        out[b.rebalance_date] = sum(e for e, _ in some) / total if total else None
    return out


def records_table(spark, records: Sequence[dict]) -> DataFrame:
    """Model records as a table; nested maps stay maps."""
    from pyspark.sql import Row

    return spark.createDataFrame([Row(**r) for r in records])


def _scored(models: ls.TreeModels, frame: DataFrame, label: str) -> DataFrame:
    columns = ["entity", "trade_date", label, "target_rank", "relevance", "is_target_topk"]
    return models.score(frame.select(*columns, "bins")).select("entity", "trade_date", "rebalance_date", *columns[2:], "score")


def _tops(models: ls.TreeModels, top: int) -> dict[str, list[tuple[str, float]]]:
    """Strongest factors of every refit: ``top`` rows each."""
    found: dict[str, list[tuple[str, float]]] = {}
    for r in models.importance(top).orderBy("rebalance_date", "position").collect():
        found.setdefault(r.rebalance_date, []).append((r.factor, r.importance))
    return found


# --- single trees ------------------------------------------------------------------------


def tree_text(trees: ls.Trees, model: int, factors: Sequence[str], bins: int) -> str:
    """The rules of one tree, one line per leaf."""
    lines = []

    def walk(node, rules):
        inner = node < trees.feature.shape[1] and trees.feature[model, node] >= 0
        if not inner:
            lines.append(f"{' and '.join(rules) or 'all'}: {trees.value[model, node]:.6f} ({trees.rows[model, node]} rows)")
            return
        edge = f"{factors[trees.feature[model, node]]} {{}} {(int(trees.cut[model, node]) + 1) / bins:.4f}"
        walk(2 * node + 1, [*rules, edge.format("<")])
        walk(2 * node + 2, [*rules, edge.format(">=")])

    walk(0, [])
    return "\n".join(lines)


def _cut_to(trees: ls.Trees, depth: int | np.ndarray) -> ls.Trees:
    """Trees ended at a depth (one for all models, or one per model)."""
    out = ls.Trees(len(trees.feature), trees.depth)
    level = np.floor(np.log2(np.arange(trees.feature.shape[1]) + 1)).astype("i8")
    out.feature = np.where(level[None, :] < np.asarray(depth).reshape(-1, 1), trees.feature, -1).astype("i2")
    out.cut, out.value, out.gain, out.rows = trees.cut, trees.value, trees.gain, trees.rows
    return out


def rolling_tree(
    frame: DataFrame,
    factors: Sequence[str],
    blocks: Sequence[Block],
    *,
    label: str,
    depths: Sequence[int] = TREE_DEPTHS,
    leaf_shares: Sequence[float] = TREE_LEAF_SHARES,
    min_gain: float = TREE_MIN_GAIN,
    bins: int = BOOST["bins"],
    seed: int = 42,
) -> WalkForward:
    """One small tree per refit; depth and leaf size chosen on the window's newest dates.

    A tree of the largest depth holds the smaller ones, so every leaf share is grown once.
    """
    spark, deepest, shares = frame.sparkSession, max(depths), tuple(sorted(leaf_shares, reverse=True))
    growth = ls.Growth(bins=bins, min_gain=min_gain, gain_per_row=True, seed=seed)
    objective, error = ls.Objective("mean", "target_rank"), ls.Objective("regression", "target_rank")
    candidates = tuple(ls.Candidate(deepest, min_share=s) for s in shares)
    base, chosen, parts, records = baselines(frame, blocks), [], [], []
    for some, wave in ls.plan_waves(blocks, ls.date_positions(frame), candidates):
        rows = ls.row_table(frame, wave, objective)
        path = write_whole(rows)
        grower = ls.Grower(table_at(rows, path), wave, objective, growth, len(factors))
        trees, _ = grower.tree(0)
        options: dict[int, list[tuple]] = {i: [] for i in range(len(some))}
        for depth in sorted(depths):
            grower.recent = [_cut_to(trees, depth)]
            for model, loss in grower.losses(grower.collect(None, 0, 0, objective=error)).items():
                options[model // wave.variants].append((loss, depth, -shares[model // 2 % len(shares)], model))
        drop_table(spark, path)
        end = np.zeros(wave.models, "i8")
        for i, block in enumerate(some):
            loss, depth, share, model = min(options[i]) if options[i] else (None, min(depths), -shares[0], i * wave.variants)
            whole = model + ls.ALL
            end[whole] = depth
            cut = _cut_to(trees, end)
            split = cut.feature[whole] >= 0
            level = np.floor(np.log2(np.flatnonzero(split) + 1)).astype("i8") + 1
            baseline = base[block.rebalance_date]
            chosen.append(ls.Chosen(block, model // 2 % len(shares), 1, loss, 0.0, int(trees.rows[whole, 0])))
            records.append({
                "rebalance_date": block.rebalance_date, "train_start": block.train_start, "train_end": block.train_end, "max_depth": int(depth),
                "min_leaf_fraction": -share, "validation_mae": loss, "validation_baseline_mae": baseline,
                "validation_mae_improvement": None if loss is None or baseline is None else baseline - loss,
                "actual_depth": int(level.max()) if len(level) else 0, "leaf_count": _leaves(cut.feature[whole]),
                "tree_text": tree_text(cut, whole, factors, bins), "train_rows": int(trees.rows[whole, 0]),
            })
        table = ls.tree_rows(_cut_to(trees, end), some, wave, 0)
        kept = np.isin(
            np.array([f"{d}:{c}" for d, c in zip(table["rebalance_date"], table["candidate"])]),
            [f"{c.block.rebalance_date}:{c.candidate}" for c in chosen],
        )
        parts.append({c: v[kept] for c, v in table.items() if c != "candidate"})
    folder = f"{ls.work_folder(spark)}/trees-{ls.uuid.uuid4().hex}"
    ls.write_trees(spark, parts, folder)
    chosen.sort(key=lambda c: c.block.rebalance_date)
    models = ls.models_of(chosen, spark.read.parquet(folder), factors, growth)
    tops = _tops(models, 1)
    records = [{**r, "top_feature": tops[r["rebalance_date"]][0][0], "top_feature_importance": tops[r["rebalance_date"]][0][1]} for r in sorted(records, key=lambda r: r["rebalance_date"])]
    return WalkForward(_scored(models, frame, label), records, models)


def _leaves(feature: np.ndarray) -> int:
    count, open_ = 0, [0]
    while open_:
        node = open_.pop()
        if node < len(feature) and feature[node] >= 0:
            open_ += [2 * node + 1, 2 * node + 2]
        else:
            count += 1
    return count


# --- boosting ----------------------------------------------------------------------------


def growth_of(settings: dict) -> ls.Growth:
    names = ("bins", "step", "l1", "l2", "min_gain", "row_share", "feature_share", "seed")
    return ls.Growth(**{n: settings[n] for n in names})


def rolling_boost(
    frame: DataFrame, factors: Sequence[str], blocks: Sequence[Block], objective: ls.Objective, *, label: str, candidates: Sequence[dict],
    settings: dict, patience: int, link: str = "identity", metric: str, slots: int = ls.SLOTS,
) -> WalkForward:
    """Boosted trees per refit: candidates and rounds chosen on the newest dates, scored on the test dates."""
    options = [{**settings, **change} for change in candidates]
    limits = [ls.Candidate(o["depth"], o["min_rows"], leaves=o["leaves"]) for o in options]
    growth = growth_of(settings)
    chosen, table = ls.boost(
        frame, blocks, limits, objective, growth, features=len(factors), rounds=settings["max_iter"], patience=patience, slots=slots
    )
    models = ls.models_of(chosen, table, factors, growth, link)
    base, tops, records = baselines(frame, blocks), _tops(models, 5), []
    for c in chosen:
        sign = -1.0 if objective.kind == "ranker" else 1.0
        records.append({
            "rebalance_date": c.block.rebalance_date, "train_start": c.block.train_start, "train_end": c.block.train_end,
            "max_depth": options[c.candidate]["depth"], "min_child_samples": options[c.candidate]["min_rows"], "best_iteration": c.trees,
            "validation_metric": None if c.loss is None else sign * c.loss, "validation_metric_name": metric,
            "validation_baseline_mae": base[c.block.rebalance_date], "train_rows": c.train_rows, "top_features": dict(tops.get(c.block.rebalance_date, [])),
        })
    return WalkForward(_scored(models, frame, label), records, models)


def rolling_boost_regression(
    frame: DataFrame,
    factors: Sequence[str],
    blocks: Sequence[Block],
    *,
    label: str,
    candidates: Sequence[dict] = ({},),
    settings: dict = BOOST,
    half_life: float = 0.0,
    patience: int = PATIENCE,
) -> WalkForward:
    """Boosted regression on target_rank, stopped by the absolute error on the newest dates.

    Several ``candidates`` with no ``half_life`` give the first-generation search over
    depths; one candidate with a half-life gives the second-generation decay weights.
    """
    objective = ls.Objective("regression", "target_rank", half_life)
    return rolling_boost(frame, factors, blocks, objective, label=label, candidates=candidates, settings=settings, patience=patience, metric="mae")


def rolling_topk_classifier(
    frame: DataFrame,
    factors: Sequence[str],
    blocks: Sequence[Block],
    *,
    label: str,
    settings: dict = BOOST,
    half_life: float = 10.0,
    positive_weight: float = POSITIVE_WEIGHT,
    patience: int = PATIENCE,
) -> WalkForward:
    """Probability of ending in the top k; positives weigh ``positive_weight`` times more in the
    fit. It stops by the logistic loss of the newest dates, whose rows weigh alike."""
    objective = ls.Objective("classifier", "is_target_topk", half_life, positive_weight)
    return rolling_boost(
        frame, factors, blocks, objective, label=label, candidates=({},), settings=settings, patience=patience, link="logistic", metric="logloss"
    )


def save_models(models: ls.TreeModels, path: str) -> None:
    """Every refit's trees as one table below ``path``."""
    models.save(path)


def importance_table(models: ls.TreeModels, top: int | None = None) -> DataFrame:
    """(rebalance_date, factor, importance, position) for every refit."""
    return models.importance(top)

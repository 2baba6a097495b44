"""Walk-forward tree models and configuration grids (checked by invariants in the tests)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelforge.catalog.base import (
    CALENDAR_SQL, DIRECTIONS, WALK_END, HORIZON, K, LABEL, LABELLED_SQL, LIBRARY, LOOKBACK, NAMES, PANEL_SQL, WALK_START, UPDATE, avg_rank_sql, factors_sql,
    hist_sql, labelled_panel, main_calendar, main_shape, register, rounded, with_sql,
)
from panelforge.catalog.evaluation import _SUM_COLS, MONTHLY_SQL, SUMMARY_SQL, YEAR_SQL, daily_of_pred_sql, rounded as nudged, rounds
from panelforge.catalog.walk import BINNED_SQL, VOTES_SQL, bins_sql, ic_vote_sql, ranked_frame, ranked_sql, whole_span, windows
from panelforge.plans import grid as gr
from panelforge.plans import models as md
from panelforge.plans.lockstep import TreeModels
from panelforge.plans import walkforward as wf
from panelforge.session import path_exists, small_table, work_folder
from panelforge.sources import store

# Leaves fit the tables' 8 to 1,000 names per date; rounds, rates, depths and patience are the operators' own.
_BOOST = {**md.BOOST, "min_rows": 20}
# The short walks of the statements below: a refit every 20 dates, few rounds.
_UPDATE = 20
_SHORT_BOOST = {**_BOOST, "max_iter": 6, "step": 0.1}
_RUNS: dict[tuple[str, str, str, bool], md.WalkForward] = {}


def run(spark, folder, model, options=None, span=None, update=UPDATE, **settings):
    """A walk over ``span``, by default from the first date with a full window to the last date."""
    span = span or whole_span(spark, folder)
    return gr.walk_forward(
        ranked_frame(spark, folder, span=span), NAMES, main_calendar(spark, folder), main_shape(spark, folder), model=model,
        start=span[0], end=span[1], label=LABEL, horizon=HORIZON, lookback=LOOKBACK, validation=5, update=update, k=K,
        options=options, **settings,
    )


def _runs(boost, ranking):
    return {
        "rolling_tree": dict(model="tree"),
        # First generation: two depths compared on the validation dates.
        "rolling_boost_candidates": dict(
            model="regression", options=dict(settings=boost, candidates=({"depth": 2}, {"depth": 3})), half_life=0.0
        ),
        "rolling_boost_decayed": dict(model="regression", options=dict(settings=boost)),
        "rolling_topk_classifier": dict(model="classifier", options=dict(settings=boost)),
        "rolling_lambdarank": dict(model="lambdarank", options=dict(min_rows=20, **ranking)),
    }


RUNS = _runs(_BOOST, {})
SHORT_RUNS = {
    name: dict(span=(WALK_START, WALK_END), update=_UPDATE, **settings)
    for name, settings in _runs(_SHORT_BOOST, dict(rounds=3, step=0.3, depth=2, l2=1.0)).items()
}


def walked(spark, folder, name, short=False):
    """A named run, made once per session; its predictions are a written table."""
    key = (spark.sparkContext.applicationId, folder, name, short)
    found = _RUNS.get(key)
    if found is None or not path_exists(spark, found.predictions.inputFiles()[0]):
        found = _RUNS[key] = run(spark, folder, **(SHORT_RUNS if short else RUNS)[name])
    return found


def coverage(spark, folder, name):
    """Per refit of the short walk: its training dates, embargo gap and the number of rows it scored."""
    result = walked(spark, folder, name, short=True)
    position = main_calendar(spark, folder).select("trade_date", "position")
    fields = ("rebalance_date", "train_start", "train_end")
    spans = small_table(spark, **{f: [x[f] for x in result.records] for f in fields})
    at = lambda c: F.broadcast(position.select(F.col("trade_date").alias(c), F.col("position").alias(f"{c}_position")))
    rows = result.predictions.groupBy("rebalance_date").agg(F.count("*").alias("scored_rows"), F.count("score").alias("scores"))
    return (
        spans.join(at("rebalance_date"), "rebalance_date").join(at("train_end"), "train_end").join(rows, "rebalance_date")
        .select(*fields, (F.col("rebalance_date_position") - F.col("train_end_position")).cast("int").alias("gap"), "scored_rows", "scores")
    )


COVERAGE_SQL = with_sql(
    PANEL_SQL, CALENDAR_SQL, hist_sql(update=_UPDATE),
    "spans AS (SELECT rebalance_date, min(trade_date) AS train_start, max(trade_date) AS train_end FROM hist GROUP BY 1)",
    select=f"""SELECT rebalance_date, train_start, train_end, CAST({HORIZON + 1} AS INTEGER) AS gap, count(*) AS scored_rows, count(*) AS scores
FROM spans JOIN blocks USING (rebalance_date) JOIN panel ON panel.trade_date = blocks.trade_date GROUP BY 1, 2, 3""",
)
SPANS_SQL = with_sql(
    PANEL_SQL, CALENDAR_SQL, hist_sql(update=_UPDATE),
    select="SELECT rebalance_date, min(trade_date) AS train_start, max(trade_date) AS train_end FROM hist GROUP BY 1",
)


@register(
    "validation_baseline",
    with_sql(
        LABELLED_SQL, CALENDAR_SQL, hist_sql(),
        select="SELECT rebalance_date, round(avg(abs(target_rank - 0.5e0)), 10) AS validation_baseline_mae FROM hist JOIN labelled USING (trade_date) WHERE age < 5 AND target_rank IS NOT NULL GROUP BY 1",
    ),
)
def validation_baseline(spark, folder):
    base = md.validation_baseline(labelled_panel(spark, folder), windows(spark, folder)[1], 5)
    return rounded(base, ["validation_baseline_mae"])


for _name in RUNS:
    register(_name)(lambda spark, folder, name=_name: walked(spark, folder, name).predictions)
    register(f"{_name}_coverage", COVERAGE_SQL)(lambda spark, folder, name=_name: coverage(spark, folder, name))


@register("records_stored", SPANS_SQL)
def records_stored(spark, folder):
    """Model records written as JSON and read back."""
    path = f"{work_folder(spark)}/records-{uuid.uuid4().hex}"
    store.write_records(md.records_table(spark, walked(spark, folder, "rolling_tree", short=True).records), path)
    return spark.read.json(path).select("rebalance_date", "train_start", "train_end")


@register(
    "models_reloaded",
    with_sql(
        PANEL_SQL, CALENDAR_SQL, hist_sql(update=_UPDATE),
        select="SELECT rebalance_date, count(*) AS compared, CAST(0 AS BIGINT) AS different FROM (SELECT DISTINCT rebalance_date FROM hist) JOIN blocks USING (rebalance_date) JOIN panel ON panel.trade_date = blocks.trade_date GROUP BY 1",
    ),
)
def models_reloaded(spark, folder):
    """Tree models saved, loaded and scored again: rows whose score changed."""
    path, result = f"{work_folder(spark)}/models-{uuid.uuid4().hex}", walked(spark, folder, "rolling_tree", short=True)
    md.save_models(result.models, path)
    frame = ranked_frame(spark, folder).select("entity", "trade_date", *NAMES)
    again = TreeModels.load(spark, path).score(frame).withColumnRenamed("score", "again")
    both = result.predictions.join(again, ["entity", "trade_date", "rebalance_date"])
    return both.groupBy("rebalance_date").agg(F.count("*").alias("compared"), F.sum((F.col("again") != F.col("score")).cast("int")).alias("different"))


@register(
    "importance_shares",
    with_sql(
        PANEL_SQL, CALENDAR_SQL, hist_sql(update=_UPDATE),
        select=f"SELECT rebalance_date, CAST({len(NAMES)} AS BIGINT) AS factors, 1e0 AS total, CAST({len(NAMES)} AS BIGINT) AS last_position FROM hist GROUP BY 1",
    ),
)
def importance_shares(spark, folder):
    """Importances of each refit: one row per factor, adding up to one, numbered in order."""
    table = md.importance_table(walked(spark, folder, "rolling_tree", short=True).models)
    return table.groupBy("rebalance_date").agg(
        F.countDistinct("factor").alias("factors"), F.round(F.sum("importance"), 9).alias("total"), F.max("position").alias("last_position")
    )


# --- one round, written out as a statement -------------------------------------------------

_WALK_HIST_SQL = f"""test AS (SELECT trade_date, position, position - min(position) OVER () AS i FROM cal WHERE position >= {HORIZON + LOOKBACK}),
blocks AS (SELECT trade_date, position, min(trade_date) OVER (PARTITION BY i // {UPDATE}) AS rebalance_date, min(position) OVER (PARTITION BY i // {UPDATE}) AS rebalance_position FROM test),
heads AS (SELECT DISTINCT rebalance_date, rebalance_position FROM blocks),
hist AS (SELECT h.rebalance_date, c.trade_date, h.rebalance_position - {HORIZON + 1} - c.position AS age FROM heads h
  JOIN cal c ON c.position BETWEEN h.rebalance_position - {HORIZON} - {LOOKBACK} AND h.rebalance_position - {HORIZON + 1})"""


def first_tree_sql(target, half_life, least, l1, l2, start, positive_weight=1.0):
    """Root split of the first tree of every refit: gradients, histogram, best split, leaf values.

    Gradients and weights are whole multiples of 2**-24, as in the walk, so sums are exact.
    """
    whole, scale = "16777216e0", "/ 16777216e0"
    weight = f"pow(0.5e0, age / {half_life!r})" if half_life else "1e0"
    weight = f"({weight} * CASE WHEN y > 0 THEN {positive_weight!r} ELSE 1e0 END)"
    value = lambda g, h: f"(sign({g}) * greatest(abs({g}) - {l1!r}, 0e0) / ({h} + {l2!r}))"
    quality = lambda g, h: f"(greatest(abs({g}) - {l1!r}, 0e0) * greatest(abs({g}) - {l1!r}, 0e0) / ({h} + {l2!r}))"
    share = "least(greatest(g / h, 1e-9), 1e0 - 1e-9)"
    first = {"mean": "g / h", "log_odds": f"ln({share} / (1e0 - {share}))", "zero": "0e0"}[start]
    chance = "(1e0 / (1e0 + exp(-s)))"
    slope, bend = (f"y - {chance}", f"{chance} * (1e0 - {chance})") if start == "log_odds" else ("y - s", "1e0")
    bins = md.BOOST["bins"]
    cells = ", ".join(
        f"least(greatest(CAST(floor(round({n} * {bins}e0, 9)) AS INTEGER), 0), {bins - 1}) AS b{i}" for i, n in enumerate(NAMES)
    )
    tall = " UNION ALL ".join(f"SELECT rebalance_date, {i} AS feature, b{i} AS cut, g, h FROM graded" for i in range(len(NAMES)))
    return with_sql(
        LABELLED_SQL, CALENDAR_SQL, factors_sql("labelled", ["target_rank", "is_target_topk"], directions=DIRECTIONS), _WALK_HIST_SQL,
        f"rf AS (SELECT trade_date, CAST({target} AS DOUBLE) AS y, target_rank, " + ", ".join(f"coalesce({avg_rank_sql(n, 'trade_date')}, 0.5e0) AS {n}" for n in NAMES) + " FROM wide)",
        f"binned AS (SELECT trade_date, y, {cells} FROM rf WHERE target_rank IS NOT NULL)",
        f"rows AS (SELECT rebalance_date, {weight} AS w, binned.* FROM hist JOIN binned USING (trade_date))",
        f"starts AS (SELECT rebalance_date, {first} AS s FROM (SELECT rebalance_date, sum(round_even(y * w * {whole}, 0)) {scale} AS g, sum(round_even(w * {whole}, 0)) {scale} AS h FROM rows GROUP BY 1))",
        f"graded AS (SELECT rows.*, round_even(({slope}) * w * {whole}, 0) AS g, round_even(({bend}) * w * {whole}, 0) AS h FROM rows JOIN starts USING (rebalance_date))",
        f"cells AS (SELECT rebalance_date, feature, cut, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({tall}) GROUP BY 1, 2, 3)",
        "below AS (SELECT rebalance_date, feature, cut, sum(g) OVER p AS lg, sum(h) OVER p AS lh, sum(n) OVER p AS ln, sum(g) OVER t AS tg, sum(h) OVER t AS th, sum(n) OVER t AS n"
        " FROM cells WINDOW p AS (PARTITION BY rebalance_date, feature ORDER BY cut), t AS (PARTITION BY rebalance_date, feature))",
        f"splits AS (SELECT rebalance_date, feature, cut, ln, n, lg {scale} AS lg, lh {scale} AS lh, (tg - lg) {scale} AS rg, (th - lh) {scale} AS rh, tg {scale} AS tg, th {scale} AS th FROM below)",
        f"gains AS (SELECT *, {quality('lg', 'lh')} + {quality('rg', 'rh')} - {quality('tg', 'th')} AS gain FROM splits WHERE ln >= {least} AND n - ln >= {least})",
        "best AS (SELECT * FROM gains WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY rebalance_date ORDER BY gain DESC, feature, cut) = 1)",
        select=f"SELECT rebalance_date, CAST(feature AS INTEGER) AS feature, CAST(cut AS INTEGER) AS cut, round(gain, 9) + 0e0 AS gain, CAST(n AS BIGINT) AS train_rows, CAST(ln AS BIGINT) AS left_rows,"
        f" round({value('lg', 'lh')}, 9) + 0e0 AS left_value, round({value('rg', 'rh')}, 9) + 0e0 AS right_value FROM best",
    )


def first_trees(result):
    """Root split and both leaves of the first tree of every refit."""
    table = result.models.table.where("tree = 0")
    side = lambda node, **names: table.where(F.col("node") == node).select("rebalance_date", *[F.col(c).alias(a) for c, a in names.items()])
    root = table.where("node = 0 AND feature >= 0").select("rebalance_date", "feature", "cut", "gain", F.col("rows").alias("train_rows"))
    found = root.join(side(1, rows="left_rows", value="left_value"), "rebalance_date").join(side(2, value="right_value"), "rebalance_date")
    return rounded(found, ["gain", "left_value", "right_value"], 9)


_ONE_ROUND = {**_BOOST, "max_iter": 1, "depth": 1, "leaves": 2, "row_share": 1.0, "feature_share": 1.0}


@register("boost_first_round", first_tree_sql("target_rank", 10.0, 20, _BOOST["l1"], _BOOST["l2"], "mean"))
def boost_first_round(spark, folder):
    """Regression with decayed weights: first split of every refit of the whole calendar."""
    return first_trees(run(spark, folder, "regression", dict(settings=_ONE_ROUND)))


@register(
    "classifier_first_round", first_tree_sql("is_target_topk", 10.0, 20, _BOOST["l1"], _BOOST["l2"], "log_odds", md.POSITIVE_WEIGHT)
)
def classifier_first_round(spark, folder):
    return first_trees(run(spark, folder, "classifier", dict(settings=_ONE_ROUND)))


@register("tree_root_split", first_tree_sql("target_rank", 0.0, "ceil(n * 0.05e0)", 0.0, 0.0, "zero"))
def tree_root_split(spark, folder):
    """A single split per refit with leaves of a twentieth of the rows at least."""
    return first_trees(run(spark, folder, "tree", dict(depths=(1,), leaf_shares=(0.05,), min_gain=0.0)))


def _log_sql(name, lookback):
    return f"SELECT '{name}' AS run, * FROM (" + with_sql(
        PANEL_SQL, CALENDAR_SQL, hist_sql(lookback=lookback),
        select="SELECT rebalance_date AS date, min(trade_date) AS train_start, max(trade_date) AS train_end, count(*) AS rows, CAST(0 AS INTEGER) AS iteration FROM hist GROUP BY 1",
    ) + ")"


@register("refit_logs_read", _log_sql("w30", 30) + " UNION ALL " + _log_sql("w60", 60))
def refit_logs_read(spark, folder):
    """Refit logs of two walks written below one folder and found again with their paths."""
    calendar, path = main_calendar(spark, folder), f"{work_folder(spark)}/logs-{uuid.uuid4().hex}"
    blocks = wf.rebalance_calendar(calendar, WALK_START, WALK_END, UPDATE)
    for name, lookback in (("w30", 30), ("w60", 60)):
        spans = wf.history_windows(blocks, calendar, horizon=HORIZON, lookback=lookback).groupBy(F.col("rebalance_date").alias("date"))
        log = spans.agg(
            F.min("trade_date").alias("train_start"), F.max("trade_date").alias("train_end"), F.count("*").alias("rows"), F.lit(0).alias("iteration")
        )
        store.write_refit_log(log, f"{path}/{name}")
    logs = store.read_refit_logs(spark, path)
    return logs.withColumn("run", F.element_at(F.split("source_path", "/"), -2)).drop("source_path")


@register("feature_importance")
def feature_importance(spark, folder):
    result = walked(spark, folder, "rolling_tree")
    return md.importance_table(result.models, top=5)


def _grid_sql(name, model="ic_vote", lookback=LOOKBACK, half_life=10.0, bins=10, names=NAMES):
    """One configuration: its scores, their evaluation and the year's means."""
    scores = [ic_vote_sql(half_life), f"sc AS ({VOTES_SQL})"] if model == "ic_vote" else [bins_sql(bins), f"sc AS ({BINNED_SQL.format(digits=9)})"]
    whole = with_sql(
        ranked_sql(lookback, names), *scores,
        f"pred AS (SELECT entity, trade_date, score, {LABEL}, target_rank, relevance, is_target_topk FROM sc JOIN rf USING (entity, trade_date) WHERE {LABEL} IS NOT NULL)",
        daily_of_pred_sql(), MONTHLY_SQL, SUMMARY_SQL,
        select=f"SELECT CAST(days AS BIGINT) AS days, {rounds(_SUM_COLS)}, y.* FROM summary CROSS JOIN (SELECT {YEAR_SQL(['2000'])} FROM daily) y",
    )
    return f"SELECT '{name}' AS experiment_id, '{model}' AS model, CAST({len(names)} AS INTEGER) AS factor_count, * FROM ({whole})"


GRID_SQL = " UNION ALL ".join(
    [
        _grid_sql("vote"), _grid_sql("bins10", model="binning"), _grid_sql("bins20", model="binning", bins=20), _grid_sql("window60", lookback=60),
        _grid_sql("decay0", half_life=0.0), _grid_sql("without_terms", names=("f2", "f4", "f6")),
    ]
)


@register("model_grid", GRID_SQL)
def model_grid(spark, folder):
    """Relational models, windows, half-lives and an ablation on one shared frame."""
    common = dict(model="ic_vote", start=WALK_START, end=WALK_END, horizon=HORIZON, lookback=LOOKBACK, validation=5, update=5)
    library = small_table(
        spark, name=list(NAMES), expression=list(LIBRARY.values()), category=["terms", "price", "terms", "size", "terms", "price"]
    )
    grid = {
        "vote": {},
        "bins10": dict(model="binning", bins=10),
        "bins20": dict(model="binning", bins=20),
        "window60": dict(lookback=60),
        "decay0": dict(half_life=0.0),
        **gr.ablation_grid(library, {"without_terms": "terms"}),
    }
    found = gr.run_grid(
        ranked_frame(spark, folder, 60), NAMES, main_calendar(spark, folder), main_shape(spark, folder), grid, label=LABEL, k=K,
        years=["2000"], common=common, digits=9,
    )
    return nudged(found, [c for c, kind in found.dtypes if kind == "double"])

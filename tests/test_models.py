"""Tree models, the ranking gradients and the sinks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import evaluate as ev
from panelforge.operators.calendar import measure, trading_calendar
from panelforge.operators.labels import add_labels
from panelforge.plans import grid as gr
from panelforge.plans import lockstep as ls
from panelforge.plans import models as md
from panelforge.plans.lambdarank import lambda_gradients
from panelforge.sources import store

FACTORS = ["f1", "f2"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(2)
    rows = []
    for d in range(40):
        date = f"2024{1 + d // 20:02d}{1 + d % 20:02d}"
        for i in range(30):
            f1, f2 = rng.random(), rng.random()
            rows.append((f"e{i:02d}", date, f1 + 0.2 * rng.random(), f1, f2))
    df = spark.createDataFrame(rows, "entity string, trade_date string, future_ret double, f1 double, f2 double")
    return add_labels(df, k=5, edges=(0.5, 0.7, 0.9)).drop("target_position")


def run(frame, model, options=None, **settings):
    calendar, shape = trading_calendar(frame), measure(frame)
    return gr.walk_forward(
        frame, FACTORS, calendar, shape, model=model, start="20240211", end="20240220", horizon=3, lookback=20, validation=5,
        update=5, k=5, options=options, **settings,
    )


BOOST = {**md.BOOST, "max_iter": 8, "min_rows": 5, "step": 0.3}
CASES = {
    "ic_vote": None,
    "binning": None,
    "tree": dict(depths=(1, 2), leaf_shares=(0.05, 0.2)),
    "regression": dict(settings=BOOST),
    "classifier": dict(settings=BOOST),
    "lambdarank": dict(rounds=4, step=0.5, depth=2, min_rows=10, l2=1.0),
}


@pytest.mark.parametrize("model", list(CASES))
def test_walk_forward(spark, frame, model):
    result = run(frame, model, CASES[model])
    assert len(result.records) == 2
    for record in result.records:
        assert record["train_end"] < record["rebalance_date"]
    scored = result.predictions
    assert scored.count() == 300 and scored.where("score IS NULL").count() == 0
    daily = ev.daily_table(scored, "future_ret", 5)
    means = daily.agg(F.avg("ndcg").alias("ndcg"), F.avg("random_ndcg").alias("random")).first()
    assert means.ndcg > means.random + 0.2  # f1 drives the label


def test_tree_limits_and_records(spark, frame):
    result = run(frame, "tree", CASES["tree"])
    for record in result.records:
        assert record["actual_depth"] <= record["max_depth"] <= 2
        assert record["leaf_count"] <= 4 and record["top_feature"] == "f1"
        assert record["validation_mae_improvement"] > 0


def test_future_rows_change_nothing(spark, frame):
    """Labels after the embargo must not move the scores of the first block."""
    first = lambda r: {(x.entity, x.trade_date): x.score for x in r.predictions.where("rebalance_date = '20240211'").collect()}
    before = first(run(frame, "binning"))
    changed = frame.withColumn("target_rank", F.when(F.col("trade_date") >= "20240208", 1 - F.col("target_rank")).otherwise(F.col("target_rank")))
    assert first(run(changed, "binning")) == before
    assert first(run(frame.withColumn("target_rank", 1 - F.col("target_rank")), "binning")) != before


def brute_gradients(rows, k):
    """All pairs with a top-k row, written out."""
    rows = sorted(rows, key=lambda r: (-r["score"], r["entity"]))
    ideal = sum((2 ** r - 1) / math.log2(i + 2) for i, r in enumerate(sorted((r["relevance"] for r in rows), reverse=True)[:k]))
    grad, hess = {r["entity"]: 0.0 for r in rows}, {r["entity"]: 0.0 for r in rows}
    for i in range(min(k, len(rows))):
        for j in range(i + 1, len(rows)):
            a, b = rows[i], rows[j]
            if a["relevance"] == b["relevance"]:
                continue
            hi, lo = (a, b) if a["relevance"] > b["relevance"] else (b, a)
            swap = abs((2.0 ** a["relevance"] - 2.0 ** b["relevance"]) * (1 / math.log2(i + 2) - 1 / math.log2(j + 2))) / ideal
            p = 1 / (1 + math.exp(hi["score"] - lo["score"]))
            grad[hi["entity"]] += p * swap
            grad[lo["entity"]] -= p * swap
            for e in (hi, lo):
                hess[e["entity"]] += p * (1 - p) * swap
    return grad, hess


@pytest.mark.parametrize("k", [3, 8, 50])
def test_ranking_gradients(spark, k):
    rng = random.Random(k)
    rows = [dict(entity=f"e{i:02d}", trade_date="20240101", score=round(rng.gauss(0, 1), 1), relevance=rng.choice([0, 0, 1, 2, 3])) for i in range(20)]
    df = spark.createDataFrame([(r["entity"], r["trade_date"], r["score"], r["relevance"]) for r in rows], "entity string, trade_date string, score double, relevance int")
    got = {r.entity: r for r in lambda_gradients(df, k, widest=20, dates=1).collect()}
    grad, hess = brute_gradients(rows, k)
    for e in grad:
        assert got[e]["lambda"] == pytest.approx(grad[e], abs=1e-12)
        assert got[e].hessian == pytest.approx(hess[e], abs=1e-12)
    assert sum(r["lambda"] for r in got.values()) == pytest.approx(0.0, abs=1e-12)


def test_grid_and_winner(spark, frame):
    from panelforge.plans.experiments import select_winner

    common = dict(model="ic_vote", start="20240211", end="20240220", horizon=3, lookback=20, validation=5, update=5)
    results = gr.run_grid(
        frame, FACTORS, trading_calendar(frame), measure(frame), {"A": {}, "B": dict(model="binning"), "C": dict(factors=["f2"])},
        label="future_ret", k=5, years=["2024"], common=common,
    )
    rows = {r.experiment_id: r for r in results.collect()}
    assert set(rows) == {"A", "B", "C"} and rows["C"].factor_count == 1
    winner = select_winner(results, years=["2024"]).first()
    assert winner.experiment_id in ("A", "B") and winner.eligible


def test_grids_cover_every_stage():
    assert (len(gr.MODEL_GRID), len(gr.WINDOW_GRID), len(gr.DECAY_GRID), len(gr.ABLATION_GRID)) == (6, 6, 3, 4)


def test_patience_counts_trees_without_a_better_loss():
    def stop(losses, patience):
        watch = ls.Watch(1, patience)
        for number, loss in enumerate(losses, 1):
            if watch.ended(0, number, loss):
                break
        return int(watch.round[0])

    assert stop([5.0, 4.0, 3.0, 3.5, 3.4, 3.3, 2.0], patience=3) == 3
    assert stop([5.0, 4.0, 3.0, 3.5, 3.4, 2.9, 2.0], patience=4) == 7
    assert stop([1.0], patience=15) == 1 and stop([1.0, 1.0, 1.0], patience=15) == 1


@pytest.mark.parametrize("model", ["tree", "regression", "classifier", "lambdarank"])
def test_models_survive_saving(spark, frame, tmp_path, model):
    result = run(frame, model, CASES[model])
    md.save_models(result.models, f"{tmp_path}/models")
    again = ls.TreeModels.load(spark, f"{tmp_path}/models").score(frame).select("entity", "trade_date", "rebalance_date", "score")
    assert again.count() == 300
    assert again.exceptAll(result.predictions.select("entity", "trade_date", "rebalance_date", "score")).count() == 0


def test_rounds_leave_no_tables(spark, frame):
    """Boosting rounds delete what they wrote: the count of tables does not grow with the rounds."""
    import os

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    left = []
    for rounds in (1, 2):
        before = set(os.listdir(folder))
        run(frame, "lambdarank", {**CASES["lambdarank"], "rounds": rounds, "patience": 9})
        left.append(len(set(os.listdir(folder)) - before))
    assert left[0] == left[1]


def test_sinks(spark, frame, tmp_path):
    result = run(frame, "tree", dict(depths=(1,), leaf_shares=(0.1,)))
    md.save_models(result.models, f"{tmp_path}/models")
    loaded = ls.TreeModels.load(spark, f"{tmp_path}/models").table
    assert loaded.agg(F.max("node")).first()[0] == 2 and loaded.where("feature >= 0").count() == 2
    whole = ev.evaluate_predictions(result.predictions, k=5)
    store.write_predictions(whole.ranked, f"{tmp_path}/pred")
    assert spark.read.parquet(f"{tmp_path}/pred/topk_predictions").count() == 50
    store.write_metrics({"daily": whole.daily, "monthly": whole.monthly}, f"{tmp_path}/metrics")
    assert spark.read.option("header", True).csv(f"{tmp_path}/metrics/daily").count() == 10
    records = md.records_table(spark, [{**r, "top_features": {"f1": 1.0}} for r in result.records])
    store.write_records(records, f"{tmp_path}/records")
    assert spark.read.json(f"{tmp_path}/records").count() == 2


def test_library_round_trip(spark, tmp_path):
    (tmp_path / "library.json").write_text(
        '{"options": {"quick": false}, "factors": [{"name": "factor_01", "expression": ["add", ["mean_5", "x"], "y"], "direction": -1,'
        ' "category": "size", "score": 0.5, "peak_month": "202401"}, {"name": "factor_02", "expression": "x", "direction": 1}]}'
    )
    library = store.read_library(spark, f"{tmp_path}/library.json")
    rows = library.orderBy("name").collect()
    assert rows[0].expression == '["add",["mean_5","x"],"y"]' and rows[0].depth == 2 and rows[0].direction == -1
    assert rows[1].expression == '"x"' and rows[1].nodes == 1
    store.write_library(library, f"{tmp_path}/out")
    again = store.read_library(spark, f"{tmp_path}/out").orderBy("name").collect()
    assert [r.expression for r in again] == [r.expression for r in rows]
    texts, directions = store.library_expressions(library)
    assert directions == {"factor_01": -1, "factor_02": 1} and texts["factor_02"] == '"x"'
    assert "expression" not in spark.read.option("header", True).csv(f"{tmp_path}/out/csv").columns


def test_first_generation_library(spark, tmp_path):
    (tmp_path / "old.json").write_text(
        '{"factors": [{"name": "factor_01", "expression": ["neg", "x"], "depth": 1, "search_score": 0.25, "best_month_abs_ic": 0.4,'
        ' "mean_top_abs_ic": 0.3, "valid_months": 7, "peak_month": "202403", "full_months_abs_ic_ge_005": 12}]}'
    )
    library = store.read_library(spark, f"{tmp_path}/old.json")
    row = library.first()
    assert (row.score, row.best_month_abs_ic, row.valid_months, row.full_months_abs_ic_ge_005) == (0.25, 0.4, 7, 12)
    review = spark.createDataFrame(
        [("factor_01", "202405", 0.5, 0.45, 0.2, 15)],
        "factor string, full_peak_month string, full_best_month_abs_ic double, full_top3_month_abs_ic double, full_mean_abs_month_ic double, full_months_abs_ic_ge_005 bigint",
    )
    store.write_library(store.with_review(library, review), f"{tmp_path}/new")
    again = store.read_library(spark, f"{tmp_path}/new").first()
    assert (again.score, again.full_peak_month, again.full_months_abs_ic_ge_005) == (0.25, "202405", 15)


def test_refit_logs_keep_their_path(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "models.csv").write_text("date,train_start,train_end,rows,iteration\n20240110,20231201,20240101,10,3\n")
        (tmp_path / name / "other.csv").write_text("x\n1\n")
    logs = store.read_refit_logs(spark, str(tmp_path)).collect()
    assert len(logs) == 2 and {r.date for r in logs} == {"20240110"}
    assert {r.source_path.split("/")[-2] for r in logs} == {"a", "b"}


def test_feature_list(spark, tmp_path):
    from panelforge.sources.panel import read_feature_list

    (tmp_path / "meta.json").write_text('{"feature_columns": ["x", "is_tech_warmup", "y"]}')
    assert read_feature_list(spark, f"{tmp_path}/meta.json") == ["x", "y"]

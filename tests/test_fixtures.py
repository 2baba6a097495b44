"""Small literal cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from panelforge.functions import expressions as ex
from panelforge.operators import evaluate as ev
from panelforge.operators import quality as q
from panelforge.operators.labels import add_labels
from panelforge.operators.series import with_temporals
from panelforge.plans import experiments as xp
from panelforge.plans import walkforward as wf
from panelforge.sources import panel as sources


def series(spark, values, start=0):
    rows = [("a", str(i + start), float(v) if v is not None else None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "entity string, trade_date string, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("trade_date").collect()]


@pytest.mark.parametrize("position", [True, False])
def test_rank_edges_of_eight_names(spark, position):
    """Eight names with returns out of order: ranks are eighths, edges are inclusive from below."""
    returns = {"kiwi": 0.03, "fig": -0.20, "date": 0.11, "plum": -0.01, "lime": 0.40, "pear": 0.02, "nut": -0.07, "yam": 0.25}
    df = spark.createDataFrame([(e, "20230630", r) for e, r in returns.items()], "entity string, trade_date string, future_ret double")
    rows = {r.entity: r for r in add_labels(df, k=3, edges=(0.25, 0.6, 0.8), position=position).collect()}
    order = ["fig", "nut", "plum", "pear", "kiwi", "date", "yam", "lime"]
    assert [rows[e].target_rank * 8 for e in order] == pytest.approx(list(range(1, 9)))
    assert [rows[e].relevance for e in order] == [0, 1, 1, 1, 2, 2, 3, 3]
    assert {e for e in order if rows[e].is_target_topk} == {"date", "yam", "lime"}


def test_inverted_scores_pick_the_worst(spark):
    """Scores that reverse the returns choose the other end and correlate at -1."""
    df = spark.createDataFrame([(f"n{i}", "20230630", i * i * 0.01) for i in range(9)], "entity string, trade_date string, future_ret double")
    scored = add_labels(df, k=4, edges=(0.5, 0.8)).withColumn("score", -F.col("future_ret"))
    whole = ev.evaluate_predictions(scored, k=4)
    assert {r.entity for r in whole.ranked.where("is_pred_topk").collect()} == {"n0", "n1", "n2", "n3"}
    day = whole.daily.first()
    assert day.rank_ic == pytest.approx(-1.0) and day.turnover is None and day.ndcg == pytest.approx(0.0)


def test_difference_over_a_gap(spark):
    """A missing observation blanks its own row and the row five places on, nothing else."""
    values = [2.0, 7.0, None, 1.0, 4.0, 8.0, 9.0, 3.0, 6.0]
    got = column(with_temporals(series(spark, values), [("delta_5", "x")]), "delta_5__x")
    assert got == [None] * 5 + [6.0, 2.0, None, 5.0]


def test_slope_of_a_bent_line(spark):
    """Least squares over 6, 0, 1, 5, 3 on equal steps: (-2*6 - 0 + 5 + 2*3) / 10."""
    assert column(with_temporals(series(spark, [6, 0, 1, 5, 3]), [("slope_5", "x")]), "slope_5__x")[4] == pytest.approx(-0.1)


@pytest.mark.parametrize("op", ["delta_5", "slope_5", "mean_5", "std_20", "zscore_20", "ts_rank_20"])
def test_temporals_match_pandas_and_ignore_the_future(spark, op):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.15 else float(rng.integers(0, 6)) for _ in range(60)]
    s = pd.Series(values, dtype="float64")
    expected = {
        "delta_5": s - s.shift(5),
        "slope_5": (2 * s + s.shift(1) - s.shift(3) - 2 * s.shift(4)) / 10,
        "mean_5": s.rolling(5, min_periods=3).mean(),
        "std_20": s.rolling(20, min_periods=5).std(),
        "zscore_20": (s - s.rolling(20, min_periods=5).mean()) / s.rolling(20, min_periods=5).std(),
        "ts_rank_20": s.rolling(20, min_periods=5).rank(pct=True),
    }[op]
    rows = [("a", f"{i:04d}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "entity string, trade_date string, x double")
    got = column(with_temporals(df, [(op, "x")]), f"{op}__x")
    for g, e in zip(got, expected):
        assert (g is None) == bool(pd.isna(e)) and (g is None or g == pytest.approx(e, abs=1e-9))
    changed = spark.createDataFrame(rows[:40] + [("a", f"{i:04d}", 77.0) for i in range(40, 60)], df.schema)
    assert column(with_temporals(changed, [(op, "x")]), f"{op}__x")[:40] == got[:40]


@pytest.mark.parametrize(
    "tree, valid",
    [
        ("px", True),
        (["std_20", "tax"], True),
        (["max", ["zscore_20", "rev"], ["neg", ["signed_log", ["delta_5", "px"]]]], True),
        (["neg", ["max", "rev", ["ts_rank_20", ["abs", "px"]]]], False),
        (["delta_5", ["std_20", "px"]], False),
        (["slope_5", "px", "rev"], False),
        (["sub", ["mul", "px", ["signed_sqrt", ["std_20", ["neg", "tax"]]]], "rev"], False),
    ],
)
def test_windows_take_one_bare_feature(tree, valid):
    assert ex.is_valid(tree) is valid


@pytest.mark.parametrize("tree", [["pow", "px", "tax"], ["neg", "px", "tax"], ["add", "px"], ["min", "px", "tax", "rev"]])
def test_unknown_operators_and_wrong_operand_counts_are_refused(tree):
    with pytest.raises(ValueError, match="unknown operator"):
        ex.sql_text(tree)


def test_shape_of_nested_expressions(spark):
    """max over two branches: three levels on the left, a bare feature on the right."""
    tree = ["max", ["neg", ["mul", "px", ["std_20", "qty"]]], "tax"]
    assert (ex.tree_depth(tree), ex.node_count(tree)) == (4, 7)
    assert ex.readable(tree) == "max(neg(mul(px,std_20(qty))),tax)"
    assert ex.to_text(["abs", "größe"]) == '["abs","größe"]'
    nested = ex.to_text(["std_20", ["neg", "px"]])  # windows take features only
    rows = ex.profile_expressions(spark.createDataFrame([(ex.to_text(tree),), (nested,)], "expression string")).collect()
    assert [(r.nodes, r.depth, r.valid) for r in rows] == [(7, 4, True), (3, 2, False)]


def test_operator_semantics(spark):
    inf = float("inf")
    df = spark.createDataFrame(
        [(1, 4.0, 0.0), (2, -9.0, None), (3, inf, 1.0), (4, 2e6, 2.0), (5, inf, inf)], "id int, a double, b double"
    )
    value = lambda tree, i: df.where(f"id = {i}").select(ex.compile_tree(tree).alias("v")).first().v
    assert value(["div", "a", "b"], 1) is None
    assert value(["min", "a", "b"], 2) is None and value(["max", "a", "b"], 2) is None
    assert value(["neg", "a"], 3) == -1e6 and value(["add", "a", "b"], 4) == 1e6
    assert value("a", 4) == 2e6
    assert value(["sub", "a", "b"], 5) is None  # inf - inf
    assert value(["signed_sqrt", "a"], 2) == -3.0
    assert value(["signed_log", ["neg", "a"]], 1) == pytest.approx(-1.6094379124341003)


def test_both_ends_of_a_u_shape(spark):
    """Six names, relevance at both ends: gains 1, 0, 0, 0, 0, 3 in order of value, k = 2."""
    import math

    rows = [("f", f"n{i}", "20230630", float(i), (i + 1) / 6, r) for i, r in enumerate([1, 0, 0, 0, 0, 2])]
    long = spark.createDataFrame(rows, "factor string, entity string, trade_date string, value double, target_rank double, relevance int")
    day = q.daily_ndcg_sides(long, k=2, min_valid=2).first()
    ideal = 3 + 1 / math.log2(3)
    assert day.pos == pytest.approx(3 / ideal) and day.neg == pytest.approx(1 / ideal)


def test_contiguous_needs_a_pair(spark):
    months = spark.createDataFrame([("f", "202401", 0.5, 0.1, 5, 0.5, 1)], "factor string, month string, pos double, neg double, days int, score double, direction int")
    assert q.contiguous_objective(months).count() == 0


def test_duplicate_keys_are_refused(spark):
    df = spark.createDataFrame([("a", "1", 1.0), ("a", "1", 2.0)], "entity string, trade_date string, px double")
    twice = sources.prepare_panel(df, df.limit(1), "px", 1)
    for panel in (twice, sources.prepare_panel(df.limit(1), df, "px", 1)):
        with pytest.raises(Exception, match="duplicate key entity=a, trade_date=1 .2 rows."):
            panel.collect()
    assert sources.prepare_panel(df, df, "px", 1, check=False).count() == 4


def test_key_guard_shares_the_exchange_of_the_join(spark):
    left, right = (spark.range(n).selectExpr("CAST(id AS string) AS entity", "'1' AS trade_date", f"id AS {c}") for n, c in ((50, "x"), (40, "y")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = sources.join_panel(left, right)
        assert joined.count() == 40
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 2 and final.count("Window") >= 2


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "entity string, x double")
    assert [r.x for r in sources.normalise(df).orderBy("entity").collect()] == [None, 1.0]


def weights_of(spark, raw, cap):
    rows = [("b", f"f{i:02d}", 0.0, float(v)) for i, v in enumerate(raw)]
    df = spark.createDataFrame(rows, "rebalance_date string, factor string, mean_ic double, raw double")
    return [r.weight for r in wf.cap_weights(df, cap).orderBy("factor").collect()]


def test_weights_below_the_cap_are_shares(spark):
    assert weights_of(spark, [2.0, -1.0, 1.0], 0.5) == pytest.approx([0.5, -0.25, 0.25])
    assert weights_of(spark, [0.0, 0.0], 0.5) == [0.0, 0.0]


def test_excess_goes_to_the_others_in_proportion(spark):
    # 0.6 is cut to 0.4; the other shares 0.3 and 0.1 grow by 0.6 / 0.4.
    # The grown 0.45 is cut in turn; the rounds close in on two capped shares and 0.2.
    assert weights_of(spark, [6.0, -3.0, 1.0], 0.4) == pytest.approx([0.4, -0.4, 0.2], abs=0.003)


def test_cap_properties(spark):
    import random

    rng = random.Random(8)
    for n, cap in ((5, 0.3), (9, 0.2), (4, 0.4)):
        raw = [rng.gauss(0, 1) ** 3 for _ in range(n)]
        got = weights_of(spark, raw, cap)
        assert all(g * r > 0 for g, r in zip(got, raw)) and max(map(abs, got)) <= cap * 1.05
        assert sum(map(abs, got)) <= 1 + 1e-9
        # Weights below the cap keep their order.
        below = sorted((abs(r), abs(g)) for r, g in zip(raw, got) if abs(g) < cap * 0.99)
        assert [g for _, g in below] == sorted(g for _, g in below)


def test_embargo_and_windows(spark):
    calendar = spark.createDataFrame([(f"{20240100 + i}", i) for i in range(1, 41)], "trade_date string, position int")
    blocks = wf.rebalance_calendar(calendar, "20240120", "20240140", 5)
    windows = wf.history_windows(blocks, calendar, horizon=5, lookback=10)
    position = {r.trade_date: r.position for r in calendar.collect()}
    for r in windows.groupBy("rebalance_date").agg(F.max("trade_date").alias("last"), F.count("*").alias("n")).collect():
        assert position[r["last"]] == position[r.rebalance_date] - 6 and r.n == 10
    models = windows.groupBy(F.col("rebalance_date").alias("date")).agg(F.max("trade_date").alias("train_end"))
    from panelforge.operators.calendar import PanelShape

    shape = PanelShape(40, 40, 1)
    assert xp.audit_label_leakage(models, calendar, shape, horizon=5).count() == 0
    assert xp.audit_label_leakage(models, calendar, shape, horizon=6).count() == models.count()


def test_validation_gap_by_zero(spark):
    one = spark.createDataFrame([(0.0, 2.0)], "ndcg double, turnover double")
    two = spark.createDataFrame([(1.0, 1.0)], "ndcg double, turnover double")
    rows = {r.metric: r for r in xp.validation_test_gap(one, two, ["ndcg", "turnover"]).collect()}
    assert rows["ndcg"].retention is None and rows["turnover"].retention == 0.5 and rows["ndcg"].absolute_gap == 1.0

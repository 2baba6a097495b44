"""The forms used beyond one task's limits agree with the plain ones."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import expressions as ex
from panelforge.operators import daily as dl, labels
from panelforge.operators import quality as q
from panelforge.operators.calendar import PanelShape
from panelforge.operators.ranks import average_rank, ordinal_rank, ranks_among
from panelforge.plans import search as sr


@pytest.fixture(scope="module")
def skewed(spark):
    """One date holds most rows; a third of all values are equal; some are missing."""
    rng = np.random.default_rng(5)
    n = 3000
    date = np.where(rng.random(n) < 0.7, "20240101", rng.choice(["20240102", "20240103", "20240104"], n))
    value = np.where(rng.random(n) < 0.33, 1.5, np.round(rng.normal(size=n), 2))
    value = np.where(rng.random(n) < 0.05, np.nan, value)
    pdf = pd.DataFrame({"entity": [f"e{i:05d}" for i in range(n)], "trade_date": date, "x": value})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return df, pdf


@pytest.fixture
def small_groups(spark):
    spark.conf.set("spark.panelforge.maxGroupRows", "100")
    yield
    spark.conf.unset("spark.panelforge.maxGroupRows")


def as_series(df):
    return df.select("entity", "r").toPandas().set_index("entity")["r"].astype(float).sort_index()


@pytest.mark.parametrize("pct", [True, False])
def test_average_rank_sliced(spark, skewed, small_groups, pct):
    df, pdf = skewed
    expected = pdf.groupby("trade_date")["x"].rank(pct=pct)
    got = as_series(average_rank(df, ["trade_date"], "x", "r", pct=pct))
    pd.testing.assert_series_equal(got.reset_index(drop=True), expected.reset_index(drop=True), check_names=False)


@pytest.mark.parametrize("pct", [True, False])
def test_ranks_of_few_rows_among_all(spark, skewed, pct):
    """Ties inside and outside the few, missing values, a date of which no row is taken."""
    df, pdf = skewed
    few = df.where("trade_date <> '20240104' AND (entity LIKE '%7' OR x IS NULL OR x = 1.5)")
    expected = pdf.set_index("entity").groupby("trade_date")["x"].rank(pct=pct).sort_index()
    got = as_series(ranks_among(few, df, ["trade_date"], "x", "r", pct=pct))
    assert 700 < len(got) < len(expected) and got.isna().any()
    pd.testing.assert_series_equal(got, expected[got.index], check_names=False, check_exact=True)


@pytest.mark.parametrize("descending", [True, False])
def test_ordinal_rank_sliced(spark, skewed, small_groups, descending):
    df, pdf = skewed
    expected = pdf.groupby("trade_date")["x"].rank(method="first", ascending=not descending)
    got = as_series(ordinal_rank(df, ["trade_date"], "x", "r", descending=descending))
    pd.testing.assert_series_equal(got.reset_index(drop=True), expected.reset_index(drop=True), check_names=False)


def test_columns_ranked_together(spark, skewed, small_groups):
    """Several columns beyond the limit: the same ranks, and as many tables for five as for two."""
    import os

    from panelforge.operators.ranks import average_ranks

    df, pdf = skewed
    names = [f"x{i}" for i in range(5)]
    wide = df.select("entity", "trade_date", *[(F.col("x") * (1 - 2 * (i % 2)) + i).alias(n) for i, n in enumerate(names)])
    folder, written = spark.sparkContext.getConf().get("spark.checkpoint.dir"), []
    for count in (2, 5):
        before = set(os.listdir(folder))
        got = average_ranks(wide, ["trade_date"], {n: f"r_{n}" for n in names[:count]}).toPandas().set_index("entity").sort_index()
        written.append(len(set(os.listdir(folder)) - before))
    assert written[0] == written[1]
    base = pdf.set_index("entity").sort_index()
    for i, n in enumerate(names):
        want = (base["x"] * (1 - 2 * (i % 2)) + i).groupby(base["trade_date"]).rank(pct=True)
        pd.testing.assert_series_equal(got[f"r_{n}"].astype(float), want, check_names=False)


def test_sliced_groups_leave_no_large_window(spark, skewed, small_groups):
    """No window partition holds a whole hot date: ties are salted, the rest is cut by value."""
    df, _ = skewed
    plan = average_rank(df, ["trade_date"], "x", "r")._jdf.queryExecution().executedPlan().toString()
    assert "__slice" in plan and "__salt" in plan


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = []
    for m in ("202401", "202402", "202403"):
        for d in range(1, 7):
            ranks = list(range(1, 41))
            rng.shuffle(ranks)
            for i in range(40):
                a = None if rng.random() < 0.1 else round(rng.gauss(ranks[i] / 20, 1), 2)
                rows.append((f"e{i:02d}", f"{m}{d:02d}", a, float(rng.randint(0, 5)), ranks[i] / 40, max(0, ranks[i] - 36)))
    return spark.createDataFrame(rows, "entity string, trade_date string, a double, b double, target_rank double, relevance int")


EXPRESSIONS = {"p": '"a"', "q": '["add","a","b"]', "r": '["mul","b",["neg","a"]]', "flat": '["sub","b","b"]'}


@pytest.mark.parametrize("objective", ["phase_ic", "top3_ic", "top3_ndcg", "contiguous_ndcg", "contiguous_ic"])
def test_wide_and_long_scoring_agree(spark, labelled, objective):
    options = sr.SearchOptions(objective=objective, k=5, min_valid=10, min_names=10, min_days=3)
    shape = PanelShape(720, 18, 40)
    wide = ex.evaluate_expressions(labelled, EXPRESSIONS, keep=["target_rank", "relevance"])
    sizes = q.expression_sizes(spark, EXPRESSIONS)
    a = {r.factor: r for r in sr._score_wide(wide, EXPRESSIONS, sizes, options, shape).collect()}
    b = {r.factor: r for r in sr._score_long(wide, EXPRESSIONS, sizes, options, shape).collect()}
    assert set(a) == set(b) == set(EXPRESSIONS)
    for name in a:
        assert a[name].score == pytest.approx(b[name].score, abs=1e-9)
        assert a[name].peak_month == b[name].peak_month and a[name].direction == b[name].direction
    assert a["flat"].score < -1e8


@pytest.mark.parametrize("kind", ["prerank", "ic", "ndcg"])
@pytest.mark.parametrize("cells", [1, 90, 120])
def test_columns_of_a_date_in_chunks(spark, labelled, monkeypatch, kind, cells):
    """One, two or three of the four columns per task give what all together give."""
    wide = ex.evaluate_expressions(labelled, EXPRESSIONS, keep=["target_rank", "relevance"])
    whole = dl.daily_statistics(wide, list(EXPRESSIONS), kind, k=5, least=5).collect()
    monkeypatch.setattr(dl, "CELLS", cells)
    parts = dl.daily_statistics(wide, list(EXPRESSIONS), kind, k=5, least=5, widest=40).collect()
    plain = lambda rows: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows)
    assert plain(whole) == plain(parts) and len(whole) == 72


def test_value_spread(spark, labelled):
    wide = ex.evaluate_expressions(labelled, EXPRESSIONS, keep=["target_rank", "relevance"])
    daily = dl.daily_statistics(wide, list(EXPRESSIONS), "prerank")
    got = {r.factor: r.value_std for r in dl.value_spread(daily).collect()}
    expected = wide.agg(*[F.stddev_samp(n).alias(n) for n in EXPRESSIONS]).first()
    for name in EXPRESSIONS:
        assert got[name] == pytest.approx(expected[name], abs=1e-9)


@pytest.mark.parametrize("limit", ["4000000", "15"])
def test_pooled_correlation_matches_pandas(spark, labelled, limit):
    spark.conf.set("spark.panelforge.maxGroupRows", limit)
    matrix = sr.rank_correlation_matrix(labelled, EXPRESSIONS, widest=40)
    spark.conf.unset("spark.panelforge.maxGroupRows")
    got = {(r.left, r.right): r.correlation for r in matrix.collect()}
    wide = ex.evaluate_expressions(labelled, EXPRESSIONS).toPandas()
    names = list(EXPRESSIONS)
    ranks = wide.groupby("trade_date")[names].rank(pct=True)
    for i, a in enumerate(names):
        for b in names[i:]:
            if "flat" in (a, b):
                assert got[a, b] is None or abs(got[a, b]) <= 1
            else:
                assert got[a, b] == pytest.approx(ranks[a].corr(ranks[b]), abs=1e-9)


def test_selection_rules(spark, labelled):
    options = sr.SearchOptions(min_valid=10, library_size=3, max_per_month=2)
    make = lambda text, month, score: {"expression": text, "peak_month": month, "score": score, "direction": 1, "sampled": score}
    candidates = [
        make('"a"', "202401", 9.0), make('["neg","a"]', "202402", 8.0), make('["sub","b","b"]', "202402", 7.0),
        make('"b"', "202401", 6.0), make('["mul","b",["neg","a"]]', "202401", 5.0),
    ]
    for chunk in (1, 2, 10):
        chosen = sr.select_library(labelled, candidates, options, PanelShape(720, 18, 40), chunk=chunk)
        assert [c["expression"] for c in chosen] == ['"a"', '"b"']


def test_search_is_reproducible(spark, labelled):
    options = sr.SearchOptions(
        objective="top3_ndcg", k=5, min_valid=10, min_days=3, population=8, generations=2, elite=3, library_size=3,
        temporal=("mean_5",), names_per_date=30, max_depth=2, mutation="mixed", crossover="symmetric_subtree", selection="tournament",
    )
    first = [tuple(r) for r in sr.search_factors(labelled, ["a", "b"], options).collect()]
    again = [tuple(r) for r in sr.search_factors(labelled, ["a", "b"], options).collect()]
    assert first == again and 0 < len(first) <= 3


@pytest.mark.parametrize("crossover", ["insert_parent", "symmetric_subtree"])
@pytest.mark.parametrize("mutation", ["subtree", "mixed"])
def test_varied_trees_stay_valid(crossover, mutation):
    options = sr.SearchOptions(crossover=crossover, mutation=mutation, temporal=("mean_5", "std_20"), population=30, max_depth=3)
    grammar = sr.Grammar(["a", "b", "c"], options, random.Random(4))
    trees = grammar.first_population()
    for _ in range(4):
        trees = grammar.next_population([(float(i), ex.to_text(t)) for i, t in enumerate(trees)])
        assert len(trees) == 30 and all(ex.tree_depth(t) <= 3 and ex.is_valid(t) for t in trees)


def test_labelled_rows_fill_the_sample(spark):
    rows = [("20240102", f"n{i}", float(i) if i % 2 else None) for i in range(10)] + [("20240103", "n0", None)]
    panel = spark.createDataFrame(rows, "trade_date string, entity string, y double")
    free = {(r.trade_date, r.entity) for r in labels.flag_entities(panel, 5, 3).where("in_sample").collect()}
    known = labels.flag_entities(panel, 5, 3, label="y")
    assert len(free) == 6 and known.count() == 11
    assert {(r.trade_date, r.entity) for r in known.where("in_sample").collect()} == {("20240102", f"n{i}") for i in (1, 3, 5, 7, 9)}


@pytest.mark.parametrize("kind", ["prerank", "complete", "ic", "ndcg"])
def test_factor_columns_agree_with_the_long_form(spark, kind):
    rng = np.random.default_rng(11)
    rows = [
        (f"2024010{d}", f"n{i:03d}", float(i * 7919 % 40) / 40, i * 31 % 5, *(None if x > 0.9 else float(round(x, 1)) for x in rng.random(2)))
        for d in (1, 2) for i in range(40)
    ]
    wide = spark.createDataFrame(rows, "trade_date string, entity string, target_rank double, relevance int, a double, b double")

    def found(widest):
        if kind in ("ic", "ndcg"):
            return q.factor_sides(wide, ["a", "b"], kind, k=5, min_valid=5, widest=widest)
        return q.factor_ics(wide, ["a", "b"], complete=kind == "complete", min_names=5, widest=widest)

    near, far = (sorted(map(tuple, found(w).collect())) for w in (40, 5_000_000))
    assert len(near) == len(far) == 4
    for x, y in zip(near, far):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:])


def test_columns_of_a_date_are_ranked_in_one_pass(spark, monkeypatch):
    """No sort of whole rows per column; ties, missing values and NaN as in the windows."""
    from panelforge.operators import ranks

    rng, some = random.Random(4), [None, float("nan"), -0.0, 0.0, 1.0, 2.5]
    rows = [(f"e{i:03d}", f"2024010{i % 3}", *[rng.choice(some) if rng.random() < 0.5 else rng.random() for _ in range(3)]) for i in range(240)]
    rows += [("alone", "20240109", None, None, 1.0)]
    df = spark.createDataFrame(rows, "entity string, trade_date string, a double, b double, c double")
    made = lambda pct: ranks.average_ranks(df, ["trade_date"], {n: f"r_{n}" for n in "abc"}, pct=pct)
    plan = made(True)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Sort [") == 1
    here = [sorted(map(repr, made(pct).collect())) for pct in (True, False)]
    monkeypatch.setattr(ranks, "GROUP_CELLS", 0)
    assert [sorted(map(repr, made(pct).collect())) for pct in (True, False)] == here


def test_panel_groups_are_kept_as_numbers(spark, tmp_path):
    """A scan task's groups hold no text and no decimals of 28 digits; sums stay exact."""
    from decimal import Decimal

    from panelforge.sources import panel

    rng = random.Random(5)
    lines = [(s, 10 * s, float(rng.randint(1, 50)), rng.randint(1, 10**9) / 100, rng.randint(0, 10) / 100, rng.randint(0, 8) / 100, "RNA"[s % 3]) for s in (1, 2, 3) for _ in range(200)]
    df = spark.createDataFrame(lines, "l_suppkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string")
    df.selectExpr("*", "timestamp'2024-01-31 12:00:00' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    week, month = panel.supplier_week(spark, str(tmp_path)), panel.supplier_month(spark, str(tmp_path))
    partial = [x for x in week._jdf.queryExecution().executedPlan().toString().splitlines() if "partial_sum" in x]
    assert partial and all("keys=[l_suppkey#" in x and "as bigint)" in x for x in partial)
    for found, date in ((week, "20240129"), (month, "20240101")):
        for r in found.collect():
            own = [x for x in lines if str(x[0]) == r.entity]
            assert r.trade_date == date and r.rev == float(sum(Decimal(str(x[3])) for x in own)) and r.qty == sum(x[2] for x in own) and r.n_lines == 200


def test_panel_and_forward_return_take_one_exchange(spark, tmp_path, monkeypatch):
    """Sums and series share the exchange by entity, which carries combined lines; the same rows as before."""
    from panelforge.functions.scalar import fixed
    from panelforge.sources import panel

    rng = random.Random(6)
    lines = [(s, float(rng.randint(1, 50)), rng.randint(1, 10**9) / 100, rng.randint(0, 10) / 100, None if rng.random() < 0.02 else rng.randint(0, 8) / 100, "RNA"[rng.randrange(3)], 7 * rng.randrange(30)) for s in (None, 1, 2, 3) for _ in range(300)]
    df = spark.createDataFrame(lines, "l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, d int")
    df.selectExpr("*", "timestamp'2024-01-31 12:00:00' + make_interval(0, 0, 0, d) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = panel.with_forward_return(panel.supplier_week(spark, str(tmp_path)), "px", 5, "ahead").withColumn("ahead", fixed(F.col("ahead"), 6))
    for combined in (1, 70, 10**6):
        monkeypatch.setattr(panel, "COMBINED", combined)
        got = panel.supplier_week_ahead(spark, str(tmp_path), 5, "ahead")
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    shuffles = lambda x: x.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(got) == 1 and shuffles(want) == 2


def test_evaluation_writes_the_columns_it_needs(spark, monkeypatch):
    """Panel and predictions hold keys, score and labels; other columns only if the whole panel is there."""
    from panelforge.catalog import base, evaluation

    monkeypatch.setattr(base, "_PREPARED", {})
    monkeypatch.setattr(base, "_SHAPES", {})
    folder = "/root/testdata/sf0.001"
    narrow = sorted(map(repr, evaluation.predictions(spark, folder).collect()))
    made = {key[-1]: spark.read.parquet(path).columns for key, path in base._PREPARED.items()}
    assert made["panel disc"] == ["entity", "trade_date", "disc", "future_ret"] and len(made) == 2
    base._PREPARED.clear()
    assert len(base.main_panel(spark, folder).columns) == 10
    assert sorted(map(repr, evaluation.predictions(spark, folder).collect())) == narrow and len(base._PREPARED) == 2


def test_gap_of_selected_rows_moves_no_others(spark, monkeypatch):
    """Equal to the daily table of all labelled rows; of the panel nothing is dealt by date or written beside it."""
    from panelforge.catalog import base, evaluation
    from panelforge.operators import evaluate as ev

    monkeypatch.setattr(base, "_PREPARED", {})
    monkeypatch.setattr(base, "_SHAPES", {})
    folder = "/root/testdata/sf0.001"
    gap = base.QUERIES["validation_test_gap"](spark, folder).collect()
    assert len(gap) == 5 and [key[-1] for key in base._PREPARED] == ["panel disc"]
    rng = random.Random(3)
    value = lambda digits: None if rng.random() < 0.15 else round(rng.gauss(0, 1), digits)
    rows = [(f"e{e}", f"202401{d:02d}", value(0), value(1)) for d in range(1, 9) for e in range(rng.choice((3, 40, 200)))]
    pred = spark.createDataFrame([*rows, ("e1", "20240109", 1.0, None)], "entity string, trade_date string, score double, y double").repartition(5)
    names = ["trade_date", "topk_return", "universe_return", "topk_excess", "topk_mean_percentile", "precision", "ndcg", "turnover", "month", "year"]
    want = ev.daily_table(ev.scored_rows(labels.add_labels(pred, "y", 10, base.EDGES, widest=200), "y"), "y", 10, widest=200)
    got = ev.daily_top_table(pred, "y", 10, base.EDGES)
    a, b = (x.select(names).orderBy("trade_date").toPandas() for x in (got, want))
    assert len(a) == 8 and a["ndcg"].notna().any()
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-12, atol=1e-12)


def test_sweep_deals_a_date_once_whatever_the_combinations(spark, monkeypatch):
    """No row per combination is made for dates that fit a task, however many cells their scores have."""
    from panelforge.catalog import base, walk
    from panelforge.operators import daily, ranks

    folder, seen = "/root/testdata/sf0.001", []
    monkeypatch.setattr(walk.wf, "VECTOR_CELLS", 0, raising=False)
    monkeypatch.setattr(walk.wf, "average_rank", lambda df, *a, **k: seen.append(a) or ranks.average_rank(df, *a, **k))
    one = {tuple(r) for r in base.QUERIES["parameter_sweep"](spark, folder).collect()}
    assert len(one) == 48 and not seen
    # Dates beyond the group limit keep rows per combination and give the same.
    spark.conf.set("spark.panelforge.maxGroupRows", "3")
    try:
        two = {tuple(r) for r in base.QUERIES["parameter_sweep"](spark, folder).collect()}
    finally:
        spark.conf.unset("spark.panelforge.maxGroupRows")
    assert seen and one == two

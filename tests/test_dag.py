"""Expression graphs against the compiled columns, and the search in both forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelforge.functions import expressions as ex
from panelforge.operators import dag
from panelforge.operators.calendar import measure
from panelforge.operators.daily import daily_statistics
from panelforge.operators.labels import add_labels
from panelforge.plans import search as sr

FEATURES = ("a", "b", "c")
TEMPORAL = ("delta_5", "mean_5", "std_20")


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(3)
    rows = []
    for d in range(60):
        date = f"2024{1 + d // 20:02d}{1 + d % 20:02d}"
        for i in range(25):
            f = [None if rng.random() < 0.08 else rng.choice([0.0, 1e-9, -2.5, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1e7)]) for _ in FEATURES]
            rows.append((f"e{i:02d}", date, None if rng.random() < 0.1 else (f[0] or 0.0) / 1e7 + rng.gauss(0, 1), *f))
    df = spark.createDataFrame(rows, "entity string, trade_date string, future_ret double, a double, b double, c double")
    return add_labels(df, k=4, edges=(0.5, 0.7, 0.9)).drop("target_position")


def population(n=60, seed=1):
    grammar = sr.Grammar(FEATURES, sr.SearchOptions(temporal=TEMPORAL), random.Random(seed))
    texts = list(dict.fromkeys(ex.to_text(grammar.draw()) for _ in range(n)))
    return {f"e{i}": t for i, t in enumerate([*texts, '"a"', '["div","a","b"]', '["min","a",["neg","c"]]'])}


def laid(panel, options=sr.SearchOptions(temporal=TEMPORAL)):
    pairs = [(op, f) for op in TEMPORAL for f in FEATURES]
    return sr.lay_by_dates(panel, FEATURES, pairs, options, measure(panel))


@pytest.mark.parametrize("kind", ["ndcg", "ic", "prerank"])
@pytest.mark.parametrize("cells", [dag.CELLS, 400])
def test_statistics_equal_those_of_compiled_columns(spark, panel, monkeypatch, kind, cells):
    monkeypatch.setattr(dag, "CELLS", cells)  # many lots per date
    named = population()
    table = laid(panel)
    key = lambda r: (r.factor, r.trade_date)
    got = {key(r): r for r in dag.population_statistics(table, named, kind, k=4, least=5, digits=9).collect()}
    wide = ex.evaluate_expressions(table.rows, named, keep=("target_rank", "relevance"), digits=9)
    want = {key(r): r for r in daily_statistics(wide, list(named), kind, k=4, least=5).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert (g.names, g.n) == (w.names, w.n), (k, named[k[0]])
        for c in ("total", "scatter", "pos", "neg"):
            a, b = g[c], w[c]
            assert (a is None) == (b is None), (k, c)
            assert a is None or a == pytest.approx(b, rel=1e-6, abs=1e-6), (k, c, named[k[0]])


def test_equal_parts_are_one_node():
    graph = dag.graph_of(['["add",["mul","a","b"],["neg",["mul","a","b"]]]', '["mul","a","b"]', '["mul","b","a"]', '["mean_5","a"]'])
    assert len(graph.nodes) == 7 and graph.columns() == ["a", "b", "mean_5__a"]
    assert all(all(o < n for o in node[1]) for n, node in enumerate(graph.nodes) if node[0])
    for wrong in ('["pow","a","b"]', '["min","a","b","c"]', '["neg","a","b"]'):
        with pytest.raises(ValueError, match="unknown operator"):
            dag.graph_of([wrong])


def test_lots_cover_every_expression_once(monkeypatch):
    graph = dag.graph_of(list(population(200).values()))
    for cells in (1, 300, 2000, 10**9):
        monkeypatch.setattr(dag, "CELLS", cells)
        lots = list(graph.chunks(10))
        assert [f for f, _ in lots] == sorted({f for f, _ in lots}) and lots[0][0] == 0
        assert cells < 10**9 or len(lots) == 1
        for (first, nodes), nxt in zip(lots, [*[f for f, _ in lots[1:]], len(graph.roots)]):
            assert set(graph.below(graph.roots[first:nxt])) == set(nodes)


def test_rounding_is_half_away_from_zero():
    import numpy as np

    assert dag.rounded(np.array([0.25, -0.25, 1.04, -0.04, math.nan]), 1).tolist()[:4] == [0.3, -0.3, 1.0, 0.0]


def test_correlations_of_candidates_equal_the_whole_matrix(spark, panel):
    named = population(20, 5)
    table = laid(panel)
    names = list(named)
    now, before = {n: named[n] for n in names[:9]}, {n: named[n] for n in names[9:]}
    matrix = {(r.left, r.right): r for r in sr.rank_correlation_matrix(table.rows, named, digits=9, widest=25).collect()}
    found = dag.candidate_correlations(table, now, before, digits=9).collect()
    assert len(found) == 9 * len(names)
    for r in found:
        w = matrix[min((r.left, r.right), (r.right, r.left), key=lambda p: names.index(p[0]))]
        assert r.n == w.n and (r.correlation is None) == (w.correlation is None)
        assert r.correlation is None or r.correlation == pytest.approx(w.correlation, abs=1e-9)


@pytest.mark.parametrize("objective", ["top3_ndcg", "phase_ic", "contiguous_ic"])
def test_search_finds_the_same_library_in_both_forms(spark, panel, monkeypatch, objective):
    options = sr.SearchOptions(
        objective=objective, names_per_date=18, temporal=TEMPORAL, population=14, generations=3, elite=4, keep=12, library_size=4, k=4, min_valid=5, min_names=6, min_days=3,
        selection="tournament", crossover="symmetric_subtree", mutation="mixed", digits=9,
    )
    kept = ("name", "expression", "direction", "peak_month")
    graph = [tuple(r[c] for c in kept) + (round(r.score, 7),) for r in sr.search_factors(panel, FEATURES, options).collect()]
    monkeypatch.setattr(sr, "fits", lambda *a: False)
    columns = [tuple(r[c] for c in kept) + (round(r.score, 7),) for r in sr.search_factors(panel, FEATURES, options).collect()]
    assert graph == columns and graph


def test_series_operators_in_tasks_equal_the_windows(spark, panel):
    """Gaps, single rows, constant runs, huge values and batches that cut series."""
    from panelforge.operators.series import TEMPORAL as ALL, temporals_by_series, with_temporals

    rows = panel.select("entity", "trade_date", "a", F.when(F.hash("entity") % 3 == 0, 1e9 / 3).otherwise(F.col("b")).alias("b"))
    rows = rows.unionByName(spark.createDataFrame([("alone", "20240101", 1.0, None), (None, "20240101", 2.0, 1.0), (None, "20240102", 3.0, 2.0)], "entity string, trade_date string, a double, b double"))
    pairs = [(op, f) for op in ALL for f in ("a", "b")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = sorted(map(repr, temporals_by_series(rows, pairs).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(repr, with_temporals(rows, pairs).collect()))


def test_only_sampled_entities_take_part_in_the_windows(spark, panel):
    flagged = panel.withColumn("in_search", F.col("entity").isin("e01", "e07") & (F.col("trade_date") > "20240210"))
    kept = sr.sampled_histories(flagged)
    assert kept.count() == 120 and {r.entity for r in kept.select("entity").distinct().collect()} == {"e01", "e07"}


def test_leading_rows_equal_those_of_a_stable_sort():
    import numpy as np

    from panelforge.operators import daily

    rng = np.random.default_rng(2)
    for n in (1, 5, 30, 300):
        for x in (rng.normal(size=n), np.round(rng.normal(size=n)), np.where(rng.random(n) < 0.9, np.nan, rng.normal(size=n))):
            assert daily._leading(x, 10).tolist() == np.argsort(x, kind="stable")[:10].tolist()

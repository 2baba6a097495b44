"""Registered queries do the whole job: every date, the operators' own rounds and candidates."""

import pytest
from pyspark.sql import functions as F

from panelforge.catalog import base, models, quality
from panelforge.catalog.base import HORIZON, LOOKBACK, main_calendar
from panelforge.plans import models as md
from panelforge.plans import search as sr

FOLDER = "/root/testdata/sf0.001"


def test_walks_score_every_date_with_a_full_window(spark):
    result = models.run(spark, FOLDER, "tree", dict(depths=(1,), leaf_shares=(0.1,)), update=80)
    wanted = main_calendar(spark, FOLDER).where(F.col("position") >= HORIZON + LOOKBACK).select("trade_date")
    scored = result.predictions.where("score IS NOT NULL").select("trade_date").distinct()
    assert wanted.count() > 300 and wanted.exceptAll(scored).count() == 0


@pytest.mark.parametrize("name", [*models.RUNS, "feature_importance"])
def test_registered_walks_are_not_shortened(spark, monkeypatch, name):
    seen = {}

    def walk_forward(frame, factors, calendar, shape, **settings):
        seen.update(settings, dates=frame.select("trade_date").distinct().count())
        raise InterruptedError

    monkeypatch.setattr(models.gr, "walk_forward", walk_forward)
    with pytest.raises(InterruptedError):
        base.QUERIES[name](spark, FOLDER)
    calendar = main_calendar(spark, FOLDER).orderBy("trade_date").collect()
    assert (seen["start"], seen["end"]) == (calendar[HORIZON + LOOKBACK].trade_date, calendar[-1].trade_date)
    assert seen["update"] == 5 and seen["dates"] == len(calendar)
    options = seen["options"] or {}
    assert not {"rounds", "depths", "leaf_shares", "depth", "step"} & set(options)
    for key, value in options.get("settings", {}).items():
        assert key == "min_rows" or value == md.BOOST[key]
    assert len(options.get("candidates", md.BOOST_CANDIDATES)) == len(md.BOOST_CANDIDATES)


def test_registered_search_uses_the_default_effort(spark, monkeypatch):
    monkeypatch.setattr(quality.sr, "search_factors", lambda panel, features, options: (features, options))
    features, options = base.QUERIES["search_factors"](spark, FOLDER)
    own = sr.SearchOptions()
    for name in ("population", "generations", "elite", "keep", "library_size", "names_per_date", "months", "max_depth", "review"):
        assert getattr(options, name) == getattr(own, name), name
    assert set(options.temporal) == {"delta_5", "slope_5", "mean_5", "std_20", "zscore_20", "ts_rank_20"}
    assert features == base.FEATURES


@pytest.mark.parametrize("name, label", [("score_population_sampled", None), ("score_population_phase_ic", "future_ret")])
def test_sampled_populations_write_the_series_they_sample(spark, monkeypatch, name, label):
    """Of the whole panel they write keys and label, all columns for the sampled entities only."""
    monkeypatch.setattr(base, "_PREPARED", {})
    monkeypatch.setattr(base, "_SHAPES", {})
    base.QUERIES[name](spark, FOLDER).collect()
    tables = {key[2]: spark.read.parquet(path) for key, path in base._PREPARED.items()}
    assert sorted(tables) == ["panel ", f"sampled 20 7 40 {label}"]
    whole, sampled = tables["panel "], tables[f"sampled 20 7 40 {label}"]
    assert whole.columns == ["entity", "trade_date", base.LABEL]
    # Their rows equal those of the panel with all labels and the mask, in full.
    full = sr.search_mask(base.labelled_panel(spark, FOLDER), 20, 7, months=40, label=label).localCheckpoint()
    histories = sr.sampled_histories(full)
    keys = ["entity", "trade_date", "in_search", *base.FEATURES, base.LABEL]
    assert sampled.select(keys).exceptAll(histories.select(keys)).count() == 0 and sampled.count() == histories.count()
    kept = [*keys, "target_rank", "relevance"]
    taken = sampled.where("in_search").select(kept)
    assert taken.count() > 0 and taken.exceptAll(full.where("in_search").select(kept)).count() == 0

"""Lock-step trees against a plain booster that fits one refit after the other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators.calendar import measure, trading_calendar
from panelforge.operators.labels import add_labels
from panelforge.plans import grid as gr
from panelforge.plans import lockstep as ls
from panelforge.plans import models as md
from panelforge.plans.lambdarank import GAINS
from panelforge.sources.bydate import whole_dates

FACTORS = ["f1", "f2", "f3"]
HORIZON, LOOKBACK, VALIDATION, UPDATE = 2, 12, 4, 3
START, END = "20240118", "20240128"


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(11)
    rows = []
    for d in range(28):
        for i in range(12):
            f = [round(rng.random(), 3) for _ in FACTORS]
            rows.append((f"e{i:02d}", f"202401{1 + d:02d}", f[0] + 0.5 * f[1] * f[2] + 0.3 * rng.random() if rng.random() > 0.05 else None, *f))
    df = spark.createDataFrame(rows, "entity string, trade_date string, future_ret double, f1 double, f2 double, f3 double")
    return add_labels(df, k=3, edges=(0.5, 0.7, 0.9)).drop("target_position")


def walk(frame, model, options, half_life=0.0, **more):
    return gr.walk_forward(
        frame, FACTORS, trading_calendar(frame), measure(frame), model=model, start=START, end=END, horizon=HORIZON, lookback=LOOKBACK,
        validation=VALIDATION, update=UPDATE, half_life=half_life, k=3, options=options, **more,
    )


class Plain:
    """One model at a time, rows as Python tuples; every float as the walk defines it."""

    def __init__(self, kind, settings, half_life, weight=1.0, k=3):
        self.kind, self.s, self.half_life, self.weight, self.k = kind, settings, half_life, weight, k

    def weights(self, rows):
        newest = max(r["position"] for r in rows)
        return [
            (0.5 ** ((newest - r["position"]) / self.half_life) if self.half_life else 1.0) * (self.weight if self.kind == "classifier" and r["y"] > 0 else 1.0) for r in rows
        ]

    def whole(self, x):
        return int(np.rint(x * ls.SCALE))

    def value(self, g, h):
        g, h = g / ls.SCALE, h / ls.SCALE
        return math.copysign(max(abs(g) - self.s["l1"], 0.0), g) / (h + self.s["l2"]) if h + self.s["l2"] > 0 else 0.0

    def quality(self, g, h):
        g, h = g / ls.SCALE, h / ls.SCALE
        return max(abs(g) - self.s["l1"], 0.0) ** 2 / (h + self.s["l2"]) if h + self.s["l2"] > 0 else 0.0

    def start(self, rows):
        if self.kind == "ranker":
            return 0.0
        w = self.weights(rows)
        mean = (sum(self.whole(r["y"] * x) for r, x in zip(rows, w)) / ls.SCALE) / (sum(map(self.whole, w)) / ls.SCALE)
        return math.log(mean / (1 - mean)) if self.kind == "classifier" else mean

    def gradients(self, rows, scores):
        if self.kind == "ranker":
            out = [None] * len(rows)
            for date in {r["trade_date"] for r in rows}:
                at = sorted((i for i, r in enumerate(rows) if r["trade_date"] == date), key=lambda i: (-scores[i], rows[i]["entity"]))
                gain = [GAINS[int(rows[i]["y"])] for i in at]
                ideal = sum(g / math.log2(p + 2) for p, g in enumerate(sorted(gain, reverse=True)[: self.k]))
                g, h = [0.0] * len(at), [0.0] * len(at)
                for a in range(min(self.k, len(at))):
                    for b in range(a + 1, len(at)):
                        if gain[a] == gain[b] or not ideal:
                            continue
                        swap = abs((gain[a] - gain[b]) * (1 / math.log2(a + 2) - 1 / math.log2(b + 2))) / ideal
                        hi, lo = (a, b) if gain[a] > gain[b] else (b, a)
                        p = 1 / (1 + math.exp(scores[at[hi]] - scores[at[lo]]))
                        g[hi] += p * swap
                        g[lo] -= p * swap
                        for x in (a, b):
                            h[x] += p * (1 - p) * swap
                for p, i in enumerate(at):
                    out[i] = (g[p], h[p])
            return out
        if self.kind == "classifier":
            chance = [1 / (1 + math.exp(-s)) for s in scores]
            return [(r["y"] - p, p * (1 - p)) for r, p in zip(rows, chance)]
        return [(r["y"] - s, 1.0) for r, s in zip(rows, scores)]

    def loss(self, rows, scores):
        if self.kind == "classifier":
            return np.mean([math.log1p(math.exp(-s if r["y"] > 0 else s)) for r, s in zip(rows, scores)])
        if self.kind == "regression":
            return np.mean([abs(r["y"] - s) for r, s in zip(rows, scores)])
        found = []
        for date in {r["trade_date"] for r in rows}:
            at = sorted((i for i, r in enumerate(rows) if r["trade_date"] == date), key=lambda i: (-scores[i], rows[i]["entity"]))
            gain = [GAINS[int(rows[i]["y"])] for i in at]
            ideal = sum(g / math.log2(p + 2) for p, g in enumerate(sorted(gain, reverse=True)[: self.k]))
            if ideal:
                found.append(sum(g / math.log2(p + 2) for p, g in enumerate(gain[: self.k])) / ideal)
        return -np.mean(found)

    def tree(self, rows, scores):
        """{node: (feature, cut)} and {node: value}, grown leaf by leaf."""
        w = self.weights(rows)
        gh = [(self.whole(g * x), self.whole(h * x)) for (g, h), x in zip(self.gradients(rows, scores), w)]
        splits, values, waiting = {}, {}, {}

        def best(members):
            g, h = (sum(gh[i][j] for i in members) for j in (0, 1))
            found = None
            for f in range(len(FACTORS)):
                for cut in range(self.s["bins"] - 1):
                    left = [i for i in members if rows[i]["bins"][f] <= cut]
                    if min(len(left), len(members) - len(left)) < self.s["min_rows"]:
                        continue
                    lg, lh = (sum(gh[i][j] for i in left) for j in (0, 1))
                    gain = self.quality(lg, lh) + self.quality(g - lg, h - lh) - self.quality(g, h)
                    if gain > self.s["min_gain"] and (found is None or gain > found[0]):
                        found = (gain, f, cut)
            return found

        def opened(node, members):
            values[node] = self.value(*(sum(gh[i][j] for i in members) for j in (0, 1)))
            if math.floor(math.log2(node + 1)) < self.s["depth"] and (found := best(members)):
                waiting[node] = (found, members)

        opened(0, list(range(len(rows))))
        while waiting and len(splits) < self.s["leaves"] - 1:
            node = max(sorted(waiting), key=lambda n: waiting[n][0][0])
            (_, f, cut), members = waiting.pop(node)
            splits[node] = (f, cut)
            opened(2 * node + 1, [i for i in members if rows[i]["bins"][f] <= cut])
            opened(2 * node + 2, [i for i in members if rows[i]["bins"][f] > cut])
        return splits, values

    @staticmethod
    def leaf(tree, row):
        node = 0
        while node in tree[0]:
            f, cut = tree[0][node]
            node = 2 * node + 1 + (row["bins"][f] > cut)
        return tree[1][node]

    def grow(self, rows, rounds, watch=None):
        trees, scores, start = [], [self.start(rows)] * len(rows), self.start(rows)
        best, at = math.inf, 1
        for number in range(1, rounds + 1):
            trees.append(self.tree(rows, scores))
            scores = [s + self.s["step"] * self.leaf(trees[-1], r) for s, r in zip(scores, rows)]
            if watch:
                seen = [start + sum(self.s["step"] * self.leaf(t, r) for t in trees) for r in watch]
                loss = self.loss(watch, seen)
                if loss < best - 1e-12:
                    best, at = loss, number
                if number - at >= self.s["patience"]:
                    break
        return trees, start, at


def plain_walk(frame, kind, target, candidates, half_life, weight=1.0):
    bins = candidates[0]["bins"]
    dates = sorted({r.trade_date for r in frame.select("trade_date").distinct().collect()})
    rows = []
    for r in frame.orderBy("trade_date", "entity").collect():
        cells = [min(int(math.floor(round(r[f] * bins, 9))), bins - 1) for f in FACTORS]
        rows.append(dict(entity=r.entity, trade_date=r.trade_date, position=dates.index(r.trade_date), y=None if r[target] is None else float(r[target]), known=r.target_rank is not None, bins=cells))
    test, out = [d for d in dates if START <= d <= END], {}
    for n in range(0, len(test), UPDATE):
        end = dates.index(test[n]) - HORIZON
        window = dates[end - LOOKBACK : end]
        if end - LOOKBACK < 0:
            continue
        train = [r for r in rows if r["trade_date"] in window and r["known"]]
        older, newer = ([r for r in train if (r["trade_date"] in window[-VALIDATION:]) == x] for x in (False, True))
        options = []
        for c in candidates:
            model = Plain(kind, c, half_life, weight)
            trees, start, at = model.grow(older, c["max_iter"], newer)
            loss = model.loss(newer, [start + sum(c["step"] * model.leaf(t, r) for t in trees[:at]) for r in newer])
            options.append((loss, c["depth"], at, model))
        loss, _, at, model = min(options, key=lambda o: o[:3])
        trees, start, _ = model.grow(train, at)
        for r in rows:
            if r["trade_date"] in test[n : n + UPDATE]:
                s = start + sum(model.s["step"] * model.leaf(t, r) for t in trees)
                out[r["entity"], r["trade_date"]] = (1 / (1 + math.exp(-s)) if kind == "classifier" else s, test[n], at, loss)
    return out


BASE = {**md.BOOST, "max_iter": 9, "bins": 12, "min_rows": 6, "step": 0.3, "l2": 1.0, "row_share": 1.0, "feature_share": 1.0}


@pytest.mark.parametrize("kind, target, half_life, weight", [("regression", "target_rank", 0.0, 1.0), ("regression", "target_rank", 5.0, 1.0), ("classifier", "is_target_topk", 5.0, 50.0), ("ranker", "relevance", 5.0, 1.0)])
def test_walk_equals_a_plain_booster(spark, frame, monkeypatch, kind, target, half_life, weight):
    monkeypatch.setattr(ls, "FLUSH", 4)
    monkeypatch.setattr(ls, "SLOTS", 8)  # several waves
    candidates = [dict(depth=2, leaves=4, min_rows=9), dict(depth=3, leaves=6, min_rows=6)] if kind == "regression" and not half_life else [{}]
    if kind == "ranker":
        options = dict(rounds=9, bins=12, min_rows=6, step=0.3, l2=1.0, row_share=1.0, feature_share=1.0, patience=3)
    else:
        options = dict(settings=BASE, patience=3)
    model = {"regression": "regression", "classifier": "classifier", "ranker": "lambdarank"}[kind]
    if len(candidates) > 1:
        options["candidates"] = candidates
    result = walk(frame, model, options, half_life)
    want = plain_walk(frame, kind, target, [{**BASE, **c, "patience": 3} for c in candidates], half_life, weight)
    got = {(r.entity, r.trade_date): r for r in result.predictions.collect()}
    assert set(got) == set(want) and len(got) == 12 * 11
    for key, (score, head, at, loss) in want.items():
        assert got[key].rebalance_date == head and got[key].score == pytest.approx(score, abs=1e-7), key
    records = {r["rebalance_date"]: r for r in result.records}
    for _, head, at, loss in want.values():
        assert records[head]["best_iteration"] == at
        assert abs(records[head]["validation_metric"]) == pytest.approx(abs(loss), abs=1e-6)


def test_trees_do_not_depend_on_partitions(spark, frame):
    options = dict(settings={**BASE, "row_share": 0.7, "feature_share": 0.67}, patience=3)
    rows = lambda r: sorted(tuple(x) for x in r.models.table.select("rebalance_date", "tree", "node", "feature", "cut", "value", "rows").collect())
    one = rows(walk(frame, "regression", options))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows(walk(frame.repartition(9), "regression", options)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert any(r[3] >= 0 for r in one)


@pytest.mark.parametrize("model", ["regression", "classifier", "lambdarank"])
def test_windows_in_tasks_grow_the_lockstep_trees(spark, frame, monkeypatch, model):
    """Equal trees, records and scores from both forms; the first needs no job per level of a tree."""
    ranker = dict(rounds=9, bins=12, min_rows=6, step=0.3, l2=1.0, row_share=0.7, feature_share=0.67, patience=3)
    options = ranker if model == "lambdarank" else dict(settings={**BASE, "row_share": 0.7, "feature_share": 0.67}, patience=3)

    def found():
        result = walk(frame, model, options, 5.0)
        trees = result.models.table.select("rebalance_date", "tree", "node", "feature", "cut", "value", "gain", "rows").collect()
        # Shares of gain and errors of the constant are sums in any order.
        records = [{**r, "top_features": {f: round(x, 9) for f, x in r["top_features"].items()}, "validation_baseline_mae": None} for r in result.records]
        return sorted(map(tuple, trees)), records, sorted(map(tuple, result.predictions.collect()))

    def never(*args, **changes):
        raise AssertionError("a job per level")

    with monkeypatch.context() as m:
        m.setattr(ls.Grower, "collect", never)
        one = found()
    monkeypatch.setattr(ls, "WINDOW_ROWS", 0)
    assert found() == one


def test_first_generation_ranker(spark, frame):
    """Decile relevance, two candidates, quality over the whole list, windows that need not be full."""
    from panelforge.plans.lambdarank import DECILE_GAINS

    options = dict(
        relevance="decile", gains=DECILE_GAINS, eval_at=500, candidates=({"depth": 2, "leaves": 4, "min_rows": 9}, {"depth": 3, "leaves": 7, "min_rows": 6}),
        rounds=4, step=0.3, l2=1.0,
    )
    result = walk(frame, "lambdarank", options)
    assert {r["validation_metric_name"] for r in result.records} == {"ndcg@500"}
    assert all(0 < r["validation_metric"] <= 1 and r["max_depth"] in (2, 3) for r in result.records)
    early = gr.walk_forward(
        frame, FACTORS, trading_calendar(frame), measure(frame), model="regression", start="20240109", end="20240111", horizon=HORIZON, lookback=LOOKBACK,
        validation=VALIDATION, update=UPDATE, k=3, require_full=False, options=dict(settings=BASE),
    )
    assert early.predictions.count() == 36 and early.records[0]["train_start"] == "20240101"


def test_wide_dates_take_the_sliced_form(spark, frame, monkeypatch):
    from panelforge.plans import lambdarank as lr

    monkeypatch.setattr(lr, "DATE_ROWS", 5)
    result = walk(frame, "lambdarank", dict(rounds=2, step=0.3, depth=2, min_rows=6, l2=1.0))
    assert result.predictions.where("score IS NOT NULL").count() == 132 and isinstance(result.models, dict)


def test_leafwise_limit_keeps_the_best_reachable_splits():
    trees = ls.Trees(1, 3)
    trees.feature[0], trees.gain[0] = 0, [9, 1, 5, 8, 2, 4, 3]
    ls.keep_best_splits(trees, np.array([0]), 5)
    # Root, its right side, both of that side's children: the left side's 8 waits behind a gain of 1.
    assert np.flatnonzero(trees.feature[0] >= 0).tolist() == [0, 2, 5, 6]


def test_dates_are_never_cut():
    import pyarrow as pa

    parts = [pa.RecordBatch.from_pydict({"position": p}) for p in ([3, 3], [3, 1, 1], [1], [], [2, 2, 5], [7])]
    found = [t.column("position").to_pylist() for t in whole_dates(iter(parts), "position")]
    assert [x for t in found for x in t] == [3, 3, 3, 1, 1, 1, 2, 2, 5, 7]
    for position in (1, 2, 3, 5, 7):
        assert sum(position in t for t in found) == 1


def test_windows_count_two_features_together_and_the_smaller_side_only(monkeypatch):
    """A round counts each row once per pair of features, and below a split at most half of the rows again."""
    rng, rows, rounds, depth = np.random.default_rng(3), 24_000, 4, 3
    position = np.repeat(np.arange(12), rows // 12)
    y, hashes = (rng.random(rows) > 0.7).astype("f8"), rng.integers(0, 2**63, rows).astype("u8")
    for features, weight in ((6, 50.0), (5, 1.0)):
        bins = rng.integers(0, 63, (features, rows)).astype("u1")
        bins[1] = bins[0] // 2
        objective = ls.Objective("classifier" if weight > 1 else "regression", "y", 10.0, weight)
        growth = ls.Growth(bins=63, step=0.1, row_share=0.8, feature_share=0.8, l2=1.0)
        found = []
        for joint in (0, 10**6):
            counted, plain = [0], np.bincount
            with monkeypatch.context() as m:
                m.setattr(ls, "JOINT", joint)
                m.setattr(ls.np, "bincount", lambda x, *a, **k: counted.__setitem__(0, counted[0] + len(x)) or plain(x, *a, **k))
                chosen, trees = ls.Refit(position, y, hashes, bins, objective, growth).boost(9, 11, [ls.Candidate(depth, 20, leaves=7)], rounds, 15)
            # Rounds of the older dates (9 of 12) and of the whole window; three sums, 0.8 of the rows drawn.
            grown, groups = rows * (rounds * 9 / 12 + chosen["trees"]), -(-features // 2) if joint == 0 else features
            assert counted[0] <= 1.02 * 0.8 * grown * 3 * groups * (1 + (depth - 1) / 2)
            found.append((chosen, [[getattr(t, c).tolist() for c in ("feature", "cut", "value", "gain", "rows")] for t in trees]))
        assert found[0] == found[1] and any(f >= 0 for t in found[0][1] for f in t[0][0])

"""Histogram trees of all walk-forward refits, grown level by level at the same time.

A row of the panel belongs to the windows of several refits. Instead of one chain of jobs per refit,
every job serves all of them: tasks read their rows once, look up the refits whose window holds a
row's date, and add up gradients per (refit, node, feature, bin); the sums are shuffled by refit and
each refit's best splits come back as a few numbers per node. A round of boosting takes as many jobs
as a tree has levels, however many refits, candidates and rows there are.

* Features are percentile ranks per date, so equal-width bins hold equal shares of a date and need
  no pass over the data. A row carries its bins as bytes.
* The model for the validation dates and the one for the whole window are variants of one refit and
  grow together; the second is cut at the round that the first one found best.
* Scores of the trees so far stand in the row table, one per (refit, variant), and are renewed every
  ``FLUSH`` rounds; the trees in between are applied on the fly. Tasks are functions of a written
  table and a few trees, so a lost executor costs its tasks only, and refits that have ended drop out.
* Gradients are rounded to multiples of 2**-24 and added as whole numbers: trees do not depend on
  partitions or on the order in which tasks finish.
* Trees are written as tables, never kept; the driver holds the trees of at most ``FLUSH`` rounds.
  What it collects is a few numbers per node and refit, as large as the calendar.
* Rows of very long windows carry a bounded number of scores: refits are dealt to waves.

The ranker compares the rows of a date, so a date must lie in one task; see ``plans.lambdarank`` for
dates beyond that.

Boosting hundreds of rounds this way costs a job per level, so windows of up to ``WINDOW_ROWS`` rows
are dealt out by refit instead: one shuffle brings a refit's dates, packed, to one task, which grows
all rounds of its models there. The sums are the same whole numbers, so both forms give the same trees.
There two features are counted at a time, by their joint bin, while a window has many more rows than joint
bins; below a split only the side of fewer rows is counted, the other one is what is left of the parent.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelforge.session import drop_table, materialize, small_table, table_at, work_folder
from panelforge.sources.bydate import each_date, whole_dates, write_whole

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = float(2**24)
# Rounds between two renewals of the row table, scores a row may carry, refits scored by one job.
FLUSH = 10
SLOTS = 128
SCORED_BLOCKS = 256
# Pairs of row and score that a task should hold.
PAIRS = 2_000_000
# Rows of a window that one task boosts by itself (about 80 bytes each), rows it adds up at a time.
WINDOW_ROWS = 12_000_000
PIECE = 1 << 16
# Rows per joint bin of two features from which they are counted together.
JOINT = 4
FIT, ALL = 0, 1


@dataclass(frozen=True)
class Candidate:
    """Limits of a tree. ``min_share`` is a share of the training rows, in place of ``min_rows``."""

    depth: int
    min_rows: int = 1
    min_share: float = 0.0
    leaves: int = 0


@dataclass(frozen=True)
class Objective:
    """What is fitted: ``regression``, ``classifier``, ``ranker`` or ``mean`` (a single tree of means)."""

    kind: str
    target: str
    half_life: float = 0.0
    positive_weight: float = 1.0
    # Ranker: pairs with a row among the first k, quality at eval_at, gain per relevance.
    k: int = 50
    eval_at: int = 50
    gains: tuple[float, ...] = ()


@dataclass(frozen=True)
class Growth:
    """Settings that all candidates share."""

    bins: int = 63
    step: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    min_gain: float = 0.0
    gain_per_row: bool = False
    row_share: float = 1.0
    feature_share: float = 1.0
    seed: int = 42


@dataclass
class Wave:
    """Refits grown together: positions of their windows and the state of their models.

    Model ``(block * candidates + candidate) * 2 + phase``.
    """

    first: np.ndarray
    last: np.ndarray
    validation: np.ndarray
    candidates: tuple[Candidate, ...]
    alive: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)

    def __post_init__(self):
        self.alive = np.ones(self.models, bool)
        self.start = np.zeros(self.models)

    @property
    def variants(self) -> int:
        return 2 * len(self.candidates)

    @property
    def models(self) -> int:
        return len(self.first) * self.variants

    def held(self) -> tuple[int, np.ndarray, np.ndarray]:
        """(lowest position, first block, last block) by position; blocks are in order of date."""
        low, high = int(self.first.min()), int(self.last.max())
        at = np.arange(low, high + 1)
        return low, np.searchsorted(self.last, at), np.searchsorted(self.first, at, "right") - 1


class Trees:
    """Trees of all models as arrays: nodes in level order, feature -1 where a tree ends."""

    def __init__(self, models: int, depth: int):
        inner, nodes = 2**depth - 1, 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature = np.full((models, inner), -1, "i2")
        self.cut = np.zeros((models, inner), "u1")
        self.value = np.zeros((models, nodes))
        self.gain = np.zeros((models, inner))
        self.rows = np.zeros((models, nodes), "i8")

    def leaf(self, model: np.ndarray, bins: np.ndarray, row: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Node in which each (row, model) ends."""
        node, inner = np.zeros(len(row), "i8"), self.feature.shape[1]
        feature, cut = self.feature.ravel(), self.cut.ravel()
        for level in range(self.depth if depth is None else depth):
            at = model * inner + np.minimum(node, inner - 1)
            f = feature[at]
            # A row that ended above this level stays where it is.
            on = (f >= 0) & (node >= 2**level - 1)
            node = np.where(on, 2 * node + 1 + (bins[row, f] > cut[at]), node)
        return node


def mixed(rows: np.ndarray, number: int) -> np.ndarray:
    """Uniform numbers in [0, 1) by row hash and number."""
    x = rows ^ np.uint64((number * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(2**53)


def drawn_rows(rows: np.ndarray, number: int, share: float) -> np.ndarray:
    """``mixed(rows, number) < share`` without the numbers themselves."""
    x = rows ^ np.uint64((number * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    return x < np.uint64(math.ceil(share * 2**53))


def allowed_features(growth: Growth, features: int, number: int) -> np.ndarray:
    """Feature numbers that the tree of this round may use, the same for all refits."""
    take = max(1, int(features * growth.feature_share + 0.5))
    order = np.argsort(mixed(np.arange(features, dtype="u8"), growth.seed * 1_000_003 + number + 7), kind="stable")
    return np.sort(order[:take])


# --- tasks -------------------------------------------------------------------------------


class Rows:
    """Rows of one batch with their refits: one pair per (row, refit)."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, wave: Wave, features: int):
        get = lambda c: batch.column(c)
        self.position = get("position").to_numpy()
        self.y = get("y").to_numpy()
        self.hash = get("hash").to_numpy().view("u8")
        self.bins = np.frombuffer(b"".join(get("bins").to_pylist()), "u1").reshape(len(self.y), features)
        low, first, last = wave.held()
        a, b = first[self.position - low], last[self.position - low]
        self.count = np.maximum(b - a + 1, 0)
        self.row = np.repeat(np.arange(len(self.y)), self.count)
        self.block = np.arange(len(self.row)) - np.repeat(np.cumsum(self.count) - self.count - a, self.count)
        scores = get("scores")
        if scores.null_count == len(self.y):  # before the first renewal every score is the model's start
            self.score = wave.start.reshape(-1, wave.variants)[self.block]
        else:
            self.score = np.frombuffer(b"".join(scores.to_pylist()), "f8").reshape(-1, wave.variants).copy()
        self.at = self.position[self.row]

    def advance(self, wave: Wave, recent: Sequence[Trees], step: float) -> None:
        """Adds the trees that the row table does not hold yet."""
        for trees in recent:
            nodes = trees.value.shape[1]
            for v in range(wave.variants):
                model = self.block * wave.variants + v
                some = np.flatnonzero(wave.alive[model])
                m = model[some]
                self.score[some, v] += step * trees.value.ravel()[m * nodes + trees.leaf(m, self.bins, self.row[some])]

    def weights(self, wave: Wave, phase: int, objective: Objective, some: np.ndarray) -> np.ndarray | None:
        weight = None
        if objective.half_life:
            newest = (wave.validation - 1 if phase == FIT else wave.last)[self.block[some]]
            weight = 0.5 ** ((newest - self.at[some]) / objective.half_life)
        if objective.positive_weight != 1.0:
            factor = np.where(self.y[self.row[some]] > 0, objective.positive_weight, 1.0)
            weight = factor if weight is None else weight * factor
        return weight


def gradients(y, score, objective: Objective):
    """(gradient, curvature) of rows of weight one; curvature None is one."""
    if objective.kind == "classifier":
        p = 1.0 / (1.0 + np.exp(-score))
        return y - p, p * (1.0 - p)
    return y - score, None


def losses(y, score, objective: Objective):
    if objective.kind == "classifier":
        return np.logaddexp(0.0, np.where(y > 0, -score, score))
    return np.abs(y - score)


def ideal_dcg(gain: np.ndarray, k: int) -> float:
    best = np.sort(gain)[::-1][:k]
    return float((best / np.log2(np.arange(2, len(best) + 2))).sum())


def rank_gradients(relevance: np.ndarray, scores: np.ndarray, objective: Objective) -> tuple[np.ndarray, np.ndarray]:
    """Ranking gradient and curvature of one date for each column of ``scores``; ties keep row order."""
    gain = np.asarray(objective.gains)[relevance]
    ideal = ideal_dcg(gain, objective.k)
    g, h = np.zeros(scores.shape), np.zeros(scores.shape)
    if not ideal:
        return g, h
    order = np.argsort(-scores, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(gain))[:, None], order.shape), 0)
    discount = 1.0 / np.log2(rank + 2.0)
    for slot in range(min(objective.k, len(gain))):
        top = order[slot]  # one row per column
        better = gain[top][None, :] - gain[:, None]  # of the top row over each row
        swap = np.abs(better * (1.0 / math.log2(slot + 2) - discount)) / ideal
        # Pairs of two top rows are met once, at the higher of the two.
        swap[rank <= slot] = 0.0
        ahead = np.sign(better) * (np.take_along_axis(scores, top[None, :], 0) - scores)
        wrong = 1.0 / (1.0 + np.exp(ahead))
        push, bend = np.sign(better) * wrong * swap, wrong * (1.0 - wrong) * swap
        g -= push
        h += bend
        columns = np.arange(scores.shape[1])
        g[top, columns] += push.sum(0)
        h[top, columns] += bend.sum(0)
    return g, h


def rank_quality(relevance: np.ndarray, scores: np.ndarray, objective: Objective) -> np.ndarray | None:
    """NDCG of one date for each column, None when no row has a gain."""
    gain = np.asarray(objective.gains)[relevance]
    ideal = ideal_dcg(gain, objective.eval_at)
    if not ideal:
        return None
    best = np.argsort(-scores, axis=0, kind="stable")[: objective.eval_at]
    return (gain[best] / np.log2(np.arange(2, len(best) + 2))[:, None]).sum(0) / ideal


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * SCALE)


class Task:
    """Sums of one task: histograms and losses per model."""

    def __init__(self, wave: Wave, objective: Objective, growth: Growth, features: int, recent, current: Trees | None, number: int, level: int):
        self.wave, self.objective, self.growth, self.features = wave, objective, growth, features
        self.recent, self.current, self.number, self.level = recent, current, number, level
        self.histograms: dict[int, np.ndarray] = {}
        self.loss: dict[int, np.ndarray] = {}

    def add(self, batch) -> None:
        rows = Rows(batch, self.wave, self.features)
        rows.advance(self.wave, self.recent, self.growth.step)
        ranking = self._ranking(rows) if self.objective.kind == "ranker" else None
        if self.level == 0 and self.objective.kind != "mean":
            self._losses(rows)
        if self.current is None:
            return
        drawn = None if self.growth.row_share >= 1 else mixed(rows.hash, self.growth.seed * 1_000_003 + self.number) < self.growth.row_share
        for v in range(self.wave.variants):
            if self.level < self.wave.candidates[v // 2].depth:
                self._variant(rows, v, drawn, ranking)

    def _ranking(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of all pairs, date by date, and the quality of validation dates."""
        g, h = np.zeros(rows.score.shape), np.zeros(rows.score.shape)
        starts = np.flatnonzero(np.concatenate(([True], rows.position[1:] != rows.position[:-1])))
        pair = 0
        for a, b in zip(starts, np.append(starts[1:], len(rows.position))):
            held = int(rows.count[a])
            if not held:
                continue
            part = slice(pair, pair + held * (b - a))
            pair = part.stop
            scores = rows.score[part].reshape(b - a, -1)
            relevance = rows.y[a:b].astype("i8")
            if self.current is not None:
                one, two = rank_gradients(relevance, scores, self.objective)
                g[part], h[part] = one.reshape(-1, self.wave.variants), two.reshape(-1, self.wave.variants)
            if self.level == 0:
                quality = rank_quality(relevance, scores, self.objective)
                blocks = rows.block[part][:held]
                for i, block in enumerate(blocks.tolist()):
                    for v in range(FIT, self.wave.variants, 2):
                        model = block * self.wave.variants + v
                        if quality is not None and self.wave.alive[model] and rows.position[a] >= self.wave.validation[block]:
                            self._count(model, round(-quality[i * self.wave.variants + v] * SCALE), 1)
        return g, h

    def _count(self, model: int, loss: int, n: int) -> None:
        found = self.loss.setdefault(model, np.zeros(2, "i8"))
        found += (loss, n)

    def _losses(self, rows: Rows) -> None:
        if self.objective.kind == "ranker":
            return
        for v in range(FIT, self.wave.variants, 2):
            model = rows.block * self.wave.variants + v
            some = np.flatnonzero(self.wave.alive[model] & (rows.at >= self.wave.validation[rows.block]))
            loss = _whole(losses(rows.y[rows.row[some]], rows.score[some, v], self.objective))
            low = int(rows.block.min()) if len(rows.block) else 0
            block = rows.block[some] - low
            total, n = np.bincount(block, loss), np.bincount(block)
            for i in np.flatnonzero(n).tolist():
                self._count((low + i) * self.wave.variants + v, int(total[i]), int(n[i]))

    def _variant(self, rows: Rows, v: int, drawn, ranking) -> None:
        wave, B, width = self.wave, self.growth.bins, 2**self.level
        model = rows.block * wave.variants + v
        use = wave.alive[model]
        if v % 2 == FIT:
            use = use & (rows.at < wave.validation[rows.block])
        if drawn is not None:
            use = use & drawn[rows.row]
        some = np.flatnonzero(use)
        if not len(some):
            return
        node = np.zeros(len(some), "i8")
        if self.level:
            node = self.current.leaf(model[some], rows.bins, rows.row[some], self.level) - (width - 1)
            some, node = some[node >= 0], node[node >= 0]
            if not len(some):
                return
        if ranking is not None:
            g, h = ranking[0][some, v], ranking[1][some, v]
        else:
            g, h = gradients(rows.y[rows.row[some]], rows.score[some, v], self.objective)
        weight = rows.weights(wave, v % 2, self.objective, some)
        if weight is not None:
            g, h = g * weight, weight if h is None else h * weight
        g, h = _whole(g), None if h is None else _whole(h)
        block = rows.block[some]
        low, high = int(block.min()), int(block.max())
        base = ((block - low) * width + node) * B
        cells = (high - low + 1) * width * B
        out = np.empty((high - low + 1, width, self.features, B, 3), "i8")
        for f in range(self.features):
            key = base + rows.bins[rows.row[some], f]
            n = np.bincount(key, minlength=cells)
            out[:, :, f, :, 0] = np.bincount(key, g, cells).reshape(-1, width, B)
            out[:, :, f, :, 1] = (n * int(SCALE) if h is None else np.bincount(key, h, cells)).reshape(-1, width, B)
            out[:, :, f, :, 2] = n.reshape(-1, width, B)
        for i in np.flatnonzero(out[:, :, 0, :, 2].any((1, 2))).tolist():
            m = (low + i) * wave.variants + v
            self.histograms[m] = self.histograms[m] + out[i] if m in self.histograms else out[i]

    def result(self) -> Iterator[pa.RecordBatch]:
        models = sorted({*self.histograms, *self.loss})
        for m in models:
            found = self.histograms.get(m)
            loss, n = self.loss.get(m, (0, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([m], pa.int32()), pa.array([None if found is None else found.tobytes()], pa.binary()), pa.array([int(loss)], pa.int64()), pa.array([int(n)], pa.int64())],
                names=["model", "sums", "loss", "n"],
            )


SUMS = "model int, sums binary, loss bigint, n bigint"
SPLITS = "model int, node int, feature int, cut int, gain double, value double, left double, right double, rows bigint, left_rows bigint, loss bigint, n bigint"
SPLIT_NAMES = [c.split()[0] for c in SPLITS.split(", ")]


def leaf_value(g, h, growth: Growth):
    shrunk = np.sign(g) * np.maximum(np.abs(g) - growth.l1, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h + growth.l2 > 0, shrunk / (h + growth.l2), 0.0)


def quality_of(g, h, growth: Growth):
    shrunk = np.maximum(np.abs(g) - growth.l1, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h + growth.l2 > 0, shrunk * shrunk / (h + growth.l2), 0.0)


def best_splits(sums: np.ndarray, growth: Growth, least: int, allowed: np.ndarray) -> list[tuple]:
    """(feature, cut, gain, value, left, right, rows, left rows) per node; feature -1 without a split.

    ``sums``: node x feature x bin x (gradient, curvature, rows). Ties go to the first feature and bin.
    """
    out, below = [], np.cumsum(sums, axis=2)
    for node in range(len(sums)):
        g, h, n = (below[node, 0, -1, i] for i in range(3))
        total_g, total_h = g / SCALE, h / SCALE
        left_g, left_h, left_n = (below[node][allowed][:, :-1, i] for i in range(3))
        right_g, right_h = (g - left_g) / SCALE, (h - left_h) / SCALE
        left_g, left_h = left_g / SCALE, left_h / SCALE
        gain = quality_of(left_g, left_h, growth) + quality_of(right_g, right_h, growth) - quality_of(total_g, total_h, growth)
        fits = (left_n >= max(1, least)) & (n - left_n >= max(1, least))
        gain = np.where(fits, gain, -np.inf)
        f, c = divmod(int(np.argmax(gain)), gain.shape[1]) if gain.size else (0, 0)
        best = gain[f, c] if gain.size else -np.inf
        value = float(leaf_value(total_g, total_h, growth))
        if not best > growth.min_gain * (float(n) if growth.gain_per_row else 1.0):
            out.append((-1, 0, 0.0, value, 0.0, 0.0, int(n), 0))
            continue
        sides = (float(leaf_value(left_g[f, c], left_h[f, c], growth)), float(leaf_value(right_g[f, c], right_h[f, c], growth)))
        out.append((int(allowed[f]), c, float(best), value, *sides, int(n), int(left_n[f, c])))
    return out


# --- driver ------------------------------------------------------------------------------


class Grower:
    """Runs the jobs of one wave over its row table."""

    def __init__(self, state: DataFrame, wave: Wave, objective: Objective, growth: Growth, features: int):
        self.state, self.wave, self.objective, self.growth, self.features = state, wave, objective, growth, features
        self.path: str | None = None
        self.recent: list[Trees] = []
        self.depth = max(c.depth for c in wave.candidates)
        self.least: np.ndarray | None = None
        spark = state.sparkSession
        self.tasks = max(1, min(spark.sparkContext.defaultParallelism, wave.models // 32))

    def _task(self, current, number, level, **changes):
        wave, objective, growth, features, recent = self.wave, changes.get("objective", self.objective), self.growth, self.features, list(self.recent)
        by_date = objective.kind == "ranker"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = Task(wave, objective, growth, features, recent, current, number, level)
            for part in whole_dates(batches, "position") if by_date else batches:
                if part.num_rows:
                    task.add(part)
            yield from task.result()

        return run

    def collect(self, current: Trees | None, number: int, level: int, **changes) -> dict[str, np.ndarray]:
        """One job: histograms of a level over all rows, best splits per model, losses."""
        growth, width, features = self.growth, 2**level, self.features
        allowed, least, candidates = allowed_features(growth, features, number), self.least, self.wave.candidates
        partial = self.state.mapInArrow(self._task(current, number, level, **changes), SUMS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            loss: dict[int, np.ndarray] = {}
            for batch in batches:
                for m, found, x, n in zip(*(c.to_pylist() for c in batch.columns)):
                    loss[m] = loss.get(m, 0) + np.array([x, n], "i8")
                    if found is not None:
                        part = np.frombuffer(found, "i8").reshape(width, features, growth.bins, 3)
                        sums[m] = sums[m] + part if m in sums else part
            rows = []
            for m in loss:
                candidate = candidates[m // 2 % len(candidates)]
                if m not in sums:
                    rows.append((m, -1, -1, 0, 0.0, 0.0, 0.0, 0.0, 0, 0, *loss[m].tolist()))
                    continue
                n = int(sums[m][0, 0, :, 2].sum()) if level == 0 else 0
                floor = int(least[m]) if least is not None else max(1, math.ceil(n * candidate.min_share)) if candidate.min_share else candidate.min_rows
                for i, split in enumerate(best_splits(sums[m], growth, floor, allowed)):
                    rows.append((m, width - 1 + i, *split, *loss[m].tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SPLIT_TYPES)], names=SPLIT_NAMES)

        found = partial.repartition(self.tasks, "model").mapInArrow(run, SPLITS).toArrow()
        return {c: found.column(c).to_numpy() for c in SPLIT_NAMES}

    def losses(self, found: dict[str, np.ndarray]) -> dict[int, float]:
        """Mean loss per fit model."""
        some = found["n"] > 0
        return dict(zip(found["model"][some].tolist(), (found["loss"][some] / SCALE / found["n"][some]).tolist()))

    def prepare(self) -> None:
        """Starting scores: the weighted mean of a model's training rows, as log odds for a classifier."""
        if self.objective.kind not in ("regression", "classifier"):
            return
        growth, self.growth = self.growth, Growth(bins=self.growth.bins)
        mean = Objective("mean", self.objective.target, self.objective.half_life, self.objective.positive_weight)
        found = self.collect(Trees(self.wave.models, 1), 0, 0, objective=mean)
        self.growth = growth
        root = found["node"] == 0
        value = found["value"][root]
        if self.objective.kind == "classifier":
            share = np.clip(value, 1e-9, 1 - 1e-9)
            value = np.log(share / (1 - share))
        self.wave.start[found["model"][root]] = value

    def tree(self, number: int) -> tuple[Trees, dict[int, float]]:
        """Grows the tree of one round for all models; returns it and the losses before it."""
        current, lost = Trees(self.wave.models, self.depth), {}
        for level in range(self.depth):
            found = self.collect(current, number, level)
            if level == 0:
                lost = self.losses(found)
            some = np.flatnonzero(found["node"] >= 0)
            m, node = found["model"][some], found["node"][some]
            if level == 0:
                current.value[m, 0], current.rows[m, 0] = found["value"][some], found["rows"][some]
                if any(c.min_share for c in self.wave.candidates):
                    share = np.array([c.min_share for c in self.wave.candidates])[m // 2 % len(self.wave.candidates)]
                    self.least = np.zeros(self.wave.models, "i8")
                    self.least[m] = np.maximum(1, np.ceil(current.rows[m, 0] * share))
            split = found["feature"][some] >= 0
            some, m, node = some[split], m[split], node[split]
            current.feature[m, node], current.cut[m, node], current.gain[m, node] = found["feature"][some], found["cut"][some], found["gain"][some]
            for side, values in ((1, found["left"]), (2, found["right"])):
                current.value[m, 2 * node + side] = values[some]
            current.rows[m, 2 * node + 1] = found["left_rows"][some]
            current.rows[m, 2 * node + 2] = found["rows"][some] - found["left_rows"][some]
            if not len(some):
                break
        self.least = None
        for i, c in enumerate(self.wave.candidates):
            if c.leaves:
                models = np.flatnonzero(np.arange(self.wave.models) // 2 % len(self.wave.candidates) == i)
                keep_best_splits(current, models, c.leaves)
        return current, lost

    def flush(self) -> None:
        """Renews the row table: scores with the recent trees, rows of ended refits dropped."""
        wave, growth, features, recent = self.wave, self.growth, self.features, list(self.recent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = Rows(batch, wave, features)
                rows.advance(wave, recent, growth.step)
                ends = np.cumsum(rows.count)
                alive = wave.alive.reshape(-1, wave.variants).any(1)
                kept = np.bincount(rows.row, alive[rows.block], len(rows.y)) > 0
                flat = [rows.score[e - c : e].tobytes() for e, c in zip(ends.tolist(), rows.count.tolist())]
                names = [n for n in batch.schema.names if n != "scores"]
                renewed = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(flat, pa.binary())], names=[*names, "scores"])
                yield renewed.filter(pa.array(kept))

        order = [c for c in self.state.columns if c != "scores"] + ["scores"]
        renewed = self.state.select(*order).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in self.state.select(*order).dtypes))
        path = write_whole(renewed)
        self.state = table_at(renewed, path)
        drop_table(self.state.sparkSession, self.path)
        self.path, self.recent = path, []

    def close(self) -> None:
        drop_table(self.state.sparkSession, self.path)


SPLIT_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4, *[pa.int64()] * 4]


def keep_best_splits(trees: Trees, models: np.ndarray, leaves: int) -> None:
    """Leaf-wise growth to ``leaves`` leaves: splits in order of gain, each after its parent's."""
    inner = trees.feature.shape[1]
    gain = np.where(trees.feature[models] >= 0, trees.gain[models], -1.0)
    open_, kept = np.zeros((len(models), inner), bool), np.zeros((len(models), inner), bool)
    open_[:, 0] = True
    line = np.arange(len(models))
    for _ in range(leaves - 1):
        best = np.where(open_, gain, -1.0)
        node = best.argmax(1)
        go = best[line, node] >= 0
        i, node = line[go], node[go]
        kept[i, node], open_[i, node] = True, False
        for side in (1, 2):
            inside = 2 * node + side < inner
            open_[i[inside], (2 * node + side)[inside]] = True
    trees.feature[models] = np.where(kept, trees.feature[models], -1)


def plan_waves(blocks: Sequence, position: dict[str, int], candidates: Sequence[Candidate], slots: int = SLOTS) -> list[tuple[list, Wave]]:
    """Refits dealt to waves in which a row carries at most ``slots`` scores."""
    first, last, valid = (np.array([position[getattr(b, a)] for b in blocks]) for a in ("train_start", "train_end", "validation_start"))
    if not len(blocks):
        return []
    at = np.arange(first.min(), last.max() + 1)
    widest = int((np.searchsorted(first, at, "right") - np.searchsorted(last, at)).max())
    count = max(1, math.ceil(widest * 2 * len(candidates) / slots))
    waves = []
    for w in range(min(count, len(blocks))):
        part = slice(w, None, count)
        waves.append((list(blocks[part]), Wave(first[part], last[part], valid[part], tuple(candidates))))
    return waves


def row_table(frame: DataFrame, wave: Wave, objective: Objective) -> DataFrame:
    """Rows of the wave's windows, in order of date, without scores. Dates are never cut."""
    target, rows = F.col(objective.target).cast("double"), window_rows(frame, objective, wave)
    low, first, last = wave.held()
    widest = int((last - first + 1).max()) * wave.variants
    spark = frame.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() * widest / PAIRS))
    return (
        rows.select("position", "entity", target.alias("y"), F.xxhash64("entity", "trade_date").alias("hash"), "bins")
        .repartitionByRange(tasks, "position").sortWithinPartitions("position", "entity").drop("entity")
        .withColumn("scores", F.lit(None).cast("binary"))
    )


def packed_bins(frame: DataFrame, factors: Sequence[str], bins: int) -> DataFrame:
    """Replaces the factor columns by one column of bytes, a bin per factor; missing ranks are 0.5."""
    rest = [c for c in frame.columns if c not in factors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in factors], 1) if batch.num_rows else np.zeros((0, len(factors)))
            ranks = np.where(np.isnan(ranks), 0.5, ranks)
            cells = np.clip(np.floor(np.round(ranks * bins, 9)), 0, bins - 1).astype("u1")
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(factors)), len(cells), [None, pa.py_buffer(cells.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), packed], names=[*rest, "bins"])

    schema = ", ".join(f"`{c}` {t}" for c, t in frame.select(*rest).dtypes)
    doubles = [F.col(c).cast("double").alias(c) for c in factors]
    return frame.select(*rest, *doubles).mapInArrow(run, f"{schema}, bins binary")


class TreeModels:
    """Trees of every refit as a table, with what scoring needs.

    ``table``: rebalance_date, tree, node, feature (-1: a leaf), cut, value, gain, rows.
    ``blocks``: rebalance_date, test_end, start (score before the first tree).
    """

    def __init__(self, table: DataFrame, blocks: DataFrame, factors: Sequence[str], *, bins: int, step: float, link: str):
        self.table, self.blocks, self.factors = table, blocks, list(factors)
        self.bins, self.step, self.link = bins, step, link

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/trees")
        kept = self.blocks.select(
            "*", F.array(*[F.lit(f) for f in self.factors]).alias("factors"), F.lit(self.bins).alias("bins"), F.lit(self.step).alias("step"), F.lit(self.link).alias("link")
        )
        kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/blocks")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModels:
        blocks = spark.read.parquet(f"{path}/blocks")
        one = blocks.select("factors", "bins", "step", "link").first()
        return cls(
            spark.read.parquet(f"{path}/trees"), blocks.select("rebalance_date", "test_end", "start"), one.factors, bins=one.bins, step=one.step, link=one.link
        )

    def importance(self, top: int | None = None) -> DataFrame:
        """(rebalance_date, factor, importance, position): shares of the gain, largest first."""
        names = F.array(*[F.lit(f) for f in self.factors])
        gains = self.table.where("feature >= 0").groupBy("rebalance_date", "feature").agg(F.sum("gain").alias("gain"))
        grid = self.blocks.select("rebalance_date", F.explode(F.sequence(F.lit(0), F.lit(len(self.factors) - 1))).alias("feature"))
        of = Window.partitionBy("rebalance_date")
        share = F.coalesce(F.col("gain") / F.sum("gain").over(of), F.lit(0.0))
        rows = grid.join(gains, ["rebalance_date", "feature"], "left").select("rebalance_date", F.element_at(names, F.col("feature") + 1).alias("factor"), share.alias("importance"))
        rows = rows.withColumn("position", F.row_number().over(of.orderBy(F.desc("importance"), "factor")))
        return rows if top is None else rows.where(F.col("position") <= top)

    def score(self, frame: DataFrame) -> DataFrame:
        """Rows of test dates with rebalance_date and score; ``frame`` has the factors or ``bins``."""
        if "bins" not in frame.columns:
            frame = packed_bins(frame, self.factors, self.bins)
        blocks = self.blocks.orderBy("rebalance_date").collect()  # calendar-sized
        folder = f"{work_folder(frame.sparkSession)}/scores-{uuid.uuid4().hex}"
        for at in range(0, len(blocks), SCORED_BLOCKS):
            some = blocks[at : at + SCORED_BLOCKS]
            part = frame.where(F.col("trade_date").between(some[0].rebalance_date, max(b.test_end for b in some)))
            found = self.table.where(F.col("rebalance_date").between(some[0].rebalance_date, some[-1].rebalance_date)).toArrow()
            scored = part.mapInArrow(self._scorer(some, found), ", ".join(f"`{n}` {t}" for n, t in frame.drop("bins").dtypes) + ", rebalance_date string, score double")
            scored.write.parquet(f"{folder}/part={at}")
        return frame.sparkSession.read.schema(scored.schema).parquet(*[f"{folder}/part={at}" for at in range(0, len(blocks), SCORED_BLOCKS)])

    def _scorer(self, blocks, found: pa.Table):
        heads = [b.rebalance_date for b in blocks]
        ends, start = [b.test_end for b in blocks], np.array([b.start for b in blocks])
        get = lambda c: found.column(c).to_numpy()
        number = {h: i for i, h in enumerate(heads)}
        block = np.array([number[d] for d in found.column("rebalance_date").to_pylist()], "i8")
        rounds = int(get("tree").max()) + 1 if len(block) else 0
        nodes = int(get("node").max()) + 1 if len(block) else 1
        depth = math.ceil(math.log2(nodes + 1)) - 1
        size = 2 ** (depth + 1) - 1
        feature, cut, value = np.full((rounds, len(heads), size), -1, "i2"), np.zeros((rounds, len(heads), size), "u1"), np.zeros((rounds, len(heads), size))
        at = (get("tree"), block, get("node"))
        feature[at], cut[at], value[at] = get("feature"), get("cut"), get("value")
        step, link, width = self.step, self.link, len(self.factors)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import bisect

            for batch in batches:
                day = batch.column("trade_date").dictionary_encode()
                owner = [bisect.bisect_right(heads, d) - 1 for d in day.dictionary.to_pylist()]
                owner = np.array([b if b >= 0 and d <= ends[b] else -1 for b, d in zip(owner, day.dictionary.to_pylist())], "i8")
                b = owner[day.indices.to_numpy()] if batch.num_rows else np.zeros(0, "i8")
                kept = np.flatnonzero(b >= 0)
                batch, b = batch.take(pa.array(kept)), b[kept]
                bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), "u1").reshape(len(b), width)
                total, line = start[b].copy() if len(b) else np.zeros(0), np.arange(len(b))
                for t in range(rounds):
                    f, c, v, node = feature[t], cut[t], value[t], np.zeros(len(b), "i8")
                    for _ in range(depth):
                        at = f[b, node]
                        node = np.where(at >= 0, 2 * node + 1 + (bins[line, at] > c[b, node]), node)
                    total += step * v[b, node]
                if link == "logistic":
                    total = 1.0 / (1.0 + np.exp(-total))
                rest = [n for n in batch.schema.names if n != "bins"]
                head = pa.array([heads[i] for i in b.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), head, pa.array(total)], names=[*rest, "rebalance_date", "score"])

        return run


# --- rounds ------------------------------------------------------------------------------


class Watch:
    """Smallest loss of every model and the round that had it."""

    def __init__(self, models: int, patience: int):
        self.loss, self.round, self.patience = np.full(models, np.inf), np.ones(models, "i8"), patience

    def ended(self, model: int, number: int, loss: float) -> bool:
        """Takes the loss after ``number`` trees; true once ``patience`` trees brought no smaller one."""
        if loss < self.loss[model]:
            self.loss[model], self.round[model] = loss, number
        return number - self.round[model] >= self.patience


@dataclass
class Chosen:
    """What was found best for a refit."""

    block: object
    candidate: int
    trees: int
    loss: float
    start: float
    train_rows: int


def reached_nodes(trees: Trees, models: np.ndarray) -> tuple[np.ndarray, ...]:
    """(model, node, feature, cut, gain) of the nodes that rows can reach in some of the models."""
    inner = trees.feature.shape[1]
    reached = np.zeros(trees.value.shape, bool)
    reached[:, 0] = models
    for n in range(inner):
        reached[:, 2 * n + 1] = reached[:, 2 * n + 2] = reached[:, n] & (trees.feature[:, n] >= 0)
    model, node = np.nonzero(reached)
    inside, at = node < inner, np.minimum(node, inner - 1)
    feature = np.where(inside, trees.feature[model, at], -1)
    return model, node, feature, np.where(feature >= 0, trees.cut[model, at], 0), np.where(feature >= 0, trees.gain[model, at], 0.0)


def tree_rows(trees: Trees, blocks: Sequence, wave: Wave, number: int) -> dict[str, np.ndarray]:
    """The trees of the whole-window models as table columns."""
    model, node, feature, cut, gain = reached_nodes(trees, wave.alive & (np.arange(wave.models) % 2 == ALL))
    heads = np.array([b.rebalance_date for b in blocks], object)
    return dict(
        rebalance_date=heads[model // wave.variants], candidate=(model // 2 % len(wave.candidates)).astype("i4"), tree=np.full(len(model), number, "i4"),
        node=node.astype("i4"), feature=feature.astype("i4"), cut=cut.astype("i4"), value=trees.value[model, node], gain=gain, rows=trees.rows[model, node],
    )


def write_trees(spark: SparkSession, parts: Sequence[dict[str, np.ndarray]], folder: str) -> None:
    table = pa.table({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})
    spark.createDataFrame(table).write.mode("append").parquet(folder)


def date_positions(frame: DataFrame) -> dict[str, int]:
    """Calendar of the frame: one entry per date."""
    return {r.trade_date: r.position for r in frame.select("trade_date", "position").distinct().collect()}


# --- whole windows in a task --------------------------------------------------------------


class Refit:
    """The rows of one window in order of date; models are grown on its older dates or on all of it."""

    def __init__(self, position: np.ndarray, y: np.ndarray, hashes: np.ndarray, bins: np.ndarray, objective: Objective, growth: Growth):
        self.y, self.hash, self.objective, self.growth = y, hashes, objective, growth
        self.bins = bins  # feature x row
        # Features counted together, and their joint bins.
        step = 2 if len(y) > JOINT * growth.bins**2 and growth.bins < 256 else 1
        self.groups = [tuple(range(f, min(f + step, len(bins)))) for f in range(0, len(bins), step)]
        self.joint = [bins[g[0]] if len(g) == 1 else bins[g[0]] * np.uint16(growth.bins) + bins[g[1]] for g in self.groups]
        self.dates, self.starts = np.unique(position, return_index=True)
        self.starts = np.append(self.starts, len(y))

    def until(self, position: int) -> int:
        """Rows before a position."""
        return int(self.starts[np.searchsorted(self.dates, position)])

    def weights(self, rows: int, newest: int) -> np.ndarray | None:
        weight = None
        if self.objective.half_life:
            daily = 0.5 ** ((newest - self.dates) / self.objective.half_life)
            weight = np.repeat(daily, np.diff(self.starts))[:rows]
        if self.objective.positive_weight != 1.0:
            factor = np.where(self.y[:rows] > 0, self.objective.positive_weight, 1.0)
            weight = factor if weight is None else weight * factor
        return weight

    def start(self, rows: int, weight: np.ndarray | None) -> float:
        if self.objective.kind not in ("regression", "classifier") or not rows:
            return 0.0
        total = lambda x: sum(int(_whole(x[i : i + PIECE]).sum()) for i in range(0, rows, PIECE))
        y = self.y[:rows]
        g, h = (total(y), rows * int(SCALE)) if weight is None else (total(y * weight), total(weight))
        value = float(leaf_value(g / SCALE, h / SCALE, Growth()))
        if self.objective.kind == "classifier":
            share = np.clip(value, 1e-9, 1 - 1e-9)
            value = float(np.log(share / (1 - share)))
        return value

    def drawn(self, rows: int, number: int) -> np.ndarray | None:
        """Rows that the tree of a round uses; None for all."""
        if self.growth.row_share >= 1:
            return None
        key = self.growth.seed * 1_000_003 + number
        return np.concatenate([np.zeros(0, bool), *(drawn_rows(self.hash[i : min(i + PIECE, rows)], key, self.growth.row_share) for i in range(0, rows, PIECE))])

    def _by_date(self, first: int, last: int) -> Iterator[slice]:
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist()):
            if first <= a and b <= last:
                yield slice(a, b)

    def _gradients(self, rows: int, score: np.ndarray, weight: np.ndarray | None, some: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        ranks, n = None, rows if some is None else len(some)
        if self.objective.kind == "ranker":
            ranks = np.zeros((2, rows))
            for part in self._by_date(0, rows):
                one, two = rank_gradients(self.y[part].astype("i8"), score[part].reshape(-1, 1), self.objective)
                ranks[0, part], ranks[1, part] = one[:, 0], two[:, 0]
        g, h = np.empty(n), None if weight is None and self.objective.kind not in ("ranker", "classifier") else np.empty(n)
        for i in range(0, n, PIECE):
            part = slice(i, min(i + PIECE, n))
            at = part if some is None else some[part]
            one, two = gradients(self.y[at], score[at], self.objective) if ranks is None else (ranks[0, at], ranks[1, at])
            if weight is not None:
                w = weight[at]
                one, two = one * w, w if two is None else two * w
            g[part] = _whole(one)
            if h is not None:
                h[part] = _whole(two)
        return g, h

    def _histograms(self, joint, node: np.ndarray | None, slots: int, g, h, counted: Sequence[int]) -> np.ndarray:
        """slot x feature x bin x (gradient, curvature, rows); ``node`` is a row's slot, None for one slot."""
        B = self.growth.bins
        sums = np.zeros((slots, len(self.bins), B, 3), "i8")
        for features, keys in zip(self.groups, joint):
            if not set(features) & set(counted):
                continue
            size = B ** len(features)
            found = np.zeros((3, slots * size), "i8")
            for i in range(0, len(keys), PIECE):
                part = slice(i, i + PIECE)
                at = keys[part].astype("i8")
                if node is not None:
                    at += node[part] * np.int64(size)
                n = np.bincount(at, minlength=slots * size)
                found[0] += np.bincount(at, g[part], slots * size).astype("i8")
                found[1] += n * int(SCALE) if h is None else np.bincount(at, h[part], slots * size).astype("i8")
                found[2] += n
            found = found.reshape(3, slots, *[B] * len(features))
            for axis, f in enumerate(features):
                own = found if len(features) == 1 else found.sum(3 - axis)
                sums[:, f] = own.transpose(1, 2, 0)
        return sums

    def tree(self, number: int, rows: int, score: np.ndarray, weight: np.ndarray | None, candidate: Candidate) -> Trees:
        """The tree of one round on the first ``rows`` rows."""
        trees, growth = Trees(1, candidate.depth), self.growth
        drawn = self.drawn(rows, number)
        some = None if drawn is None else np.flatnonzero(drawn)
        taken = lambda x: x[:rows] if some is None else x.take(some)
        joint = [taken(x) for x in self.joint]
        g, h = self._gradients(rows, score, weight, some)
        allowed = allowed_features(growth, len(self.bins), number)
        # Totals are read from the first feature.
        counted = sorted({0, *allowed.tolist()})
        node, floor = np.zeros(len(g), "u1" if candidate.depth <= 8 else "i4"), candidate.min_rows
        for level in range(candidate.depth if len(g) else 0):
            width = 2**level
            if level == 0:
                sums = self._histograms(joint, None, 1, g, h, counted)
                if candidate.min_share:
                    floor = max(1, math.ceil(len(g) * candidate.min_share))
            else:
                # Of the two sides of a split the smaller one is counted; places here are within a level.
                split = np.flatnonzero(trees.feature[0, width // 2 - 1 : width - 1] >= 0)
                node = move(node, {f: taken(self.bins[f]) for f in split_features(trees, level - 1)}, trees, level - 1)
                n = trees.rows[0, width - 1 : 2 * width - 1]
                few = 2 * split + (n[2 * split + 1] < n[2 * split])
                slot = np.full(width, len(split), node.dtype)
                slot[few] = np.arange(len(split))
                at = np.concatenate([np.flatnonzero(_among(node[i : i + PIECE], few)) + i for i in range(0, len(node), PIECE)])
                own = self._histograms(
                    [x.take(at) for x in joint], None if len(few) == 1 else slot.take(node.take(at)), len(few), g.take(at), None if h is None else h.take(at), counted
                )
                whole, sums = sums, np.zeros((width, *sums.shape[1:]), "i8")
                sums[few] = own
                sums[few ^ 1] = whole[split] - own
            went = False
            for at, (feature, cut, gain, value, left, right, n, left_n) in enumerate(best_splits(sums, growth, floor, allowed), width - 1):
                if level == 0:
                    trees.value[0, 0], trees.rows[0, 0] = value, n
                if feature >= 0:
                    went = True
                    trees.feature[0, at], trees.cut[0, at], trees.gain[0, at] = feature, cut, gain
                    trees.value[0, 2 * at + 1 : 2 * at + 3] = left, right
                    trees.rows[0, 2 * at + 1 : 2 * at + 3] = left_n, n - left_n
            if not went:
                break
        if candidate.leaves:
            keep_best_splits(trees, np.array([0]), candidate.leaves)
        return trees

    def advance(self, score: np.ndarray, trees: Trees) -> None:
        """Adds a tree to the scores of the first rows."""
        # A row that ends above the last level goes on to the left there.
        ends = np.zeros(1, "i8")
        for level in range(trees.depth):
            on = (ends >= 2**level - 1) & (trees.feature[0, np.minimum(ends, trees.feature.shape[1] - 1)] >= 0)
            ends = np.stack([np.where(on, 2 * ends + 1, ends), np.where(on, 2 * ends + 2, ends)], 1).ravel()
        value = self.growth.step * trees.value[0, ends]
        used = sorted({f for level in range(trees.depth) for f in split_features(trees, level)})
        for i in range(0, len(score), PIECE):
            part = slice(i, min(i + PIECE, len(score)))
            bins = {f: self.bins[f, part] for f in used}
            node = np.zeros(part.stop - i, "u1" if trees.depth <= 8 else "i4")
            for level in range(trees.depth):
                node = move(node, bins, trees, level)
            score[part] += value.take(node)

    def loss(self, older: int, score: np.ndarray) -> float | None:
        """Mean loss of the rows (ranker: dates) behind ``older``; None without any."""
        total = n = 0
        if self.objective.kind == "ranker":
            for part in self._by_date(older, len(score)):
                quality = rank_quality(self.y[part].astype("i8"), score[part].reshape(-1, 1), self.objective)
                if quality is not None:
                    total, n = total + round(-quality[0] * SCALE), n + 1
        else:
            n = len(score) - older
            for i in range(older, len(score), PIECE):
                total += int(_whole(losses(self.y[i : i + PIECE], score[i : i + PIECE], self.objective)).sum())
        return total / SCALE / n if n else None

    def boost(self, validation: int, last: int, candidates: Sequence[Candidate], rounds: int, patience: int) -> tuple[dict, list[Trees]]:
        """What :func:`boost` chooses for the refit, and the trees of the whole window."""
        older, rows = self.until(validation), len(self.y)
        weight, tried = self.weights(older, validation - 1), []
        start = self.start(older, weight)
        for candidate in candidates:
            score, watch, grown = np.full(rows, start), Watch(1, patience), rounds
            for number in range(1, rounds + 1):
                self.advance(score, self.tree(number - 1, older, score, weight, candidate))
                loss = self.loss(older, score)
                if loss is not None and watch.ended(0, number, loss):
                    grown = min(number + 1, rounds)
                    break
            tried.append((float(watch.loss[0]), candidate.depth, int(watch.round[0]), len(tried), grown))
        loss, _, best, pick, grown = min(tried, key=lambda t: t[:3])
        weight, trees = self.weights(rows, last), []
        start = self.start(rows, weight)
        score = np.full(rows, start)
        for number in range(best):
            trees.append(self.tree(number, rows, score, weight, candidates[pick]))
            self.advance(score, trees[-1])
        used = [int(t.rows[0, 0]) for t in trees]
        # As in lock-step, the largest draw of all rounds until the refit's end.
        if self.growth.row_share < 1:
            used += [int(self.drawn(rows, number).sum()) for number in range(best, grown)]
        return dict(candidate=pick, trees=best, loss=loss if np.isfinite(loss) else None, start=start, train_rows=max(used, default=0)), trees


def split_features(trees: Trees, level: int) -> set[int]:
    """Features of the splits of a level."""
    return {f for f in trees.feature[0, 2**level - 1 : 2 ** (level + 1) - 1].tolist() if f >= 0}


def _among(node: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Rows in one of a few nodes."""
    out = node == few[0]
    for k in few[1:].tolist():
        out |= node == k
    return out


def move(node: np.ndarray, bins: dict[int, np.ndarray], trees: Trees, level: int) -> np.ndarray:
    """Places of rows in the next level, left where their node has no split; ``bins`` by feature."""
    right = None
    for k in range(2**level):
        f = int(trees.feature[0, 2**level - 1 + k])
        if f >= 0:
            side = bins[f] > trees.cut[0, 2**level - 1 + k]
            if level:
                side &= node == k
            right = side if right is None else np.logical_or(right, side, out=right)
    node = node + node
    if right is not None:
        node += right
    return node


BOOSTED = "block int, tree int, node int, feature int, cut int, value double, gain double, rows bigint, candidate int, trees int, loss double, start double, train_rows bigint"
BOOSTED_NAMES = [c.split()[0] for c in BOOSTED.split(", ")]
BOOSTED_TYPES = [*[pa.int32()] * 5, pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]


def window_rows(frame: DataFrame, objective: Objective, wave: Wave) -> DataFrame:
    """Rows that windows train on."""
    known = F.col("target_rank").isNotNull() & F.col(objective.target).isNotNull()
    return frame.where(known & F.col("position").between(int(wave.first.min()), int(wave.last.max())))


def boost_windows(
    frame: DataFrame, blocks: Sequence, wave: Wave, objective: Objective, growth: Growth, *, features: int, rounds: int, patience: int, rows: int
) -> tuple[list[Chosen], DataFrame]:
    """As :func:`boost` when every window fits a task: dates are packed, dealt to refits and boosted there."""
    spark = frame.sparkSession
    low, first, last = wave.held()
    bounds, candidates = list(zip(wave.validation.tolist(), wave.last.tolist())), wave.candidates

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for date in each_date(batches, "position"):
            position = date.column("position")[0].as_py()
            packed = [
                date.column("y").to_numpy().tobytes(), date.column("hash").to_numpy().tobytes(),
                np.frombuffer(b"".join(date.column("bins").to_pylist()), "u1").reshape(-1, features).T.tobytes(),
            ]
            for block in range(first[position - low], last[position - low] + 1):
                columns = [pa.array([block], pa.int32()), pa.array([position], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "position", "y", "hash", "bins"])

    def fit(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        table = table.sort_by("position")
        y, hashes = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)]) for c, t in (("y", "f8"), ("hash", "u8")))
        bins = np.concatenate([np.frombuffer(x.as_buffer(), "u1").reshape(features, -1) for x in table.column("bins")], axis=1)
        counts = [len(x.as_buffer()) // 8 for x in table.column("y")]
        position = np.repeat(table.column("position").to_numpy(), counts)
        del table
        found, trees = Refit(position, y, hashes, bins, objective, growth).boost(*bounds[block], candidates, rounds, patience)
        out = [(block, -1, *[None] * 6, *found.values())]
        for number, tree in enumerate(trees):
            _, node, feature, cut, gain = reached_nodes(tree, np.array([True]))
            out += [(block, number, n, f, c, v, g, r, *[None] * 5) for n, f, c, v, g, r in zip(node.tolist(), feature.tolist(), cut.tolist(), tree.value[0, node].tolist(), gain.tolist(), tree.rows[0, node].tolist())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), BOOSTED_TYPES)], names=BOOSTED_NAMES)

    tasks = max(1, spark.sparkContext.defaultParallelism, math.ceil(rows / PAIRS))
    dated = (
        window_rows(frame, objective, wave)
        .select("position", "entity", F.col(objective.target).cast("double").alias("y"), F.xxhash64("entity", "trade_date").alias("hash"), "bins")
        .repartitionByRange(tasks, "position").sortWithinPartitions("position", "entity").drop("entity")
        .mapInArrow(pack, "block int, position int, y binary, hash binary, bins binary")
    )
    # Several partitions a refit, so that few refits share a task; the number is set, so none are merged.
    grown = materialize(dated.repartition(4 * len(blocks), "block").groupBy("block").applyInArrow(fit, BOOSTED))
    chosen = [
        Chosen(blocks[r.block], r.candidate, r.trees, r.loss, r.start, r.train_rows)
        for r in grown.where("tree < 0").select("block", *BOOSTED_NAMES[8:]).collect()
    ]
    # A refit without any row to learn from has no group.
    seen = {c.block.rebalance_date for c in chosen}
    shallow = min(range(len(candidates)), key=lambda c: candidates[c].depth)
    bare = [i for i, b in enumerate(blocks) if b.rebalance_date not in seen]
    chosen += [Chosen(blocks[i], shallow, 1, None, 0.0, 0) for i in bare]
    heads = small_table(spark, block=pa.array(range(len(blocks)), pa.int32()), rebalance_date=[b.rebalance_date for b in blocks])
    table = grown.where("tree >= 0").join(F.broadcast(heads), "block").select("rebalance_date", *BOOSTED_NAMES[1:8])
    if bare:
        empty = pa.table({"rebalance_date": [blocks[i].rebalance_date for i in bare]})
        stump = "0 AS tree", "0 AS node", "-1 AS feature", "0 AS cut", "0D AS value", "0D AS gain", "0L AS rows"
        table = table.unionByName(spark.createDataFrame(empty).selectExpr("rebalance_date", *stump))
    chosen.sort(key=lambda c: c.block.rebalance_date)
    return chosen, table


def boost(
    frame: DataFrame, blocks: Sequence, candidates: Sequence[Candidate], objective: Objective, growth: Growth, *,
    features: int, rounds: int, patience: int, slots: int = SLOTS,
) -> tuple[list[Chosen], DataFrame]:
    """Boosted trees of all refits: the choice per refit and the table of the chosen trees.

    ``frame`` has position and ``bins``. A model's rounds end when ``patience`` trees brought no
    smaller loss on its validation dates; the candidate with the smallest loss is chosen, of equals
    the shallower one, then the one of fewer trees.
    """
    position = date_positions(frame)
    if blocks:
        (_, whole), = plan_waves(blocks, position, candidates, sys.maxsize)
        daily = dict(window_rows(frame, objective, whole).groupBy("position").count().collect())  # one row per date
        held = [sum(daily.get(p, 0) for p in range(a, b + 1)) for a, b in zip(whole.first.tolist(), whole.last.tolist())]
        if max(held) <= WINDOW_ROWS:
            return boost_windows(frame, blocks, whole, objective, growth, features=features, rounds=rounds, patience=patience, rows=sum(held))
    spark, folder, chosen = frame.sparkSession, f"{work_folder(frame.sparkSession)}/trees-{uuid.uuid4().hex}", []
    for some, wave in plan_waves(blocks, position, candidates, slots):
        rows = row_table(frame, wave, objective)
        path = write_whole(rows)
        grower = Grower(table_at(rows, path), wave, objective, growth, features)
        grower.prepare()
        watch, train, parts = Watch(wave.models, patience), np.zeros(wave.models, "i8"), []
        for number in range(rounds + 1):
            if number < rounds:
                current, lost = grower.tree(number)
                train = np.maximum(train, current.rows[:, 0])
            else:
                lost = grower.losses(grower.collect(None, number, 0))
            if number:
                for model, loss in lost.items():
                    if watch.ended(model, number, loss):
                        wave.alive[[model, model + 1]] = False
            if number == rounds or not wave.alive.any():
                break
            parts.append(tree_rows(current, some, wave, number))
            grower.recent.append(current)
            if len(grower.recent) == FLUSH:
                write_trees(spark, parts, folder)
                grower.flush()
                parts = []
        if parts:
            write_trees(spark, parts, folder)
        grower.close()
        drop_table(spark, path)
        for i, block in enumerate(some):
            models = i * wave.variants + 2 * np.arange(len(candidates))
            pick = min(range(len(candidates)), key=lambda c: (watch.loss[models[c]], candidates[c].depth, watch.round[models[c]]))
            m = models[pick]
            loss = float(watch.loss[m]) if np.isfinite(watch.loss[m]) else None
            chosen.append(Chosen(block, pick, int(watch.round[m]), loss, float(wave.start[m + ALL]), int(train[m + ALL])))
    chosen.sort(key=lambda c: c.block.rebalance_date)
    picks = small_table(
        spark, rebalance_date=[c.block.rebalance_date for c in chosen], candidate=pa.array([c.candidate for c in chosen], pa.int32()),
        trees=pa.array([c.trees for c in chosen], pa.int32()),
    )
    table = spark.read.parquet(folder).join(F.broadcast(picks), ["rebalance_date", "candidate"]).where("tree < trees").drop("candidate", "trees")
    table = materialize(table.repartitionByRange("rebalance_date"))
    drop_table(spark, folder)
    return chosen, table


def models_of(chosen: Sequence[Chosen], table: DataFrame, factors: Sequence[str], growth: Growth, link: str = "identity") -> TreeModels:
    blocks = small_table(
        table.sparkSession, rebalance_date=[c.block.rebalance_date for c in chosen], test_end=[c.block.test_end for c in chosen], start=[c.start for c in chosen]
    )
    return TreeModels(table, blocks, factors, bins=growth.bins, step=growth.step, link=link)

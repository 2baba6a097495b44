"""Hard negatives from an R-tree over quantised vectors.

Rows are packed by Sort-Tile-Recursive: range partitions by label and first component are the
slabs, rows of a slab are tiled by the components that vary most there, and every ``LEAF`` rows are
a leaf with a minimum bounding box over the label and all components; ``FAN`` leaves are an inner
node. A box gives an interval per component, hence an interval of inner products with an anchor.

An anchor searches a slab best-first: nodes wait in a queue by the upper end of their interval and
leaves are scored. A node is left out when its labels cannot match, when its interval lies outside
every open score window, or strictly below what the k-th best already has (equal scores still count,
as ties go by id). Two rounds use this one search: positives (own label, no window) and negatives
(another label, one window per positive). Slabs return their own best; the best of those are taken
by rank.

An anchor is a row like any other and meets every slab that may hold a match: slab rows and anchors
are dealt to slabs by one shuffle, a task holds one slab and streams anchors past it. The number of
slabs grows with the square root of the rows, so a slab fits a task and copies of the anchors stay
of the order of the table. The work is anchors times rows less what boxes prune; boxes of many
dimensions prune little when vectors fill all directions.

Defined results: rows with a missing label or vector, or a missing or infinite component, take no
part; shorter vectors count as ended by zeros, an empty one scores 0; a missing id is ordered last
and is no anchor; rows repeated with their id are rows of their own, each an anchor, and each
other's partners; equal vectors tie and go by id; no positive score above 0 means a window that
holds nothing (0 holds only 0); an empty table gives an empty result; other columns are ignored.
Sums are exact while a vector's squared length is below 2**53.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.session import materialize

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Parameters: rows of a leaf, children of an inner node, tiled components, slabs per root of the rows.
LEAF = 512
FAN = 8
TILED = 3
SLABS = 1 / 20
# Parameters of the mining: anchors, positives, negatives, window in percent of the positive's score.
EVERY = 100
POSITIVES = 5
NEGATIVES = 10
WINDOW = (30, 90)
LAST_ID = 2**63 - 1


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """uid, id, label and whole-number components of the rows that take part, written once."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))
    kept = rows.where(F.col("label").isNotNull() & F.col(vector).isNotNull() & finite)
    return kept.select(
        F.monotonically_increasing_id().alias("uid"), F.coalesce("vec_id", F.lit(LAST_ID)).alias("id"),
        F.col("label").cast("bigint").alias("label"), whole.alias("v"),
    )


def relabelled(rows: DataFrame) -> DataFrame:
    """The fixed change of every seventh label."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


# --- the tree ------------------------------------------------------------------------------


class Tree:
    """An STR-packed R-tree of one slab."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, label: np.ndarray, vectors: np.ndarray):
        order = self.tile(label, vectors)
        self.uid, self.ids, self.label, self.vectors = uid[order], ids[order], label[order], vectors[order]
        n = len(order)
        self.leaves = [(a, min(a + LEAF, n)) for a in range(0, n, LEAF)]
        # Corners of boxes are longer than rows, so intervals are always computed in double precision.
        low = np.array([self.vectors[a:b].min(0) for a, b in self.leaves], "f8")
        high = np.array([self.vectors[a:b].max(0) for a, b in self.leaves], "f8")
        labels = np.array([(self.label[a:b].min(), self.label[a:b].max()) for a, b in self.leaves])
        self.levels = [(low, high, labels)]
        while len(self.levels[-1][0]) > FAN:
            low, high, labels = self.levels[-1]
            cuts = np.arange(0, len(low), FAN)
            pair = np.stack((np.minimum.reduceat(labels[:, 0], cuts), np.maximum.reduceat(labels[:, 1], cuts)), 1)
            self.levels.append((np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), pair))

    @staticmethod
    def tile(label: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Row order: slices by label, then tiles by the components that vary most."""
        axes = [label.astype("f8"), *(vectors[:, d] for d in np.argsort(-vectors.var(0), kind="stable")[:TILED])] if vectors.shape[1] else [label]

        def split(rows, depth):
            rows = rows[np.argsort(axes[depth][rows], kind="stable")]
            if depth == len(axes) - 1 or len(rows) <= LEAF:
                return [rows]
            leaves = -(-len(rows) // LEAF)
            size = LEAF * -(-leaves // max(1, round(leaves ** (1 / (len(axes) - depth)))))
            return [part for a in range(0, len(rows), size) for part in split(rows[a : a + size], depth + 1)]

        return np.concatenate(split(np.arange(len(label)), 0))

    def bounds(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level the (lower, upper) inner products of every anchor with every box."""
        up, down = np.maximum(anchors, 0).astype("f8"), np.minimum(anchors, 0).astype("f8")
        return [(up @ low.T + down @ high.T, up @ high.T + down @ low.T) for low, high, _ in self.levels]

    def search(self, at, bounds, vector, uid, label, same, windows, k):
        """Best k (score, id, uid) per window, highest scores first, ties by id."""
        best: list[list[tuple[float, int, int]]] = [[] for _ in windows]
        floor = [low if low <= high else float("inf") for low, high in windows]
        top = len(self.levels) - 1
        queue = [(-bounds[top][1][at, c], top, c) for c in range(len(self.levels[top][0]))]
        heapq.heapify(queue)
        while queue:
            upper, level, c = heapq.heappop(queue)
            if -upper < min(floor):
                break  # strictly below the k-th best of every window
            first, last = self.levels[level][2][c]
            if not first <= label <= last if same else first == last == label:
                continue
            lower = bounds[level][0][at, c]
            if not any(f <= -upper and lower <= high for f, (_, high) in zip(floor, windows)):
                continue
            if level:
                children = range(c * FAN, min((c + 1) * FAN, len(self.levels[level - 1][0])))
                for child in children:
                    heapq.heappush(queue, (-bounds[level - 1][1][at, child], level - 1, child))
                continue
            a, b = self.leaves[c]
            scores = self.vectors[a:b] @ vector
            fits = (self.label[a:b] == label) & (self.uid[a:b] != uid) if same else self.label[a:b] != label
            for j, (_, high) in enumerate(windows):
                rows = np.flatnonzero(fits & (scores >= floor[j]) & (scores <= high))
                if not len(rows):
                    continue
                if len(rows) > k:
                    rows = rows[np.lexsort((self.uid[a:b][rows], self.ids[a:b][rows], -scores[rows]))[:k]]
                found = zip((-scores[rows]).tolist(), self.ids[a:b][rows].tolist(), self.uid[a:b][rows].tolist())
                best[j] = heapq.nsmallest(k, [*best[j], *found])
                if len(best[j]) == k:
                    floor[j] = -best[j][-1][0]
        return [[(-s, i, u) for s, i, u in x] for x in best]


def matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Vectors as rows, ended by zeros."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), kind)
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


# --- search over all slabs -----------------------------------------------------------------

FOUND = "anchor bigint, window int, score bigint, id bigint, uid bigint"


def _best(slabs: DataFrame, anchors: DataFrame, tasks: int, width: int, squares: float, same: bool, k: int) -> DataFrame:
    """Per anchor and window the best k rows of each slab.

    ``anchors``: slab, uid, id, label, v and windows (low, high); both sides meet in their slab.
    """
    kind = "f4" if squares < 2**24 else "f8"
    none = F.lit(None).cast("array<struct<low:double,high:double>>")
    # Rows of a slab come first, then the anchors that stream past.
    both = slabs.withColumn("windows", none).unionByName(anchors)
    laid = both.repartition(tasks, "slab").sortWithinPartitions("slab", F.col("windows").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, parts, tree = None, [], None
        for batch in batches:
            names = {n: batch.column(n) for n in batch.schema.names}
            at, asks = names["slab"].to_numpy(), names["windows"].is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                if at[a] != slab:
                    slab, parts, tree = at[a], [], None
                uid, ids, label = (names[c].to_numpy()[a:b] for c in ("uid", "id", "label"))
                vectors = matrix(names["v"].slice(a, b - a), width, kind)
                if not asks[a]:
                    parts.append((uid, ids, label, vectors))
                    continue
                if not parts and tree is None:
                    continue
                if tree is None:
                    tree, parts = Tree(*(np.concatenate(x) for x in zip(*parts))), []
                rows, bounds = [], tree.bounds(vectors)
                for i, windows in enumerate(names["windows"].slice(a, b - a).to_pylist()):
                    limits = [(w["low"], w["high"]) for w in windows]
                    for j, found in enumerate(tree.search(i, bounds, vectors[i], uid[i], label[i], same, limits, k)):
                        rows += [(int(uid[i]), j, int(s), d, u) for s, d, u in found]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in FOUND.split(", ")])

    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "uid")
    return laid.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, *, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, embedding. ``is_anchor`` is a condition on ``id``.
    """
    count = rows.count()
    tasks = max(1, round(count**0.5 * SLABS))
    usable_rows = usable(rows)
    first = F.coalesce(F.get("v", F.lit(0)), F.lit(0.0))
    slabs = materialize(
        materialize(usable_rows).repartitionByRange(tasks, "label", first, "uid").withColumn("slab", F.spark_partition_id())
    )
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    shape = slabs.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(size), F.lit(0.0)), F.coalesce(F.max("slab"), F.lit(0))).first()
    width, squares, last = shape
    anchors = slabs.where((F.col("id") != LAST_ID) & is_anchor).drop("slab")
    every = F.array(F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))

    # Positives: the slabs that hold the label.
    held = slabs.select("label", "slab").distinct()
    asked = anchors.join(held, "label").withColumn("windows", every)
    best = _best(slabs, asked.select(*slabs.columns, "windows"), tasks, width, squares, True, positives)
    best = materialize(best.select("anchor", F.col("rank").alias("position"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")))

    # Negatives: one window per positive, in all slabs.
    low, high = F.ceil(F.col("positive_score") * window[0] / 100), F.floor(F.col("positive_score") * window[1] / 100)
    wanted = best.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("position", low.cast("double").alias("low"), high.cast("double").alias("high")))).alias("w")
    ).select(F.col("anchor").alias("uid"), F.transform("w", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))).alias("windows"))
    asked = anchors.join(wanted, "uid").withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(last))))
    found = _best(slabs, asked.select(*slabs.columns, "windows"), tasks, width, squares, False, negatives)
    found = found.select("anchor", (F.col("window") + 1).alias("position"), "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    named = lambda c: F.when(F.col(c) != LAST_ID, F.col(c)).alias(c)
    return (
        found.join(best, ["anchor", "position"]).join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score")
    )


def mined(rows: DataFrame) -> DataFrame:
    """The mining by the fixed rule: every seventh label changed, every hundredth id an anchor."""
    return hard_negatives(relabelled(rows.select("vec_id", "label", "embedding")), is_anchor=F.col("id") % EVERY == 0)

"""Hard negatives against scoring every pair, and the bounds of the tree."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import negatives as hn


def by_hand(data, every=100):
    rows = []
    for vec_id, label, v in data:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if vec_id is not None and vec_id % 7 == 0 else label
        rows.append((hn.LAST_ID if vec_id is None else vec_id, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, (anchor, label, v) in enumerate(rows):
        if anchor % every or anchor == hn.LAST_ID:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for k, (j, l, w) in enumerate(rows) if l == label and k != i)[:5]
        others = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, l, w in rows if l != label)
        for ps, p in scored:
            inside = [(-s, j) for s, j in others if 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            name = lambda x: None if x == hn.LAST_ID else x
            out += [(anchor, name(p), r, name(j), -ps, s) for r, (s, j) in enumerate(inside, 1)]
    return sorted(out, key=repr)


def vectors(seed, n=900, width=6, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width))
    out = []
    for i in range(n):
        label = int(rng.integers(labels)) if rng.random() > 0.3 else 0
        out.append((i, label, [float(np.float32(x)) for x in centres[label] * 0.4 + rng.normal(size=width) * 0.5]))
    return out


SCHEMA = "vec_id bigint, label int, embedding array<float>"


def mined(spark, data, schema=SCHEMA):
    df = spark.createDataFrame(data, schema).repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("uid", "id", "v", "slab", "windows", "anchor", "rank", "low")})
    return sorted((tuple(r) for r in hn.mined(df).collect()), key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_result_is_that_of_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(hn, "LEAF", 16)  # many leaves and levels
    data = vectors(seed)
    got = mined(spark, data)
    assert got == by_hand(data) and len(got) > 100


def test_awkward_rows(spark):
    rng = random.Random(3)
    data = vectors(7, 420, 5)
    data += [(None, 1, [0.5] * 5), (None, 2, None), (1000, None, [0.1] * 5), (1001, 1, [float("nan")] * 5), (1002, 1, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    data += [(1003, 1, [None, 0.1, 0.2, 0.3, 0.4]), (1100, 1, []), (1200, 2, [0.7]), (1201, 2, [0.9, 0.1]), (-100, -3, [0.2] * 5), (-99, -3, [0.21] * 5)]
    data += [data[100], data[100], data[200]]  # repeated anchors
    data += [(2000 + i, rng.randint(0, 3), [0.25, 0.5, 0.0, 0.0, 0.0]) for i in range(60)]  # equal vectors
    assert mined(spark, data) == by_hand(data)


def test_small_and_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0, 2.0])]) == []
    assert mined(spark, [(100, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 2, [0.5, 0.5])]) == by_hand([(100, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 2, [0.5, 0.5])])


def test_boxes_hold_their_rows_and_prune(monkeypatch):
    monkeypatch.setattr(hn, "LEAF", 32)
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(size=(4000, 3)) * 200)
    tree = hn.Tree(np.arange(4000), np.arange(4000), rng.integers(0, 3, 4000), v)
    assert sorted(tree.uid.tolist()) == list(range(4000))
    anchors = v[:20]
    for level, (lower, upper) in enumerate(tree.bounds(anchors)):
        for c in range(lower.shape[1]):
            leaves = range(c * hn.FAN**level, min((c + 1) * hn.FAN**level, len(tree.leaves)))
            rows = np.concatenate([tree.vectors[slice(*tree.leaves[x])] for x in leaves])
            s = anchors @ rows.T
            assert (lower[:, c] <= s.min(1)).all() and (s.max(1) <= upper[:, c]).all()
    seen = []

    class Watched(list):
        def __getitem__(self, i):
            seen.append(i)
            return super().__getitem__(i)

    tree.leaves = Watched(tree.leaves)
    found = tree.search(0, tree.bounds(anchors), anchors[0], 0, tree.label[0], True, [(-math.inf, math.inf)], 5)[0]
    assert len(found) == 5 and len(seen) < len(tree.leaves) / 2

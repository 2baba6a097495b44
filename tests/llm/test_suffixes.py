"""The sampled suffix array against counting every window, and its parts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelforge.llm import suffixes as sx
from tests.llm.data import LONG, frame


def brute(texts, least):
    texts = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(x for x, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    """Shared passages cut at any byte, near copies, runs of one character and equal texts."""
    rng = random.Random(seed)
    words = ["ka", "lo", "mir", "néo", "tu", "xxxxx", "\U0001f600"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [some(rng.randint(20, 120)) for _ in range(6)]
    texts = []
    for _ in range(90):
        parts = [some(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            a = rng.randint(0, len(passage) // 2)
            parts += [passage[a : rng.randint(a, len(passage))], some(rng.randint(0, 20))]
        texts.append(" ".join(parts))
    texts += [None, "", "a" * 300, "a" * 90, "ab" * 100, texts[3], texts[3], shared[0]]
    for _ in range(40):
        parts = shared[1].split()
        parts[rng.randrange(len(parts))] = "zz"
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize("seed, least, reach", [(0, 40, 16), (1, 64, 30), (2, 50, 43)])
def test_removed_bytes_are_those_of_brute_force(spark, seed, least, reach):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = sorted(sx.without_repeats(docs, least, reach).collect())
    assert [tuple(r)[1:5] for r in got] == brute(texts, least)
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_awkward_rows_with_the_production_length(spark):
    data = frame(spark).collect()
    got = sorted(tuple(r)[1:5] for r in sx.without_repeats(frame(spark, clashing=True)).collect())
    assert got == sorted(brute([r.text for r in data], 400))
    assert sx.without_repeats(frame(spark, [])).count() == 0
    one = sx.without_repeats(frame(spark, [(1, LONG, None, None, 0), (2, "short", None, None, 0)])).orderBy("doc_id").collect()
    assert tuple(one[0])[1:5] == brute([LONG], 400)[0] and one[1].n_removed == 0


def test_a_core_that_fills_many_buckets(spark):
    """Every text holds the same passage; buckets are forced to be small."""
    texts = [f"{i:03d}" * (i % 5) + "the passage that all of them hold, word by word" + f"{i * 7919:05d}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = sorted(sx.without_repeats(docs, 40, 16).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [tuple(r)[1:5] for r in got] == brute(texts, 40)


def test_equal_windows_own_the_same_place():
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab") for _ in range(3000)) + b"z" * 300
    owner = {}
    for least, reach in ((40, 16), (50, 43)):
        owner.clear()
        at, low, high = sx.places(text, least, reach)
        assert low[0] == 0 and high[-1] == len(text) - least and (low[1:] == high[:-1] + 1).all()
        for p, a, b in zip(at, low, high):
            for s in range(a, b + 1):
                assert 0 <= p - s < reach
                assert owner.setdefault(text[s : s + least], p - s) == p - s


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_multikey_order(n):
    rng = np.random.default_rng(n)
    tokens = [rng.integers(0, 5, n), rng.integers(-3, 3, n), rng.integers(0, 10**6, n)]
    rows = list(zip(*[t[sx.multikey_order(tokens)].tolist() for t in tokens]))
    assert rows == sorted(zip(*[t.tolist() for t in tokens]))


def test_order_over_buckets_counts_shared_tokens(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 3), rng.randint(0, 3), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, i bigint")
    got = {r.i: (r.prev, r.next) for r in sx.suffix_order(df, ["a", "b"], ["i"], 1).collect()}
    line = sorted(rows)
    shared = lambda x, y: 0 if x[0] != y[0] else 1 if x[1] != y[1] else 2
    for k, row in enumerate(line):
        want = (shared(line[k - 1], row) if k else 0, shared(row, line[k + 1]) if k + 1 < len(line) else 0)
        assert got.get(row[2], (0, 0)) == (want if max(want) else (0, 0))

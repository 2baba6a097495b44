"""Cases in which an operator over documents used to do less than the whole job."""

from collections import defaultdict

import pytest

from panelforge.llm import masked, mixing, secrets
from tests.llm.data import frame


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_long_text_leaves_no_gap_that_short_ones_fill(spark, seed):
    data = [(i, "w " * 10, None, "a", 0) for i in range(2000)] + [(2000, "w " * 20_000, None, "a", 0)]
    got = mixing.mix(frame(spark, data), seed=seed).collect()
    assert 0 <= 40_000 - sum(r.taken for r in got) < 10 + 1e-6


def test_mix_takes_by_rank_whatever_fits(spark):
    # Lots of several rows, texts of very different sizes and several sources.
    data = [(i, "w " * (1 + i * i * 7919 % 400), None, f"s{i % 3}", 0) for i in range(900)] + [(9, "w " * 50, None, "s0", 0)] * 5
    docs = frame(spark, data)
    rows = mixing.materialize(mixing.measured(docs, 1))
    plan, n = mixing.plan_mix(rows)
    ranked = mixing._ranked(mixing._with_sources(rows, plan, n), mixing.F.sqrt, 3.0).collect()
    lots, gap, want = defaultdict(list), {}, defaultdict(int)
    for r in ranked:
        gap[r.source] = gap.get(r.source, r.target) - r.sure * r["size"]
        want[r.source] += r.sure * r["size"]
        if r["rank"] is not None:
            lots[r.source, r["rank"], r.draw].append(r["size"])
    for (source, _, _), sizes in sorted(lots.items()):
        if sum(sizes) <= gap[source]:
            gap[source] -= sum(sizes)
            want[source] += sum(sizes)
    got = defaultdict(int)
    for r in mixing.with_copies(rows, plan, n).collect():
        got[r.source] += r.copies * r["size"]
    assert got == want


def test_keys_beside_harmless_words_are_found(spark):
    key = "q7Zx9LmK2vTb8RwY4nHd6JcP1sGf3UaE5oXiWkQz"
    bad = [f"example/{key}", f"sample_key={key}", f"2024-01-01_{key}", f"{key}-dummy", f"2024-01-01T10-20-30Z-{key}", "example" * 200 + "/" + key]
    good = ["example-" * 60 + "Ab3", "my-Sample1-value2x-placeholder3y", "2024-01-01T10-20-30-123Z", "2024-01-01_backup-of-the-database-v2b"]
    docs = spark.createDataFrame(list(enumerate(bad + good)), "doc_id bigint, text string")
    got = {r.doc_id: [s for s in r.spans if s.kind == "entropy_key"] for r in secrets.scan(docs).collect()}
    for i, text in enumerate(bad):
        at = text.index(key)
        assert any(s.start <= at + 1 and s.end >= at + len(key) - 1 for s in got[i]), text
    assert not any(got[i] for i in range(len(bad), len(bad + good)))


LONG_CANDIDATES = """
import random, sys, tempfile
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
from panelforge.llm import secrets
rng = random.Random(1)
key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200_000))
texts = ["a-" * n for n in (1_000, 100_000, 1_000_000)] + ["2024-01-01" + "_ab" * 300_000, "/usr/" * 200_000, "x" * 1_000_000, key]
rows = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
assert not any(rows[i] for i in range(6)), [rows[i][:2] for i in range(6)]
covered = sum(s.end - s.start for s in rows[6])
assert covered > 195_000 and rows[6][-1].end <= 200_000, covered
print("whole")
"""


def test_long_candidates_in_a_fresh_session():
    """Words joined a million times, and one key of 200,000 characters, before anything is compiled."""
    import subprocess
    import sys
    from pathlib import Path

    found = subprocess.run([sys.executable, "-c", LONG_CANDIDATES], capture_output=True, text=True, timeout=300, cwd=Path(__file__).parents[2])
    assert found.stdout.strip().endswith("whole"), found.stderr[-2000:]


def test_every_position_is_a_training_target_once(spark, monkeypatch):
    """Also in texts whose words repeat at the stride of the masks."""
    import numpy as np

    texts = [list(range(7 * i, 7 * i + n)) for i, n in enumerate((1, 2, 3, 8, 9, 24, 40, 5))]
    rows = spark.createDataFrame([(bytes(np.array(t, "<u2").tobytes()),) for t in texts], "slots binary").coalesce(1)
    vocabulary = masked.Vocabulary(np.zeros(masked.SLOTS, "i8"))
    vocabulary.classes = (np.arange(masked.SLOTS) % masked.CLASSES).astype("i4")
    # In place of a gradient step the bias moves by the counts of the targets.
    met = np.zeros(masked.CLASSES)

    def step(self, context, target, rate):
        self.bias += np.bincount(target, minlength=masked.CLASSES).astype("f4")

    monkeypatch.setattr(masked.Network, "step", step)
    network = masked.Network(vocabulary)
    for turn in range(masked.ROUNDS):
        met += (masked.train_round(rows, vocabulary, network, turn, masked.ROUNDS, 1.0) - network.flat())[-masked.CLASSES :]
    assert met.round().astype(int).tolist() == np.bincount(sum(texts, []), minlength=masked.CLASSES).tolist()


def test_words_of_one_slot_are_counted_apart(spark, monkeypatch):
    """Also across segments, and so that the words of the corpus share their slot's probability."""
    import math
    import zlib
    from itertools import count

    import numpy as np

    slot = zlib.crc32(b"alpha") % masked.SLOTS
    twin = next(w for w in (f"w{i}" for i in count()) if zlib.crc32(w.encode()) % masked.SLOTS == slot)
    data = [(i, "alpha one", None, None, 0) for i in range(30)] + [(30 + i, f"{twin} one", None, None, 0) for i in range(10)] + [(40, None, None, None, 0)]
    for size in (masked.SEGMENT, 7):
        monkeypatch.setattr(masked, "SEGMENT", size)
        monkeypatch.setattr(masked, "COUNTED", size)
        got = {r.doc_id: r for r in masked.scored(frame(spark, data), by_word=True).collect()}
        assert len(got) == 41 and got[40].n_tokens == 0 and got[40].log_likelihood == 0
        # The two texts differ by words of one slot, so by nothing but the words' counts.
        assert abs(got[0].log_likelihood - got[30].log_likelihood - math.log(3)) < 1e-3, size
        rows = masked.materialize(masked.tokens(frame(spark, data)))
        words = {p for r in masked.word_counts(rows).collect() for p in zip(np.frombuffer(r.slots, "<u2").tolist(), np.frombuffer(r.n, "<i8").tolist())}
        assert sorted(n for s, n in words if s == slot) == [10, 30]
        assert rows.select("segment").distinct().count() > (3 if size == 7 else 0)

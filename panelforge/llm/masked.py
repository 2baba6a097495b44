"""Language-model scores by masked pseudo-likelihood.

Every token of a document is predicted from the tokens on both sides, and the logarithms of the
conditional probabilities are summed. The network embeds the ``WINDOW`` tokens on either side of
the masked one, one table per position, adds them, applies tanh and ends in a softmax over token
classes. Words are hashed to slots whose counts come from the whole corpus: frequent slots are
classes of their own, the others share the remaining classes, and within a class a slot has its
share of the class's count. Words of a slot are told apart by counts keyed by word: a word has its
share of the slot's count. So the probability of a word is that of its class in its context times the
slot's share of the class and the word's share of the slot; over all words of the corpus it sums to one.

The vocabulary is a table of every word and grows with the corpus. A segment (about ``SEGMENT`` tokens
of successive documents) numbers its distinct words; only those, not their occurrences, are shuffled by
key to be counted, as packed arrays, and their counts return to the segment, where its documents are scored.

Training covers all positions of all documents: a round masks every ``ROUNDS``-th token, the next
round those after them, so that each token is a target once. In each round every task starts from the
same weights, takes gradient steps in NumPy over all its documents and returns its weights; the next weights are their mean over tasks, weighted by tokens. What a round gathers
grows with the number of tasks, that is with the corpus, and is summed by a shuffle. Sums are
taken over whole numbers, so they do not depend on the order of arrival.

Token slots (two bytes each), word numbers (four) and the distinct words of segments are written
between the passes; training reads the slots only.

Defined results: a missing or empty text has no tokens, log-likelihood 0 and no mean; a text of
one token is predicted from padding; repeated rows each count and get a row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from panelforge.session import materialize

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOTS = 1 << 16
CLASSES = 256
OWN = 192
WINDOW = 2
WIDTH = 16
ROUNDS = 3
RATE = 4.0
STEP = 1024
# Weights are summed as whole numbers of this fraction.
SCALE = float(1 << 24)
# Bound of logits below which single-precision exponentials need no shift.
SAFE = 60.0
ONES = np.ones(CLASSES, "f4")
# Positions predicted at a time, and tokens after which a segment ends with its document.
CHUNK = 1 << 9
SEGMENT = 1 << 21
# A word of a segment: 64 bits of hash, slot, occurrences. Words that a task counts at a time.
WORD = np.dtype([("key", "<i8"), ("slot", "<u2"), ("n", "<u4")])
COUNTED = 2_000_000


class Numbers(dict):
    """Number of each lower-cased word of a segment, in order of its first occurrence."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def worker_hash(docs: DataFrame) -> int:
    """What a Python worker of the session makes of a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([hash("a")] * batch.num_rows, pa.int64())], names=["seeded"])

    return docs.sparkSession.range(1, numPartitions=1).mapInArrow(run, "seeded bigint").first()[0]


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, the slots of its words (two bytes each), its segment and the words' numbers there (four bytes).

    The first row of a segment has the segment's words, packed in order of their numbers. Python's hash
    of a word is the same in all workers, since Spark sets its seed for the application.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if hash("a") != seeded:
            raise RuntimeError("Python workers hash words differently; set PYTHONHASHSEED")
        segment = TaskContext.get().partitionId() << 32
        numbers, ids, names, held = Numbers(), [], [], 0

        def ended() -> pa.RecordBatch:
            words = np.empty(len(numbers), WORD)
            words["key"] = np.fromiter(map(hash, numbers), "i8", len(numbers))
            words["slot"] = np.fromiter((zlib.crc32(w.encode()) % SLOTS for w in numbers), "<u2", len(numbers))
            words["n"] = np.bincount(np.concatenate(ids), minlength=len(numbers))
            slots = words["slot"].copy()
            packed = [words.tobytes(), *[None] * (len(ids) - 1)]
            columns = [pa.array(c, pa.binary()) for c in ([slots[i].tobytes() for i in ids], [i.tobytes() for i in ids], packed)]
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(names), columns[0], pa.array([segment] * len(ids), pa.int64()), *columns[1:]],
                names=["doc_id", "slots", "segment", "ids", "words"],
            )

        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").lower().split()
                ids.append(np.fromiter(map(numbers.__getitem__, words), "<u4", len(words)))
                names.append(batch.column("doc_id").slice(i, 1))
                held += len(words)
                if held >= SEGMENT:
                    yield ended()
                    segment, numbers, ids, names, held = segment + 1, Numbers(), [], [], 0
        if ids:
            yield ended()

    seeded = worker_hash(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, slots binary, segment bigint, ids binary, words binary")


def word_counts(rows: DataFrame) -> DataFrame:
    """(segment, ids, slots, n): occurrences in the whole corpus of every word of every segment, packed.

    Words are dealt by ranges of their key to tasks of about ``COUNTED`` entries; equal key and slot, 80 bits
    together, are one word. A word has one entry per segment that it occurs in.
    """
    found = rows.where("words IS NOT NULL").select("segment", "words")
    entries = (found.agg(F.sum(F.length("words"))).first()[0] or 0) // WORD.itemsize
    parts = max(1, entries // COUNTED)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, words in zip(batch.column("segment").to_pylist(), batch.column("words")):
                words = np.frombuffer(words.as_py(), WORD)
                part = (words["key"].astype("u8") >> np.uint64(33)) * np.uint64(parts) >> np.uint64(31)
                order = np.argsort(part, kind="stable").astype("<u4")
                used, first = np.unique(part[order], return_index=True)
                own = [order[a:b] for a, b in zip(first, [*first[1:], len(order)])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype("i4")), pa.array([segment] * len(own), pa.int64()),
                        pa.array([i.tobytes() for i in own], pa.binary()), pa.array([words[i].tobytes() for i in own], pa.binary()),
                    ],
                    names=["part", "segment", "ids", "words"],
                )

    def count(table: pa.Table) -> pa.Table:
        words = np.concatenate([np.frombuffer(w.as_py(), WORD) for w in table.column("words")])
        key, slot = words["key"].copy(), words["slot"].copy()
        order = np.lexsort((slot, key))
        key, other = key[order], slot[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (other[1:] != other[:-1]))))
        n = np.empty(len(order), "<i8")
        n[order] = np.repeat(np.add.reduceat(words["n"][order].astype("i8"), first), np.diff(np.append(first, len(order))))
        ends = np.cumsum([len(i.as_py()) // 4 for i in table.column("ids")])[:-1]
        packed = [pa.array([x.tobytes() for x in np.split(c, ends)], pa.binary()) for c in (slot, n)]
        return pa.table([table.column("segment"), table.column("ids"), *packed], names=["segment", "ids", "slots", "n"])

    dealt = found.mapInArrow(deal, "part int, segment bigint, ids binary, words binary")
    return dealt.groupBy("part").applyInArrow(count, "segment bigint, ids binary, slots binary, n binary")


def slot_counts(rows: DataFrame) -> np.ndarray:
    """Occurrences of each slot in the whole corpus: a fixed number of counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, "i8")
        for batch in batches:
            for slots in batch.column("slots"):
                total += np.bincount(np.frombuffer(slots.as_py(), "<u2"), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    counts = np.zeros(SLOTS, "i8")
    for slot, n in rows.select("slots").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n")).collect():
        counts[slot] = n
    return counts


class Vocabulary:
    """Class of each slot and the logarithm of the slot's share of its class."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        order = np.lexsort((np.arange(SLOTS), -counts))
        self.classes = np.empty(SLOTS, "i4")
        self.classes[order[:OWN]] = np.arange(OWN)
        rest = order[OWN:]
        self.classes[rest] = OWN + rest % (CLASSES - OWN)
        smooth = counts + 1.0
        total = np.bincount(self.classes, smooth, CLASSES)
        self.share = np.log(smooth / total[self.classes])
        self.bias = np.log(total / total.sum()).astype("f4")


class Network:
    """Weights: one embedding table per position (row CLASSES is padding), output matrix, bias."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (2 * WINDOW, CLASSES + 1, WIDTH)).astype("f4")
        self.out = rng.normal(0, 0.1, (WIDTH, CLASSES)).astype("f4")
        self.bias = vocabulary.bias.copy()

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray):
        for p in self.parts():
            p[...] = flat[: p.size].reshape(p.shape)
            flat = flat[p.size :]

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.embed[0][context[0]]
        for table, c in zip(self.embed[1:], context[1:]):
            total = total + table[c]
        return np.tanh(total)

    def logits(self, hidden: np.ndarray) -> np.ndarray:
        """Scores of all classes, shifted by their maximum if exponentials could overflow."""
        logits = hidden @ self.out
        logits += self.bias
        if not (np.abs(self.out).sum(0) + np.abs(self.bias)).max() < SAFE:  # |hidden| <= 1
            logits -= logits.max(1, keepdims=True)
        return logits

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        logits = self.logits(self.hidden(context))
        picked = logits[np.arange(len(target)), target]
        return picked - np.log(np.exp(logits, out=logits) @ ONES)

    def step(self, context: np.ndarray, target: np.ndarray, rate: float):
        """One gradient step on masked positions."""
        h, n = self.hidden(context), np.float32(len(target))
        p = self.logits(h)
        np.exp(p, out=p)
        p *= (1 / (p.sum(1, keepdims=True) * n)).astype("f4")
        p[np.arange(len(target)), target] -= 1 / n
        back = (p @ self.out.T) * (1 - h * h)
        self.out -= np.float32(rate) * (h.T @ p)
        self.bias -= np.float32(rate) * p.sum(0)
        for table, c in zip(self.embed, context):
            # Sums of the gradient per class: a product with the class indicators, by sorting.
            order = np.argsort(c.astype("u2"), kind="stable")
            met = c[order]
            first = np.flatnonzero(np.concatenate(([True], met[1:] != met[:-1])))
            table[met[first]] -= np.float32(rate * WIDTH) * np.add.reduceat(back[order], first)


def contexts(classes: np.ndarray, step: int = 1, first: int = 0) -> np.ndarray:
    """Classes at each relative position of every ``step``-th token of a document, padded at its ends."""
    n = len(classes)
    padded = np.full(n + 2 * WINDOW, CLASSES, "i4")
    padded[WINDOW : WINDOW + n] = classes
    return np.stack([padded[o + first : o + n : step] for o in range(2 * WINDOW + 1) if o != WINDOW])


def _batches(rows: Iterator[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts and targets of masked positions of successive documents, in steps of ``size``."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for context, target in rows:
        held.append((context, target))
        n += len(target)
        if n >= size:
            context, target = np.concatenate([c for c, _ in held], axis=1), np.concatenate([t for _, t in held])
            for i in range(0, n - size + 1, size):
                yield context[:, i : i + size], target[i : i + size]
            rest = n % size
            held, n = [(context[:, n - rest :], target[n - rest :])], rest
    if n:
        yield np.concatenate([c for c, _ in held], axis=1), np.concatenate([t for _, t in held])


def first_target(seen: int, turn: int, rounds: int) -> int:
    """First place of a document that a round masks, every ``rounds``-th follows; over all rounds each place once.

    The stride runs on from document to document, so that repeated texts do not start alike.
    """
    return (turn - seen) % rounds


def train_round(rows: DataFrame, vocabulary: Vocabulary, network: Network, turn: int, rounds: int, rate: float) -> np.ndarray:
    """Mean of the weights that the tasks return, weighted by their tokens."""
    start, classes = network.flat(), vocabulary.classes
    seed_network = Network(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed_network.load(start)
        seen = 0

        def masked():
            nonlocal seen
            for batch in batches:
                for slots in batch.column("slots"):
                    own = classes[np.frombuffer(slots.as_py(), "<u2")]
                    at = first_target(seen, turn, rounds)
                    seen += len(own)
                    if at < len(own):
                        yield contexts(own, rounds, at), own[at::rounds]

        for context, target in _batches(masked(), STEP):
            seed_network.step(context, target, rate)
        moved = np.rint((seed_network.flat().astype("f8") - start) * SCALE).astype("i8")
        # A task's weight is its tokens in thousands, at least one, so that sums stay in 64 bits.
        weight = max(1, seen // 1000) if seen else 0
        if weight:
            place = np.arange(len(moved) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.append(moved * weight, weight))], names=["place", "moved"])

    sums = rows.select("slots").mapInArrow(run, "place bigint, moved bigint").groupBy("place").agg(F.sum("moved")).collect()
    if not sums:
        return start
    total = np.zeros(len(start) + 1)
    for place, moved in sums:
        total[place] = moved
    return (start + total[:-1] / total[-1] / SCALE).astype("f4")


def train(rows: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> tuple[Vocabulary, Network]:
    """Vocabulary and network from the token slots of the whole corpus, written to a table."""
    vocabulary = Vocabulary(slot_counts(rows))
    network = Network(vocabulary)
    for turn in range(rounds):
        network.load(train_round(rows, vocabulary, network, turn, rounds, rate / (turn + 1)))
    return vocabulary, network


def document_score(slots: np.ndarray, vocabulary: Vocabulary, network: Network) -> float:
    """Sum of the conditional log-probabilities of all tokens of a document."""
    own = vocabulary.classes[slots]
    context, total = contexts(own), float(vocabulary.share[slots].sum())
    for i in range(0, len(own), CHUNK):
        total += float(network.log_probabilities(context[:, i : i + CHUNK], own[i : i + CHUNK]).sum(dtype="f8"))
    return total


def scored(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE, *, by_word: bool = False) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood and perplexity of every row.

    The likelihood is that of the words with ``by_word``, as in the registered query, else that of their slots.
    """
    rows = materialize(tokens(docs))
    vocabulary, network = train(rows, rounds, rate)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(texts: pa.Table, words: pa.Table) -> pa.Table:
        at, slots, n = (np.concatenate([np.frombuffer(x.as_py(), t) for x in words.column(c)] or [np.zeros(0, t)]) for c, t in (("ids", "<u4"), ("slots", "<u2"), ("n", "<i8")))
        order = np.argsort(at)
        slots, share = slots[order], np.zeros(len(at))
        if by_word:
            share = np.log(n[order]) - np.log(np.maximum(vocabulary.counts[slots], 1))
        n, total = [], []
        for ids in texts.column("ids"):
            ids = np.frombuffer(ids.as_py(), "<u4")
            n.append(len(ids))
            total.append(round(document_score(slots[ids], vocabulary, network) + float(share[ids].sum()), 4) if len(ids) else 0.0)
        return pa.table([texts.column("doc_id"), pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=["doc_id", "n_tokens", "log_likelihood"])

    texts = rows.select("segment", "doc_id", "ids").groupBy("segment")
    out = texts.cogroup(word_counts(rows).groupBy("segment")).applyInArrow(score, f"doc_id {kind}, n_tokens bigint, log_likelihood double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.withColumn("mean_log_likelihood", mean).withColumn("perplexity", F.exp(-F.col("mean_log_likelihood")))

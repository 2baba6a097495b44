"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds ``sum(c[j] * B**j for j < i)`` modulo a prime for every i, so the
hash of any span is a difference of two entries times a power of the inverse of B. Two primes are
used together. Spans of two texts are compared in constant time and the longest common extension
of two positions is found by binary search over lengths.

A fingerprint is a one-permutation minimum sketch of the hashes of all spans of ``SPAN`` code
points: 64 slots of 16 bits. The likeness of two fingerprints is the share of slots that agree and
estimates the share of common spans. The spans of an edited text are those of its two parts and
the few across the seam, so its sketch needs no second pass over the parts.

Every document meets the next one in order of ``doc_id``. Texts are range-partitioned and sorted
once; within a partition neighbours stream past each other, and the first and last text of each
partition are kept aside and matched afterwards.

Defined results: missing texts are empty; an empty text has no spans and equals only texts without
spans; texts shorter than a span are one span; missing ids come first; rows of one id are ordered
by text; a single document is its own next; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from panelforge.llm.text import whole
from panelforge.session import materialize

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Parameters: two primes below 2**31 and a base for each.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353)
SPAN = 16
SLOTS = 64
EMPTY = 0xFFFF
ODD = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of each base and of its inverse, grown to the longest text met."""

    def __init__(self):
        self.up = [np.ones(1, "u8") for _ in PRIMES]
        self.down = [np.ones(1, "u8") for _ in PRIMES]

    def upto(self, n: int):
        while len(self.up[0]) <= n:
            for k, (p, b) in enumerate(zip(PRIMES, BASES)):
                for table, x in ((self.up, b), (self.down, pow(b, -1, p))):
                    step = np.uint64(pow(x, len(table[k]), p))
                    table[k] = np.concatenate((table[k], table[k] * step % np.uint64(p)))
        return self.up, self.down


class Prefixes:
    """Prefix arrays of one text."""

    def __init__(self, text: str, powers: Powers):
        self.text, self.powers = text, powers
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8") + np.uint64(1)
        self.n = len(codes)
        up, _ = powers.upto(self.n)
        self.sums = []
        for p, power in zip(PRIMES, up):
            sums = np.zeros(self.n + 1, "u8")
            # Terms are below 2**31, so sums over 2**32 code points stay within 64 bits.
            np.cumsum(codes * power[: self.n] % np.uint64(p), out=sums[1:])
            self.sums.append(sums % np.uint64(p))

    def span(self, start, length) -> tuple[int, int]:
        """Hash of one span, the same wherever it stands."""
        _, down = self.powers.upto(self.n)
        return tuple(
            (int(s[start + length]) - int(s[start])) % p * int(d[start]) % p for s, d, p in zip(self.sums, down, PRIMES)
        )

    def equal(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        return self.span(i, length) == other.span(j, length)

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension of position i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, length: int = SPAN) -> np.ndarray:
        """Mixed 64-bit hashes of all spans of the given length, or of a shorter text itself."""
        length = min(length, self.n)
        if not length:
            return np.empty(0, "u8")
        _, down = self.powers.upto(self.n)
        m, both = self.n - length + 1, np.zeros(self.n - length + 1, "u8")
        for s, d, p in zip(self.sums, down, PRIMES):
            p = np.uint64(p)
            both = (both << np.uint64(31)) | ((s[length:] + p - s[:m]) % p * d[:m] % p)
        both = (both ^ (both >> np.uint64(29))) * ODD
        return (both ^ (both >> np.uint64(32))) * ODD


def sketch(parts: list[np.ndarray]) -> str:
    """Per slot the low bits of the smallest hash, as hex digits.

    A slot is the top six bits. Small values are tried first, which leaves no slot open in a long
    text but for chance; then all values are used.
    """
    low, shift = np.full(SLOTS, 2**64 - 1, "u8"), np.uint64(6)
    total = sum(map(len, parts))
    bound = 2**64 - 1 if total < 64 * SLOTS else 2**64 // total * 16 * SLOTS
    for limit in (bound, 2**64 - 1):
        for part in parts:
            rest = part << shift
            some = part[rest <= np.uint64(limit)] if limit < 2**64 - 1 else part
            np.minimum.at(low, (some >> np.uint64(58)).astype("i8"), some << shift)
        if limit == 2**64 - 1 or (low < 2**64 - 1).all():
            break
    value = (low >> np.uint64(6)) % np.uint64(EMPTY)
    value[low == 2**64 - 1] = EMPTY
    return "".join(f"{v:04x}" for v in value.tolist())


def likeness(a: str, b: str) -> float:
    """Share of agreeing slots among those that either fingerprint uses; 1 for two empty ones."""
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    used = (x != EMPTY) | (y != EMPTY)
    return float(((x == y) & used).sum() / used.sum()) if used.any() else 1.0


class Document:
    def __init__(self, text: str, powers: Powers):
        self.prefixes = Prefixes(text, powers)
        self.hashes = self.prefixes.spans()
        self.print = sketch([self.hashes])


def against_next(one: Document, two: Document) -> tuple:
    """Result columns of a document and its successor."""
    text, other = one.prefixes.text, two.prefixes.text
    cut = len(text) - len(text) // 4
    added = other[: len(text) // 4]
    edited = text[:cut] + added
    if len(edited) < SPAN:
        hashes = [Prefixes(edited, one.prefixes.powers).spans()]
    else:
        seam = text[max(0, cut - SPAN + 1) : cut] + added[: SPAN - 1]
        across = Prefixes(seam, one.prefixes.powers).spans() if len(seam) >= SPAN else np.empty(0, "u8")
        hashes = [one.hashes[: max(0, cut - SPAN + 1)], across]
        if len(added) >= SPAN:
            hashes.append(two.hashes[: len(added) - SPAN + 1])
    edited_print = sketch(hashes)
    return (
        len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), one.print, edited_print,
        likeness(one.print, edited_print), likeness(one.print, two.print), one.prefixes.extension(0, two.prefixes, 0),
    )


RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_next bigint"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(KINDS)]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id with fingerprints of the text and the edited text and their likeness."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", whole(F.col("text")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("uid", F.monotonically_increasing_id())
    laid = rows.repartitionByRange("doc_id", "tie", "uid").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        powers, part, last, last_id = Powers(), TaskContext.get().partitionId(), None, None

        def aside(ids, text, edge):
            return pa.RecordBatch.from_arrays(
                [ids, *[pa.nulls(1, k) for k in KINDS], pa.array([part], pa.int32()), pa.array([edge]), pa.array([text])], names=["doc_id", *NAMES, "part", "edge", "text"]
            )

        for batch in batches:
            results, ids = [], batch.column("doc_id")
            for i, text in enumerate(batch.column("text")):
                this = Document(text.as_py(), powers)
                if last is None:
                    yield aside(ids.slice(i, 1), this.prefixes.text, "first")
                else:
                    results.append(against_next(last, this))
                last = this
            owners = ids if last_id is None else pa.concat_arrays([last_id, ids])
            n, last_id = len(results), ids.slice(len(ids) - 1, 1) if len(ids) else last_id
            if n:
                extra = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays([owners.slice(0, n), *_columns(results), *extra], names=["doc_id", *NAMES, "part", "edge", "text"])
        if last is not None:
            yield aside(last_id, last.prefixes.text, "last")

    inner = materialize(laid.mapInArrow(run, f"doc_id {kind}, {RESULT}, part int, edge string, text string"))
    return inner.where("edge IS NULL").select("doc_id", *NAMES).unionByName(_across(inner, kind))


def _across(inner: DataFrame, kind: str) -> DataFrame:
    """Results of the last document of each partition: two texts per partition."""
    first = inner.where("edge = 'first'").select("part", F.col("text").alias("next"))
    order = Window.orderBy("part")
    start = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = first.select("part").select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(start)).alias("after"))
    pairs = (
        inner.where("edge = 'last'").select("part", "doc_id", "text").join(follows, "part")
        .join(first.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "next")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("next").to_pylist())
            results = [against_next(Document(a, powers), Document(b, powers)) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_columns(results)], names=["doc_id", *NAMES])

    return pairs.mapInArrow(run, f"doc_id {kind}, {RESULT}")

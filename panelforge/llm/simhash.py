"""SimHash near-duplicates through an inverted index on byte positions.

A fingerprint has eight bytes. Two fingerprints that differ in at most four bits share at least
four bytes at equal positions, the guaranteed minimum. A posting list of a single positional byte
would hold a 256th of the corpus, so lists are kept for 20 choices of three positions, made so that
any four positions hold one of them: every pair with four shared bytes meets, and so do pairs with
three. Within a list the positional bytes that a pair shares are tallied, pairs below the minimum
are dropped, and the rest is verified by counting differing bits.

Copies share a fingerprint and are one entry. A list passes its links on as a spanning forest, not
as all pairs. Lists above ``DENSE`` entries (many variants of one text) are never held by a task:
two of their fingerprints are linked exactly if some value lies within two bits of each, so every
entry is posted under the 821 such values of its 40 free bits and points to the smallest entry of
each; this is exact and grows with the entries, not with their pairs.

Python runs inside tasks only: hashing of shingles, and NumPy on postings sorted by key.

Defined results: a missing or empty text has fingerprint zero and is linked like any other; the
component's id is its smallest ``doc_id`` (missing ids are ignored); repeated rows each get a row;
an empty table gives an empty result; other columns are ignored (``one_per_component`` keeps them).
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from panelforge.llm.components import components
from panelforge.session import broadcast_checked, materialize

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 4
WORDS = 4
SEED = 42
DENSE = 1024
# Positions in three groups: three of a group, or two of a group and one of the next.
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
CHOICES = tuple(
    [c for g in GROUPS for c in itertools.combinations(g, 3)]
    + [(*two, one) for g, after in zip(GROUPS, GROUPS[1:] + GROUPS[:1]) for two in itertools.combinations(g, 2) for one in after]
)
# Values within two bits of an entry in the 40 bits that a list leaves free.
NEAR = 1 + 40 + 40 * 39 // 2
# Hashes tallied at a time, which bounds the memory of a very long text.
TALLIED = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the lower-cased shingles; bytes.split() splits at exactly U+0009-U+000D and U+0020."""
    from xxhash import xxh64_intdigest as hashed

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    starts, ends = starts[:n], ends[min(words, len(parts)) - 1 :]
    tally = np.zeros(64, np.int64)
    for i in range(0, n, TALLIED):
        spans = zip(starts[i : i + TALLIED].tolist(), ends[i : i + TALLIED].tolist())
        h = np.array([hashed(joined[s:e], SEED) for s, e in spans], "<u8")
        tally += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(tally * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column("text")], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _posting(choice: int) -> Column:
    """Number of the choice of positions, then the three bytes at them."""
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(0xFF)) for p in CHOICES[choice]]
    key = F.lit(choice << 24).cast("long")
    for i, b in enumerate(byte):
        key = key.bitwiseOR(F.shiftleft(b, 8 * i))
    return key


def tallied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positional bytes that fingerprints share."""
    return ((a ^ b)[..., None].view("u1") == 0).sum(-1)


def _linked(fp: np.ndarray) -> np.ndarray:
    """Boolean matrix of links: pairs that reach the guaranteed shared bytes, then verified by bits."""
    out = np.zeros((len(fp), len(fp)), bool)
    i, j = np.nonzero(tallied(fp[:, None], fp[None, :]) >= 8 - BITS)
    out[i, j] = np.bitwise_count(fp[i] ^ fp[j]) <= BITS
    return out


def _forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """(member, first member reached) for each component of the list's links."""
    adjacent, left, out = _linked(fp), np.ones(len(fp), bool), []
    for i in range(len(fp)):
        if left[i]:
            front = reached = adjacent[i] & left
            while front.any():
                left &= ~front
                front = adjacent[front].any(0) & left
                reached = reached | front
            out += [(int(fp[j]), int(fp[i])) for j in np.flatnonzero(reached) if j != i]
    return out


def _read_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the posting lists in a partition sorted by key; entries of dense lists as they are."""
    key, fp, dense = np.empty(0, "i8"), np.empty(0, "<u8"), None

    def rows(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    def closed(key, fp):
        cuts = np.flatnonzero(np.diff(key)) + 1
        begin, size = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(key)])))
        two = begin[size == 2]
        two = two[tallied(fp[two], fp[two + 1]) >= 8 - BITS]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= BITS]
        yield rows(0, fp[near].view("<i8"), fp[near + 1].view("<i8"))
        for s, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
            if n > DENSE:
                yield rows(1, fp[s : s + n].view("<i8"), key[s : s + n])
            elif pairs := _forest(fp[s : s + n]):
                a, b = np.array(pairs, "<u8").view("<i8").T
                yield rows(0, np.ascontiguousarray(a), np.ascontiguousarray(b))

    for batch in batches:
        key = np.concatenate((key, batch.column("key").to_numpy()))
        fp = np.concatenate((fp, batch.column("fp").to_numpy().view("<u8")))
        if dense is not None:
            n = int(np.searchsorted(key, dense, "right"))
            yield rows(1, fp[:n].view("<i8"), key[:n])
            key, fp = key[n:], fp[n:]
            dense = dense if not len(key) else None
        if len(key):
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from closed(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
            if len(key) > DENSE:
                dense = int(key[-1])
                yield rows(1, fp.view("<i8"), key)
                key, fp = key[:0], fp[:0]
    if len(key):
        yield from closed(key, fp)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each entry of a dense list the values within two bits of it, in the list's free bits."""
    masks = []
    for choice in CHOICES:
        bits = [1 << (8 * p + i) for p in range(8) if p not in choice for i in range(8)]
        masks.append(np.array([0, *bits, *(x | y for x, y in itertools.combinations(bits, 2))], "<u8"))
    for batch in batches:
        fp, key = batch.column("fp").to_numpy(), batch.column("key").to_numpy()
        for s in range(0, len(fp), 256):
            part, keys = fp[s : s + 256], key[s : s + 256]
            mids = np.concatenate([p.view("<u8") ^ masks[k >> 24] for p, k in zip(part.reshape(-1, 1), keys.tolist())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(keys, NEAR)), pa.array(mids.view("<i8")), pa.array(np.repeat(part, NEAR))], names=["key", "mid", "fp"]
            )


def links(entries: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``BITS`` bits; ``entries`` has distinct fp."""
    # Entries may stand in a few small files; their postings are made by as many tasks as read them.
    spread = entries.select("fp").repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    postings = spread.select("fp", F.explode(F.array(*[_posting(i) for i in range(len(CHOICES))])).alias("key"))
    sorted_ = postings.repartition("key").sortWithinPartitions("key").select("key", "fp")
    found = materialize(sorted_.mapInArrow(_read_postings, "kind int, a bigint, b bigint"))
    out = found.where("kind = 0").select("a", "b")
    dense = found.where("kind = 1").select(F.col("a").alias("fp"), F.col("b").alias("key"))
    if not dense.isEmpty():
        mids = dense.repartition("fp").mapInArrow(_between, "key bigint, mid bigint, fp bigint")
        first = mids.groupBy("key", "mid").agg(F.min("fp").alias("first"))
        out = out.unionByName(mids.join(first, ["key", "mid"]).where("fp != first").select(F.col("fp").alias("a"), F.col("first").alias("b")))
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows = materialize(fingerprints(docs))
    entries = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(entries.select("fp")))
    placed = materialize(entries.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    # Components of several fingerprints, counted before they are sent to every task.
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members")).where("members > 1")
    named = placed.join(broadcast_checked(materialize(ids.drop("members"))), "root", "left")
    return rows.join(named.select("fp", F.coalesce("component_id", "first").alias("component_id")), "fp")


def one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of each component's smallest ``doc_id``, all columns kept. Rows without id stay."""
    kept = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_id"], "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))

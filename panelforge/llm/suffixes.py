"""Removal of repeated passages by a distributed suffix array over sampled suffixes.

A byte goes when a window of ``least`` bytes that covers it also starts anywhere else. Sorting the
suffix at every byte would shuffle many times the corpus, so suffixes start at content-defined
places: every window owns the place of the smallest hash of eight bytes among its first ``reach``
bytes (the first of equal ones). Equal windows own the same place at the same distance, and all
windows of a place share its *core*, the ``least - reach + 1`` bytes from there on. The windows of
a place together cover its *context*. A suffix is known by its leading tokens: its first eight
bytes, its core, its context.

1. Range partitions with sampled splitters (``repartitionByRange``) order the suffixes by leading
   tokens; place and text are the last keys, so one token's suffixes may fill many buckets. A
   bucket sorts by multikey quicksort and counts the tokens that neighbours share; the first and
   last suffix of a bucket meet those of the adjoining buckets. Three shared tokens: all windows
   of the place repeat. Fewer than two: none does.
2. Suffixes at the border of two contexts with one core stand for their contexts. Their windows are
   hashed one by one. They are ordered by core in the same way; a bucket decides the cores that
   lie inside it, and windows of the cores at its ends are ordered and compared over all buckets.

Results depend on the texts alone, so tables are keyed by two 64-bit hashes of the text, and each
hash comparison rests on 128 bits (core and context, core and window). Nothing is gathered per
core, passage or group of copies.

Defined results: missing texts are empty; texts below ``least`` bytes lose nothing; equal texts,
also in rows repeated with their id, lose everything from ``least`` bytes on; a cut may leave
broken UTF-8 sequences, so what stays is bytes; rows keep whatever id they have, missing ones
included; an empty table gives an empty result; other columns are ignored.
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

# Parameters: shortest repeat in bytes, and the first bytes of a window that may own its place.
LEAST = 400
REACH = 128
# Odd multipliers of the hash of eight bytes.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
SMALL = 1024
ROWS = 65_536


def places(data: bytes, least: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of all windows of a text, in order."""
    n = len(data) - least + 1
    raw = np.frombuffer(data, "u1")
    grams = np.lib.stride_tricks.sliding_window_view(np.concatenate((raw[: n + reach + 6], np.zeros(8, "u1"))), 8)[: n + reach - 1]
    h = np.ascontiguousarray(grams).view("<u8").ravel() * MIX[0]
    h ^= h >> np.uint64(29)
    h *= MIX[1]
    # High half: hash; low half: position, so that a minimum is the first of equal hashes.
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(len(h), dtype="u8")
    blocks = -(-len(h) // reach)
    padded = np.full(blocks * reach, 2**64 - 1, "u8")
    padded[: len(h)] = h
    padded = padded.reshape(blocks, reach)
    after = np.minimum.accumulate(padded, axis=1).ravel()
    before = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    lowest = np.minimum(before[:n], after[reach - 1 : reach - 1 + n])
    first = np.flatnonzero(np.concatenate(([True], lowest[1:] != lowest[:-1])))
    return (lowest[first] & np.uint64(0xFFFFFFFF)).astype("i8"), first, np.append(first[1:] - 1, n - 1)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, "u8").view("i8")


SUFFIX = "t0 bigint, t1 bigint, t2 bigint, k1 bigint, k2 bigint, place bigint, low bigint, high bigint"
SUFFIX_NAMES = [c.split()[0] for c in SUFFIX.split(", ")]


def sampled_suffixes(keyed: DataFrame, least: int, reach: int) -> DataFrame:
    """One row per place with its leading tokens; ``low`` and ``high`` are its first and last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, core = xxhash.xxh3_64_intdigest, least - reach + 1
        parts, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=SUFFIX_NAMES)

        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for i, value in enumerate(batch.column("data")):
                data = value.as_py()
                if len(data) < least:
                    continue
                at, low, high = places(data, least, reach)
                view, n = memoryview(data), len(at)
                spots = list(zip(at.tolist(), low.tolist(), high.tolist()))
                t0 = np.frombuffer(b"".join([data[p : p + 8] for p in at.tolist()]), ">u8").astype("u8").view("i8") if core >= 8 else at * 0
                t1 = _signed([digest(view[p : p + core]) for p in at.tolist()])
                # The distance of the windows from the place is part of the context.
                t2 = _signed([digest(view[a : b + least], (p - a) * 65_537 + b - a) for p, a, b in spots])
                parts.append((t0, t1, t2, np.full(n, k1[i]), np.full(n, k2[i]), at, low, high))
                held += n
                if held >= ROWS:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    return keyed.mapInArrow(run, SUFFIX)


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Positions in token order: three-way partitions by one token, equal parts by the next."""
    n = len(tokens[0])
    order, open_ = np.arange(n), [(0, n, 0)]
    while open_:
        start, end, depth = open_.pop()
        if end - start < 2 or depth == len(tokens):
            continue
        part = order[start:end]
        if end - start <= SMALL:
            order[start:end] = part[np.lexsort([t[part] for t in reversed(tokens[depth:])])]
            continue
        values = tokens[depth][part]
        pivot = np.partition(values[:: max(1, len(values) // 63)], -1 + min(63, len(values)) // 2)[min(63, len(values)) // 2 - 1]
        less, more = values < pivot, values > pivot
        a, b = start + int(less.sum()), end - int(more.sum())
        order[start:end] = np.concatenate((part[less], part[~(less | more)], part[more]))
        open_ += [(start, a, depth), (a, b, depth + 1), (b, end, depth)]
    return order


def shared_tokens(columns: list[np.ndarray]) -> np.ndarray:
    """Leading tokens that each row shares with the one before it."""
    n = len(columns[0])
    shared, same = np.zeros(n, "i4"), np.ones(max(0, n - 1), bool)
    for c in columns:
        same &= c[1:] == c[:-1]
        shared[1:] += same
    return shared


def _bucket(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches).combine_chunks() if batches else None


def suffix_order(rows: DataFrame, tokens: list[str], ties: list[str], keep: int) -> DataFrame:
    """Rows that share at least ``keep`` leading tokens with a neighbour in the order of all rows.

    Adds ``prev`` and ``next``, the numbers of shared tokens. Two rows per bucket meet those of the
    adjoining buckets.
    """
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", prev int, next int, part int, edge int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = _bucket(batches)
        if table is None:
            return
        order = multikey_order([table[t].to_numpy() for t in tokens])
        columns = [table[t].to_numpy()[order] for t in tokens]
        prev = shared_tokens(columns)
        following, edge = np.append(prev[1:], 0).astype("i4"), np.zeros(len(order), "i4")
        edge[0] |= 1
        edge[-1] |= 2
        chosen = (prev >= keep) | (following >= keep) | (edge > 0)
        found = table.take(pa.array(order[chosen]))
        part = np.full(int(chosen.sum()), TaskContext.get().partitionId(), "i4")
        for name, values in (("prev", prev[chosen]), ("next", following[chosen]), ("part", part), ("edge", edge[chosen])):
            found = found.append_column(name, pa.array(values))
        yield from found.to_batches(ROWS)

    ordered = materialize(rows.repartitionByRange(*tokens, *ties).mapInArrow(run, schema))
    # At most two rows per bucket.
    line = Window.orderBy("part", "edge")
    with_other = ordered.where("edge > 0").select(
        "*", *[F.lag(t).over(line).alias(f"{t}_before") for t in tokens], *[F.lead(t).over(line).alias(f"{t}_after") for t in tokens]
    )

    def common(side):
        count, same = F.lit(0), F.lit(True)
        for t in tokens:
            same = same & F.coalesce(F.col(t) == F.col(f"{t}_{side}"), F.lit(False))
            count = count + same.cast("int")
        return count

    first, last = F.col("edge").bitwiseAND(1) > 0, F.col("edge").bitwiseAND(2) > 0
    edges = with_other.select(
        *rows.columns, F.when(first, common("before")).otherwise(F.col("prev")).alias("prev"),
        F.when(last, common("after")).otherwise(F.col("next")).alias("next"),
    )
    inner = ordered.where("edge = 0").select(*rows.columns, "prev", "next")
    return inner.unionByName(edges).where((F.col("prev") >= keep) | (F.col("next") >= keep))


STAND = "t1 bigint, k1 bigint, k2 bigint, place bigint, low bigint, single boolean, data binary"
SEEN = "t1 bigint, w bigint, k1 bigint, k2 bigint, low bigint, wanted boolean"
SEEN_NAMES = [c.split()[0] for c in SEEN.split(", ")]


def _contexts(stands: DataFrame, keyed: DataFrame, least: int) -> DataFrame:
    """The bytes of the contexts of ``stands``, cut from one copy of each text."""
    spots = F.collect_list(F.struct("t1", "place", "low", "high", "single"))
    lists = stands.dropDuplicates(["k1", "k2", "place"]).groupBy("k1", "k2").agg(spots.alias("spots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            rows = []
            for k1, k2, data, spots in zip(*(batch.column(c) for c in ("k1", "k2", "data", "spots"))):
                key = (k1.as_py(), k2.as_py())
                if key in seen:
                    continue
                seen.add(key)
                data = data.as_py()
                for s in spots.as_py():
                    rows.append((s["t1"], *key, s["place"], s["low"], s["single"], data[s["low"] : s["high"] + least]))
                if len(rows) >= ROWS // 16:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=STAND_NAMES)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=STAND_NAMES)

    return keyed.join(lists, ["k1", "k2"]).select("k1", "k2", "data", "spots").mapInArrow(run, STAND)


STAND_NAMES = [c.split()[0] for c in STAND.split(", ")]


def repeated_windows(contexts: DataFrame, least: int) -> DataFrame:
    """(k1, k2, low, high): windows of single contexts that another context holds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, table = xxhash.xxh3_64_intdigest, _bucket(batches)
        if table is None:
            return
        core = table["t1"].to_numpy()
        order = multikey_order([core])
        starts = np.flatnonzero(np.concatenate(([True], core[order][1:] != core[order][:-1])))
        ends, last = np.append(starts[1:], len(order)), len(starts) - 1
        k1, k2, place, low = (table[c].to_numpy() for c in ("k1", "k2", "place", "low"))
        single, data = table["single"].to_pylist(), table["data"]
        rows, held = [], 0

        def decide(i, a, b):
            """Row numbers, starts and hashes of the windows of one core, and which hashes are the first of their kind."""
            owner, at, hashes = [], [], []
            for r in order[a:b].tolist():
                view, s = memoryview(data[r].as_py()), int(low[r])
                n, ahead = len(view) - least + 1, int(place[r]) - s
                hashes += [digest(view[o : o + least], ahead - o) for o in range(n)]
                owner += [r] * n
                at += range(s, s + n)
            owner, at, hashes = np.array(owner), np.array(at), _signed(hashes)
            _, first, inverse, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            twice, wanted = count[inverse] > 1, np.array([single[r] for r in owner.tolist()])
            chosen = twice & wanted
            yield k1[owner[chosen]], k2[owner[chosen]], at[chosen], np.ones(int(chosen.sum()), bool), hashes[chosen], core[owner[chosen]]
            if i in (0, last):  # the core may go on in the next bucket: one row per hash is compared there
                yield k1[owner[first]], k2[owner[first]], at[first], (wanted & ~twice)[first], hashes[first], core[owner[first]], "open"

        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            if b - a < 2 and i not in (0, last):
                continue
            for x in decide(i, a, b):
                n = len(x[0])
                rows.append((x[5], x[4], x[0], x[1], x[2], x[3], np.full(n, len(x) < 7)))
                held += n
            if held >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=[*SEEN_NAMES, "final"])
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=[*SEEN_NAMES, "final"])

    seen = materialize(contexts.repartitionByRange("t1", "k1", "k2", "place").mapInArrow(run, f"{SEEN}, final boolean"))
    across = suffix_order(seen.where("NOT final").drop("final"), ["t1", "w"], ["k1", "k2", "low"], 2)
    return seen.where("final").select("k1", "k2", "low").unionByName(across.where("wanted").select("k1", "k2", "low"))


def key_of(docs: DataFrame) -> DataFrame:
    """Rows with the bytes of the text and its two hashes."""
    text = whole(F.col("text"))
    return docs.select("doc_id", text.cast("binary").alias("data"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def repeated_spans(docs: DataFrame, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """(k1, k2, spans): per text, byte ranges (start, end) that repeat; ranges may overlap."""
    keyed = key_of(docs)
    suffixes = sampled_suffixes(keyed.where(F.length("data") >= least), least, reach)
    ordered = materialize(suffix_order(suffixes, ["t0", "t1", "t2"], ["k1", "k2", "place"], 2))
    whole_context = (F.col("prev") == 3) | (F.col("next") == 3)
    border = (F.col("prev") == 2) | (F.col("next") == 2)
    stands = ordered.where(border).withColumn("single", ~whole_context)
    windows = repeated_windows(_contexts(stands, keyed.where(F.length("data") >= least), least), least)
    ranges = ordered.where(whole_context).select("k1", "k2", "low", (F.col("high") + least).alias("end"))
    ranges = ranges.unionByName(windows.select("k1", "k2", "low", (F.col("low") + least).alias("end")))
    return ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct(F.col("low").alias("start"), "end")).alias("spans"))


def merged(spans: list[dict]) -> list[list[int]]:
    """Sorted ranges, overlapping and touching ones joined."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def without_repeats(docs: DataFrame, least: int = LEAST, reach: int = REACH, *, kept: bool = True) -> DataFrame:
    """doc_id, sizes, digest of what stays and, unless ``kept`` is off, the bytes that stay."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = materialize(repeated_spans(docs, least, reach))
    schema = f"doc_id {kind}, {RESULT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, spans in zip(batch.column("data"), batch.column("spans")):
                data = data.as_py()
                cuts = merged(spans.as_py() or [])
                edges = [0, *[e for cut in cuts for e in cut], len(data)]
                rest = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])]) if cuts else data
                rows.append((len(data), len(data) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(), rest if kept else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=pa.schema([batch.schema.field("doc_id"), *[(c.split()[0], k) for c, k in zip(RESULT.split(", "), kinds)]]))

    return key_of(docs).join(spans, ["k1", "k2"], "left").select("doc_id", "data", "spans").mapInArrow(run, schema)

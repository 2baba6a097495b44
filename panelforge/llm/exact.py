"""Exact deduplication with an extendible-hash index on shared files.

Texts are compared after replacing each run of white space by one space. Keys (64-bit hash and
SHA-256 of that text) are written once to shared files. The directory addresses buckets by the
leading bits of the hash: it starts at the depth the number of hashes calls for, and buckets above
their capacity are split by one more bit until none is overfull. Every key is routed to its bucket;
an owner task holds a range of buckets, and there keys of one hash form a chain whose entries are
told apart by their digests: the smallest id and the number of copies of an entry are decided
inside its bucket. Copies of a task collapse before they are sent, so a text with any number of
copies sends a few rows to its owner. The texts behind repeated hashes are then compared byte by
byte.

Only DataFrame operations are used. Texts are not shuffled, except those whose hash occurs more
than once, and copies of these collapse before the shuffle.

Defined results: a missing text counts as empty; among equal texts the smallest ``doc_id`` stays
(missing ids last), and of rows tied on it exactly one; an empty table gives an empty result;
other columns are ignored (``deduplicated`` keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.llm.text import single_spaced
from panelforge.session import broadcast_checked, broadcast_limit, materialize

CAPACITY = 50_000


def keys_of(docs: DataFrame) -> DataFrame:
    """doc_id, hash and digest of the single-spaced text, written to the shared folder."""
    text = single_spaced(F.col("text"))
    return materialize(
        docs.select("doc_id", text.alias("_t")).select("doc_id", F.xxhash64("_t").alias("hash"), F.sha2("_t", 256).alias("sha"))
        .withColumn("uid", F.monotonically_increasing_id())
    )


def _prefix(depth: Column) -> Column:
    """The leading bits of the hash; all hashes have prefix 0 at depth 0."""
    return F.when(depth > 0, F.expr("shiftrightunsigned(hash, 64 - depth)")).otherwise(F.lit(0).cast("long"))


def directory(hashes: DataFrame, capacity: int) -> DataFrame:
    """The buckets (depth, bucket): leading bits under which no more than ``capacity`` hashes stand.

    ``hashes`` are distinct. A bucket at the full 64 bits holds one hash and cannot be split.
    """
    n = hashes.count()
    depth = max(0, math.ceil(math.log2(n / capacity))) if n > capacity else 0
    whole, open_ = None, hashes
    while True:
        sizes = materialize(
            open_.withColumn("depth", F.lit(depth)).withColumn("bucket", _prefix(F.col("depth"))).groupBy("depth", "bucket").agg(F.count(F.lit(1)).alias("size"))
        )
        fits = sizes.where((F.col("size") <= capacity) | (F.col("depth") == 64)).select("depth", "bucket")
        whole = fits if whole is None else whole.unionByName(fits)
        full = sizes.where((F.col("size") > capacity) & (F.col("depth") < 64)).select("bucket")
        if full.isEmpty():
            return whole
        # Only hashes of overfull buckets are looked at again, one bit deeper.
        open_ = open_.withColumn("depth", F.lit(depth)).withColumn("bucket", _prefix(F.col("depth"))).join(broadcast_checked(full), "bucket", "left_semi").select("hash")
        depth += 1


def routed(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Keys with the depth and number of their bucket, found in the directory."""
    buckets = materialize(directory(materialize(keys.select("hash").distinct()), capacity))
    depths = [r.depth for r in buckets.select("depth").distinct().collect()]  # 64 at most
    out = None
    for depth in depths:
        at = keys.withColumn("depth", F.lit(depth)).withColumn("bucket", _prefix(F.col("depth")))
        part = at.join(broadcast_checked(buckets.where(F.col("depth") == depth)), ["depth", "bucket"])
        out = part if out is None else out.unionByName(part)
    return out if out is not None else keys.withColumn("depth", F.lit(0)).withColumn("bucket", F.lit(0).cast("long"))


def index(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index: one entry per distinct text of a bucket, decided by the bucket's owner.

    ``keys`` are routed. Copies within a task collapse first; the rest goes to owners by ranges of
    buckets, which group the chain of every hash by digest where it arrives.
    """
    first = lambda c: F.min(c).alias("first")
    mine = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "uid")
    partial = keys.groupBy(F.spark_partition_id().alias("task"), "depth", "bucket", "hash", "sha").agg(first(mine), F.count(F.lit(1)).alias("n"))
    partial = materialize(partial.drop("task"))
    # Position of the bucket's first key among all keys: owners hold contiguous ranges.
    start = F.when(F.col("depth") > 0, F.expr("shiftleft(bucket, 64 - depth)")).otherwise(F.lit(0).cast("long"))
    owners = max(1, math.ceil(partial.count() / capacity) * 2)
    sent = partial.withColumn("start", start.bitwiseXOR(F.lit(-(2**63)))).repartitionByRange(owners, "start", "hash", "sha")
    entries = sent.groupBy("start", "depth", "bucket", "hash", "sha").agg(first("first"), F.sum("n").alias("n"))
    return materialize(entries.select("depth", "bucket", "hash", "sha", F.col("first.doc_id").alias("keep_id"), F.col("first.uid").alias("keep_uid"), "n"))


def _repeated(entries: DataFrame) -> DataFrame:
    """Hashes met more than once, by copies or by collision."""
    return materialize(entries.groupBy("hash").agg(F.sum("n").alias("rows")).where("rows > 1").select("hash"))


def compare_bytes(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries with copies whose texts were compared whole; a mismatch stops the job."""
    text = docs.select(single_spaced(F.col("text")).alias("_t")).select("_t", F.xxhash64("_t").alias("hash"))
    seen = text.join(broadcast_checked(_repeated(entries)), "hash", "left_semi").groupBy("hash", "_t").count()
    found = seen.select("hash", F.sha2("_t", 256).alias("sha"), F.col("count").alias("_same"))
    joined = found.join(entries, ["hash", "sha"])
    wrong = F.raise_error(F.lit("different texts share a digest"))
    n = F.when(F.col("n") == F.col("_same"), F.col("n")).otherwise(wrong)
    return joined.where("n > 1").select("bucket", "hash", "sha", "keep_id", "keep_uid", n.alias("n"))


def groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    keys = routed(keys_of(docs), capacity)
    copies = compare_bytes(docs, index(keys, capacity))
    out = keys.join(copies, ["bucket", "hash", "sha"], "left")
    alone = F.col("n").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows whose hash is unique pass where they are. The others meet their entry by a join, and
    one of the rows tied on the entry's id is kept.
    """
    entries = index(routed(keys_of(docs), capacity), capacity)
    copies = materialize(compare_bytes(docs, entries))
    hashes = _repeated(entries)
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), single_spaced(docs["text"]).alias("_t"))
    wide = wide.select("_row", "_id", F.xxhash64("_t").alias("hash"), F.sha2("_t", 256).alias("sha"))
    small = hashes.limit(broadcast_limit(docs.sparkSession) + 1).count() <= broadcast_limit(docs.sparkSession)
    known = F.broadcast(hashes) if small else hashes
    alone = wide.join(known, "hash", "left_anti").select("_row")
    met = wide.join(known, "hash", "left_semi").join(copies, ["hash", "sha"], "left")
    # A hash may repeat by collision only; such rows have no entry with copies and stay.
    single = met.where("n IS NULL").select("_row")
    first = met.where(F.col("n").isNotNull() & F.col("_id").eqNullSafe(F.col("keep_id")))
    tied = first.groupBy("hash", "sha").agg(F.first("_row").alias("_row")).select("_row")
    return alone.unionByName(single).unionByName(tied).select("_row.*")

"""WARC archives with an index, written and read by ranges.

Writing: each task appends one gzip member per record to archives of its own in the shared folder
and returns the index: file, offset, length, URL and digest per record. Archive names are new for
each attempt and the index is committed by Spark, so a repeated task leaves no trace in it.

Payloads that occur more than once are found by a narrow aggregation of their digests. The page
with the smallest id holds the payload as a response, the others are revisits that refer to it.
Payloads are not shuffled while the repeated digests are few enough to broadcast.

Reading: the selected index rows are sorted by file and offset, neighbouring byte ranges are
coalesced into one read of bounded size, and each record is unpacked and its digest checked.

Defined results: a missing html is an empty payload, and empty payloads are equal like any
others (``least`` sets the payload size from which revisits are written); rows that share the
smallest id of a payload are all responses; a missing ``page_id`` counts as the largest; a missing
url leaves out the target header; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from panelforge.llm.text import whole
from panelforge.session import broadcast_checked, materialize, work_folder

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ARCHIVE_BYTES = 1 << 28
# Ranges at most this far apart are read together, up to so many bytes.
GAP = 1 << 16
READ_BYTES = 1 << 23
# Archive bytes that one task reads.
TASK_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"
# Fixed value: the profile of revisits with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset bigint, length bigint, url string, digest string, record_type string, payload_bytes bigint"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given by URI or absolute path."""
    return fs.FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, not yet compressed."""
    head = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()]
    revisit = refers_to is not None
    block = head[0] + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, payload and payload size of one record; a damaged record raises."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    if first != "WARC/1.1" or len(rest) != int(headers["Content-Length"]) + 4:
        raise ValueError("damaged record")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")).split()[1])
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("payload does not match its digest")
    named = lambda x: x.removeprefix("<urn:page:").removesuffix(">") or None
    url = headers.get("WARC-Target-URI")
    return {
        "page_id": named(headers["WARC-Record-ID"]), "refers_to": named(headers.get("WARC-Refers-To", "")), "record_type": kind, "digest": digest,
        "payload_bytes": size, "payload": payload if kind == "response" else None,
        "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
    }


def write(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row below ``folder`` and returns the index with page_id and refers_to."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", whole(F.col("html")).alias("html")).withColumn("sha", F.sha2("html", 256))
    repeated = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = materialize(repeated.where("n > 1 AND first IS NOT NULL").select("sha", "first"))
    known = rows.join(broadcast_checked(repeated), "sha", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        out = name = None
        at = 0
        try:
            for batch in batches:
                index, urls = [], batch.column("url").to_pylist()
                for i, html in enumerate(batch.column("html")):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    payload = html.as_py().encode()
                    digest, refers_to = payload_digest(payload), batch.column("refers_to")[i].as_py()
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record(batch.column("page_id")[i].as_py(), urls[i], payload, digest, refers_to)) + packer.flush()
                    out.write(member)
                    index.append((f"{folder}/{name}", at, len(member), urls[i], digest, "response" if refers_to is None else "revisit", len(payload)))
                    at += len(member)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                columns = [pa.array([r[k] for r in index], t) for k, t in enumerate(kinds)]
                names = [c.split()[0] for c in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("refers_to"), *columns], names=["page_id", "refers_to", *names])
        finally:
            if out is not None:
                out.close()

    written = known.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(run, f"page_id {kind}, refers_to {kind}, {INDEX}")
    return materialize(written)


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, begin, end, positions) of the reads that cover sorted (file, offset, length) rows."""
    open_ = None
    for i, (file, offset, length) in enumerate(rows):
        if open_ and file == open_[0] and offset - open_[2] <= GAP and offset + length - open_[1] <= READ_BYTES:
            open_ = (file, open_[1], max(open_[2], offset + length), [*open_[3], i])
        else:
            if open_:
                yield open_
            open_ = (file, offset, offset + length, [i])
    if open_:
        yield open_


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, the
    payload (missing for revisits) of the selected index rows."""
    kind = index.schema["page_id"].dataType.simpleString()
    selected = index.select("file", "offset", "length")
    # The index is tiny beside the archives it stands for, so tasks are counted by the bytes they read.
    tasks = max(1, -(-(selected.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    order = selected.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, system = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")))), None
            for file, begin, end, members in ranges(rows):
                system, path = open_folder(file)
                with system.open_input_file(path) as source:
                    source.seek(begin)
                    block = source.read(end - begin)
                out = []
                for i in members:
                    _, offset, length = rows[i]
                    out.append(parse(zlib.decompress(block[offset - begin : offset - begin + length], 31)))
                text, number = pa.string(), pa.int64()
                columns = [("page_id", text), ("url", text), ("payload_bytes", number), ("digest", text), ("record_type", text), ("refers_to", text)]
                columns += [("payload", pa.binary())] if payload else []
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in columns], names=[n for n, _ in columns])

    kinds = "page_id string, url string, payload_bytes bigint, digest string, record_type string, refers_to string" + ", payload binary" * payload
    found = order.mapInArrow(run, kinds).withColumnRenamed("digest", "payload_digest")
    return found.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def archive_folder(df: DataFrame) -> str:
    """A new folder for archives in the session's shared folder, as a URI."""
    folder = f"{work_folder(df.sparkSession)}/warc-{uuid.uuid4().hex}"
    return folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:", "file://", 1)

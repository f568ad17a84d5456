"""WARC archives: written with an index, read back by coalesced byte ranges.

Each task writes archives of its own, one gzip member for each record, and returns
the index: file, offset, length, URL and digest of every record.  The index is kept
as a table; whoever wants records selects rows of it, and tasks read the selected
ranges in file order, neighbouring ones at once.

A task that is retried writes new files under new names and returns their index
rows; files of lost attempts are in no index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_path, slices, text_or_empty, written

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

INDEX = "page_id bigint, url string, payload_digest string, payload_bytes bigint, record_type string, refers_to bigint, file string, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, payload_digest string, payload_bytes bigint, record_type string, refers_to bigint, payload binary"


def qualified(spark: SparkSession, path: str) -> str:
    """path as a URI with the scheme that Spark would take."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def safe_uri(url: str) -> str:
    """The URL on one line: control characters, spaces at its ends and % before them are escaped."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)


def plain_uri(value: str) -> str:
    return re.sub(r"%([01][0-9A-F]|20|7F|25)", lambda m: chr(int(m[1], 16)), value)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record, not compressed.  A revisit has no block; its digest and length are its payload's."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if kind == "response" else head
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", EPOCH), ("WARC-Target-URI", None if url is None else safe_uri(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("X-Payload-Length", str(len(payload))),
        ("WARC-Profile", REVISIT_PROFILE if kind == "revisit" else None), ("WARC-Refers-To", record_id(refers_to) if kind == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    lines = [VERSION, *(f"{k}: {v}" for k, v in fields if v is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class WarcRecord:
    page_id: int | None
    url: str | None
    payload_digest: str
    payload_bytes: int
    record_type: str
    refers_to: int | None
    payload: bytes | None


def decode_record(data: bytes) -> WarcRecord:
    """A record from its bytes.  A response's payload must have the digest and length of its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != VERSION:
        raise ValueError(f"not a record of {VERSION}: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's block doesn't end where its header says")
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    digest, size = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), int(fields["X-Payload-Length"])
    if payload is not None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't the one that was written")
    url = fields.get("WARC-Target-URI")
    return WarcRecord(page_of(fields["WARC-Record-ID"]), None if url is None else plain_uri(url), digest, size, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To")), payload)


def with_revisits(pages: DataFrame, *, least_bytes: int = 1000, broadcast_groups: int = 200_000) -> DataFrame:
    """page_id, url, html with payload_digest, payload_bytes, record_type and refers_to.

    Of pages with equal payloads of least_bytes or more, that with the largest
    page_id is the response (each row of it, if it is repeated) and the others revisit
    it.  If all their ids are null, all are responses.  Payloads meet by digest and
    length, so that no text is shuffled unless the groups of copies are more than
    broadcast_groups.
    """
    payload = text_or_empty("html").cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    same = ["payload_digest", "payload_bytes"]
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy(*same).agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 and kept is not null").drop("n")
    groups = written(groups, "warc-copies")
    if groups.count() <= broadcast_groups:
        groups = F.broadcast(groups)
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return rows.join(groups, same, "left").select(
        "page_id", "url", "html", *same, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept")).alias("refers_to")
    )


def write_archives(records: DataFrame, path: str, *, archive_bytes: int = 256 << 20) -> DataFrame:
    """Writes `with_revisits`' rows to archives below path and returns the index, a table beside them.

    An archive is closed when it has archive_bytes; each starts with a warcinfo record.
    """
    spark = records.sparkSession
    root = qualified(spark, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in slices(batches, 2):
            index = []
            for page_id, url, html, digest, size, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                    info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
                    first = gzip.compress(f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {EPOCH}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n", 6, mtime=0)
                    out.write(first)
                    at = len(first)
                member = gzip.compress(encode_record(page_id, url, (html or "").encode(), digest, kind, refers_to), 6, mtime=0)
                out.write(member)
                index.append((page_id, url, digest, size, kind, refers_to, f"{root}/{name}", at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), INDEX_TYPES, strict=True)], INDEX_NAMES)
        if out is not None:
            out.close()

    ordered = records.select(F.col("page_id").cast("long"), "url", "html", "payload_digest", "payload_bytes", "record_type", F.col("refers_to").cast("long"))
    return written(ordered.mapInArrow(write, INDEX), "warc-index")


INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
INDEX_TYPES = [{"bigint": pa.int64(), "string": pa.string()}[c.split()[1]] for c in INDEX.split(", ")]


def ranges(rows: list[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, offset, length, numbers of rows) of reads that cover rows of (file, offset, length) in file order."""
    first = 0
    for i in range(1, len(rows) + 1):
        if i < len(rows):
            (file, at, n), (_, start, _) = rows[i], rows[first]
            end = rows[i - 1][1] + rows[i - 1][2]
            if file == rows[first][0] and at - end <= gap and at + n - start <= most:
                continue
        yield rows[first][0], rows[first][1], rows[i - 1][1] + rows[i - 1][2] - rows[first][1], list(range(first, i))
        first = i


def read_records(index: DataFrame, *, gap: int = 64 << 10, most: int = 8 << 20, task_bytes: int = 16 << 20) -> DataFrame:
    """The records that the rows of index point to, read from the archives.

    Rows are dealt by file and offset to as many tasks as the selected records have
    task_bytes: the index itself is small, and Spark would give all of it to one.
    Ranges less than gap bytes apart are read at once, up to `most` bytes.  A record whose
    bytes don't give its digest is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, object] = {}
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for file, at, n, covered in ranges(rows, gap, most):
                if file not in opened:
                    for f in opened.values():
                        f.close()
                    system, path = fs.FileSystem.from_uri(file)
                    opened = {file: system.open_input_file(path)}
                data = opened[file].read_at(n, at)
                found = [decode_record(gzip.decompress(data[rows[i][1] - at : rows[i][1] - at + rows[i][2]])) for i in covered]
                columns = [[getattr(r, c) for r in found] for c in RECORD_NAMES]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*INDEX_TYPES[:6], pa.binary()], strict=True)], RECORD_NAMES)
        for f in opened.values():
            f.close()

    where = index.select("file", "offset", "length")
    tasks = max(1, -(-(where.agg(F.sum("length")).first()[0] or 0) // task_bytes))
    return where.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, RECORDS)


RECORD_NAMES = [c.split()[0] for c in RECORDS.split(", ")]


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes every row of pages as a record, then reads all archives back.

    A null html is an empty payload, a null url gives a record without one, null ids
    stay null.  Repeated rows are records each; empty tables give no archive.
    """
    path = scratch_path(pages.sparkSession, "warc")
    return read_records(write_archives(with_revisits(pages), path))

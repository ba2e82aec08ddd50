"""WARC archives: a gzip member per record (operator 4)."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanwarden.llm.shared import in_batches, partitions, shared_folder, written

_VERSION = b"WARC/1.1\r\n"
_CHUNK = 1 << 18
_ARCHIVES = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32, as archives write it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit that has the response's headers only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        *([("WARC-Target-URI", _line(url))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if revisit else []),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>")] if revisit and refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return _VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member of its own."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """For each gzip member, its data piece by piece, decompressed as it is read."""
    rest = b""

    def one() -> Iterator[bytes]:
        nonlocal rest
        z = zlib.decompressobj(31)
        while not z.eof:
            data = rest or stream.read(_CHUNK)
            rest = b""
            if not data:
                raise ValueError("archive ends inside a record")
            piece = z.decompress(data, _CHUNK)
            while piece:
                yield piece
                piece = b"" if z.eof else z.decompress(z.unconsumed_tail, _CHUNK) if z.unconsumed_tail else b""
            rest = z.unused_data

    while rest or (rest := stream.read(_CHUNK)):
        yield one()


def read_records(stream: BinaryIO, with_payload: bool = False) -> Iterator[tuple]:
    """Reads records one after another: page id, url, payload bytes, digest, type, referred id, payload or None.

    A record is framed by its content length. The block's digest and, for responses, the payload's are computed as the
    data come and compared with the headers; any difference, missing end or excess raises ValueError.
    """
    for pieces in _members(stream):
        held = b""
        while b"\r\n\r\n" not in held:
            held += next(pieces, None) or _fail("record without headers")
        head, _, held = held.partition(b"\r\n\r\n")
        if not head.startswith(_VERSION):
            _fail("not a record")
        fields = dict(x.split(": ", 1) for x in head[len(_VERSION) :].decode().split("\r\n"))
        left = int(fields["Content-Length"])
        block, payload, http, kept, size = hashlib.sha1(), hashlib.sha1(), b"", [], 0
        inside = False
        while True:
            part, held = held[:left], held[left:]
            left -= len(part)
            block.update(part)
            if not inside:
                http += part
                if b"\r\n\r\n" in http:
                    http, _, part = http.partition(b"\r\n\r\n")
                    inside = True
                else:
                    part = b""
            if inside and part:
                payload.update(part)
                size += len(part)
                if with_payload:
                    kept.append(part)
            if not left:
                break
            held = next(pieces, None) or _fail("block shorter than its content length")
        held += b"".join(pieces)
        if held != b"\r\n\r\n":
            _fail("block longer than its content length")
        if f"sha1:{base64.b32encode(block.digest()).decode()}" != fields["WARC-Block-Digest"]:
            _fail("block digest differs")
        length = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
        told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = fields["WARC-Type"]
        if kind == "response" and (base64.b32encode(payload.digest()).decode() != told or size != length):
            _fail("payload digest differs")
        ident = re.fullmatch(r"<urn:page:(-?\d+)>", fields["WARC-Record-ID"])
        other = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
        yield (int(ident[1]) if ident else None, fields.get("WARC-Target-URI"), length, told, kind, int(other[1]) if other else None,
               b"".join(kept) if with_payload and kind == "response" else None)


def _fail(why: str):
    raise ValueError(f"damaged archive: {why}")


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``refers_to`` and ``revisit`` for each row.

    Of rows with equal payloads of ``min_bytes`` or more, those with the largest id are responses and the others revisit
    them. Equality is that of SHA-256. Only ids and digests of repeated payloads are matched; a null payload counts as empty,
    a null id as smaller than all others.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    ids = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "key")
    owners = ids.groupBy("key").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    again = ids.join(owners.select(F.col("key").alias("k"), "owner"), F.col("key") == F.col("k"))
    again = again.where(~F.col("page_id").eqNullSafe(F.col("owner"))).select(F.col("page_id").alias("i"), "k", "owner").distinct()
    out = rows.join(again.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    return out.select("page_id", "url", "payload", F.col("owner").alias("refers_to"), F.col("k").isNotNull().alias("revisit"))


def write_archives(rows: DataFrame, folder: str | None = None, archive_bytes: int = 1 << 30) -> DataFrame:
    """Writes the rows of ``with_revisits`` as ``.warc.gz`` files into ``folder``; returns the table of archives.

    A task writes archives of about ``archive_bytes`` under names of its own attempt, and lists them when they are closed.
    Only listed archives count: what a lost or repeated attempt has left is never read.
    """
    folder = folder or shared_folder(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        files.create_dir(root, recursive=True)
        sink, name, count, size = None, "", 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    name, count, size = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = files.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(*row))
                sink.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    sink.close()
                    sink = None
                    yield from in_batches(iter([(f"{folder}/{name}", count, size)]), _ARCHIVES)
        if sink is not None:
            sink.close()
            yield from in_batches(iter([(f"{folder}/{name}", count, size)]), _ARCHIVES)

    ordered = rows.select("page_id", "url", "payload", "refers_to", "revisit")
    return written(ordered.mapInArrow(run, "archive string, records long, bytes long"))


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the archives listed in column ``archive``, each read from start to end by one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    files, path = _opened(name)
                    with files.open_input_stream(path, compression=None) as stream:
                        yield from read_records(stream, with_payload)
        yield from in_batches(rows(), _RECORDS, size=lambda r: len(r[6] or b""))

    spread = archives.select("archive").repartition(partitions(archives.sparkSession))
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                                  "refers_to long, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives in the shared folder and reads them back.

    Returns ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and ``payload`` (null
    unless wanted) per page. Rows that repeat an id and payload are alike, and all responses if theirs is the largest id;
    an empty table gives no rows; other columns are ignored.
    """
    return read_archives(write_archives(with_revisits(pages, min_bytes)), with_payload)

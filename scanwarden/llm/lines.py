"""Repeated lines (operator 2)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanwarden.llm.shared import encoded, in_batches, partitions, texts

_SPACE = b" \t\n\x0b\x0c\r"
_ROWS = pa.schema([("part", pa.int64()), ("line", pa.binary()), ("doc_id", pa.int64()), ("body", pa.int64()),
                   ("lines", pa.int32()), ("docs", pa.int32()), ("positions", pa.list_(pa.int32()))])
_DROPS = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("lines", pa.int32()), ("positions", pa.list_(pa.int32()))])
_LOWEST = -(1 << 64)


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z lower-cased."""
    return line.strip(_SPACE).lower()


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def keep_bitmaps(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3,
                 held_lines: int = 400_000) -> DataFrame:
    """Which lines each document keeps, when lines found in ``min_docs`` documents stay only in the largest id.

    Returns a row for each text that loses lines: ``doc_id``, ``body`` (hash of the text, which tells apart rows that
    share an id), ``lines``, ``n_dropped`` and ``keep_bitmap``: a bit for each line, packed and compressed by zlib.

    Hashes of 128 bits are dealt to ranges of equal width and sorted there by hash, document (largest first) and
    position; one streaming pass per range then tells the first occurrence. Before that, each task settles lines that
    it saw in ``min_docs`` documents of its own: all but its largest document lose them for certain, so that a line
    found in a third of all documents sends one row per task.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            seen: dict[bytes, list] = {}
            held = 0
            for batch in batches:
                columns = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoded(batch.column(2)))
                for i, body, value in zip(*columns):
                    lines = value.split(b"\n")
                    own: dict[bytes, list[int]] = {}
                    for at, line in enumerate(lines):
                        if len(line) >= min_chars:
                            key = line_key(line)
                            if len(key) >= min_chars and _code_points(key) >= min_chars:
                                own.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
                    doc = (_LOWEST if i is None else i, body, len(lines))
                    for h, at in own.items():
                        seen.setdefault(h, []).append((doc, at))
                    held += len(own)
                    if held >= held_lines:
                        yield from flush(seen)
                        seen, held = {}, 0
            yield from flush(seen)

        def flush(seen):
            settled: dict[tuple, list[int]] = {}
            for h, found in seen.items():
                weight = 1
                if len(found) >= min_docs and len({doc[0] for doc, _ in found}) >= min_docs:
                    weight = min_docs
                    last = max(doc[0] for doc, _ in found)
                    for doc, at in found:
                        if doc[0] != last:
                            settled.setdefault(doc, []).extend(at)
                    found = [x for x in found if x[0][0] == last]
                for doc, at in found:
                    yield row(h, doc, weight, at)
            for doc, at in settled.items():
                yield row(xxhash.xxh3_128_digest(b"%d %d" % doc[:2]), doc, 0, at)

        def row(h, doc, weight, at):
            return int.from_bytes(h[:4], "big"), h, None if doc[0] == _LOWEST else doc[0], doc[1], doc[2], weight, at
        yield from in_batches(rows(), _ROWS, most=20_000)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            line, owner, ids, sure, waiting = None, None, set(), False, set()
            for batch in batches:
                for h, i, body, n, weight, at in zip(*(batch.column(c).to_pylist() for c in ("line", "doc_id", "body", "lines", "docs", "positions"))):
                    if weight == 0:
                        yield i, body, n, at
                        continue
                    if h != line:
                        line, owner, ids, sure, waiting = h, i, set(), False, set()
                    if i != owner:
                        if sure:
                            yield i, body, n, at
                        else:
                            waiting.add((i, body, n, tuple(at)))
                    if not sure:
                        ids.add(i)
                        if weight >= min_docs or len(ids) >= min_docs:
                            sure = True
                            yield from ((*x[:3], list(x[3])) for x in waiting)
                            waiting = set()
        yield from in_batches(rows(), _DROPS, most=20_000)

    n = partitions(docs.sparkSession)
    source = with_body(texts(docs, ident, text))
    found = source.select(F.col("doc_id").cast("long"), "body", "text").mapInArrow(
        local, "part long, line binary, doc_id long, body long, lines int, docs int, positions array<int>")
    ranged = found.repartitionById(n, F.shiftright(F.col("part") * n, 32).cast("int")).drop("part")
    drops = ranged.sortWithinPartitions("line", F.desc_nulls_last("doc_id"), "body").mapInArrow(
        stream, "doc_id long, body long, lines int, positions array<int>")
    listed = drops.groupBy("doc_id", "body").agg(
        F.max("lines").alias("lines"), F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for lines, at in zip(batch.column("lines").to_pylist(), batch.column("positions").to_pylist()):
                bits = np.ones(lines, np.uint8)
                bits[at] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
            counts = pa.array([len(x) for x in batch.column("positions").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("body"), batch.column("lines"), counts, pa.array(maps, pa.binary())],
                ["doc_id", "body", "lines", "n_dropped", "keep_bitmap"])

    return listed.mapInArrow(pack, "doc_id long, body long, lines int, n_dropped long, keep_bitmap binary")


def with_body(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``body``, a hash of the text."""
    return df.withColumn("body", F.xxhash64(text))


def dedup_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All rows and columns of ``docs`` with the text that stays, ``n_lines`` (before) and ``n_dropped``.

    A null text counts as one empty line, and stays null if other columns need it that way: it becomes empty here. Rows
    that share an id count as one document; an empty table gives no rows. Columns named ``n_lines`` or ``n_dropped``
    are replaced.
    """
    maps = keep_bitmaps(docs, ident, text, min_chars, min_docs)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*kept).withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = rows.select(F.struct(*kept).alias("row"), F.col(ident).cast("long").alias("_i"), F.col(text).alias("_t"), F.xxhash64(text).alias("_b"))
    maps = maps.select(F.col("doc_id").alias("_mi"), F.col("body").alias("_mb"), "n_dropped", "keep_bitmap")
    joined = rows.join(maps.hint("shuffle_hash"), F.col("_i").eqNullSafe(F.col("_mi")) & (F.col("_b") == F.col("_mb")), "left")

    @F.pandas_udf("string")
    def apply(values, bitmaps):
        return _applied(values, bitmaps)

    lines = F.length("_t") - F.length(F.replace(F.col("_t"), F.lit("\n"), F.lit(""))) + 1
    left = F.when(F.col("keep_bitmap").isNull(), F.col("_t")).otherwise(apply("_t", "keep_bitmap"))
    out = joined.select("row", left.alias("_left"), lines.cast("long").alias("n_lines"),
                        F.coalesce(F.col("n_dropped"), F.lit(0).cast("long")).alias("n_dropped"))
    return out.select(*[F.col("_left").alias(c) if c == text else F.col("row")[c].alias(c) for c in kept], "n_lines", "n_dropped")


def _applied(values, bitmaps):
    out = []
    for value, bitmap in zip(values, bitmaps):
        if bitmap is None:
            out.append(value)
            continue
        lines = value.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
        out.append("\n".join([x for x, keep in zip(lines, bits) if keep]))
    return pd.Series(out, dtype=object)

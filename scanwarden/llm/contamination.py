"""Test items inside documents (operator 3)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanwarden.llm.shared import encoded, free_names, in_batches, laid_out, texts, word_shingles, written

FILTER_BITS = 24  # 2 MB for each size class, whatever the number of items
SIZE_CLASSES = 16  # by powers of two; the last one has no end
_ITEMS = pa.schema([("item", pa.int64()), ("size_class", pa.int32()), ("shingle", pa.binary()), ("hash", pa.int64()), ("shingles", pa.int32()),
                    ("in_sketch", pa.bool_())])
_HITS = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("size_class", pa.int32()), ("shingle", pa.binary())])


def _distinct_shingles(values: list[bytes], width: int) -> Iterator[tuple[int, dict[bytes, int]]]:
    """Number of a text, and its distinct shingles with their hashes; texts without any are left out."""
    for base, data, at in laid_out(values):
        owner, first, end, hashes = word_shingles(data, at, width)
        now, found = None, {}
        for o, x, y, h in zip(owner.tolist(), first.tolist(), end.tolist(), hashes.tolist()):
            if o != now:
                if found:
                    yield base + now, found
                now, found = o, {}
            found[b" ".join(data[x:y].split())] = h
        if found:
            yield base + now, found


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def item_sketches(items: DataFrame, ident: str = "item_id", text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The distinct shingles of each item, and which of them are its MinHash sketch.

    Items are partitioned by size. A document that holds ``threshold`` of an item's n shingles misses at most
    n - ceil(threshold * n), so one of the next smallest hashes must be in it: the sketch keeps one hash more than may be
    missing. The sketches of a size class are of like size, and no document that qualifies is missed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for k, found in _distinct_shingles(encoded(batch.column(1)), width):
                    n = len(found)
                    sketch = set(sorted(found.values())[: n - math.ceil(threshold * n) + 1])
                    for shingle, h in found.items():
                        yield ids[k], min(n.bit_length(), SIZE_CLASSES), shingle, _signed(h), n, h in sketch
        yield from in_batches(rows(), _ITEMS)
    source = texts(items, ident, text).withColumn("doc_id", F.col("doc_id").cast("long")).distinct()
    return source.mapInArrow(run, "item long, size_class int, shingle binary, hash long, shingles int, in_sketch boolean")


def _filters(hashes: DataFrame) -> dict[int, np.ndarray]:
    """For each size class, bits of the hashes' first ``FILTER_BITS``, joined on the driver from tables of fixed size: they may
    hold too many, never too few."""
    step = 64 - FILTER_BITS
    cells = hashes.select("size_class", F.shiftrightunsigned("hash", step + 6).alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {step}) & 63 as int))").alias("bit"))
    cells = cells.groupBy("size_class", "cell").agg(F.bit_or("bit").alias("bits"))  # at most 2**18 rows of a fixed table a class
    got = cells.toArrow()
    classes, places, bits = (got.column(c).to_numpy() for c in ("size_class", "cell", "bits"))
    out = {}
    for c in np.unique(classes).tolist():
        table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
        table[places[classes == c]] = bits[classes == c]
        out[c] = table.view(np.uint64)
    return out


def contaminated(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item_ident: str = "item_id",
                 item_text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs of a document and an item of which it holds ``threshold`` of the distinct word shingles or more.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Returns ``doc_id``, ``body`` (hash of the
    text), ``item_id``, ``item_shingles``, ``matched`` and ``containment``. Items of fewer than ``width`` words have no shingle
    and match nothing; null texts count as empty; repeated rows of a document give one pair; empty tables give none.

    Items are searched by size class. Tasks scan whole documents against a filter of fixed size made of the class's MinHash
    sketches; only documents with a hit go on in that class, with those shingles that the filter of all its items' shingles
    lets through. A join on class and shingle finds candidates by sketch and verifies them by exact containment.
    """
    spark = docs.sparkSession
    sketches = written(item_sketches(items, item_ident, item_text, width, threshold))
    # at most SIZE_CLASSES filters of 2 MB each
    shared = spark.sparkContext.broadcast((_filters(sketches.where("in_sketch")), _filters(sketches)))
    step, low = np.uint64(64 - FILTER_BITS), np.uint64(63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketched, every = shared.value

        def passes(table, hashes):
            top = hashes >> step
            return ((table[(top >> np.uint64(6)).astype(np.int64)] >> (top & low)) & np.uint64(1)).astype(bool)

        def rows():
            for batch in batches:
                ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for base, data, at in laid_out(encoded(batch.column(2))):
                    owner, first, end, hashes = word_shingles(data, at, width)
                    for c, sketch in sketched.items():
                        hit = np.zeros(len(at), bool)
                        hit[owner[passes(sketch, hashes)]] = True
                        some = np.flatnonzero(hit[owner])
                        some = some[passes(every[c], hashes[some])]
                        seen = set()
                        for o, x, y in zip(owner[some].tolist(), first[some].tolist(), end[some].tolist()):
                            shingle = b" ".join(data[x:y].split())
                            if (o, shingle) not in seen:
                                seen.add((o, shingle))
                                yield ids[base + o], bodies[base + o], c, shingle
        yield from in_batches(rows(), _HITS, most=20_000)

    source = texts(docs, ident, text).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("body"), "text")
    hits = source.mapInArrow(run, "doc_id long, body long, size_class int, shingle binary").distinct()
    both = hits.join(sketches, ["size_class", "shingle"])
    found = both.groupBy("doc_id", "body", "item").agg(
        F.count("*").alias("matched"), F.first("shingles").alias("item_shingles"), F.max("in_sketch").alias("candidate"))
    need = F.ceil(F.lit(threshold) * F.col("item_shingles") - 1e-9)
    return found.where(F.col("candidate") & (F.col("matched") >= need)).select(
        "doc_id", "body", F.col("item").alias("item_id"), "item_shingles", "matched",
        (F.col("matched") / F.col("item_shingles")).alias("containment"))


def without_contamination(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    bad, found = free_names(docs, "_bad", "_found")
    pairs = contaminated(docs, items, ident, text, **options).select(F.col("doc_id").alias(bad), F.col("body").alias(found)).distinct()
    body = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.join(pairs, docs[ident].cast("long").eqNullSafe(F.col(bad)) & (body == F.col(found)), "left_anti")

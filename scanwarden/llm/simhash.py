"""Near duplicates by SimHash fingerprints and pivot distance tables (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanwarden.llm.graph import components
from scanwarden.llm.shared import encoded, partitions, texts, written

#: Reference fingerprints: the odd multiples of a constant, as good as random.
PIVOTS = (np.arange(1, 49, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(24, dtype=np.uint64) << np.uint64(59))
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, width: int = 4) -> int:
    """SimHash of the hashes (XXH64, seed 42) of all word shingles; shorter texts are one shingle, empty ones give 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(joined, 42)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        first = (ends - sizes)[: len(words) - width + 1].tolist()
        hashes = [digest(joined[x:y], 42) for x, y in zip(first, ends[width - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long, of every row."""
    source = texts(docs, ident, text)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([signed(fingerprint(x, width)) for x in encoded(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), marks], ["doc_id", "fp"])
    return source.mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(rows: int, distance: int, bucket_rows: int = 512) -> list[int]:
    """Bit masks such that two fingerprints at ``distance`` or fewer bits agree on at least one of them.

    64 bits are cut into blocks; of m blocks, at most ``distance`` differ, so some m - distance of them are equal. m
    is the smallest for which a bucket of equal bits holds about ``bucket_rows`` of ``rows`` random fingerprints.
    """
    for m in range(distance + 1, 2 * distance + 3):
        ends = [round(64 * i / m) for i in range(m + 1)]
        blocks = [((1 << (y - x)) - 1) << x for x, y in zip(ends, ends[1:])]
        masks = [sum(c) for c in combinations(blocks, m - distance)]
        if rows >> min(x.bit_count() for x in masks) <= bucket_rows:
            break
    return [signed(x) for x in masks]


def near_pairs(x: np.ndarray, distance: int, pivots: np.ndarray = PIVOTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs at ``distance`` or fewer bits.

    A table holds the distance of each fingerprint to each pivot. Fingerprints are sorted by the first column, so that
    only those within ``distance`` of it meet; the other columns then discard pairs by their largest difference, and
    survivors are verified.
    """
    table = np.bitwise_count(x[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    x, table = x[order], table[order]
    reach = np.searchsorted(table[:, 0], table[:, 0].astype(np.int16) + distance, side="right")
    step = max(1, (1 << 18) // max(1, len(x)))
    for low in range(0, len(x), step):
        high = min(len(x), low + step)
        i, j = [], []
        width = reach[low:high] - np.arange(low, high) - 1
        i = np.repeat(np.arange(low, high), width)
        if not len(i):
            continue
        j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + i + 1
        for c in range(1, len(pivots)):
            ok = np.abs(table[i, c] - table[j, c]) <= distance
            i, j = i[ok], j[ok]
            if len(i) < 64:
                break
        ok = np.bitwise_count(x[i] ^ x[j]) <= distance
        if ok.any():
            yield order[i[ok]], order[j[ok]]


def _forest(x: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that join the same fingerprints as all near pairs do, at most one less than there are fingerprints."""
    parent = list(range(len(x)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i
    for i, j in near_pairs(x, distance):
        for p, q in zip(i.tolist(), j.tolist()):
            a, b = top(p), top(q)
            if a != b:
                parent[a] = b
                yield p, q


def links(marks: DataFrame, distance: int = 4, bucket_rows: int = 512, cell_rows: int = 4096) -> DataFrame:
    """Links between the distinct fingerprints in column ``fp`` that give the same components as all pairs at
    ``distance`` or fewer bits.

    Fingerprints are dealt to buckets of equal blocks (``block_masks``). A bucket of more than ``cell_rows`` is cut into
    pieces by hash, and each two pieces meet in a cell of their own, so that no task holds more than two pieces.
    """
    spark = marks.sparkSession
    n = marks.count()
    masks = block_masks(n, distance, bucket_rows)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])
    dealt = marks.select("fp", F.explode(tables).alias("e")).select("fp", "e.t", "e.k")
    large = dealt.groupBy("t", "k").count().where(F.col("count") > cell_rows)
    large = large.select(F.col("t").alias("lt"), F.col("k").alias("lk"), F.ceil(F.col("count") / cell_rows).cast("int").alias("g"))
    rows = dealt.join(large, (F.col("t") == F.col("lt")) & (F.col("k") == F.col("lk")), "left")
    pieces = F.coalesce(F.col("g"), F.lit(1))
    rows = rows.select("fp", "t", "k", pieces.alias("g"), F.pmod(F.xxhash64("fp"), pieces).cast("int").alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("fp", "t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    cells = rows.repartition(partitions(spark), "t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = None, []
        for batch in batches:
            cell = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "k", "i", "j")], axis=1)
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                key = tuple(cell[low]) if high > low else None
                if key != kept:
                    yield from solved(held)
                    kept, held = key, []
                held.append(fp[low:high])
        yield from solved(held)

    def solved(held) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        fp = np.concatenate(held)
        if len(fp) < 2:
            return
        found = list(_forest(fp.view(np.uint64), distance))
        if found:
            i, j = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], schema=_LINKS)

    return cells.select("fp", "t", "k", "i", "j").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp``, ``component_id`` (the smallest id reachable over links of at most
    ``distance`` bits, itself included).

    A null or empty text has fingerprint 0 and is linked like any other; null ids count as larger than all others; rows
    that repeat an id are rows of their own; an empty table gives no rows; other columns are ignored. Copies share a
    fingerprint, and only distinct fingerprints are compared.
    """
    marks = written(fingerprints(docs, ident, text, width))
    classes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), distance))
    of = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.select("fp", "root").join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return marks.join(named, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def hexadecimal(column: str = "fp") -> Column:
    """A signed long as 16 hex digits of its 64 bits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))

"""Near duplicates by word shingles: candidates by SimHash fingerprints and by bands of MinHash values, verified by exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanwarden.llm import simhash
from scanwarden.llm.graph import components
from scanwarden.llm.shared import encoded, free_names, in_batches, partitions, texts, written

#: A pair at similarity 0.8 shares no band of four values with chance (1 - 0.8**4)**32, which is 5e-8.
BANDS, BAND_ROWS = 32, 4
VALUES = BANDS * BAND_ROWS
#: Candidates agree on so many values; a pair at 0.8 has fewer with a chance below 2e-9.
LEAST_EQUAL = 70
_rng = np.random.default_rng(20)
_MASKS = _rng.integers(0, 2**64, VALUES, dtype=np.uint64)
_FACTORS = _rng.integers(0, 2**64, VALUES, dtype=np.uint64) | np.uint64(1)
_BAND_FACTORS = _rng.integers(0, 2**64, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)
_PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def shingles(joined: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes (XXH64, seed 42) of the word shingles of a text whose words stand one space apart; shorter
    texts are one shingle, empty ones have none."""
    words = joined.split()
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(joined, 42)] if words else [], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first = (ends - sizes)[: len(words) - width + 1].tolist()
    return np.unique(np.array([digest(joined[x:y], 42) for x, y in zip(first, ends[width - 1 :].tolist())], np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that is not empty."""
    out = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(hashes), 4096):
        mixed = (hashes[low : low + 4096, None] ^ _MASKS) * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        np.minimum(out, mixed.min(axis=0), out=out)
    return out


def _joined(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def signatures(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """``doc_id``; ``node``, a 128-bit hash of the words; the number of ``shingles``; a key for each of the ``bands``; 16 bits
    of each MinHash value; ``fp``, the SimHash fingerprint. A text without words has no bands."""
    source = texts(docs, ident, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    types = [pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64()]

    def one(value: bytes):
        joined = _joined(value)
        found, node = shingles(joined, width), xxhash.xxh128_digest(joined)
        if not len(found):
            return node, 0, [], b"", 0
        low = minima(found)
        keys = (low.reshape(BANDS, BAND_ROWS) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64)
        keys = (keys ^ (keys >> np.uint64(29))) * _BAND_FACTORS[:, 0]  # other factors for each band
        return node, len(found), keys.view(np.int64), ((low * _FACTORS[0]) >> np.uint64(48)).astype("<u2").tobytes(), simhash.signed(simhash.fingerprint(joined))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(one, encoded(batch.column(1))))) or [[]] * 5
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "node", "shingles", "bands", "signature", "fp"])
    return source.mapInArrow(run, f"doc_id {kind}, node binary, shingles int, bands array<long>, signature binary, fp long")


def _forest(n: int, matches) -> Iterator[tuple[int, int]]:
    """Links that join the same of ``n`` rows as all matches do; ``matches(i, left)`` tells which of the rows ``left`` match
    row i. A row is compared only with rows that are not joined yet."""
    left = np.arange(n)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = matches(i, left)
            if hit.any():
                found = left[hit].tolist()
                yield from ((i, j) for j in found)
                queue += found
                left = left[~hit]


def _alike(rows: list[bytes]) -> Iterator[tuple[int, int]]:
    """Links between signatures with ``LEAST_EQUAL`` equal values."""
    table = np.frombuffer(b"".join(rows), "<u2").reshape(len(rows), VALUES)

    def matches(i: int, left: np.ndarray) -> np.ndarray:
        return np.concatenate([(table[left[k : k + 2048]] == table[i]).sum(axis=1) for k in range(0, len(left), 2048)]) >= LEAST_EQUAL
    return _forest(len(rows), matches)


def similar_sets(sets: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int]]:
    """Links that give the same components as all pairs of sets (none empty) at Jaccard similarity ``threshold`` or more."""
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    parts = np.split(codes.astype(np.int32), ends[:-1])
    held = np.zeros(int(codes.max()) + 1, np.uint8)
    now = {}

    def matches(i: int, left: np.ndarray) -> np.ndarray:
        if now.get("n") != len(left):  # rows only ever leave
            now.update(n=len(left), flat=np.concatenate([parts[k] for k in left]), starts=np.concatenate(([0], np.cumsum(sizes[left])[:-1])))
        held[parts[i]] = 1
        both = np.add.reduceat(held[now["flat"]], now["starts"], dtype=np.int64)
        held[parts[i]] = 0
        return both >= threshold * (sizes[i] + sizes[left] - both) - 1e-9
    return _forest(len(sets), matches)


def _in_cells(rows: DataFrame, key: str, value: str, pieces: str, solve) -> DataFrame:
    """Deals rows with a ``key`` to ``pieces`` by hash of ``node``; each two pieces of a key meet in a cell, in which
    ``solve(values)`` gives links between positions. Returns the nodes linked."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col(pieces)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(pieces) - 1)))
    names = [key, "i", "j"]
    rows = rows.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", value)
    cells = rows.repartition(partitions(rows.sparkSession), *names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            kept, nodes, values = None, [], []
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in (*names, "node")]
                for k, i, j, node, item in zip(*columns, encoded(batch.column(4))):
                    if (k, i, j) != kept:
                        yield from solved(nodes, values)
                        kept, nodes, values = (k, i, j), [], []
                    nodes.append(node)
                    values.append(item)
            yield from solved(nodes, values)
        yield from in_batches(found(), _PAIRS)

    def solved(nodes, values):
        if len(nodes) > 1:
            yield from ((nodes[a], nodes[b]) for a, b in solve(values))

    return cells.mapInArrow(run, "a binary, b binary").distinct()


def candidates(classes: DataFrame, cell_rows: int = 4096) -> DataFrame:
    """Links between nodes that share a band and have ``LEAST_EQUAL`` equal values. Bands with the same nodes count once."""
    keys = classes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("who")).where("n > 1")
    shared = shared.groupBy("n", "who").agg(F.min("key").alias("band")).select("band", F.ceil(F.col("n") / cell_rows).cast("int").alias("g"))
    rows = keys.join(shared, F.col("key") == F.col("band")).select("key", "node", "g")
    return _in_cells(rows.join(classes.select("node", "signature"), "node"), "key", "signature", "g", _alike)


def by_fingerprint(classes: DataFrame, distance: int = 4) -> DataFrame:
    """Links that join the same nodes as all pairs of SimHash fingerprints at ``distance`` or fewer bits (operator 7) do."""
    known = classes.where("shingles > 0").select("node", "fp")
    first = written(known.groupBy("fp").agg(F.min("node").alias("first")))
    same = known.join(first, "fp").where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    a, b = (first.select(F.col("fp").alias(x), F.col("first").alias(f"node_{x}")) for x in "ab")
    near = simhash.links(first.select("fp"), distance).join(a, "a").join(b, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return same.union(near)


def one_of_each(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8,
                cell_rows: int = 2048, cell_shingles: int = 1 << 21) -> DataFrame:
    """One row of each group of near duplicates, with all columns: that with the smallest id.

    Two texts are near duplicates if the Jaccard similarity of their sets of word shingles (words are what white space
    separates, A-Z lower-cased) is ``threshold`` or more; groups are the components of such pairs. Texts of fewer than
    ``width`` words are alike if their words are equal; null texts count as empty, and all texts without words are one group.
    SimHash fingerprints and MinHash bands find candidates, whose components are cut into cells of two pieces and there compared by exact similarity.

    A null id is larger than all others. Rows of a group that share the smallest id are told apart by a hash of the text,
    of which the smallest stays, and of equal rows any one. A row with the same id in another group is not touched.
    """
    body = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(F.struct(F.col(ident).alias("id"), body.alias("body")).alias("row"), F.col(text).alias("text"))
    marks = written(signatures(rows, "row", "text", width))
    rank = F.struct(F.col("doc_id.id").isNull().alias("last"), F.col("doc_id.id").alias("id"), F.col("doc_id.body").alias("body"))
    classes = written(marks.groupBy("node").agg(
        F.min(rank).alias("least"), F.any_value("shingles").alias("shingles"), F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature"),
        F.any_value("fp").alias("fp")))

    wanted = components(by_fingerprint(classes).union(candidates(classes))).join(classes.select("node", "shingles", "least"), "node")
    sizes = wanted.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / cell_rows, F.sum("shingles") / cell_shingles)).cast("int").alias("g"))
    wanted = wanted.join(sizes, "root").select("node", "root", "g", F.col("least.id").alias("_id"), F.col("least.body").alias("_body"))
    whole = rows.join(wanted, F.col("row.id").eqNullSafe(F.col("_id")) & (F.col("row.body") == F.col("_body")))
    whole = whole.select("node", "root", "g", "text").dropDuplicates(["node"])  # rows may repeat
    links = _in_cells(whole, "root", "text", "g", lambda values: similar_sets([shingles(_joined(x), width) for x in values], threshold))

    roots = components(links).withColumnRenamed("node", "of").withColumnRenamed("root", "top")
    group = F.coalesce("top", "node")
    first = classes.join(roots, F.col("node") == F.col("of"), "left").groupBy(group.alias("top")).agg(F.min("least").alias("first"))
    own, least, hashed = free_names(docs, "_own", "_id", "_body")
    first = first.select(F.col("first.id").cast(kind).alias(least), F.col("first.body").alias(hashed))
    kept = docs.withColumn(own, body).join(first, F.col(ident).eqNullSafe(F.col(least)) & (F.col(own) == F.col(hashed)), "left_semi")
    return kept.dropDuplicates([ident, own]).drop(own)

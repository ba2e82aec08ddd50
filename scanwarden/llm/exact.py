"""Exact duplicates by Patricia tries (operator 10)."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanwarden.llm.shared import encoded, in_batches, partitions, texts, written
from scanwarden.skew import join_on

_NULL = -(1 << 64)  # stands for a null id, below every other


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        half = (low + high + 1) // 2
        if a[low:half] == b[at + low : at + half]:
            low = half
        else:
            high = half - 1
    return low


class Trie:
    """Compressed radix trie over byte strings; a node is [label, children, value].

    ``merge(old, new)`` joins the values of equal strings. With ``spill_bytes`` the trie writes its largest subtree to an
    unnamed file of the task once the labels take more than that; later strings of this subtree follow there, and
    ``items`` builds each such subtree alone, below what its strings have in common.
    """

    def __init__(self, merge, spill_bytes: int | None = None, depth: int = 0):
        self.merge, self.spill_bytes, self.depth = merge, spill_bytes, depth
        self.clear()

    def clear(self) -> None:
        self.root = [b"", {}, None]
        self.size, self.below, self.spilled = 0, {}, {}

    def add(self, key: bytes, value) -> None:
        at = self.depth
        top = key[at] if at < len(key) else None
        if top in self.spilled:
            pickle.dump((key, value), self.spilled[top])
            return
        node, end, grown = self.root, len(key), 0
        while at < end:
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, value]
                grown, value = end - at, None
                break
            label = child[0]
            if key.startswith(label, at):
                at += len(label)
                node = child
                continue
            same = _common(label, key, at)
            middle = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = middle
            at += same
            node = middle
        if value is not None:
            node[2] = value if node[2] is None else self.merge(node[2], value)
        if grown:
            self.size += grown
            self.below[top] = self.below.get(top, 0) + grown
            if self.spill_bytes and self.size > self.spill_bytes and len(key) > self.depth:
                self._spill()

    def _spill(self) -> None:
        split = [b for b in self.below if self.root[1][b][1]]
        if not split:  # single strings, which have to be held anyway
            return
        top = max(split, key=self.below.get)
        file = tempfile.TemporaryFile()
        for pair in _walk(self.root[1].pop(top), b""):
            pickle.dump((self.path + pair[0], pair[1]), file)
        self.spilled[top] = file
        self.size -= self.below.pop(top)

    path = b""  # the common first bytes of all strings of a subtree

    def items(self) -> Iterator[tuple[bytes, object]]:
        """All strings with their values; empties the trie."""
        for key, value in _walk(self.root, b""):
            yield self.path + key, value
        files = list(self.spilled.values())
        self.clear()
        while files:
            with files.pop() as file:
                start = None
                for key, _ in _pairs(file):
                    start = key if start is None else start[: _common(start, key, 0)]
                deeper = Trie(self.merge, self.spill_bytes, len(start))
                deeper.path = start
                for key, value in _pairs(file):
                    deeper.add(key, value)
            for key, value in _walk(deeper.root, b""):
                yield start + key, value
            files.extend(deeper.spilled.values())


def _pairs(file) -> Iterator[tuple[bytes, object]]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _walk(top: list, prefix: bytes) -> Iterator[tuple[bytes, object]]:
    stack = [(top, prefix)]
    while stack:
        node, before = stack.pop()
        key = before + node[0]
        if node[2] is not None:
            yield key, node[2]
        stack.extend((child, key) for child in node[1].values())


_LOCAL = pa.schema([("doc_id", pa.int64()), ("rep", pa.int64()), ("sha", pa.binary()), ("copies", pa.int64()),
                    ("length", pa.int64()), ("text", pa.binary())])
_OWNER = pa.schema([("rep", pa.int64()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _out(ident: int):
    return None if ident == _NULL else ident


def exact_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", keep: str = "largest",
                     held_bytes: int = 32 << 20) -> DataFrame:
    """Groups of texts that are identical after lower-casing A-Z.

    Returns one row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size`` (rows), ``kept``, ``text_sha256``.
    A null text counts as empty; a null id comes last in the choice; rows that share the kept id are all marked
    as kept; an empty table gives no rows; other columns are ignored.

    Each task first puts its own rows into a trie, so that of a text with very many copies only one string per task
    (and ``held_bytes`` of text) is sent on. Strings are dealt by length and content hash to a second trie, whose
    terminal nodes hold the id to keep. It spills by subtree beyond ``held_bytes``. Members follow by a join of ids.
    """
    best = max if keep == "largest" else min
    null = _NULL if keep == "largest" else -_NULL

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            trie = Trie(lambda a, b: a.extend(b) or a)
            for batch in batches:
                for i, value in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                    trie.add(value.lower(), [null if i is None else i])
                    if trie.size > held_bytes:
                        yield from flush(trie)
            yield from flush(trie)

        def flush(trie: Trie):
            for key, ids in trie.items():
                rep, sha = best(ids), hashlib.sha256(key).digest()
                shown = None if rep == null else rep
                yield shown, shown, sha, len(ids), len(key), key
                ids.remove(rep)
                for i in ids:
                    yield None if i == null else i, shown, sha, None, None, None
        yield from in_batches(rows(), _LOCAL, size=lambda r: len(r[5] or b""))

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merge(a, b):
            return best(a[0], b[0]), a[1] + b[1], a[2] | b[2], a[3]

        trie = Trie(merge, held_bytes)
        for batch in batches:
            reps, shas, copies, keys = (batch.column(c) for c in ("rep", "sha", "copies", "text"))
            for rep, sha, n, key in zip(reps.to_pylist(), shas.to_pylist(), copies.to_pylist(), keys.to_pylist()):
                i = null if rep is None else rep
                trie.add(key, (i, n, {rep}, sha))
        yield from in_batches(((rep, v[3], None if v[0] == null else v[0], v[1]) for _, v in trie.items() for rep in v[2]), _OWNER)

    source = texts(docs, ident, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    table = written(source.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        local, "doc_id long, rep long, sha binary, copies long, length long, text binary"))
    strings = table.where(F.col("copies").isNotNull()).select("rep", "sha", "copies", "length", "text")
    dealt = strings.repartition(partitions(docs.sparkSession), "length", "sha").drop("length")
    found = dealt.mapInArrow(owners, "rep long, sha binary, keep_id long, group_size long")
    out = join_on(table.select("doc_id", "rep", "sha"), found, ["rep", "sha"])
    return out.select(
        F.col("doc_id").cast(kind).alias("doc_id"), F.col("keep_id").cast(kind).alias("keep_id"), "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

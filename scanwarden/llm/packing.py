"""Packing of tokenised documents into sequences by vector best fit (operator 5)."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scanwarden.llm.shared import encoded, in_batches, partitions, texts, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


#: Runs of ASCII letters and non-ASCII characters, runs of ASCII punctuation but for the apostrophe, and single others.
_PARTS = re.compile(r"[a-z\x80-\U0010ffff]+|[!-&(-/:-@\[-`{-~]+|.", re.S)
#: Single punctuation that ends most words of prose.
_STOPS = b".,;:!?"
#: Texts whose runs are told apart together have about so many bytes.
_AT_ONCE_BYTES = 8 << 20
#: The only letter whose lower case is more than letters.
_DOTTED = "\u0130"


def _each_bytes(column: pa.LargeStringArray) -> list[bytes]:
    """The values of a column without nulls or offset, cut from its buffer."""
    if not len(column):
        return []
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64, len(column) + 1).tolist()
    data = data.to_pybytes() if data else b""
    return [data[x:y] for x, y in zip(at, at[1:])]


class Encoder:
    """Token ids of whole texts as little-endian 32-bit numbers.

    The tokenizer lower-cases, drops white space and treats what stands between it on its own, so ids are kept per run of
    other characters, A-Z lower-cased. When the table has ``most`` entries, those used since it last was that full stay
    within reach and the others go. It also treats letters and punctuation on their own, so a new run of nothing else is
    put together from its parts; each part ends with the only token of an end of word, which tells the ids of many parts
    apart that are encoded together. Runs with digits, apostrophes or other characters are encoded whole. A special token
    (``<|endoftext|>``) is known by its own case and wherever it stands, so a text that holds one is encoded whole.
    """

    def __init__(self, path: str, most: int = 800_000, at_once: int = 8192):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use all cores
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.stops = dict(zip(_STOPS, self._each([chr(c) for c in _STOPS])))
        self.known: dict[bytes, bytes] = {b"": b""}
        self.earlier: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.most, self.at_once = most, at_once

    def ids(self, texts_: list[bytes]) -> Iterator[bytes]:
        low = 0
        while low < len(texts_):
            high, size = low, 0
            while high < len(texts_) and (high == low or high - low < self.at_once and size + len(texts_[high]) < _AT_ONCE_BYTES):
                size += len(texts_[high])
                high += 1
            yield from self._some(texts_[low:high])
            low = high

    def _some(self, some: list[bytes]) -> Iterator[bytes]:
        """Runs are told apart once for all texts; their ids are laid out by number."""
        whole = {i for i, x in enumerate(some) if any(t in x for t in self.special)}
        plain = pa.array([b"" if i in whole else x for i, x in enumerate(some)], pa.large_binary()).view(pa.large_string())
        runs = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        edges = runs.offsets.to_numpy()
        numbered = runs.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        names = _each_bytes(numbered.dictionary)
        found = self._of_runs(names)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ids = np.frombuffer(b"".join(found), "<u4")
        number = numbered.indices.to_numpy()
        each = sizes[number]
        ends = np.cumsum(each)
        starts = (np.cumsum(sizes) - sizes)[number]
        laid = ids[np.repeat(starts - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate(([0], ends))[edges - edges[0]].tolist()
        for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
            yield self._each([some[i].decode("utf-8", "replace")])[0] if i in whole else laid[x:y].tobytes()

    def _of_runs(self, names: list[bytes]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known, self.earlier = {b"": b""}, self.known
        found = [*map(self.known.get, names)]
        new = {w for w, x in zip(names, found) if x is None}
        if new:
            again = new.intersection(self.earlier)
            self.known.update((w, self.earlier[w]) for w in again)
            self._learn(new - again)
            found = [self.known[w] if x is None else x for w, x in zip(names, found)]
        return found

    def _learn(self, runs: set[bytes]) -> None:
        words: dict[bytes, None] = {}
        ended: list[bytes] = []
        rest: list[bytes] = []
        for run in runs:
            stop = run[-1] in _STOPS
            body = run[:-1] if stop else run
            if not body.isalpha() and not self._letters(body):
                rest.append(run)
                continue
            if stop:
                ended.append(run)
            if body not in self.known:
                words[body] = None
        self._learn_parts(self.known, list(words), [w.decode() for w in words])
        for run in ended:
            self.known[run] = self.known[run[:-1]] + self.stops[run[-1]]
        self._put_together(rest)

    @staticmethod
    def _letters(body: bytes) -> bool:
        if body.isascii():
            return False
        text = body.decode("utf-8", "replace")
        return text.isalpha() and _DOTTED not in text

    def _put_together(self, runs: list[bytes]) -> None:
        made: list[tuple[bytes, list[str]]] = []
        whole: list[tuple[bytes, str]] = []
        new: dict[str, None] = {}
        for run in runs:
            text = run.decode("utf-8", "replace")
            parts = _PARTS.findall(text)
            if _DOTTED not in text and all(p.isalpha() or "!" <= p[0] <= "~" and not p[0].isalnum() and p[0] != "'" for p in parts):
                made.append((run, parts))
                new.update((p, None) for p in parts if p not in self.parts)
            else:
                whole.append((run, text))
        self._learn_parts(self.parts, list(new), list(new))
        for run, parts in made:
            self.known[run] = b"".join([self.parts[p] for p in parts])
        for (run, _), ids in zip(whole, self._each([text for _, text in whole])):
            self.known[run] = ids

    def _each(self, texts_: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False)]

    def _learn_parts(self, table: dict, keys: list, parts: list[str]) -> None:
        for low in range(0, len(parts), 200):
            names, some = keys[low : low + 200], parts[low : low + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(some) and cuts[-1] == 4 * len(ids):
                data = ids.tobytes()
                table.update(zip(names, [data[x:y] for x, y in zip([0, *cuts], cuts)]))
            else:
                table.update(zip(names, self._each(some)))


@cache
def _encoder(path: str) -> Encoder:
    """One for each Python worker, whatever the number of its tasks."""
    return Encoder(path)


def token_pieces(docs: DataFrame, ident: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """Each document's ids, an id 0 after them, cut every ``capacity`` ids: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""
    source = texts(docs, ident, text).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        step = 4 * capacity

        def rows():
            for batch in batches:
                for i, ids in zip(batch.column(0).to_pylist(), encoder.ids(encoded(batch.column(1)))):
                    ids += b"\0\0\0\0"
                    for k, low in enumerate(range(0, len(ids), step)):
                        part = ids[low : low + step]
                        yield i, k, low // 4, len(part) // 4, zlib.crc32(part)
        yield from in_batches(rows(), _PIECES, most=20_000)
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence (tokens, documents, attention cost as the sum of squared lengths) and the weights of the
    three when a bin is chosen. The defaults for documents and attention never bind before the tokens do."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


class BestFit:
    """Open bins by residual capacities; ``place(length)`` returns a bin and the tokens already in it.

    ``norm`` takes the bin whose residual vector is shortest after the item is put in, ``dot`` the one with the largest
    weighted product of item and residual; either only among bins that hold the item under every constraint. Bins with
    equal residuals are alike and kept together. Bins are looked at from the smallest residual tokens that suffice, until
    no larger residual can be better (``norm``).
    """

    def __init__(self, limits: Limits):
        self.limits, self.made = limits, 0
        self.open: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.some = 0  # bit r is set if a bin with r tokens left is open

    def place(self, length: int) -> tuple[int, int]:
        lim, cost = self.limits, length * length
        if length > lim.tokens or cost > lim.attention or lim.documents < 1:
            raise ValueError(f"an item of {length} tokens fits no sequence")
        wt, wd, wa = lim.weights
        best, found = None, None
        rest, r = self.some >> length, length - 1
        while rest:
            skip = (rest & -rest).bit_length()
            r, rest = r + skip, rest >> skip
            left = wt * ((r - length) / lim.tokens) ** 2
            if lim.rule == "norm" and best is not None and left >= best:
                break
            for docs, attention in self.open[r]:
                if docs < 1 or attention < cost:
                    continue
                if lim.rule == "norm":
                    value = left + wd * ((docs - 1) / lim.documents) ** 2 + wa * ((attention - cost) / lim.attention) ** 2
                else:
                    value = -(wt * length * r / lim.tokens**2 + wd * docs / lim.documents**2 + wa * cost * attention / lim.attention**2)
                if best is None or value < best:
                    best, found = value, (r, docs, attention)
        if found is None:
            number, r, docs, attention = self.made, lim.tokens, lim.documents, lim.attention
            self.made += 1
        else:
            r, docs, attention = found
            same = self.open[r][docs, attention]
            number = same.pop()
            if not same:
                del self.open[r][docs, attention]
                if not self.open[r]:
                    del self.open[r]
                    self.some &= ~(1 << r)
        if r > length:
            self.open.setdefault(r - length, {}).setdefault((docs - 1, attention - cost), []).append(number)
            self.some |= 1 << (r - length)
        return number, lim.tokens - r


_PACKED = pa.schema([*_PIECES, ("group", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64())])


def pack(pieces: DataFrame, limits: Limits = Limits(), group_rows: int = 8192) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length``.

    Pieces are dealt by hash to groups of about ``group_rows``, each with lengths like the whole, and packed there from the
    longest to the shortest; a task streams its groups and holds open bins only. A group leaves about one sequence unfilled.
    """
    n = pieces.count()
    groups = max(1, round(n / group_rows))
    spark = pieces.sparkSession
    # rows may repeat, so their place in the table is part of the hash
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    ordered = dealt.repartition(partitions(spark), "group").sortWithinPartitions("group", F.desc("length"), "doc_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            group, bins = None, None
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in (*_PIECES.names, "group"))):
                    if row[-1] != group:
                        group, bins = row[-1], BestFit(limits)
                    yield (*row, *bins.place(row[3]))
        yield from in_batches(rows(), _PACKED, most=20_000)

    out = ordered.select(*_PIECES.names, "group").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, group long, bin long, offset long")
    # a group has fewer bins than rows, and far fewer than 2**40
    return out.select(*_PIECES.names, (F.col("group") * (1 << 40) + F.col("bin")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, ident: str = "doc_id", text: str = "text", limits: Limits = Limits(), tokenizer: str = TOKENIZER) -> DataFrame:
    """Tokenises whole documents and packs their pieces into sequences of at most ``limits.tokens`` ids.

    A null or empty text is one piece with the id 0 alone; rows that share an id are packed each; an empty table gives no
    rows; other columns are ignored.
    """
    return pack(written(token_pieces(docs, ident, text, limits.tokens, tokenizer)), limits)

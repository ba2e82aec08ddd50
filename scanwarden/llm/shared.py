"""What the corpus operators share: tables in the cluster's folder, batches, words and shingles of whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanwarden.session import ensure_checkpoint_dir

#: Lower-cases A-Z and turns every ASCII character that is neither letter nor digit into a space.
PLAIN_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def partitions(spark: SparkSession) -> int:
    """Width of the exchanges, as the session sets it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written once to the shared folder and read from there: later steps don't repeat the work,
    and a lost executor costs one read."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """``doc_id`` and ``text``; a null text counts as empty."""
    return df.select(F.col(ident).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def encoded(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8."""
    return column.cast(pa.large_binary()).to_pylist()


def in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, size=None, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``most`` rows and, if ``size(row)`` is given, about ``most_bytes``."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        if size:
            weight += size(row)
        if len(held) >= most or weight >= most_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


# ---- hashed word shingles of a whole batch at once ------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_MIX = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_shingles(lowered: bytes, starts_at: np.ndarray, width: int = 5):
    """Hashes of all runs of ``width`` words in texts laid end to end.

    ``lowered`` holds the texts after ``PLAIN_WORDS``, ``starts_at`` the first byte of each text and the end of the
    last. Returns text number, first byte, byte after the last word, and 64-bit hash of each shingle. Equal shingles
    have equal hashes, so that a filter on hashes loses none.
    """
    data = np.frombuffer(lowered, np.uint8)
    none = np.empty(0, np.int64)
    if not len(data):
        return none, none, none, np.empty(0, np.uint64)
    inside = data != 32
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = starts_at[:-1]
    before[edges[edges < len(data)]] = False
    first = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = edges[(edges > 0) & (edges <= len(data))] - 1
    after[cut] = False
    end = np.flatnonzero(inside & ~after) + 1
    if len(first) < width:
        return none, none, none, np.empty(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    word = (sums[end] - sums[first]) * down[first]
    word ^= word >> np.uint64(29)
    owner = np.searchsorted(starts_at, first, side="right") - 1
    n = len(first) - width + 1
    mixed = np.zeros(n, np.uint64)
    for j in range(width):
        mixed += word[j : j + n] * np.uint64(_MIX[j % len(_MIX)] + 2 * (j // len(_MIX)))
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(_MIX[1])
    mixed ^= mixed >> np.uint64(30)
    whole = owner[:n] == owner[width - 1 :]
    return owner[:n][whole], first[:n][whole], end[width - 1 :][whole], mixed[whole]


def laid_out(values: list[bytes], most_bytes: int = 1 << 20) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Texts after ``PLAIN_WORDS``, end to end in pieces of about ``most_bytes`` (a longer text is a piece of its own):
    number of the first text, the bytes, the first byte of each."""
    held, size, first = [], 0, 0
    for i, value in enumerate(values):
        if held and size + len(value) > most_bytes:
            yield first, b"".join(held), np.concatenate(([0], np.cumsum([len(x) for x in held])))
            held, size, first = [], 0, i
        held.append(value.translate(PLAIN_WORDS))
        size += len(value)
    if held:
        yield first, b"".join(held), np.concatenate(([0], np.cumsum([len(x) for x in held])))

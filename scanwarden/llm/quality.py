"""Quality by a regularised quadratic discriminant (operator 1)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from scanwarden.llm.shared import encoded, free_names

_UPPER = bytes(range(65, 91))
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_SPACES = b" \t\n\x0b\x0c\r"
_STOPS = b".,;:?"
NAMES = ("length", "word_length", "upper", "letters", "symbols", "stops", "distinct", "commonest", "repeats", "lines", "repeated_lines", "halves")
#: Usual shares, counted as so many characters or words before a text's own: a short text says little about its shares.
_USUAL = {"upper": 0.03, "letters": 0.82, "symbols": 0.003, "stops": 0.02, "commonest": 0.07, "repeats": 0.01, "repeated_lines": 0.02}
_BEFORE = 40


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole text: logs of sizes and log odds of shares.

    Digits count neither as letters nor as symbols.
    """
    n = len(text)
    words = text.split()
    w = len(words)
    lines = text.split(b"\n")

    def odds(name: str, part: float, whole: float) -> float:
        share = (part + _BEFORE * _USUAL[name]) / (max(whole, part) + _BEFORE)
        return math.log(share / (1 - share))

    letters = n - len(text.translate(None, _LETTERS))
    digits = n - len(text.translate(None, _DIGITS))
    spaces = n - len(text.translate(None, _SPACES))
    stops = n - len(text.translate(None, _STOPS))
    upper = n - len(text.translate(None, _UPPER))
    counts = Counter(words)
    half = w // 2
    return [
        math.log(w + 20), math.log((n - spaces + 5.5 * _BEFORE) / (w + _BEFORE)), odds("upper", upper, letters), odds("letters", letters, n),
        odds("symbols", n - letters - digits - spaces - stops, n), odds("stops", stops, n),
        math.log(len(counts) + 20) - 0.75 * math.log(w + 20), odds("commonest", max(counts.values(), default=0), w),
        odds("repeats", sum(map(eq, words, words[1:])), w), math.log((w + 40) / (len(lines) + 1)),
        odds("repeated_lines", len(lines) - len(set(lines)), len(lines)),
        math.log((len(set(words[:half])) + 20) / (len(set(words[half:])) + 20)),
    ]


def with_statistics(docs: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """All columns, and the array of ``statistics``; a null text counts as empty."""
    schema = StructType([f for f in docs.schema.fields if f.name != out] + [StructField(out, ArrayType(DoubleType()))])
    names = schema.names[:-1]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([statistics(x or b"") for x in encoded(batch.column(at))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], [*names, out])
    return docs.select(*names).mapInArrow(run, schema)


def document_statistics(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``statistics`` of each row."""
    source = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return with_statistics(source).select("doc_id", "statistics")


def held_out(ident: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(ident.cast("string")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior and log determinant, mean, and the inverse of the Cholesky factor of the shrunk covariance."""

    offsets: tuple[float, float]
    means: np.ndarray
    factors: np.ndarray

    def score(self, statistics: Column) -> Column:
        """Probability of class 1: the logistic of the difference of Mahalanobis log densities."""
        logs = []
        for c in (0, 1):
            centred = F.zip_with(statistics, F.array(*[F.lit(float(x)) for x in self.means[c]]), lambda a, b: a - b)
            rows = [F.array(*[F.lit(float(x)) for x in row]) for row in self.factors[c]]
            far = F.aggregate(
                F.array(*rows), F.lit(0.0),
                lambda acc, row: acc + F.pow(F.aggregate(F.zip_with(row, centred, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v), F.lit(2.0)))
            logs.append(F.lit(self.offsets[c]) - 0.5 * far)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), logs[0] - logs[1]))))


def fit(statistics: DataFrame, labels: DataFrame, label: str = "quality", shrinkage: float = 0.1, floor: float = 0.03) -> Discriminant | None:
    """Fits both classes from all labelled rows that are not held out; None without rows of both.

    Sums and products are added up by Spark, so the driver sees one row per class. Each covariance is shrunk towards
    its diagonal by ``shrinkage`` and towards the pooled one by the same share. Rows and labels that repeat an id count each; rows
    without an id or a label take no part.
    """
    k = len(NAMES)
    rows = statistics.where(~held_out(F.col("doc_id"))).join(
        labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("y")), "doc_id").where("statistics is not null")
    cells = [F.col("statistics")[i] for i in range(k)]
    sums = rows.groupBy("y").agg(F.count("*"), *[F.sum(c) for c in cells], *[F.sum(cells[i] * cells[j]) for i in range(k) for j in range(i + 1)]).collect()
    if len(sums) < 2:
        return None
    found = {}
    for row in sums:
        n, first, second = row[1], np.array(row[2 : 2 + k]), np.zeros((k, k))
        second[np.tril_indices(k)] = row[2 + k :]
        second = second + np.tril(second, -1).T
        mean = first / n
        found[row[0]] = n, mean, second / n - np.outer(mean, mean)
    total = found[0][0] + found[1][0]
    pooled = sum(found[c][0] * found[c][2] for c in (0, 1)) / total
    offsets, means, factors = [], [], []
    for c in (0, 1):
        n, mean, cov = found[c]
        cov = (1 - 2 * shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + shrinkage * pooled + floor * np.eye(k)
        root = np.linalg.cholesky(cov)
        offsets.append(float(np.log(n / total) - np.log(np.diag(root)).sum()))
        means.append(mean)
        factors.append(np.linalg.inv(root))
    return Discriminant(tuple(offsets), np.array(means), np.array(factors))


def score(docs: DataFrame, model: Discriminant | None, text: str = "text") -> DataFrame:
    """All rows and columns with ``score`` (0 to 1, higher: better), replacing a column of that name; 1 without a model.

    A null text counts as empty; texts are read whole, however long; rows that repeat or have a null id are scored each, equal texts
    alike; an empty table gives no rows."""
    held, = free_names(docs, "_statistics")
    out = with_statistics(docs, text, held)
    value = model.score(F.col(held)) if model else F.lit(1.0)
    return out.withColumn("score", value).drop(held)

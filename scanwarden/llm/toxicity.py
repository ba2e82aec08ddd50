"""Toxicity by a chain of linear classifiers (operator 8)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanwarden.llm.quality import held_out
from scanwarden.llm.shared import PLAIN_WORDS, encoded, written

#: Categories in the order of the chain, and the words that tell which category a toxic label is about.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "intellect": ("idiot", "stupid", "moron", "dumb", "fool", "clown"),
    "worth": ("worthless", "pathetic", "loser", "useless"),
    "disgust": ("trash", "scum", "disgusting", "garbage", "filth"),
}


#: Lengths of the beginnings: inflected and compound words share them.
BEGINNINGS = (5, 7)
LENGTH = "*"  # no word


def features_of(text: bytes, known: Mapping[str, int] | None = None) -> Counter[str]:
    """Words (runs of letters, digits and non-ASCII characters, A-Z lower-cased) and the beginnings of longer words, each with
    how often it occurs, and under ``LENGTH`` the number of words; only those in ``known`` if that is given."""
    found: Counter[str] = Counter()
    words = text.translate(PLAIN_WORDS).decode("utf-8", "replace").split()
    for w, times in Counter(words).items():
        for name in (w, *[w[:n] + "*" for n in BEGINNINGS if len(w) > n]):
            if known is None or name in known:
                found[name] += times
    if words:
        found[LENGTH] = len(words)
    return found


@dataclass(frozen=True)
class Chain:
    """Features with their columns, and per link its name, feature weights, weights of earlier links, and intercept."""

    vocabulary: Mapping[str, int]
    links: Sequence[tuple[str, np.ndarray, np.ndarray, float]]

    def probabilities(self, found: list[Mapping[str, int]]) -> np.ndarray:
        """A column for each link; ``found`` has the known features of each document."""
        out = np.zeros((len(found), len(self.links)))
        size = sum(map(len, found))
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        places = np.fromiter((self.vocabulary[w] for x in found for w in x), np.int64, size)
        values = np.log1p(np.fromiter((n for x in found for n in x.values()), float, size))
        for k, (_, words, earlier, intercept) in enumerate(self.links):
            z = np.bincount(owner, words[places] * values, len(found)) if size else np.zeros(len(found))
            out[:, k] = _logistic(z + out[:, :k] @ earlier + intercept)
        return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last column of ``x`` is constant."""
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = _logistic(x @ beta)
        slope = x.T @ (weight * (p - y)) + ridge * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        size = np.abs(step).max()
        beta -= step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-4:
            break
    return beta


def train_chain(found: list[Mapping[str, int]], vocabulary: list[str], labels: dict[str, np.ndarray], weight: np.ndarray,
                fold: np.ndarray, penalty: float = 0.3) -> Chain:
    """Fits the links in order. A later link sees the earlier ones' probabilities, which for training rows come from
    models that have not seen the row's fold."""
    at = {w: i for i, w in enumerate(vocabulary)}
    x = np.zeros((len(found), len(vocabulary)))
    for i, counts in enumerate(found):
        for w, n in counts.items():
            x[i, at[w]] = np.log1p(n)
    one = np.ones((len(found), 1))
    earlier = np.zeros((len(found), 0))
    links = []
    for name, y in labels.items():
        full = np.hstack([x, earlier, one])
        unseen = np.zeros(len(y))
        for f in np.unique(fold):
            rest = fold != f
            beta = _regression(full[rest], y[rest], weight[rest], penalty)
            unseen[~rest] = _logistic(full[~rest] @ beta)
        beta = _regression(full, y, weight, penalty)
        v = x.shape[1]
        links.append((name, beta[:v], beta[v:-1], float(beta[-1])))
        earlier = np.hstack([earlier, unseen[:, None]])
    return Chain(at, links)


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic",
        categories: Mapping[str, Sequence[str]] = CATEGORIES, most_rows: int = 4000, features: int = 200, least_gap: float = 5.0,
        folds: int = 5) -> Chain | None:
    """Learns the chain from labelled rows that are not held out; None without rows of both kinds.

    The labels name no category, so a category's label is a toxic label on a text with one of its words; the last link is
    the label itself. About ``most_rows`` rows of each kind are used, chosen by a hash of the id; both kinds weigh the
    same, as a missed toxic text costs more than a false alarm. Up to ``features`` words take part, those that tell toxic from other
    rows of the sample best, each by ``least_gap`` standard errors or more. An id that is labelled more than once is toxic if one
    label says so; of rows that share a labelled id, that with the smallest hash of the text is used; a null text has no words.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max(label).alias("y"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(totals) < 2:
        return None
    share = {y: min(1.0, most_rows / n) for y, n in totals.items()}
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(8)), F.lit(1_000_000)) / 1e6
    sample = known.where(draw < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([list(features_of(x or b"").items()) for x in encoded(batch.column(2))], pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words], ["id", "y", "words"])

    # the sample has about 2 * most_rows rows of two numbers, whatever the size of the corpus
    body = F.col(text).cast("string")
    rows = docs.select(F.col(ident).alias("doc_id"), F.struct(F.xxhash64(body).alias("h"), body.alias("text")).alias("body"))
    rows = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).groupBy("id", "y").agg(F.min("body")["text"].alias("text"))
    kind = sample.schema["id"].dataType.simpleString()
    read = written(rows.select("id", F.col("y").cast("int"), "text").mapInArrow(run, f"id {kind}, y int, words map<string,int>"))
    sizes = {r["y"]: r["count"] for r in read.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    seen = read.select("y", F.explode("words").alias("word", "times")).groupBy("word").agg(
        F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    p, q = F.col("a") / sizes[1], F.col("b") / sizes[0]
    mean = (F.col("a") + F.col("b")) / (sizes[0] + sizes[1])
    gap = (p - q) / F.sqrt(mean * (1 - mean) * (1 / sizes[0] + 1 / sizes[1]) + 1e-12)
    best = seen.where(p > q).select("word", gap.alias("gap")).where(F.col("gap") >= least_gap).orderBy(F.desc("gap"), "word").limit(features).collect()
    vocabulary = [r["word"] for r in best if r["word"] != LENGTH] + [LENGTH]
    known = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string"))
    hits = read.select("id", F.explode("words").alias("word", "times")).join(known, "word")
    hits = hits.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "times"))).alias("counts"))
    seeded = [F.arrays_overlap(F.map_keys("words"), F.array(*map(F.lit, seeds))).alias(f"seed_{name}") for name, seeds in categories.items()]
    table = read.select("id", "y", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(folds)).alias("fold"), *seeded).join(hits, "id", "left").orderBy("id").collect()
    found = [r["counts"] or {} for r in table]
    y = np.array([r["y"] for r in table], float)
    told: dict[str, np.ndarray] = {}
    for name in categories:
        told[name] = y * np.array([r[f"seed_{name}"] for r in table], float)
    told["toxic"] = y
    weight = np.where(y == 1, 1 / sizes[1], 1 / sizes[0])
    return train_chain(found, vocabulary, told, weight / weight.mean(), np.array([r["fold"] for r in table]))


def score(docs: DataFrame, chain: Chain | None, ident: str = "doc_id", text: str = "text", cut: float = 0.6,
          categories: Mapping[str, Sequence[str]] = CATEGORIES) -> DataFrame:
    """``doc_id``, a probability for each category (``p_<name>``), ``toxicity`` and ``toxic`` for each row of ``docs``.

    Whole texts are read; a null text counts as empty; without a chain all probabilities are 0; an empty table gives no
    rows; other columns are ignored.
    """
    names = [f"p_{c}" for c in categories]
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if chain is None:
                p = np.zeros((batch.num_rows, len(names) + 1))
            else:
                known = chain.vocabulary
                p = chain.probabilities([features_of(x or b"", known) for x in encoded(batch.column(1))])
            columns = [pa.array(p[:, k]) for k in range(p.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(p[:, -1] >= cut)], ["doc_id", *names, "toxicity", "toxic"])

    source = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in names) + ", toxicity double, toxic boolean")

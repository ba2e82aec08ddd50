"""The near-dedup stage of the pipeline takes candidates from SimHash fingerprints."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from scanwarden.llm import similar, simhash
from tests.llm.test_corpus import plain_components


def texts():
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(40):
        base = [f"w{rng.integers(50_000)}" for _ in range(400)]
        copy = list(base)
        copy[int(rng.integers(5, 395))] = "other"
        rows += [" ".join(base), " ".join(copy)]
    return [(k, t) for k, t in enumerate([*rows, "", None, rows[0].upper()])]


def frame(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts()], "doc_id long, text string, lang string, source string, n_chars long")


def test_fingerprints_alone_find_near_copies(spark, monkeypatch):
    marks = {i: simhash.fingerprint((t or "").encode()) for i, t in texts()}
    ids = [i for i, t in texts() if t]
    top = plain_components([(a, b) for a in ids for b in ids if a < b and (marks[a] ^ marks[b]).bit_count() <= 4], ids)
    groups = {t: min(i for i in ids if top[i] == t) for t in top.values()}
    assert 40 <= len(groups) < 75  # some near copies are within 4 bits
    monkeypatch.setattr(similar, "candidates", lambda classes: classes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false"))
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark), "").collect()}
    assert got == set(groups.values()) | {80}


def test_all_near_copies_are_found(spark):
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark), "").collect()}
    assert got == {*range(0, 80, 2), 80}

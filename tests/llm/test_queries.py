"""Registered corpus queries and the pipeline against plain versions over the smallest tables."""

import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from scanwarden.llm import packing, quality, simhash
from scanwarden.llm.queries import QUERIES
from tests.llm.test_similar import plain_groups
from tests.llm.test_corpus import lower, plain_components, plain_fingerprint, plain_lines, shingles


@pytest.fixture(scope="module")
def tables(spark, sf):
    def rows(name):
        return spark.read.parquet(f"{sf}/{name}.parquet").collect()
    return rows


def plain_pieces(rows):
    tokenizer = packing.Tokenizer.from_file(packing.TOKENIZER)
    out = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s : s + 2048], "<u4")
            out.append((i, k, s, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)


def well_packed(got):
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(filled) <= -(-sum(r.length for r in got) // 2048) + 1


def test_quality_query(spark, sf):
    """Over sf0.1, as the smallest table has 19 labelled rows that are held out."""
    folder = f"{sf}/../sf0.1"
    got = QUERIES["op1_quality_classifier"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(a == b for a, b in held) >= 0.98 * len(held)


def test_packing_query(spark, sf, tables):
    got = QUERIES["op5_best_fit_packing"](spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pieces([(r.doc_id, r.text) for r in tables("documents")])
    well_packed(got)


def test_html_query(spark, sf, tables):
    got = {r.page_id: r for r in QUERIES["op6_html_extraction"](spark, sf).collect()}
    pages = tables("pages")
    assert len(got) == len(pages)
    for page in pages:
        row = got[page.page_id]
        assert row.url == page.url and row.n_chars == len(row.text) and not re.search(r"(?m)^\s|\s$|\n\n|[ \t]{2}", row.text)


def plain_near(rows):
    marks = [plain_fingerprint(t) for _, t in rows]
    values = sorted(set(marks))
    near = [(a, b) for k, a in enumerate(values) for b in values[:k] if (a ^ b).bit_count() <= 4]
    roots = plain_components(near, values)
    least = {}
    for (i, _), m in zip(rows, marks):
        least[roots[m]] = min(i, least.get(roots[m], i))
    return [(i, f"{m:016x}", least[roots[m]]) for (i, _), m in zip(rows, marks)]


def test_simhash_query(spark, sf, tables):
    got = QUERIES["op7_simhash_near_dedup"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(plain_near([(r.doc_id, r.text) for r in tables("documents")]))


def test_toxicity_query(spark, sf, tables):
    got = QUERIES["op8_toxicity"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in tables("documents"))
    assert all(0 <= r.toxicity <= 1 and r.toxic == (r.toxicity >= 0.6) for r in got)


def test_licence_query(spark, sf, tables):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    got = {r.doc_id: r for r in QUERIES["op9_license_scan"](spark, sf).collect()}
    for doc in tables("documents"):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(doc.text))
        at, labels = [], set()
        for phrase, label in phrases.items():
            p = phrase.encode().split()
            found = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        row = got[doc.doc_id]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert row.base_labels == ",".join(sorted(labels)) and labels <= set(row.labels.split(",")) and 0 <= row.score <= 1
    assert len(got) == len(tables("documents"))


def test_pipeline(spark, sf, tables):
    """Each stage against a plain version; the classifier's cut is applied to scores of the fitted model."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(quality.document_statistics(docs), spark.read.parquet(f"{sf}/labels.parquet"))

    def score(text):
        x = np.array(quality.statistics((text or "").encode()))
        a, b = (model.offsets[c] - 0.5 * ((model.factors[c] @ (x - model.means[c])) ** 2).sum() for c in (0, 1))
        return 1 / (1 + math.exp(min(700.0, max(-700.0, a - b))))
    rows = [(r.doc_id, r.text) for r in tables("documents")]
    rows = [(i, t) for i, t in rows if score(t) >= 0.3]
    assert 0 < len(rows) < docs.count()
    rows = [(int(i), t) for i, t, *_ in plain_lines(rows)]
    rows = [(i, t) for (i, t), least in zip(rows, plain_groups(rows)) if least == i]
    items = [shingles(r.text) for r in tables("benchmark")]
    rows = [(i, t) for i, t in rows if not any(len(x & s) >= math.ceil(0.8 * len(x) - 1e-9) for s in [shingles(t)] for x in items if x)]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pieces(rows)
    well_packed(got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]

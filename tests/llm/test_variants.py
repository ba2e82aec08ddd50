"""Spelling variants (operator 13) against all pairs."""

import random
import re
import zlib
from collections import Counter

from scanwarden.llm import variants


def plain_words(docs, least_length=6, least_n=5, every=199):
    counts = Counter()
    for i, text in docs:
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_n}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words, times=5):
    rows = {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = others[0][1] if others and -others[0][0] >= times * n else None
        rows[w] = (form, n, len(others), words[form] if form else None)
    out = set()
    for w, (form, n, k, m) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.add((w, form, root, n, k, m))
    return out


def test_all_pairs(spark):
    """Few letters, so that words have runs of equal letters, many neighbours and long ways of forms."""
    draw = random.Random(5)
    words = {"".join(draw.choice("aabé") for _ in range(draw.randint(6, 8))): 5 ** draw.randint(1, 7) + draw.choice((0, 0, 1)) for _ in range(500)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(table).collect()}
    assert got == plain_variants(words)
    assert any(r[1] and r[1] != r[2] for r in got)


def test_whole_texts(spark):
    draw = random.Random(7)
    base = ["Gallery", "gallary", "GALLERYS", "ÉTOILES", "Étoiles", "étoile", "short", "naïveté", "naïvetés", "gal-lery"]
    docs = [(i, " ".join(draw.choice(base) for _ in range(400))) for i in range(30)]
    docs += [(None, "gallery " * 9), (3, None), (4, ""), (5, "gallery," * 30_000), (5, "x" * 200_000), (6, "1234567 $$$$$$$")]
    table = spark.createDataFrame([(*d, 1, "k", 2) for d in docs], "doc_id long, text string, word int, key string, run int")
    words = variants.word_counts(table)
    want = plain_words(docs)
    assert {(r.word, r.n) for r in words.collect()} == set(want.items()) and any(len(w) == 6 for w in want)
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(words).collect()}
    assert got == plain_variants(want) and any(r[1] for r in got)


def test_nothing(spark):
    table = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert variants.spelling_variants(variants.word_counts(table)).collect() == []
    assert variants.spelling_variants(variants.word_counts(table.limit(0))).collect() == []

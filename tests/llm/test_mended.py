"""Repeated rows, clashing names, and pages and licence texts that are long or altered."""

import re
import time

import numpy as np
from pyspark.sql import functions as F

from scanwarden.llm import contamination, html, licences, packing, quality, similar, toxicity
from scanwarden.llm.shared import PLAIN_WORDS


def test_clashing_names(spark):
    """Columns named like those that operators add stay as they are."""
    names = ["_bad", "_found", "_own", "_id", "_body", "_statistics", "body", "row", "node", "size_class"]
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, long, *names), (2, long, *names), (3, "a b c", *names), (4, None, *names)],
                                 "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(7, long)], "item_id long, text string")
    left = contamination.without_contamination(docs, items)
    one = similar.one_of_each(docs)
    scored = quality.score(docs, None)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4] and sorted(r.doc_id for r in one.collect()) == [1, 3, 4]
    assert left.columns == one.columns == docs.columns and scored.columns == [*docs.columns, "score"]
    for df in (left, one, scored):
        assert all(r[n] == n for r in df.collect() for n in names)


def test_toxicity_of_repeated_rows_and_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    once = toxicity.fit(docs, labels)
    again = toxicity.fit(docs.union(docs), labels.union(labels))
    assert once.vocabulary == again.vocabulary
    assert all(np.allclose(a[1], b[1]) and np.allclose(a[2], b[2]) for a, b in zip(once.links, again.links))
    # one id with both labels is toxic, whichever row comes first
    both = labels.union(labels.where("toxic = 1").withColumn("toxic", F.lit(0).cast(labels.schema["toxic"].dataType)))
    assert toxicity.fit(docs, both).vocabulary == once.vocabulary


def test_rare_seed_words_count(spark):
    """A seed in few texts is no feature, and its category has labels all the same."""
    rows = [(i, "you trash thing here now") for i in range(0, 400, 2)] + [(i, "quiet river stone here now") for i in range(1, 401, 2)]
    rows[:3] = [(i, t + " scum") for i, t in rows[:3]]
    rows[3:5] = [(i, "you idiot thing here now") for i, _ in rows[3:5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in rows], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels, least_gap=6.0)
    assert "idiot" not in chain.vocabulary
    scores = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    assert any(np.abs(words).max() > 0 for name, words, _, _ in chain.links if name == "intellect") and scores[0].toxic and not scores[1].toxic


def test_pages_with_open_tags_are_read_once():
    for start in ("<a ", "<script ", "<a 'x", "<div class=\"x\" "):
        began = time.monotonic()
        html.lines_of(start * 200_000)
        assert time.monotonic() - began < 20
    assert html.lines_of("<p>a <b title='x>y'>c</b> 1 < 2") == [("a c 1 < 2", html.PLAIN)]


def test_alignment_of_long_pages():
    rng = np.random.default_rng(1)
    a, b = rng.permutation(6000).tolist(), rng.permutation(6000).tolist()
    found = html.common_lines(a, b)
    at = {x: j for j, x in enumerate(b)}
    # a longest common subsequence of two orders is a longest increasing run of places
    tails = []
    for x in (at[x] for x in a):
        k = int(np.searchsorted(tails, x)) if tails else 0
        tails[k : k + 1] = [x]
    assert len(found) == len(tails) and [at[a[i]] for i in found] == sorted(at[a[i]] for i in found)


def test_equal_pieces_are_dealt_to_many_groups(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 700, 9)] * 3000, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces, group_rows=100).collect()
    assert len({r.sequence_id >> 40 for r in got}) > 20 and max(r.offset + r.length for r in got) <= 2048


def _pattern(template):
    """A template as a regular expression over words with a space after each."""
    out = ""
    for t in re.findall(r"\[|\]|<\d+>|[^\s\[\]<>]+", template):
        out += "(?:" if t == "[" else ")?" if t == "]" else r"(?:\S+ ){0,%s}" % t[1:-1] if t[0] == "<" else re.escape(t) + " "
    return re.compile(r"(?:(?<= )|^)" + out)


def _filled(template, more):
    """Wording that the template accepts, with or without what is optional."""
    while not more and "[" in template:
        template = re.sub(r"\[[^\[\]]*\]", " ", template)
    return " ".join(re.sub(r"<\d+>", " any " if more else " ", template.replace("[", " ").replace("]", " ")).split())


def test_templates_equal_patterns(spark):
    """Whole, shortened and altered wording of each template against a matcher made another way."""
    rng = np.random.default_rng(2)
    texts = []
    for template in licences.TEMPLATES.values():
        for more in (False, True):
            words = _filled(template, more).split()
            texts.append(" ".join(["Before", *words, "after."]))
            for _ in range(4):
                changed = list(words)
                k = int(rng.integers(len(words)))
                changed[k : k + 1] = [[], ["other"], [words[k], "other"]][int(rng.integers(3))]
                texts.append(" ".join(changed).upper())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.licences(docs).collect()}
    altered = 0
    for i, text in enumerate(texts):
        joined = " ".join(text.encode().translate(PLAIN_WORDS).decode().split()) + " "
        want = {licences.ALIASES.get(k, k) for k, t in licences.TEMPLATES.items() if _pattern(t).search(joined)}
        assert set(got[i].labels) == want | set(got[i].base_labels), text
        altered += not want
    assert altered > 40

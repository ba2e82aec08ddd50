"""Personal data and terms that give it away (operator 12) against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from scanwarden.llm import pii
from scanwarden.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
            "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def plain_base(text):
    found = [(m.start(), k, m.end(), m[0]) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if holds(kind, m[0])]
    return sorted(found)


def plain_value(kind, match):
    return kind + ":" + (match.lower() if kind == "email" else match if kind == "ip" else re.sub("[^0-9]", "", match))


def plain_contexts(text):
    for s in re.split(r"\n|(?<=[.!?]) ", text or ""):
        if s:
            yield from re.sub(r"((?:\S+\s+){64})", r"\1\n", s).split("\n")


def words_of(text):
    return {w for w in re.findall(r"[^\W_]{3,}", text.lower())}


def plain_terms(texts, disclosure=0.9, least=5):
    every = {c for t in texts for c in plain_contexts(t)}
    n_e, n_t, both = Counter(), Counter(), Counter()
    for c in every:
        n_t.update(words_of(c))
        entities = {plain_value(list(PLAIN)[k], m) for _, k, _, m in plain_base(c)}
        if entities:
            bare, done = "", 0
            for s, _, e, _ in plain_base(c):
                bare, done = bare + c[done:s] + " ", max(done, e)
            bare += c[done:]
            n_e.update(entities)
            both.update((e, t) for e in entities for t in words_of(bare))
    total = len(every) + 1
    return {(e, t) for (e, t), n in both.items() if n >= least and 1 - math.log2(n_t[t] / n) / math.log2(total / n_e[e]) >= disclosure}


def plain_spans(text, terms):
    base = plain_base(text)
    mine = {t for e, t in terms for _, k, _, m in base if e == plain_value(list(PLAIN)[k], m)}
    more = [(m.start(), 4, m.end(), "") for m in re.finditer(r"[^\W_]{3,}", text or "") if m[0].lower() in mine
            and not any(s < m.end() and e > m.start() for s, _, e, _ in base)]
    return sorted(base + more)


def digest(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


TEXTS = [
    None, "", "x", "a@b.c", "a@b.c_x@d.e", "a@@b.c y@z@w.com", "A.b%c+d-e@ex-ample.co.uk. end", "a@b", "@b.c", "é@b.c ü1.2.3.4ü",
    "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 0255.000.01.1 0000000000000000000000255.1.1.1", "1.2.3", "999999999999.1.1.1", "mail@1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "0000 0000 0000", "1 2 3 4 5", "12--34", "79927398713 799273987130000",
    "+1 (743) 555-3824 x", "+4915112345678.", "+1.", "+12345678", "+1234567890123456", "+1 ((((((5", "++1 555 555 5555", "1+1 +1-5 +1 5", "4111 1111 1111 1111 1",
    "\U0001f600 a@b.c \U0001f600 +49 151 1234567 İ@b.c", "a@b.c\nb@c.d\n\n9.9.9.9", "+1 415 555 0100 4111111111111111",
]


def test_base_equals_plain(spark):
    draw = random.Random(3)
    texts = TEXTS + ["".join(draw.choice("aZ09.@+-() \n%é") for _ in range(draw.randint(5, 400))) for _ in range(300)]
    texts += ["".join(draw.choice("01 -.+") for _ in range(300)) for _ in range(200)]
    docs = spark.createDataFrame([(i % 400, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, spans string")
    got = sorted((r.doc_id, r.base) for r in pii.sanitised(docs).select("doc_id", pii.joined("base").alias("base")).collect())
    assert got == sorted((i % 400, digest(plain_base(t))) for i, t in enumerate(texts))


def test_long_texts(spark):
    """A run of a million letters or digits, and many thousands of matches in one text, are read once."""
    texts = ["a" * 1_000_000, "1" * 1_000_000, "x@" + "a." * 200_000 + "b", "+1" + " " * 500_000, "me@b.c, " * 20_000, "1.2.3.4\n" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n for r in pii.sanitised(docs).selectExpr("doc_id", "size(spans) AS n").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0, 4: 20_000, 5: 20_000}


@pytest.fixture(scope="module")
def corpus():
    """One address stands beside the words ``falconer`` and ``falconry`` in many sentences, others beside common words only."""
    draw = random.Random(11)
    common = ["river", "stone", "market", "winter", "garden", "letter", "window", "evening", "falcon", "journey"]
    rows = []
    for i in range(120):
        words = [" ".join(draw.choice(common) for _ in range(8)) for _ in range(6)]
        if i % 10 == 0:
            words[2] += f" ask the Falconer {draw.choice(common)} kx204 at Ann.Lee@example.com or so"
            words[4] += f" the old FALCONRY club {i}"
        elif i % 10 == 1:
            words[2] += f" write to bob{i}@example.com"
        elif i % 10 == 2:
            words[3] += " at zed@example.com with " + " ".join(draw.sample(common, 3))
        rows.append((i, ". ".join(words) + "."))
    # a thousand copies of a page are one observation: its rare words stay
    rows += [(1000 + i, "solitary quixotic phrase beside rare@example.org") for i in range(1000)]
    rows += [(5, None), (6, ""), (0, rows[0][1])]
    return rows


def test_terms_equal_plain(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    found = pii.sanitised(docs).select("doc_id", pii.joined("spans").alias("spans"), "text").collect()
    terms = plain_terms([t for _, t in corpus])
    assert {t for _, t in terms} == {"falconer", "ask", "kx204", "with"}
    assert sorted((r.doc_id, r.spans) for r in found) == sorted((i, digest(plain_spans(t, terms))) for i, t in corpus)
    texts = {r.doc_id: r.text for r in found}
    assert "Falconer" not in texts[10] and "Ann.Lee" not in texts[10] and "<EMAIL>" in texts[10]
    assert "solitary quixotic" in texts[1000]
    # words that begin like it are common, so the term is generalised; what begins like the other gives as much away, so it goes
    assert "falc*" in texts[10] and "kx204" not in texts[10] and "kx20*" not in texts[10] and "FALCONRY" in texts[10]


def test_replaced_text(spark):
    text = "A a@1.2.3.4 b +1 415 555 0100 c 4111 1111 1111 1111."
    docs = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")
    assert sorted(r.text for r in pii.sanitised(docs).collect()) == ["", *["A <EMAIL> b <PHONE> c <CARD>."] * 2]
    assert pii.sanitised(docs.limit(0)).collect() == []


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    terms = plain_terms([r.text for r in rows])
    want = []
    for r in rows:
        base = plain_base(r.text)
        counts = Counter(k for _, k, _, _ in base)
        want.append((r.doc_id, *[counts[k] for k in range(4)], hashlib.sha256(digest(base).encode()).hexdigest(), digest(plain_spans(r.text, terms))))
    got = QUERIES["op12_pii"](spark, sf)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(w[-1] for w in want)

"""Filter interaction audit (operator 11) on small tables."""

import re
from collections import Counter
from itertools import permutations

from scanwarden.llm import audit

DOCS = "doc_id long, text string, lang string, mask string, n string, good string, body string, part string"


def plain_audit(docs, labels):
    said = {}
    for i, q, t in (x for x in labels if x[0] is not None):
        a = said.setdefault(i, [False, False])
        a[0] |= q == 1
        a[1] |= t == 1
    fails = []
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append((part or "", ["ABCDE"[k] for k, x in enumerate([
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), e]) if x],
            *said.get(i, (False, False))))
    out = {}
    for part in {p for p, *_ in fails}:
        total, rows = Counter(), {}
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                c = Counter(kept=0, removed=0, redundant=0, unique_fails=0, good_lost=0, toxic_lost=0)
                for p, bad, good, toxic in fails:
                    if p != part:
                        continue
                    gone = any(x in bad for x in order[:k])
                    c["kept"] += not gone and f not in bad
                    c["removed"] += not gone and f in bad
                    c["redundant"] += gone and f in bad
                    c["unique_fails"] += bad == [f]
                    c["good_lost"] += not gone and f in bad and good
                    c["toxic_lost"] += not gone and f in bad and toxic
                total[f] += c["removed"]
                rows[part, order, k + 1] = c
        out.update({k: {**c, "shapley": total[k[1][k[2] - 1]]} for k, c in rows.items()})
    return out


def test_audit_equals_plain(spark):
    prose = " ".join(f"word{i}" for i in range(250))
    docs = [(1, prose, "en"), (2, prose, "de"), (3, prose, None), (4, None, ""), (5, "", "en"), (6, "A b " * 150, "en"), (6, "A b " * 150, "en"),
            (7, prose + " #", "en"), (8, "é" * 40 + "ABC", "en"), (None, prose, "en"), (None, None, "fr"), (9, " \t" + prose + "\n", "de"),
            (10, "LOUD " * 20_000, "de"), (11, "a|b", "en"), (12, "a b &", "en")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, 1, 1), (7, None, 1), (8, 1, None), (None, 1, 1), (99, 1, 1)]
    # columns that clash with the operator's own names are no trouble
    table = spark.createDataFrame([(*d, "m", "n", "g", "b", "p") for d in docs], DOCS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(table, known).collect()
    want = plain_audit(docs, labels)
    names = (*audit.COUNTS, "shapley")
    assert len(got) == len(want) == 4 * 600
    for r in got:
        assert {c: r[c] for c in names} == {c: want[r.part, r.filter_order, r.step][c] for c in names}, r


def test_audit_of_nothing(spark):
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(spark.createDataFrame([], DOCS), known).collect() == []
    got = audit.filter_audit(spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string"), known).collect()
    assert len(got) == 600 and sum(r.removed for r in got) == sum(r.removed for r in got if r.filter_order[r.step - 1] == "A") > 0

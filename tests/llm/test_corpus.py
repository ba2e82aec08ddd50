"""Corpus operators against plain versions on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import io
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from scanwarden.llm import contamination, exact, graph, html, licences, lines, packing, quality, simhash, toxicity, warc

LONG = " ".join(f"word{i}" for i in range(20_000))
SHARED = "this line stands in many documents of the corpus"
ROWS = [
    (1, f"Alpha beta gamma\n{SHARED}\nshort"), (2, f"  {SHARED.upper()} \nown line number two, long enough"), (3, f"{SHARED}\n{SHARED}\nx"),
    (4, None), (5, ""), (6, ""), (7, LONG), (8, LONG.upper()), (9, "Alpha beta gamma"), (10, "ALPHA BETA GAMMA"), (10, "ALPHA BETA GAMMA"),
    (None, "alpha Beta gamma"), (11, "ÉCOLE école Alpha"), (12, "école école alpha"), (13, LONG + " tail"), (14, "\n\n\n"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # other columns carry names that the operators use themselves
    rows = [(i, t, "h", i, 0.5, 1) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, line string, fp long, score double, n_lines int").repartition(3)


def empty(df):
    return df.where("false")


def lower(text):
    return (text or "").encode().lower()


def test_exact(docs):
    groups = {}
    for i, t in ROWS:
        groups.setdefault(lower(t), []).append(i)
    want = sorted(
        (str(i), max([x for x in groups[lower(t)] if x is not None], default=None), len(groups[lower(t)]),
         i == max([x for x in groups[lower(t)] if x is not None], default=None), hashlib.sha256(lower(t)).hexdigest()) for i, t in ROWS)
    for held in (32 << 20, 50):  # the second leaves the local trie at each text and spills the other by subtree
        got = exact.exact_duplicates(docs, held_bytes=held).collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == want
    assert exact.exact_duplicates(empty(docs)).count() == 0


def test_trie_spills_by_subtree():
    words = [("ab" * (i % 7) + str(i % 50)).encode() for i in range(500)] + [b"", b"a", b"ab"]
    want = {}
    for w in words:
        want[w] = want.get(w, 0) + 1
    for budget in (None, 1, 20, 200):
        trie = exact.Trie(lambda a, b: a + b, budget)
        for w in words:
            trie.add(w, 1)
        found = list(trie.items())
        assert len(found) == len(want) and dict(found) == want


def plain_lines(rows, least=20, often=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    ids = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            ids.setdefault(key(x), set()).add(-1 if i is None else i)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < least or len(ids[key(x)]) < often or max(ids[key(x)]) == (-1 if i is None else i)]
        out.append((str(i), "\n".join(kept), len(all_), len(all_) - len(kept)))
    return sorted(out)


def test_lines(docs, spark):
    got = lines.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "line", "fp", "score", "n_lines", "n_dropped"]
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got.collect()) == plain_lines(ROWS)
    many = [(i, f"{SHARED}\nrow {i % 40} of a line that repeats in the corpus\n{SHARED}") for i in range(300)] + [(None, SHARED)]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(5)
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(df).collect()) == plain_lines(many)
    small = lines.keep_bitmaps(df, held_lines=3).collect()
    assert {(r.doc_id, r.n_dropped) for r in small} == {(r.doc_id, r.n_dropped) for r in lines.keep_bitmaps(df).collect()}
    assert lines.dedup_lines(empty(docs)).count() == 0


def shingles(text, n=5):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_contamination(spark, docs):
    item = "the quick brown fox jumps over the lazy dog and then sleeps until the late morning comes again"
    items = [(1, item), (2, item), (3, "too short here"), (4, None), (5, " ".join(f"word{i}" for i in range(100, 140))), (6, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = item.split()
    rows = ROWS + [(20, f"{LONG} {item.upper()} end"), (21, " ".join(words[:-1])), (22, " ".join(words[:9])), (23, item.replace(" ", "-, ")),
                   (20, f"{LONG} {item.upper()} end"), (24, " ".join(words[::-1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = set()
    for i, t in rows:
        for k, x in items:
            part = shingles(x)
            hit = len(part & shingles(t))
            if part and hit >= math.ceil(0.8 * len(part)):
                want.add((i, k, len(part), hit))
    got = contamination.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id, r.item_shingles, r.matched) for r in got} == want and len(got) == len(want)
    assert {7, 8, 13, 20, 21, 23} <= {w[0] for w in want} and not {22, 24} & {w[0] for w in want}
    left = contamination.without_contamination(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in ROWS if i not in {w[0] for w in want})
    assert contamination.contaminated(empty(docs), bench).count() == 0 == contamination.contaminated(df, bench.where("false")).count()


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower(text))
    parts = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n
    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, spark):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal("fp").alias("h"), "component_id").collect()
    marks = [(i, plain_fingerprint(t)) for i, t in ROWS]
    near = [(a, b) for a in range(len(marks)) for b in range(a) if (marks[a][1] ^ marks[b][1]).bit_count() <= 4]
    roots = plain_components(near, range(len(marks)))
    groups = {}
    for n, r in roots.items():
        groups.setdefault(r, []).append(marks[n][0])
    want = [(str(marks[n][0]), f"{marks[n][1]:016x}", min([i for i in groups[r] if i is not None], default=None)) for n, r in roots.items()]
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == sorted(want)
    assert simhash.near_duplicates(empty(docs)).count() == 0


@pytest.mark.parametrize("rows,cell", [(1, 4096), (10**9, 40), (10**13, 4096)])
def test_simhash_links(spark, rows, cell):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for x in base for k in (2, 4, 5)]
    dense = [int(base[0]) ^ 1 << a ^ 1 << b for a in range(20) for b in range(20, 30)]
    values = sorted({*(int(x) for x in base), *near, *dense})
    want = plain_components([(a, b) for a in values for b in values if b < a and (a ^ b).bit_count() <= 4], values)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in values], "fp long")
    masks = simhash.block_masks(rows, 4)
    found = simhash.links(df, bucket_rows=0 if rows > 1 else 512, cell_rows=cell).collect()
    got = plain_components([(r.a % 2**64, r.b % 2**64) for r in found], values)
    assert got == want
    for m in masks[:3]:
        assert bin(m % 2**64).count("1") >= 12


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 199)]
    df = spark.createDataFrame(pairs, "a long, b long")
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    assert dict(tuple(r) for r in graph.components(df).collect()) == plain_components([p for p in pairs if p[0] != p[1]], nodes)


def test_warc(spark):
    pages = [(1, "http://a/1", "<p>x</p>", 1), (2, "http://a/2", "<p>x</p>", 2), (3, None, None, 3), (4, "u\r\nX: y", "", 4), (5, "http://b", "é" * 400_000, 5),
             (5, "http://b", "é" * 400_000, 5), (None, "http://c", "<p>x</p>", 6), (6, "http://d", "one of a kind\r\n\r\nWARC/1.1", 7)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload int")
    last = {}
    for i, _, h, _ in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in pages:
        data, owner = (h or "").encode(), last[h or ""]
        same = (-1 if i is None else i) == owner
        want.append((str(i), len(data), warc.digest(data), "response" if same else "revisit", None if same else owner))
    got = warc.round_trip(df, with_payload=True).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want)
    assert all(warc.digest(r.payload) == r.payload_digest for r in got if r.record_type == "response")
    big = warc.round_trip(df, min_bytes=100).collect()
    assert {r.record_type for r in big} == {"response"}
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_reader_finds_damage():
    one = warc.record(1, "http://a", b"payload", None, False)
    good = warc.member(one) + warc.member(warc.record(2, "http://b", b"", None, False))
    assert [r[0] for r in warc.read_records(io.BytesIO(good))] == [1, 2]
    for bad in (warc.member(one.replace(b"payload", b"paYload")), good[:-20], warc.member(one + b"x"), warc.member(one[:-9]), warc.member(b"no record\r\n\r\n")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))


def test_packing(docs):
    got = packing.pack_documents(docs).collect()
    tokenizer = packing.Tokenizer.from_file(packing.TOKENIZER)
    want = []
    for i, t in ROWS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(str(i), k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(want)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(filled) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.pack_documents(empty(docs)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_all_constraints(rule):
    limits = packing.Limits(tokens=100, documents=4, attention=6000, weights=(1.0, 0.2, 0.3), rule=rule)
    rng = np.random.default_rng(1)
    bins, plain = packing.BestFit(limits), []
    for n in sorted(rng.integers(1, 75, 400).tolist(), reverse=True):
        number, offset = bins.place(n)
        if number == len(plain):
            plain.append([])
        held = plain[number]

        def value(b, n=n):
            r, d, a = 100 - sum(b), 4 - len(b), 6000 - sum(x * x for x in b)
            if r < n or d < 1 or a < n * n:
                return None
            if rule == "norm":
                return ((r - n) / 100) ** 2 + 0.2 * ((d - 1) / 4) ** 2 + 0.3 * ((a - n * n) / 6000) ** 2
            return -(n * r / 100**2 + 0.2 * d / 16 + 0.3 * n * n * a / 6000**2)
        assert offset == sum(held)
        rivals = [v for b in plain if b and (v := value(b)) is not None]
        if held:
            assert value(held) == pytest.approx(min(rivals))
        else:
            assert not rivals
        held.append(n)
    with pytest.raises(ValueError):
        bins.place(101)


PAGE = ("<html><head><title>t</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><ul><li>Home<li>News</ul></nav>"
        "<div class='ad'>Buy</div>{}<aside>More</aside><footer>&copy; 2024</footer>")


def test_html(spark):
    main = "<article><h1>A &amp; B</h1><p><b>One\n  two<br>three<p>Four&nbsp;five<script>var t='</p>';</script><div class=\"comments\"><p>Nice!</p></div></article>"
    pages = [(1, "http://h/a/1", PAGE.replace("{}", main)), (2, "http://h/a/2?x=1", PAGE.replace("{}", main)), (3, "http://h/a/3", None), (4, None, ""),
             (5, "http://h/b/1", "<body><p>Welcome to us</p><p>Own words</p><p>Bye</p>"), (6, "http://h/b/2", "<body><p>Welcome to us</p><p>Other words</p><p>Bye</p>"),
             (6, "http://h/b/2", "<body><p>Welcome to us</p><p>Other words</p><p>Bye</p>"), (7, "http://alone/", "<p>Only &lt;page&gt; &#233;</p><form>x</form>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("path", html.F.lit("p")).withColumn("text", html.F.lit(1))
    want = {1: "A & B\nOne two three\nFour five", 2: "A & B\nOne two three\nFour five", 3: "", 4: "", 5: "Own words", 6: "Other words", 7: "Only <page> é"}
    for hot in (20_000, 1):
        got = html.main_text(df, hot_rows=hot).collect()
        assert len(got) == len(pages) and all(r.text == want[r.page_id] for r in got)
    assert html.main_text(df.where("false")).count() == 0


def test_common_lines():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 14)).tolist() for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = html.common_lines(a, b)
        rest = iter(b)
        assert len(found) == table[-1][-1] and found == sorted(set(found)) and all(a[i] in rest for i in found)


def test_quality(spark, sf, docs):
    data, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(quality.document_statistics(data), labels)
    scored = quality.score(data, model).join(labels, "doc_id").where(quality.held_out(quality.F.col("doc_id"))).collect()
    right = sum((r.score >= 0.3) == (r.quality == 1) for r in scored)
    assert right >= 0.95 * len(scored) > 0
    odd = quality.score(docs, model)
    assert sorted(odd.columns) == sorted(docs.columns)
    assert all(0 <= r.score <= 1 for r in odd.collect()) and odd.count() == len(ROWS)
    assert quality.fit(quality.document_statistics(empty(docs)), labels) is None and quality.score(empty(docs), None).count() == 0
    x = np.array(quality.statistics(b"Some text here, and there."))
    far = [model.offsets[c] - 0.5 * ((model.factors[c] @ (x - model.means[c])) ** 2).sum() for c in (0, 1)]
    one = quality.score(spark.createDataFrame([(1, "Some text here, and there.")], "doc_id long, text string"), model).first().score
    assert one == pytest.approx(1 / (1 + math.exp(far[0] - far[1])))


def test_toxicity(spark, sf, docs):
    data, labels = (spark.read.parquet(f"{sf}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(data, labels)
    got = toxicity.score(docs, chain)
    assert got.columns == ["doc_id", "p_intellect", "p_worth", "p_disgust", "toxicity", "toxic"] and got.count() == len(ROWS)
    assert toxicity.score(empty(docs), chain).count() == 0 and not any(r.toxic for r in toxicity.score(docs, None).collect())
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    found = [(truth[r.doc_id], r.p) for r in toxicity.score(data, chain).select("doc_id", quality.held_out(quality.F.col("doc_id")).alias("h"), toxicity.F.col("toxic").alias("p")).collect()
             if r.h and r.doc_id in truth]
    assert sum(p for t, p in found if t) >= 0.85 * sum(t for t, _ in found) and sum(p for t, p in found if not t) <= 0.01 * len(found)


def test_licences(docs, spark):
    texts_ = ["Released under the MIT License. Under the MIT license!", "Licensed under CC BY-NC 4.0.", "licensed under the Apache License, Version 2.0",
              "This work is licensed under the GNU General Public License, version 3.", "This is licensed under the terms of the GNU General Public License version 2 or later",
              "the GNU General Public License", "", None, "licensed under the GNU Lesser General Public License, version 3, or (at your option) any later version"]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").withColumn("base", licences.F.lit(1))
    got = {r.doc_id: r for r in licences.licences(df).collect()}
    assert [got[i].labels for i in range(9)] == [["mit"], ["cc-by-nc"], ["apache-2"], ["gpl-3"], ["gpl-2"], [], [], [], ["lgpl-3"]]
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (9, 2, 1, 5, ["mit"])
    assert (got[3].n_base, got[3].first_word, got[3].base_labels) == (0, None, []) and all(0 <= r.score <= 1 for r in got.values())
    assert licences.licences(empty(docs)).count() == 0 and licences.licences(docs).count() == len(ROWS)


def test_automaton():
    a = licences.Automaton("[the] work <2> is [[very] free] <1>")
    for text, ok in {"work is": True, "the work x y is very free z": True, "work x y z is": False, "work is very": True, "the is": False}.items():
        assert (a.accepts(text.encode().split(), 0) == len(text.split())) == ok

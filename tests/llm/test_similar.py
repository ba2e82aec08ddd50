"""The near-dedup stage of the pipeline against all pairs, on planted copies at Jaccard similarities around 0.8 to 0.95."""

import numpy as np

import corpus_pipeline
from scanwarden.llm import similar
from tests.llm.test_corpus import plain_components


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_groups(rows):
    """Least id of the group of each row, by all pairs."""
    sets = [plain_shingles(t) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (not sets[a] and not sets[b]) or (
        sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)]
    top, least = plain_components(near, range(len(rows))), {}
    for k, (i, _) in enumerate(rows):
        least[top[k]] = min(i, least.get(top[k], i))
    return [least[top[k]] for k in range(len(rows))]


def planted():
    """240 texts with copies that differ in 1 to 14 words of 300, a chain, short and empty texts; and the similarity of each
    copy to its text."""
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(50_000)}"
    rows, near = [], []
    for k in range(240):
        base = [word() for _ in range(300)]
        copy = list(base)
        for at in rng.choice(300, 1 + k % 14, replace=False):
            copy[at] = word()
        x, y = " ".join(base), " ".join(copy)
        rows += [x, y]
        near.append(len(plain_shingles(x) & plain_shingles(y)) / len(plain_shingles(x) | plain_shingles(y)))
    chain = [word() for _ in range(200)]
    for k in range(12):  # each like the next, the ends unlike
        chain = chain[:10 * k] + [word() for _ in range(10)] + chain[10 * k + 10 :]
        rows.append(" ".join(chain))
    rows += ["One two three", "one  two\nthree", "one two", None, "", " \n", rows[0].upper()]
    return [(1000 - i, t) for i, t in enumerate(rows)], near


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_near_dedup_stage_finds_all_copies(spark):
    rows, near = planted()
    assert sum(0.8 <= x < 0.85 for x in near) > 20 and sum(0.85 <= x < 0.95 for x in near) > 50 and sum(x < 0.8 for x in near) > 40
    want = sorted(i for (i, _), least in zip(rows, plain_groups(rows)) if i == least)
    df = frame(spark, rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == want
    cut = similar.one_of_each(df, cell_rows=3, cell_shingles=900)  # groups in several cells
    assert sorted(r.doc_id for r in cut.collect()) == want
    assert corpus_pipeline.near_dedup(spark, df.where("false"), "").count() == 0


def test_one_of_each_where_ids_repeat_or_are_null(spark):
    rows = [(1, "a b c d e"), (1, "other words stand here alone"), (None, "no id at all but words"), (None, "A B C D E"), (2, "A b c d e"),
            (3, None), (3, ""), (4, ""), (5, "x y z"), (5, "x y z"), (None, "no id at all but words")]
    got = similar.one_of_each(frame(spark, rows))
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in got.collect()) == sorted(
        [("1", "a b c d e"), ("1", "other words stand here alone"), ("None", "no id at all but words"), ("3", ""), ("5", "x y z")])


def test_links_of_sets_in_a_cell():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(200)]
    want = plain_components([(a, b) for a in range(200) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b])) - 1e-9], range(200))
    links = list(similar.similar_sets(sets, 0.6))
    assert plain_components(links, range(200)) == want and len(set(want.values())) == 200 - len(links)


def test_near_dedup_stage_on_the_smallest_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted(i for (i, _), least in zip(rows, plain_groups(rows)) if i == least)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == want

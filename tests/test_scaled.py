"""Similarity search over an index, and resampling on counts, against plain versions."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanwarden.operators import resampling, similarity


@pytest.fixture(scope="module")
def vectors(spark):
    """3,000 vectors around 40 directions, copies and zeros among them; and 150 queries."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16)) * 3
    x = centres[rng.integers(40, size=3000)] + rng.standard_normal((3000, 16)) * 0.6
    x[100:140] = x[100]
    x[200:204] = 0
    q = np.concatenate([x[95:105] + 0.01, centres[rng.integers(40, size=138)] + rng.standard_normal((138, 16)), np.zeros((2, 16))])
    known = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "i int, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(8888, None)], "j int, embedding array<double>")
    return x, q, known, asked


def plain_top(x, q, k, threshold, metric):
    if metric == "cosine":
        unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
        sims = unit(q) @ unit(x).T
    else:
        sims = -np.linalg.norm(q[:, None] - x[None], axis=2)
    out = set()
    for i, row in enumerate(sims):
        best = sorted(range(len(x)), key=lambda j: (-round(row[j], 9), j))[:k]
        out |= {(i, j) for j in best if row[j] > threshold}
    return out


@pytest.mark.parametrize("metric, threshold", [("cosine", 0.7), ("cosine", -1.0), ("euclidean", -2.5), ("euclidean", float("-inf"))])
def test_index_is_exact(vectors, metric, threshold):
    x, q, known, asked = vectors
    index = similarity.build_index(known, "i", metric=metric, cells=50, block_rows=64)
    assert int((index.slices > 0).sum()) > 20 and index.slices.max() > 1
    got = similarity.search(index, asked, "j", k=6, threshold=threshold).collect()
    assert {(r.q, r.n) for r in got} == plain_top(x, q, 6, threshold, metric)
    assert max(r["rank"] for r in got) == 6 and len({(r.q, r["rank"]) for r in got}) == len(got)


def test_cells_are_left_out(vectors):
    """With a threshold most cells are too far for a query, so that not every block meets every other."""
    _, _, known, asked = vectors
    index = similarity.build_index(known, "i", cells=50, block_rows=64)
    rows = asked.select(F.col("j").alias("q"), F.col("embedding").alias("v"), F.lit(0.9).alias("floor")).where("v IS NOT NULL AND q < 148")
    rows = rows.withColumn("v", similarity.normalized(F.col("v")))
    near = similarity._probes(index, rows, similarity._reachable(index.radii, "cosine"))
    assert near.count() < 0.5 * 148 * int((index.slices > 0).sum())


def test_recall(vectors):
    x, q, known, asked = vectors
    index = similarity.build_index(known, "i", cells=50, block_rows=64)
    want = plain_top(x, q, 5, 0.0, "cosine")
    got = {(r.q, r.n) for r in similarity.search(index, asked, "j", k=5, threshold=0.0, recall=0.95).collect()}
    assert len(got & want) >= 0.9 * len(want)
    some = asked.select(F.col("j").alias("q"), similarity._values("embedding", "cosine").alias("v"), F.lit(0.0).alias("floor")).where("v IS NOT NULL")
    assert similarity.probes_for(index, some, 5, 0.0, 0.95) < 25


def test_index_of_nothing(vectors, spark):
    _, _, known, asked = vectors
    index = similarity.build_index(known.limit(0), "i")
    assert similarity.search(index, asked, "j").count() == 0
    assert similarity.search(similarity.build_index(known, "i", cells=4, block_rows=500), asked.limit(0), "j").count() == 0


def emd(a, b):
    values = np.unique(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(s), values, "right") / len(s) for s in (a, b))
    return float((np.abs(fa - fb)[:-1] * np.diff(values)).sum())


def sides(spark, a, b, feature="f"):
    rows = [(feature, float(v), 0) for v in a] + [(feature, float(v), 1) for v in b]
    return spark.createDataFrame(rows, "feature string, value double, side int")


@pytest.mark.parametrize("piece", [50_000, 2])
def test_all_relabelings(spark, piece):
    """Twelve rows have 792 splits: the drawn distances follow their distribution, whole or cut into ranges of two values."""
    a, b = [1, 1, 2, 5, 8], [1, 3, 3, 5, 5, 9, 13]
    pooled = np.array(a + b, float)
    every = [emd(pooled[list(s)], np.delete(pooled, list(s))) for s in combinations(range(12), 5)]
    got = resampling.drift_test(sides(spark, a, b), n=4000, piece_values=piece).first()
    true = np.mean(np.array(every) >= emd(np.array(a), np.array(b)) - 1e-12)
    assert got.observed == pytest.approx(emd(np.array(a), np.array(b)))
    assert got.p_value == pytest.approx(true, abs=0.03)
    assert got.null_mean == pytest.approx(np.mean(every), rel=0.03) and got.null_std == pytest.approx(np.std(every), rel=0.05)


@pytest.mark.parametrize("replace", [False, True])
def test_many_values(spark, replace):
    rng = np.random.default_rng(8)
    a, b, c = rng.normal(0, 1, 400), rng.normal(0.3, 1, 300), rng.normal(0, 1, 300)
    rows = sides(spark, a, b, "moved").union(sides(spark, a, c, "same")).union(sides(spark, [1.0], [], "one side"))
    rows = rows.union(spark.createDataFrame([("same", None, 0)], rows.schema))
    got = {r.feature: r for r in resampling.drift_test(rows, n=400, replace=replace, piece_values=150).collect()}
    assert set(got) == {"moved", "same"}
    for name, other in (("moved", b), ("same", c)):
        pooled, null = np.concatenate([a, other]), []
        for _ in range(400):
            draw = [rng.choice(pooled, 400), rng.choice(pooled, 300)] if replace else np.split(rng.permutation(pooled), [400])
            null.append(emd(*draw))
        r = got[name]
        assert r.observed == pytest.approx(emd(a, other)) and r.null_mean == pytest.approx(np.mean(null), rel=0.12)
        assert r.p_value == pytest.approx(np.mean(np.array(null) >= r.observed), abs=0.09)
    assert got["moved"].p_value < 0.05


def test_counts_beyond_a_task(spark):
    """Ten billion rows are as quick as ten: only counts are drawn."""
    counts = spark.createDataFrame([("f", float(v), 10**9 + v) for v in range(10)], "feature string, value double, n long")
    total = 10 * 10**9 + 45
    sizes = spark.createDataFrame([("f", total // 2, total - total // 2)], "feature string, n0 long, n1 long")
    got = np.array([r.emd for r in resampling.resampled_distances(counts, sizes, n=300).collect()])
    expected = sum(np.sqrt(2 / np.pi * f * (1 - f) * 4 / total) for f in np.arange(1, 10) / 10)
    assert len(got) == 300 and got.mean() == pytest.approx(expected, rel=0.15)


def test_half_thresholds(spark):
    df = spark.range(600).select((F.col("id") % 24).alias("hour"), (F.col("id") * 7919 % 997).alias("place"), F.lit(None).cast("int").alias("none"))
    got = {r.feature: r for r in resampling.half_thresholds(df, ["hour", "place", "none"], n=300).collect()}
    assert set(got) == {"hour", "place"}
    rng, hours = np.random.default_rng(1), np.arange(600) % 24
    null = [emd(*np.split(rng.permutation(hours).astype(float), 2)) for _ in range(300)]
    assert got["hour"].mean == pytest.approx(np.mean(null), rel=0.12) and got["hour"].p95 == pytest.approx(np.quantile(null, 0.95), rel=0.2)
    assert got["hour"].p95 < got["hour"].p99

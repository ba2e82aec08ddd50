"""Draws of many replicates at once against those of ``sampling.draw``, and the resampling tests against plain versions."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from scanwarden.operators import draws, drift, sampling


def plain(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def test_draws_of_a_batch_are_md5():
    texts = ["", "7|", "-12|", "é|", "9" * 40 + "|", "x" * 54 + "|", "x" * 80 + "|"] + [f"{k * k}|" for k in range(20_000)]
    suffixes = ["0|42", "1|99|42", "100|1234567"]
    for suffix, got in zip(suffixes, draws.draws([t.encode() for t in texts], [s.encode() for s in suffixes])):
        assert got.tolist() == [plain(t + suffix) for t in texts]


def rows(spark):
    at = F.col("id")
    long = spark.range(3000).select(
        F.when(at % 40 > 0, at % 2500).alias("k"), (at % 3 == 0).cast("int").alias("side"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit(None).cast("string"))).alias("feature"),
        F.when(at % 7 > 0, at * at % 31).cast("double").alias("value"))
    return long


def test_key_text_with_draw(spark):
    df = rows(spark).select("k", draws.key_text(["k", "side"]).alias("two"), draws.key_text(["k"]).alias("one"), sampling.draw(["k"], 5).alias("want"), sampling.draw(["k", "side"], 5).alias("want_two"))
    for r in df.distinct().collect():
        assert plain(r.one + "5") == r.want and plain(r.two + "5") == r.want_two


def emd(a, b, values):
    order = np.argsort(values)
    a, b, v = a[order], b[order], values[order]
    return float((np.abs(np.cumsum(a) / a.sum() - np.cumsum(b) / b.sum())[:-1] * np.diff(v)).sum())


def test_resampling_tests_against_plain_versions(spark):
    df = rows(spark)
    data = [r for r in df.where("feature = 'a' AND value IS NOT NULL").collect()]
    v, side = np.array([r.value for r in data]), np.array([r.side for r in data])
    text = ["" if r.k is None else f"{r.k}|" for r in data]
    seen = emd((side == 0) * 1.0, (side == 1) * 1.0, v)
    moved, boot = [], []
    for rep in range(20):
        d = np.array([plain(f"{t}{rep}|42") for t in text])
        first = d <= np.sort(d)[(side == 0).sum() - 1]
        moved.append(emd(first * 1.0, ~first * 1.0, v))
        weights = [drift.poisson_weights(np.array([plain(f"{t}{s}|{rep}|42") for t in text]) / 2**48) for s in (0, 1)]
        boot.append(emd(*[w * 1.0 for w in weights], v))
    one = {r.feature: r for r in drift.permutation_test(df, ["k"], 20).collect()}["a"]
    assert abs(one.observed - seen) < 1e-9 and abs(one.null_mean - np.mean(moved)) < 1e-9 and abs(one.null_std - np.std(moved)) < 1e-9
    assert one.p_value == (sum(x >= seen for x in moved) + 1) / 21
    got = {r.feature: r.p_value for r in drift.bootstrap_emd_test(df, ["k"], 20).collect()}
    assert got["a"] == sum(x >= seen for x in boot) / 20


def test_draws_are_counted_where_the_rows_are(spark):
    """One row per replicate and value leaves a task, not one per replicate and row."""
    plan = drift.bootstrap_emd_test(rows(spark), ["k"], 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "explode(sequence" not in plan.lower()


def test_features_beside_each_other_are_drawn_once(spark):
    """Columns give the counts of the long form, without a row per feature."""
    rows = [(i, None if i % 5 == 0 else float(i % 4), None if i % 3 else i % 2) for i in range(200)] + [(None, 1.0, 1), (7, None, None)]
    df = spark.createDataFrame(rows, "k long, a double, b int")
    suffixes = [[f"{r}|42"] for r in range(5)]

    def odd(_, drawn, *__):
        return 1 - (drawn[0] & 1), drawn[0] & 1

    def table(counts):
        return sorted(map(tuple, counts.groupBy("replicate", "feature", "value", "side").agg({"n": "sum"}).collect()))

    beside = draws.counted_beside(df, ["k"], ["a", "b"], suffixes, odd)
    assert "Expand" not in beside._jdf.queryExecution().executedPlan().toString()
    assert table(beside) == table(draws.counted(drift.long_form(df, ["a", "b"], ["k"], cast="double", name="feature"), ["k"], suffixes, odd))

"""Focal loss: sums against plain numpy, early stopping, rows that say nothing."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from scanwarden.operators import focal

NAMES = ["epcFake", "epcDup", "locErr"]


def table(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 20.0, 0.1] + [0.0, 5.0, 1.0]
    a = (x[:, 0] + rng.normal(size=n) * 0.5 > 1.0).astype(int)
    b = (x[:, 1] > 30).astype(int)
    rows = [(i, [float(v) for v in x[i]], [int(a[i]), int(b[i]), 0], i % 4 == 0) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label array<int>, held boolean")
    return df.withColumn("features", array_to_vector("x")), x, np.stack([a, b, np.zeros(n)], axis=1)


def plain_loss(z, y, alpha=0.7, gamma=2.0, weight=1.0):
    p = 1 / (1 + np.exp(-z))
    return np.where(y == 1, -alpha * weight * (1 - p) ** gamma * np.log(p), -(1 - alpha) * p**gamma * np.log(1 - p))


def test_sums_equal_plain_loss_and_slope(spark):
    df, x, y = table(spark)
    cells = focal.cells_of(df, "features", "label", 3, None)
    rng = np.random.default_rng(1)
    trials = rng.normal(size=(2, 3, 4)) * 0.3
    center, spread, weight = x.mean(axis=0), x.std(axis=0), np.array([3.0, 1.0, 2.0])
    loss, slope, held = focal.pass_sums(cells, trials, center, spread, weight, 0.7, 2.0)
    full = np.hstack([(x - center) / spread, np.ones((len(x), 1))])

    def total(t, j):
        return plain_loss(full @ t, y[:, j], weight=weight[j]).sum()

    for s in range(2):
        for j in range(3):
            assert loss[s, j] == pytest.approx(total(trials[s, j], j))
            for k in range(4):
                move = np.zeros(4)
                move[k] = 1e-5
                assert slope[s, j, k] == pytest.approx((total(trials[s, j] + move, j) - total(trials[s, j] - move, j)) / 2e-5, rel=1e-5, abs=1e-5)
    assert not held.any()


def test_fit_falls_stops_and_scores(spark):
    df, x, y = table(spark)
    models = focal.fit_focal(df, NAMES, validation="held", rounds=30, patience=3)
    found = {m["anomaly_type"]: m for m in models.collect()}
    assert set(found) == set(NAMES[:2])  # the third never varies
    for name, m in found.items():
        assert all(later <= before for before, later in zip(m["losses"], m["losses"][1:])) and m["losses"][-1] < 0.7 * m["losses"][0]
        assert m["rows"] == 450 and m["positives"] == int(y[np.arange(600) % 4 != 0, NAMES.index(name)].sum())
    mean = np.mean([m["validation_losses"] for m in found.values()], axis=0)
    m = found["epcFake"]
    assert m["kept_round"] <= m["rounds"] and mean[m["kept_round"]] <= mean.min() + 1e-8
    assert m["rounds"] == len(m["losses"]) - 1 <= min(30, m["kept_round"] + 3)
    scored = focal.score_focal(df, models, NAMES).orderBy("id").collect()
    z = (x - m["center"]) / m["spread"] @ np.array(m["weights"]) + m["intercept"]
    assert np.allclose([r["epcFake_probability"] for r in scored], 1 / (1 + np.exp(-z)))
    assert all(r["locErr_probability"] == 0 for r in scored)
    hit = np.array([r["epcDup_detected"] for r in scored])
    assert (hit == (y[:, 1] == 1)).mean() > 0.93


def test_without_validation_ends_at_a_flat_point(spark):
    df, x, y = table(spark)
    (m,) = focal.fit_focal(df, NAMES, penalty=0.01, rounds=60).where("anomaly_type = 'epcFake'").collect()
    pos = y[:, 0].sum()
    full = np.hstack([(x - m["center"]) / m["spread"], np.ones((len(x), 1))])
    at = np.array([*m["weights"], m["intercept"]])

    def loss(t):
        return plain_loss(full @ t, y[:, 0], weight=(len(x) - pos) / pos).mean() + 0.005 * (t[:-1] ** 2).sum()

    moves = np.eye(4) * 1e-5
    assert max(abs(loss(at + v) - loss(at - v)) / 2e-5 for v in moves) < 1e-3
    assert m["losses"][-1] == pytest.approx(loss(at))


def test_empty_null_and_repeated_rows(spark):
    df, *_ = table(spark, 80)
    empty = df.where("id < 0")
    assert focal.fit_focal(empty, NAMES).count() == 0
    odd = spark.createDataFrame(
        [(1000, None, [1, 0, 0], False), (1001, [1.0, 2.0, 3.0], None, False), (1002, [float("nan"), 2.0, float("inf")], [1, None, None], None)],
        "id long, x array<double>, label array<int>, held boolean").withColumn("features", F.when(F.col("x").isNotNull(), array_to_vector("x")))
    models = focal.fit_focal(df.union(odd).withColumn("w", F.lit(1)), NAMES, rounds=2)
    rows = {m["anomaly_type"]: m["rows"] for m in models.collect()}
    assert rows["epcFake"] == 81 and rows.get("epcDup", 80) == 80
    assert all(0 <= r["epcFake_probability"] <= 1 for r in focal.score_focal(odd, models, NAMES).collect())
    twice = focal.fit_focal(df.union(df), NAMES, rounds=3).collect()
    once = focal.fit_focal(df, NAMES, rounds=3).collect()
    assert all(t["rows"] == 2 * o["rows"] for t, o in zip(twice, once))

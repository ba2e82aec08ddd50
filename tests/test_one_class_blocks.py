"""One-class models and quantiles: batches of rows, and order only where a rank is wanted."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanwarden import skew
from scanwarden.operators import oneclass as oc


@pytest.mark.parametrize("values", [
    list(np.random.default_rng(1).normal(size=3000)), [4.0] * 50, [1.0, 2.0, None, 1e12, None, -5.0, 0.0, 0.0], [-0.0, float("inf"), 3.0, float("-inf"), 7.5],
    [-1.7e308, 1.7e308, 2.0, 3.0]])
def test_quantile_grid_orders_only_ranges_with_a_wanted_rank(spark, monkeypatch, values):
    ordered = []
    totals = skew.running_totals
    monkeypatch.setattr(skew, "running_totals", lambda df, *a, **k: ordered.append(df.count()) or totals(df, *a, **k))
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = skew.quantile_grid(spark.createDataFrame([(v if v is None else float(v),) for v in values], "v double"), "v", shares).first()["quantiles"]
    known = np.sort([v for v in values if v is not None])
    places = np.array(shares) * (len(known) - 1)
    low, high = known[np.floor(places).astype(int)], known[np.ceil(places).astype(int)]
    with np.errstate(invalid="ignore", over="ignore"):
        want = low + (places - np.floor(places)) * (high - low)
    assert np.allclose(got, want, equal_nan=True)
    assert ordered[0] <= 4 * len(shares)


def test_quantile_grid_of_no_rows(spark):
    assert skew.quantile_grid(spark.createDataFrame([(None,)], "v double"), "v", [0.0, 0.5]).first()["quantiles"] in (None, [None, None])


def test_one_class_makes_no_object_per_row(spark, monkeypatch):
    """Rows go to and from the tasks' arrays in whole batches."""
    def refused(*args, **kwargs):
        raise AssertionError("row by row")

    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(float(a), float(b), int(i % 9 == 0)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))], "a double, b double, label int")
    monkeypatch.setattr(DataFrame, "mapInPandas", refused)
    monkeypatch.setattr(oc, "_batch", refused)
    model = oc.fit_one_class(df, "ab", "jump", steps=3).first()
    scored = oc.score_one_class(df, model).agg(F.count("score").alias("n"), F.max("score").alias("top")).first()
    assert (model["rows"], scored["n"]) == (266, 300) and scored["top"] <= 100


def test_one_class_keeps_no_fourier_features(spark, monkeypatch):
    """Only the rows' own numbers and the decisions are cached, not the 32 Fourier features of each row."""
    df = spark.createDataFrame([(float(i % 7), float(i % 11), 0) for i in range(100)], "a double, b double, label int")
    kept, persist = [], type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda df, *a: kept.append(df.columns) or persist(df, *a))
    assert oc.fit_one_class(df, "ab", "jump", steps=2).first()["rows"] > 90
    assert kept == [["x", "y"], ["value"]]

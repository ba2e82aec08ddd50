"""Numbers per item that need one exchange of the scans, and hot keys found without moving keys."""

import pytest
from pyspark.sql import functions as F

from scanwarden import skew
from scanwarden.operators import features as fe
from scanwarden.operators import profile as pro

KEY = ["file_id", "epc_code"]


@pytest.fixture(scope="module")
def rows(spark):
    steps = ["Factory", "WMS", None, "Retailer"]
    cells = [(i % 3 if i % 50 else None, f"e{i % 17}", i, i * 7 % 5 if i % 4 else None, i * 3 % 7, i % 6, steps[i % 4], f"h{i % 3}", f"2024-01-{1 + i % 28:02d} {i % 24:02d}:00:00")
             for i in range(400)] + [(1, "alone", 900, None, 1, None, None, None, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(cells, "file_id int, epc_code string, event_id long, location_id int, operator_id int, device_id int, business_step string, hub_type string, t string")
    return df.withColumn("event_time", F.to_timestamp("t")).drop("t").withColumns({"scan_location": F.concat(F.lit("store_"), "location_id"), "event_type": F.col("business_step")})


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


BUILDS = {
    "behaviour": pro.epc_behaviour, "profile": pro.epc_profile, "embedding": fe.epc_embedding,
    "run": lambda df, hot: fe.run_features(df, hot=hot).drop("latitude")}


def same_rows(a, b):
    """Rows of both, numbers rounded."""
    def plain(df):
        df = df.select(*[F.round(c, 9).alias(c) if t == "double" else F.transform(c, lambda x: F.round(x, 9)).alias(c) if t == "array<double>" else F.col(c) for c, t in df.dtypes])
        return sorted(map(repr, df.collect()))

    assert a.columns == b.columns
    assert plain(a) == plain(b)


@pytest.mark.parametrize("name, most", [("behaviour", 1), ("profile", 1), ("embedding", 4), ("run", 1)])
def test_few_exchanges(rows, name, most):
    """The scans move once; vectors join two tables of items."""
    assert exchanges(BUILDS[name](rows, hot=None)) <= most


@pytest.mark.parametrize("name", list(BUILDS))
def test_ordinary_and_hot_items_alike(rows, name):
    """The same numbers in one partitioning and through joined tables."""
    rows = rows.where("file_id IS NOT NULL")
    hot = skew.hot_keys(rows, KEY, limit=7)
    assert hot is not None
    same_rows(BUILDS[name](rows, hot=None), BUILDS[name](rows, hot=hot))


def test_hot_keys_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(skew, "KEY_SLOTS", 1)
    df = spark.createDataFrame([("a", None)] * 7 + [("b", 1)] * 6 + [(None, 2)] * 3, "k string, f int")
    found = skew.hot_keys(df, ["k", "f"], limit=5)
    assert found.rows == 13 and sorted(map(tuple, found.table.collect())) == [("a", None), ("b", 1)]
    assert skew.hot_keys(df, ["k", "f"], limit=7) is None

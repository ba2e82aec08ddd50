"""Steps whose cost or memory must not grow faster than the table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from scanwarden.operators import encode, features, profile, similarity, windows
from scanwarden.skew import hot_keys, over_sequence


def _next(df, hot):
    rows = over_sequence(df, lambda d, s: d.withColumns({"at": s.next_known("x", include_current=True), "after": s.next_known("x")}),
                         keys=["k"], order=["i"], before=0, carry=["x"], hot=hot)
    return rows


@pytest.mark.parametrize("limit", [None, 4])
def test_next_known_reads_no_frame_that_ends_with_the_key(spark, limit):
    values = [None, 3, None, None, 5, None, 7, None, None]
    df = spark.createDataFrame([(k, i, v) for k in ("a", None) for i, v in enumerate(values)], "k string, i int, x int")
    rows = _next(df, limit and hot_keys(df, ["k"], limit=limit))
    if limit is None:
        assert "unboundedfollowing" not in rows._jdf.queryExecution().toString().lower()
    for k in ("a", None):
        got = [(r["at"], r["after"]) for r in rows.where(F.col("k").eqNullSafe(k)).orderBy("i").collect()]
        assert got == [(3, 3), (3, 5), (5, 5), (5, 5), (5, 7), (7, 7), (7, None), (None, None), (None, None)]


def test_imputed_rows_between_donors(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 1 else float(i)) for i in range(40)] + [(None, 1.0), (None, None)], "by int, x double")
    got = {r["by"]: r["x"] for r in encode.impute_knn(df.where("by IS NOT NULL"), "x", "by", k=2).collect()}
    assert got == {i: float(i) for i in range(40)} | {39: 39.0}  # one donor on either side
    assert encode.impute_knn(df, "x", "by", k=2).where("by IS NULL").count() == 2


class _Captured:
    """A table of which only the function handed to ``mapInPandas`` is wanted."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *columns):
        return self

    def mapInPandas(self, run, schema):
        return run


def test_cells_to_search_are_handed_on_few_at_a_time(spark):
    cells = 2000
    index = similarity.Index(None, np.zeros((cells, 2)), np.full(cells, 999.0), np.ones(cells, int), 4096, "cosine")
    run = similarity._probes(index, _Captured(spark.createDataFrame([], "q long, v array<double>, floor double").schema), similarity._reachable(index.radii, "cosine"))
    batch = pd.DataFrame({"q": range(300), "v": [np.array([1.0, i]) for i in range(300)], "floor": 0.1})
    parts = list(run(iter([batch])))
    assert max(map(len, parts)) <= 8192
    whole = pd.concat(parts)
    assert len(whole) == 300 * cells and len(whole[["q", "cell"]].drop_duplicates()) == 300 * cells
    assert all(v[1] == q for q, v in zip(whole["q"][::997], whole["v"][::997]))


def test_encoding_joins_counted_values_without_moving_the_table(spark):
    rows = [(i, f"site_{i % 31}" if i % 5 else None, f"hub_{i % 17}", "in" if i % 2 else None, i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, scan_location string, hub string, way string, step int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = encode.encode_categoricals(df, ["scan_location", "hub", "way", "step"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan
    codes = {s: i for i, s in enumerate(sorted({r[1] for r in rows if r[1]}))}
    for i, place, hub, way, step in rows:
        r = got[i]
        assert r["scan_location_encoded"] == codes.get(place, -1) and r["way_encoded"] == (way == "in")
        assert r["hub_frequency"] == sum(x[2] == hub for x in rows) / len(rows)
        assert [r[f"step_{k}"] for k in range(4)] == [int(step == k) for k in range(4)] and r["step_nan"] == 0


def test_clustering_keeps_points_only(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), "wide" * 50) for i in range(200)], "id int, a double, b double, text string")
    fit, seen = KMeans.fit, []

    def spied(self, rows, *more):
        seen.append(rows.columns)
        return fit(self, rows, *more)
    monkeypatch.setattr(KMeans, "fit", spied)
    out = encode.cluster(df, ["a", "b"], k=3, components=2)
    assert seen == [["_point"]] and out.count() == 200 and {"id", "text", "cluster"} <= set(out.columns)


def test_profiles_of_items_join_once(spark):
    rows = [(1, "a", i, f"2024-01-0{1 + i} 0{i}:00:00", i % 2, None if i else "WMS", i % 3) for i in range(5)]
    rows += [(None, "b", 9, "2024-01-06 10:00:00", None, None, None), (0, None, 10, "2024-01-06 20:00:00", 4, "Retailer", 4)]
    df = spark.createDataFrame(rows, "file_id int, epc_code string, event_id long, t string, location_id int, business_step string, operator_id int")
    df = df.withColumn("event_time", F.col("t").cast("timestamp"))
    profile_rows = profile.epc_profile(df, hot=None)
    assert "Join" not in profile_rows._jdf.queryExecution().optimizedPlan().toString()
    got = {r["epc_code"]: r for r in profile_rows.collect()}
    assert [got["a"][c] for c in ("total_scans", "unique_locations", "business_step_count")] == [5, 2, 1]
    assert got["a"]["location_entropy"] == pytest.approx(0.970951, abs=1e-4)
    assert [got["b"][c] for c in ("total_scans", "unique_locations", "location_entropy")] == [1, 0, 0.0]
    assert got[None]["file_id"] == 0 and got[None]["unique_locations"] == 1
    vectors = features.epc_embedding(df, hot=None)
    assert vectors._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1 and vectors.count() == 3


def test_ties_are_read_alike_in_both_directions(spark):
    rows = [("a", None if i % 3 else 1, f"2024-01-{i + 1:02d} 00:00:00" if i % 4 == 0 else None) for i in range(28)]
    df = spark.createDataFrame(rows, "epc_code string, event_id long, t string").withColumn("event_time", F.col("t").cast("timestamp")).withColumn("file_id", F.lit(1))
    out = windows.interpolate_time(df, hot=None).collect()  # a row between two of the same place would divide by zero
    assert len(out) == 28 and all(r["event_time_interpolated"] == r["event_time"] for r in out if r["event_time"])

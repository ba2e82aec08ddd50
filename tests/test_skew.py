"""Hot items must give the same results as the plain windows."""

import pytest
from pyspark.sql import functions as F

from checks import base
from scanwarden import skew
from scanwarden.operators import detect_epc, detect_events, evaluate, features, transitions, windows
from scanwarden.sources.table_scans import as_of, scans


@pytest.fixture(scope="module")
def shared_code(spark, sf):
    """A third of all scans carry one code in one file, many at equal times."""
    df = scans(spark, sf)
    mine = F.col("event_id") % 3 == 0
    df = df.withColumns({
        "epc_code": F.when(mine, "001.8804823.0000001.000001.19990101.000000001").otherwise(F.col("epc_code")),
        "file_id": F.when(mine, 0).otherwise(F.col("file_id")),
        "event_time": F.when(mine, F.date_trunc("month", "event_time")).otherwise(F.col("event_time"))})
    return df.select("event_id", "file_id", "epc_code", "event_time", "business_step", "event_type", "event_type_raw",
                     "location_id", "scan_location", "hub_type").persist()


@pytest.fixture(scope="module")
def hot(shared_code):
    found = skew.hot_keys(shared_code, limit=150)
    assert found is not None and found.rows > 1500
    return found


def same_rows(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    left, right = (sorted(map(str, x.select(columns).collect())) for x in (a, b))
    assert left == right


CASES = {
    "order": lambda d, h: detect_events.event_order_error(d, hot=h),
    "location": lambda d, h: detect_events.event_location_error(d, hot=h),
    "detect": lambda d, h: detect_events.detect_events(d, as_of(), hot=h),
    "runs": lambda d, h: detect_epc.epc_event_order(d, type_column="event_type_raw", hot=h),
    "items": lambda d, h: detect_epc.detect_epc(detect_epc.normalize_scans(d), as_of(), hot=h),
    "gap": lambda d, h: windows.time_gap(d, hot=h),
    "rolling": lambda d, h: windows.rolling_gap(d, hot=h).withColumn("gap_mean_recent", F.round("gap_mean_recent", 4)).withColumn(
        "gap_std_recent", F.round("gap_std_recent", 4)),
    "moves": lambda d, h: windows.location_moves(d, hot=h),
    "position": lambda d, h: windows.scan_position(d, hot=h),
    "fill": lambda d, h: windows.fill_time(d.withColumn("event_time", F.when(F.col("location_id") % 3 > 0, F.col("event_time"))), hot=h),
    "interpolate": lambda d, h: windows.interpolate_time(d.withColumn("event_time", F.when(F.col("location_id") % 3 > 0, F.col("event_time"))), hot=h),
    "backward": lambda d, h: windows.backward_steps(d.withColumn("business_step", F.when(F.col("location_id") % 3 > 0, F.col("business_step"))), hot=h),
    "transitions": lambda d, h: transitions.transition_probabilities(d, hot=h),
    "order_features": lambda d, h: features.order_features(d, type_column="event_type_raw", hot=h).withColumn("event_entropy", F.round("event_entropy", 6)),
    "windows": lambda d, h: features.sequences_fixed(d.withColumn("y", F.lit(1)), ["location_id"], ["y"], length=7, hot=h),
    "latest": lambda d, h: features.latest_events(d, 5, hot=h),
}


@pytest.mark.parametrize("name", list(CASES))
def test_split_items_match(shared_code, hot, name):
    same_rows(CASES[name](shared_code, hot), CASES[name](shared_code, None))


def test_no_hot_items(spark, sf):
    assert skew.hot_keys(scans(spark, sf)) is None
    assert base.hot(spark, sf) is None


def test_running_totals_in_pieces(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    pieces = skew.running_totals(df, ["g"], ["v"], {"t": F.col("v"), "n": F.lit(1)}, limit=50)
    whole = skew.running_totals(df, ["g"], ["v"], {"t": F.col("v"), "n": F.lit(1)}, bounded=True)
    same_rows(pieces, whole)
    down = skew.running_totals(df, [], ["v"], {"n": F.lit(1)}, limit=50, descending=True)
    assert down.where("v = 999").first()["n"] == 1 and down.where("v = 0").first()["n"] == 1000


def test_quantiles_match_builtin(spark):
    df = spark.range(997).select((F.col("id") % 4).alias("g"), (F.col("id") * 7919 % 503 / 10.0).alias("v"))
    got = {r["g"]: (r["a"], r["b"]) for r in skew.quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.77}).collect()}
    want = df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.77))).alias("p"))
    for r in want.collect():
        assert got[r["g"]] == pytest.approx(tuple(r["p"]))
    grid = skew.quantile_grid(df, "v", [0.0, 0.5, 1.0]).first()["quantiles"]
    assert grid == pytest.approx(df.agg(F.percentile("v", F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)))).first()[0])


def test_auc_in_pieces(spark):
    df = spark.range(2000).select(
        F.lit("jump").alias("anomaly_type"), (F.col("id") % 7 == 0).cast("int").alias("truth"), (F.col("id") * 31 % 977 / 977.0).alias("probability"))
    a, b = evaluate.auc(df, limit=100).first(), evaluate.auc(df).first()
    assert a["auc"] == pytest.approx(b["auc"]) and a["ap"] == pytest.approx(b["ap"])
    rows = df.collect()
    pos = [r["probability"] for r in rows if r["truth"]]
    neg = [r["probability"] for r in rows if not r["truth"]]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert a["auc"] == pytest.approx(pairs / len(pos) / len(neg))


def test_partition_count_does_not_matter(spark, sf):
    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        return sorted(map(str, detect_events.detect_events(scans(spark, sf), as_of(), hot=None).collect()))

    one, many = run(1), run(16)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert one == many

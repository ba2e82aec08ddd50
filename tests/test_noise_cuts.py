"""Label noise that moves no table."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scanwarden.operators import noise
from scanwarden.operators.sampling import draw
from tests.rows import labels


@pytest.mark.parametrize("patterns", [{"epcFake": 0.02, "jump": -0.3}, {"jump": 1.0}, {"epcFake": -0.001}])
def test_bias_flips_the_lowest_draws_and_moves_no_table(spark, patterns):
    df = labels(spark, 400)
    got = noise.inject_bias(df, patterns, ["event_id"])
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan
    share = F.lit(0.0)
    for t, p in patterns.items():
        share = F.when((F.col("anomaly_type") == t) & (F.col("truth") == int(p < 0)), abs(p)).otherwise(share)
    whole = Window.partitionBy("anomaly_type", "truth")
    want = df.withColumns({"r": F.row_number().over(whole.orderBy(draw(["event_id"], 42), "event_id")), "n": F.count("*").over(whole), "s": share})
    want = want.withColumn("truth", F.when(F.col("r") <= F.floor(F.col("n") * F.col("s")), 1 - F.col("truth")).otherwise(F.col("truth"))).select(df.columns)
    assert sorted(map(tuple, got.select(df.columns).collect())) == sorted(map(tuple, want.collect()))


def test_equal_draws_flip_no_more_than_the_share(spark):
    """Keys that repeat or are null have equal draws; of them only as many are flipped as the share says."""
    df = labels(spark, 200, [None if i % 2 else i % 6 for i in range(200)])
    got = noise.inject_noise(df, 0.5, ["event_id"], "drop_positives")
    for t in ("epcFake", "jump"):
        before, after = (x.where((F.col("anomaly_type") == t) & (F.col("truth") == 1)).count() for x in (df, got))
        assert after == before - before // 2
    assert got.count() == 400 and got.columns == df.columns

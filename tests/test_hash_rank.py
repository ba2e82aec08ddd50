"""Ranks by draw in ranges against the plain window, with repeated and null keys."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from scanwarden.operators import sampling


def rows(spark):
    at = F.col("id")
    return spark.range(6000).select(
        F.when(at % 50 == 0, None).when(at % 10 == 0, at - 1).otherwise(at).alias("k"), F.when(at % 3 > 0, "a").when(at % 2 == 0, "b").alias("s"))


def test_ranks_in_ranges_are_those_of_one_window(spark):
    df = rows(spark)
    w = Window.partitionBy("s").orderBy("_draw", "k")
    want = df.withColumn("_draw", sampling.draw(["k"], 42)).select("s", "k", F.row_number().over(w).cast("long").alias("r"), F.count("*").over(Window.partitionBy("s")).alias("n"))
    for limit in (100, 10**6):
        got = sampling.hash_rank(df, ["s"], ["k"], 42, "r", limit=limit, size="n").select("s", "k", "r", "n")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        few = sampling.hash_rank(df, ["s"], ["k"], 42, "r", limit=limit, size="n", most=F.floor(F.col("n") * 0.1)).select("s", "k", "r", "n")
        few_want = want.where("r <= floor(n * 0.1)")
        assert few.exceptAll(few_want).isEmpty() and few_want.exceptAll(few).isEmpty()
        all_rows = sampling.hash_rank(df, [], ["k"], 42, "r", limit=limit).select("r")
        assert sorted(x.r for x in all_rows.collect()) == list(range(1, 6001))


def test_ranks_of_large_strata_move_only_the_columns_they_need(spark):
    df = rows(spark).withColumn("wide", F.sha2(F.col("k").cast("string"), 256))
    out = sampling.hash_rank(df, ["s"], ["k"], 42, "r", limit=100).select("k", "r")
    assert "wide" not in out._jdf.queryExecution().optimizedPlan().toString()

"""Training tables on disk: one parquet table by anomaly type and split, one metadata table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanwarden.operators.sampling import train_test_split
from scanwarden.skew import EPC_KEYS


def write_training_set(df: DataFrame, path: str, anomaly_type: str, features: Sequence[str], written: Column,
                       test_share: float = 0.2, keys: Sequence[str] = EPC_KEYS) -> None:
    """Features as a vector with label, score and code, split by label before anything is fitted."""
    rows = train_test_split(df, list(keys), "label", test_share)
    cells = F.array(*[F.col(f).cast("double") for f in features])
    table = rows.select(*keys, cells.alias("features"), "label", F.col("score").cast("double").alias("score"), "split")
    spark = df.sparkSession
    table.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data/anomaly_type={anomaly_type}")
    saved = read_training_set(spark, path, anomaly_type)
    meta = saved.agg(
        F.count("*").alias("samples"), F.count_if(F.col("label") == 1).alias("positives"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"))
    meta = meta.select(
        "*", (F.col("positives") / F.col("samples")).alias("positive_ratio"), F.lit(len(features)).alias("dimensions"),
        F.array(*[F.lit(f) for f in features]).alias("feature_names"), written.alias("written_at"))
    meta.write.mode("overwrite").parquet(f"{path}/metadata/anomaly_type={anomaly_type}")


def read_training_set(spark: SparkSession, path: str, anomaly_type: str, split: str | None = None) -> DataFrame:
    """Training rows of a type; only its folders are read. Fails when there are none."""
    rows = spark.read.parquet(f"{path}/data").where(F.col("anomaly_type") == anomaly_type)
    if split:
        rows = rows.where(F.col("split") == split)
    if rows.isEmpty():
        raise FileNotFoundError(f"no training set for {anomaly_type} in {path}")
    return rows


def training_set_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Number of sets, samples, mean positive ratio and range of dimensions; one row."""
    meta = spark.read.parquet(f"{path}/metadata")
    return meta.agg(
        F.count("*").alias("sets"), F.sum("samples").alias("samples"), F.avg("positive_ratio").alias("mean_positive_ratio"),
        F.min("dimensions").alias("min_dimensions"), F.max("dimensions").alias("max_dimensions"))


def check_training_set(spark: SparkSession, path: str, anomaly_type: str) -> DataFrame:
    """Whether rows, dimensions and labels agree with the metadata; one row of booleans."""
    rows = read_training_set(spark, path, anomaly_type)
    meta = spark.read.parquet(f"{path}/metadata").where(F.col("anomaly_type") == anomaly_type)
    found = rows.agg(
        F.count("*").alias("n"), F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi"),
        F.count_if(~F.col("label").isin(0, 1) | F.col("label").isNull()).alias("bad"))
    return meta.crossJoin(F.broadcast(found)).select(
        (F.col("n") == F.col("samples")).alias("rows_ok"),
        ((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("dimensions"))).alias("dimensions_ok"),
        (F.col("bad") == 0).alias("labels_ok"))

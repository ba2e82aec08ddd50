"""Violation lists in SQL against the operators."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from scanwarden.functions import moves
from scanwarden.operators import features
from scanwarden.plans import table_functions
from scanwarden.sources.table_scans import scans


def test_rows_of_the_operators(spark, sf):
    table_functions.register_table_functions(spark)
    df = scans(spark, sf)
    keys = ["file_id", "epc_code", "event_id"]
    features._levels(df).select(*keys, "event_time", "scan_location", F.col("_level").alias("level")).createOrReplaceTempView("t_levels")
    staged = moves.with_event_kind(df, "event_type_raw").withColumn("stage", moves.stage_of_kind(F.col("_kind")))
    staged.select(*keys, "event_time", "stage", moves.stage_rank(F.col("stage")).alias("stage_rank"), F.col("event_type_raw").alias("event_type"),
                  "scan_location").createOrReplaceTempView("t_stages")
    for name, view, want in (("location_violations", "t_levels", features.location_violations(df)),
                             ("order_violations", "t_stages", features.order_violations(df, type_column="event_type_raw"))):
        got = spark.sql(f"SELECT * FROM {name}(TABLE({view}))")
        rows = sorted(map(str, want.select(*got.columns).collect()))
        assert rows and sorted(map(str, got.select(*[F.col(c).cast(want.schema[c].dataType) for c in got.columns]).collect())) == rows
        assert spark.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM {view} WHERE false))").count() == 0


def test_missing_columns_are_named(spark):
    table_functions.register_table_functions(spark)
    with pytest.raises(AnalysisException, match="event_time, scan_location, level"):
        spark.sql("SELECT * FROM location_violations(TABLE(SELECT 1 AS file_id, 'e' AS epc_code, 2L AS event_id))").collect()

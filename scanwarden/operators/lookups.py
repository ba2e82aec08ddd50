"""Joins of events with reference tables, aggregates and findings.

Sizes decide the join: derived tables are broadcast only after ``broadcast_if_small`` has
counted them; the rest is left to the planner, which splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanwarden.functions.moves import location_name
from scanwarden.operators.windows import time_gap
from scanwarden.skew import EPC_KEYS, EVENT_ORDER, MEASURE, HotKeys, join_on, with_group_count


def with_location_names(df: DataFrame, locations: DataFrame) -> DataFrame:
    """Place name by number, the number itself where the map has none."""
    out = df.join(locations.select("location_id", "scan_location"), "location_id", "left")
    return out.withColumn("scan_location", location_name(F.col("scan_location"), F.col("location_id")))


def distinct_per(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Distinct non-null values of a column per group, through counted pairs."""
    pairs = df.groupBy(*keys, column).agg(F.lit(1).alias("one"))
    return pairs.groupBy(*keys).agg(F.count(column).alias(name))


def with_item_diversity(df: DataFrame, columns: dict[str, str], keys: Sequence[str] = EPC_KEYS) -> DataFrame:
    """Events and distinct values of the item on each of its events."""
    table = df.groupBy(*keys).agg(F.count("*").alias("item_events"))
    for column, name in columns.items():
        table = join_on(table, distinct_per(df, keys, column, name), keys)
    return join_on(df, table, keys)


def with_product_stats(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                       hot: HotKeys | str | None = MEASURE) -> DataFrame:
    """Distinct places and mean gap of the product."""
    rows = time_gap(df, keys=keys, order=order, hot=hot)
    stats = rows.groupBy("product_name").agg(F.avg("time_gap_seconds").alias("product_gap_mean"))
    stats = join_on(stats, distinct_per(df, ["product_name"], "location_id", "product_locations"), ["product_name"])
    return join_on(rows, stats, ["product_name"])


def with_value_counts(df: DataFrame) -> DataFrame:
    """Frequency and rarity of the place, and how many places the operator serves."""
    out = with_group_count(df, ["location_id"], "location_frequency")
    out = out.withColumn("location_rarity_score", 1 / F.col("location_frequency"))
    return join_on(out, distinct_per(df, ["operator_id"], "location_id", "operator_locations"), ["operator_id"])


def findings_on_events(events: DataFrame, findings: DataFrame, keys: Sequence[str] = EPC_KEYS) -> DataFrame:
    """Item findings on each event of the item."""
    return join_on(events, findings, keys, "inner")


def with_same_time(df: DataFrame, keys: Sequence[str] = EPC_KEYS) -> DataFrame:
    """Events and places of the item at the same time, by aggregation instead of a self join."""
    ties = [*keys, "event_time"]
    places = df.groupBy(*ties, "scan_location").agg(F.count("*").alias("_n"))
    table = places.groupBy(*ties).agg(F.sum("_n").alias("same_time_events"), F.count("scan_location").alias("same_time_places"))
    return join_on(df, table, ties)

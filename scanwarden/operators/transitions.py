"""Statistics of moves between places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanwarden.functions import clock
from scanwarden.skew import EPC_KEYS, EVENT_ORDER, MEASURE, HotKeys, over_sequence


def moves_of(df: DataFrame, column: str, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
             hot: HotKeys | str | None = MEASURE) -> DataFrame:
    """Each event with the previous value of ``column`` and the hours since then."""
    return over_sequence(df, lambda d, s: d.withColumns({
        "previous": s.back(column),
        "gap_h": clock.hours_between(F.col("event_time"), s.back("event_time"))}), keys=keys, order=order, hot=hot)


def build_transition_stats(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                           hot: HotKeys | str | None = MEASURE) -> DataFrame:
    """Hours between consecutive places: mean, std, min, max, count per pair."""
    rows = moves_of(df, "scan_location", keys=keys, order=order, hot=hot)
    rows = rows.where(F.col("previous").isNotNull() & F.col("scan_location").isNotNull())
    return rows.groupBy(
        F.col("previous").alias("from_scan_location"), F.col("scan_location").alias("to_scan_location")
    ).agg(
        F.avg("gap_h").alias("time_taken_hours_mean"), F.stddev("gap_h").alias("time_taken_hours_std"),
        F.min("gap_h").alias("time_taken_hours_min"), F.max("gap_h").alias("time_taken_hours_max"),
        F.count("gap_h").alias("time_taken_hours_count"))


def transition_probabilities(df: DataFrame, column: str = "location_id", *, keys: Sequence[str] = EPC_KEYS,
                             order: Sequence[str] = EVENT_ORDER, hot: HotKeys | str | None = MEASURE) -> DataFrame:
    """Share of each next value among the moves that start at a value."""
    rows = moves_of(df, column, keys=keys, order=order, hot=hot).where(F.col("previous").isNotNull())
    pairs = rows.groupBy(F.col("previous").alias("from_value"), F.col(column).alias("to_value")).agg(
        F.count("*").alias("moves"))
    starts = pairs.groupBy("from_value").agg(F.sum("moves").alias("starts"))
    return pairs.join(starts, "from_value").select(
        "from_value", "to_value", "moves", (F.col("moves") / F.col("starts")).alias("probability"))


def with_transition_probability(df: DataFrame, probabilities: DataFrame, column: str = "location_id", *,
                                keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                                hot: HotKeys | str | None = MEASURE) -> DataFrame:
    """Probability of the move that led to each event, 0 for unseen moves and first events."""
    rows = moves_of(df, column, keys=keys, order=order, hot=hot)
    table = probabilities.select(
        F.col("from_value").alias("_f"), F.col("to_value").alias("_t"), F.col("probability").alias("_p"))
    out = rows.join(table, (F.col("previous") == F.col("_f")) & (F.col(column) == F.col("_t")), "left")
    out = out.withColumn("transition_probability", F.coalesce("_p", F.lit(0.0)))
    return out.withColumn("rare_transition", (F.col("transition_probability") < 0.01).cast("int")).drop("_f", "_t", "_p")

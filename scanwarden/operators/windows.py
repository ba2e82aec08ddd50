"""Columns that depend on neighbouring events of the same item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanwarden.functions import clock, moves
from scanwarden.skew import (
    EPC_KEYS, EVENT_ORDER, MEASURE, HotKeys, Steps, hot_keys, over_sequence, quantiles, with_group_count, with_key_stats)

Hot = HotKeys | str | None


def time_gap(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER, hot: Hot = MEASURE,
             first: float | None = 0.0) -> DataFrame:
    """Seconds since the previous event of the item; ``first`` for the first event."""
    def gap(d: DataFrame, s: Steps) -> DataFrame:
        value = (F.unix_micros("event_time") - F.unix_micros(s.back("event_time"))) / 1e6
        return d.withColumn("time_gap_seconds", value if first is None else F.coalesce(value, F.lit(first)))

    return over_sequence(df, gap, keys=keys, order=order, hot=hot)


def gap_zscore(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
               hot: Hot = MEASURE) -> DataFrame:
    """How far a gap is from the mean gap of its item, in sample deviations; 0 without spread."""
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = time_gap(df, keys=keys, order=order, hot=hot)
    gap = F.col("time_gap_seconds")
    rows = with_key_stats(rows, {"_m": F.avg(gap), "_s": F.stddev(gap)}, keys=keys, hot=hot)
    z = F.when(F.col("_s") > 0, (gap - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return rows.withColumn("time_gap_zscore", z).drop("_m", "_s")


def rolling_gap(df: DataFrame, rows: int = 3, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                hot: Hot = MEASURE) -> DataFrame:
    """Mean and sample deviation of the last gaps."""
    def roll(d: DataFrame, s: Steps) -> DataFrame:
        d = d.withColumn("time_gap_seconds", F.coalesce(
            (F.unix_micros("event_time") - F.unix_micros(s.back("event_time"))) / 1e6, F.lit(0.0)))
        near = s.recent(rows - 1)
        return d.withColumns({
            "gap_mean_recent": F.avg("time_gap_seconds").over(near),
            "gap_std_recent": F.coalesce(F.stddev("time_gap_seconds").over(near), F.lit(0.0))})

    return over_sequence(df, roll, keys=keys, order=order, before=rows, hot=hot)


def location_moves(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                   hot: Hot = MEASURE) -> DataFrame:
    """Previous and next place, change and return flags, distance of place numbers."""
    rows = over_sequence(df, lambda d, s: d.withColumns({
        "prev_location_id": s.back("location_id"), "next_location_id": s.ahead("location_id"),
        "_back2": s.back("location_id", 2)}), keys=keys, order=order, before=2, after=1, hot=hot)
    here, prev = F.col("location_id"), F.col("prev_location_id")
    return rows.withColumns({
        "location_changed": (~here.eqNullSafe(prev)).cast("int"),
        "location_backtrack": F.coalesce((here == F.col("_back2")) & (here != prev), F.lit(False)).cast("int"),
        "location_distance_proxy": F.coalesce(F.abs(here - prev), F.lit(0)),
    }).drop("_back2")


def step_moves(df: DataFrame, level: Column | None = None, *, keys: Sequence[str] = EPC_KEYS,
               order: Sequence[str] = EVENT_ORDER, hot: Hot = MEASURE) -> DataFrame:
    """Regression, skip and advancement of the business step."""
    level = moves.step_level(F.col("business_step")) if level is None else level
    rows = df.withColumn("business_step_numeric", level)
    rows = over_sequence(
        rows, lambda d, s: d.withColumn("_prior", s.back("business_step_numeric")), keys=keys, order=order, hot=hot)
    change = F.col("business_step_numeric") - F.col("_prior")
    return rows.withColumns({
        "business_step_regression": F.coalesce(change < 0, F.lit(False)).cast("int"),
        "business_step_skip": F.coalesce(change > 1, F.lit(False)).cast("int"),
        "business_step_advancement": F.coalesce(change, F.lit(0)),
    }).drop("_prior")


def scan_position(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                  hot: Hot = MEASURE) -> DataFrame:
    """Position in the journey, its length, progress 0-1 and a flag for the first event."""
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = over_sequence(df, lambda d, s: d.withColumn("scan_position", s.position()), keys=keys, order=order, hot=hot)
    rows = with_key_stats(rows, {"total_scans": F.count(F.lit(1))}, keys=keys, hot=hot)
    return rows.withColumns({
        "scan_progress": F.col("scan_position") / F.col("total_scans"),
        "is_first_scan": (F.col("scan_position") == 1).cast("int")})


def events_per_period(df: DataFrame, keys: Sequence[str] = EPC_KEYS) -> DataFrame:
    """Events of the item in the same hour and on the same day."""
    rows = df.withColumns({"_hour": F.date_trunc("hour", "event_time"), "_day": F.date_trunc("day", "event_time")})
    rows = with_group_count(rows, [*keys, "_hour"], "events_per_hour")
    return with_group_count(rows, [*keys, "_day"], "events_per_day").drop("_hour", "_day")


def scans_per_location(df: DataFrame, keys: Sequence[str] = EPC_KEYS) -> DataFrame:
    """Events of the item at the same place, and whether there are several."""
    rows = with_group_count(df, [*keys, "location_id"], "scans_per_location")
    return rows.withColumn("repeated_location", (F.col("scans_per_location") > 1).cast("int"))


def unusual_gap(df: DataFrame, low: float = 0.05, high: float = 0.95, *, keys: Sequence[str] = EPC_KEYS,
                order: Sequence[str] = EVENT_ORDER, hot: Hot = MEASURE) -> DataFrame:
    """Gaps outside the global quantile range; first events have no gap and are not unusual."""
    rows = time_gap(df, keys=keys, order=order, hot=hot, first=None)
    bounds = quantiles(rows, [], "time_gap_seconds", {"_low": low, "_high": high})
    rows = rows.crossJoin(F.broadcast(bounds))
    gap = F.col("time_gap_seconds")
    flag = F.coalesce((gap > F.col("_high")) | (gap < F.col("_low")), F.lit(False))
    return rows.withColumn("unusual_time_gap", flag.cast("int")).drop("_low", "_high")


def iqr_outlier(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Flag of values outside the quartiles by more than ``factor`` times their distance."""
    bounds = quantiles(df, [], column, {"_q1": 0.25, "_q3": 0.75})
    rows = df.crossJoin(F.broadcast(bounds))
    reach = (F.col("_q3") - F.col("_q1")) * factor
    value = F.col(column)
    flag = F.coalesce((value < F.col("_q1") - reach) | (value > F.col("_q3") + reach), F.lit(False))
    return rows.withColumn(f"{column}_outlier", flag.cast("int")).drop("_q1", "_q3")


def location_cluster(df: DataFrame, bins: int = 5, column: str = "location_id") -> DataFrame:
    """Quantile bin (1..bins) of the place number; bins are right-closed."""
    edges = quantiles(df, [], column, {f"_e{i}": i / bins for i in range(1, bins)})
    rows = df.crossJoin(F.broadcast(edges))
    number = F.lit(bins)
    for i in range(bins - 1, 0, -1):
        number = F.when(F.col(column) <= F.col(f"_e{i}"), i).otherwise(number)
    label = F.when(F.col(column).isNotNull(), F.concat(F.lit("Cluster_"), number.cast("string")))
    return rows.withColumn("location_cluster", label).drop(*[f"_e{i}" for i in range(1, bins)])


def gap_skewness(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                 hot: Hot = MEASURE) -> DataFrame:
    """Population skewness of an item's gaps, 0 for fewer than three events or no spread."""
    rows = time_gap(df, keys=keys, order=order, hot=hot)
    gap = F.col("time_gap_seconds")
    skew = F.when((F.count(F.lit(1)) > 2) & (F.stddev_pop(gap) > 0), F.skewness(gap)).otherwise(0.0)
    return rows.groupBy(*keys).agg(skew.alias("gap_skewness"))


def fill_time(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = ("event_id",),
              hot: Hot = MEASURE) -> DataFrame:
    """Missing times from the event before, else from the event after, in arrival order."""
    return over_sequence(df, lambda d, s: d.withColumn("event_time_filled", F.coalesce(
        "event_time", s.last_known("event_time"), s.next_known("event_time"))),
        keys=keys, order=order, before=0, carry=["event_time"], hot=hot)


def interpolate_time(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = ("event_id",),
                     hot: Hot = MEASURE) -> DataFrame:
    """Missing times on the straight line, by position, between the known neighbours of the item."""
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = over_sequence(df, lambda d, s: d.withColumn("_pos", s.position()), keys=keys, order=order, before=0, hot=hot)
    known = F.when(F.col("event_time").isNotNull(), F.struct(F.unix_micros("event_time").alias("t"), F.col("_pos").alias("p")))
    rows = rows.withColumn("_known", known)
    rows = over_sequence(rows, lambda d, s: d.withColumns({
        "_prev": s.last_known("_known"), "_next": s.next_known("_known")}),
        keys=keys, order=order, before=0, carry=["_known"], hot=hot)
    share = (F.col("_pos") - F.col("_prev.p")) / (F.col("_next.p") - F.col("_prev.p"))
    line = F.col("_prev.t") + F.round(share * (F.col("_next.t") - F.col("_prev.t"))).cast("long")
    return rows.withColumn("event_time_interpolated", F.coalesce("event_time", F.timestamp_micros(line))).drop(
        "_pos", "_known", "_prev", "_next")


def backward_steps(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                   hot: Hot = MEASURE) -> DataFrame:
    """Events whose business step is lower than the last known step of the item."""
    level = moves.step_level(F.col("business_step"))
    rows = df.withColumn("_level", F.when(level != 99, level))
    rows = over_sequence(rows, lambda d, s: d.withColumn("last_known_step", s.last_known("_level")),
                         keys=keys, order=order, before=0, carry=["_level"], hot=hot)
    return rows.where(F.col("_level") < F.col("last_known_step")).withColumnRenamed("_level", "step")


def hub_type_changed(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                     hot: Hot = MEASURE) -> DataFrame:
    return over_sequence(df, lambda d, s: d.withColumn(
        "hub_type_changed", (~F.col("hub_type").eqNullSafe(s.back("hub_type"))).cast("int")),
        keys=keys, order=order, hot=hot)


def ordering_violations(df: DataFrame, arrival: str = "event_id", *, keys: Sequence[str] = EPC_KEYS,
                        hot: Hot = MEASURE) -> DataFrame:
    """Items whose times go back in arrival order, with the number of such events."""
    rows = over_sequence(df, lambda d, s: d.withColumn(
        "_back", F.col("event_time") < s.back("event_time")), keys=keys, order=(arrival,), hot=hot)
    return rows.groupBy(*keys).agg(F.count_if("_back").alias("violations")).where(F.col("violations") > 0)


def near_duplicate_scans(df: DataFrame, within: int = 60, *, keys: Sequence[str] = EPC_KEYS,
                         order: Sequence[str] = EVENT_ORDER, hot: Hot = MEASURE) -> DataFrame:
    """Per item: exact repeats of place and type, repeats at a place within seconds, repeat ratio."""
    rows = over_sequence(df, lambda d, s: d.withColumn("_near", (
        (F.unix_micros("event_time") - F.unix_micros(s.back("event_time")) < within * 1_000_000)
        & (F.col("scan_location") == s.back("scan_location")))), keys=keys, order=order, hot=hot)
    groups = rows.groupBy(*keys, "scan_location", "event_type").agg(
        F.count("*").alias("_n"), F.count_if("_near").alias("_near"))
    out = groups.groupBy(*keys).agg(
        F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("exact_duplicates"),
        F.sum("_near").alias("temporal_duplicates"), F.sum("_n").alias("total_events"))
    return out.withColumn("duplicate_ratio", F.col("exact_duplicates") / F.col("total_events"))


def before_manufacture(df: DataFrame) -> DataFrame:
    return df.where(F.col("event_time") < F.col("manufacture_date"))


def cross_field_conflicts(df: DataFrame, allowed: Sequence[tuple[str, str]], hub: Column, *,
                          step: str = "business_step") -> DataFrame:
    """One row per conflict kind and pair: scans before manufacture, and hub/step pairs that are not allowed."""
    early = before_manufacture(df).agg(F.count("*").alias("events")).select(
        F.lit("before_manufacture").alias("conflict"), F.lit(None).cast("string").alias("hub"),
        F.lit(None).cast("string").alias("step"), "events").where(F.col("events") > 0)
    pairs = df.groupBy(hub.alias("hub"), F.col(step).alias("step")).agg(F.count("*").alias("events"))
    rules = df.sparkSession.createDataFrame(list(allowed), "hub string, step string")
    odd = pairs.join(F.broadcast(rules), ["hub", "step"], "left_anti")
    return early.unionByName(odd.select(F.lit("hub_step").alias("conflict"), "hub", "step", "events"))

"""Findings per item: all five rules scored 0-100 over the item's whole journey."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanwarden import constants as C
from scanwarden.functions import clock, epc, moves, verdicts
from scanwarden.operators.detect_events import travel_scores
from scanwarden.skew import (
    EPC_KEYS, EVENT_ORDER, MEASURE, HotKeys, Steps, colocated, hot_keys, join_on, over_sequence, with_key_stats)


def normalize_scans(df: DataFrame) -> DataFrame:
    """Times to timestamps, time floored to the second, missing texts named, codes trimmed and upper-cased."""
    return df.withColumns({
        "event_time": F.col("event_time").cast("timestamp"),
        "event_time_rounded": F.date_trunc("second", F.col("event_time").cast("timestamp")),
        "event_type": F.coalesce("event_type", F.lit("UNKNOWN")),
        "scan_location": F.coalesce("scan_location", F.lit("UNKNOWN_LOCATION")),
        "epc_code": F.upper(F.trim("epc_code")),
    })


def _repeat_points() -> Column:
    """Points of one event for repeating the direction and step of the events just before it.

    The second of a run scores 25, the third 40, later ones at least 55; a run of four has
    reached the cap of 100 already, so looking three events back is exact.
    """
    moving = F.col("_kind").startswith("inbound") | F.col("_kind").startswith("outbound")
    again = [F.coalesce(F.col("_kind") == F.col(f"_kind{n}"), F.lit(False)) for n in (1, 2, 3)]
    one = moving & again[0]
    two, three = one & again[1], one & again[1] & again[2]
    return (
        F.when(three, C.SCORE_CONSECUTIVE + 2 * C.SCORE_CONSECUTIVE_EXTRA)
        .when(two, C.SCORE_CONSECUTIVE + C.SCORE_CONSECUTIVE_EXTRA)
        .when(one, C.SCORE_CONSECUTIVE)
        .otherwise(0)
    )


def _three_back(df: DataFrame, s: Steps) -> DataFrame:
    return df.withColumns({f"_kind{n}": s.back("_kind", n) for n in (1, 2, 3)})


def _level_points() -> Column:
    here, prior = F.col("_level"), F.col("_p_level")
    unknown = F.when(here == C.UNKNOWN_LEVEL, C.SCORE_LOCATION_UNKNOWN).otherwise(0) + F.when(
        prior == C.UNKNOWN_LEVEL, C.SCORE_LOCATION_UNKNOWN).otherwise(0)
    both = (here != C.UNKNOWN_LEVEL) & (prior != C.UNKNOWN_LEVEL)
    reverse = F.when(both & (here < prior), C.SCORE_LOCATION_REVERSE).otherwise(0)
    return F.when(prior.isNull(), 0).otherwise(unknown + reverse)


def _capped(points: Column) -> Column:
    return F.least(F.lit(C.SCORE_MAX), F.sum(points)).cast("int")


def epc_event_order(
    df: DataFrame, *, type_column: str = "event_type", keys: Sequence[str] = EPC_KEYS,
    order: Sequence[str] = EVENT_ORDER, hot: HotKeys | str | None = MEASURE,
) -> DataFrame:
    """Order score per item: runs of the same direction and step."""
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = moves.with_event_kind(colocated(df, keys, hot), type_column)
    rows = over_sequence(rows, _three_back, keys=keys, order=order, before=3, hot=hot)
    return rows.groupBy(*keys).agg(_capped(_repeat_points()).alias("evtOrderErr"))


def epc_location_error(
    df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
    hot: HotKeys | str | None = MEASURE,
) -> DataFrame:
    """Location score per item: steps down the hierarchy and unknown places."""
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = moves.with_location_level(colocated(df, keys, hot))
    rows = over_sequence(rows, lambda d, s: d.withColumn("_p_level", s.back("_level")), keys=keys, order=order, hot=hot)
    return rows.groupBy(*keys).agg(_capped(_level_points()).alias("locErr"))


def _duplicate_points(places: Column) -> Column:
    points = C.DUPLICATE_BASE + (places - 1) * C.DUPLICATE_PER_PLACE
    return F.when(places > 1, F.least(F.lit(C.SCORE_MAX), points)).otherwise(0).cast("int")


def epc_duplicate(
    df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, second: str = "event_time_rounded"
) -> DataFrame:
    """Duplicate score per item: several places within one second."""
    places = df.where(F.col("scan_location").isNotNull()).select(*keys, second, "scan_location").distinct()
    per_second = places.groupBy(*keys, second).agg(F.count("*").alias("_places"))
    return per_second.groupBy(*keys).agg(F.max(_duplicate_points(F.col("_places"))).alias("epcDup"))


def epc_jump(
    df: DataFrame, transitions: DataFrame, geo: DataFrame | None = None, *, keys: Sequence[str] = EPC_KEYS,
    order: Sequence[str] = EVENT_ORDER, hot: HotKeys | str | None = MEASURE,
) -> DataFrame:
    """Travel score per item and the first step (counted from 0) that is impossible or unlikely."""
    rows = travel_scores(df, transitions, geo, keys=keys, order=order, hot=hot)
    bad = F.col("_jump") > 0
    return rows.groupBy(*keys).agg(
        F.coalesce(F.max("_jump"), F.lit(0)).cast("int").alias("jump"),
        F.min(F.when(bad, F.col("_pos") - 1)).alias("first_step"))


def detect_epc(
    df: DataFrame, as_of: Column, transitions: DataFrame | None = None, geo: DataFrame | None = None, *,
    keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER, only_findings: bool = True,
    hot: HotKeys | str | None = MEASURE,
) -> DataFrame:
    """All five scores per item with types, primary type, position and representative event.

    Expects ``normalize_scans`` output. One exchange on the item for all sequence rules; the
    item aggregate reuses that partitioning.
    """
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = moves.with_location_level(moves.with_event_kind(colocated(df, keys, hot), "event_type"))
    for optional in ("product_name", "business_step"):
        if optional not in rows.columns:
            rows = rows.withColumn(optional, F.lit(None).cast("string"))

    def neighbours(d: DataFrame, s: Steps) -> DataFrame:
        d = _three_back(d, s)
        return d.withColumns({
            "_p_level": s.back("_level"), "_next_place": s.ahead("scan_location"),
            "_from": s.back("scan_location"), "_pos": s.position(),
            "_gap_h": clock.hours_between(F.col("event_time"), s.back("event_time"))})

    rows = over_sequence(rows, neighbours, keys=keys, order=order, before=3, after=1, hot=hot)
    rows = with_key_stats(rows, {"_total": F.count(F.lit(1))}, keys=keys, hot=hot)
    rows = _travel(rows, transitions, geo)
    if hot is None:
        second = Window.partitionBy(*keys, "event_time_rounded")
        rows = rows.withColumn("_places", F.size(F.collect_set("scan_location").over(second)))
        duplicate = F.max(_duplicate_points(F.col("_places")))
    else:
        duplicate = F.lit(0)
    event = F.struct("product_name", "business_step", "event_type", "scan_location", "event_time", "_next_place")
    at = F.col("_pos") - 1
    table = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        _capped(_repeat_points()).alias("evtOrderErr"),
        _capped(_level_points()).alias("locErr"),
        F.coalesce(F.max("_jump"), F.lit(0)).cast("int").alias("jump"),
        F.min_by(at, F.when(F.col("_jump") > 0, at)).alias("_jump_at"),
        F.min_by(event, F.when(F.col("_jump") > 0, at)).alias("_jump_event"),
        F.max(F.when(at == 0, event)).alias("_first_event"),
        F.max(F.when(at == 1, event)).alias("_second_event"),
        F.max(F.when(at == F.floor(F.col("_total") / 2), event)).alias("_middle_event"),
        duplicate.alias("epcDup"),
    )
    if hot is not None:
        table = join_on(table.drop("epcDup"), epc_duplicate(df, keys=keys), keys)
        table = table.withColumn("epcDup", F.coalesce("epcDup", F.lit(0)))
    table = epc.with_fake_score(table, as_of, "epcFake")
    return _findings(table, keys, only_findings)


def _travel(rows: DataFrame, transitions: DataFrame | None, geo: DataFrame | None) -> DataFrame:
    if transitions is None:
        return rows.withColumn("_jump", F.lit(None).cast("int"))
    stats = transitions.select(
        F.col("from_scan_location").alias("_t_from"), F.col("to_scan_location").alias("_t_to"),
        F.col("time_taken_hours_mean").alias("_mean"), F.col("time_taken_hours_std").alias("_std"))
    rows = rows.join(stats, (F.col("_from") == F.col("_t_from")) & (F.col("scan_location") == F.col("_t_to")), "left")
    km = F.lit(None).cast("double")
    if geo is not None:
        for side, place in (("a", "_from"), ("b", "scan_location")):
            named = geo.select(
                F.col("scan_location").alias(f"_g{side}"), F.col("Latitude").alias(f"_lat{side}"),
                F.col("Longitude").alias(f"_lon{side}"))
            rows = rows.join(named, F.col(place) == F.col(f"_g{side}"), "left")
        km = moves.haversine_km(F.col("_lata"), F.col("_lona"), F.col("_latb"), F.col("_lonb"))
        km = F.when(F.col("_from") != F.col("scan_location"), km)
    score = moves.jump_score(F.col("_gap_h"), F.col("_mean"), F.col("_std"), km)
    return rows.withColumn("_jump", F.when(F.col("_t_to").isNotNull(), score).cast("int"))


def _findings(table: DataFrame, keys: Sequence[str], only_findings: bool) -> DataFrame:
    top = F.greatest(*[F.col(t) for t in C.ANOMALY_TYPES])
    primary = None
    for t in C.ANOMALY_TYPES:
        primary = F.when(F.col(t) == top, t) if primary is None else primary.when(F.col(t) == top, t)
    fired = [F.when(F.col(t) > 0, F.lit(t)) for t in C.ANOMALY_TYPES]
    scores = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(t) for t in C.ANOMALY_TYPES]), F.array(*C.ANOMALY_TYPES)), lambda _, v: v > 0)
    jumped, last = F.col("_jump_at").isNotNull(), F.col("total") - 1
    wanted = (
        F.when(jumped, F.col("_jump_at")).when(F.col("epcFake") > 0, 0).when(F.col("epcDup") > 0, 1)
        .otherwise(F.floor(F.col("total") / 2))
    )
    spot = F.least(wanted, last)
    chosen = (
        F.when(jumped, F.col("_jump_event")).when((F.col("epcFake") > 0) | (last == 0), F.col("_first_event"))
        .when(F.col("epcDup") > 0, F.col("_second_event")).otherwise(F.col("_middle_event"))
    )
    problem = (
        F.when(jumped & (F.col("_jump_at") < last),
               F.concat_ws("_to_", F.col("_jump_event.scan_location"), F.col("_jump_event._next_place")))
        .when(jumped, F.concat(F.lit("Step_"), F.col("_jump_at").cast("string"), F.lit("_issue")))
        .when(F.col("epcFake") > 0, "EPC_Format_Error").when(F.col("epcDup") > 0, "Duplicate_Scan_Error")
        .otherwise("General_Analysis")
    )
    out = table.withColumns({
        "primaryAnomaly": primary, "anomalyTypes": F.array_compact(F.array(*fired)), "anomalyScores": scores,
        "sequencePosition": (spot + 1).cast("int"), "totalSequenceLength": F.col("total").cast("int"),
        "problemStep": problem, "_event": chosen})
    if only_findings:
        out = out.where(top > 0)
    return out.select(
        *keys, *C.ANOMALY_TYPES, "primaryAnomaly", "anomalyTypes", "anomalyScores", "sequencePosition",
        "totalSequenceLength", "problemStep",
        F.coalesce("_event.product_name", F.lit("Unknown")).alias("productName"),
        F.coalesce("_event.business_step", "_event.event_type").alias("businessStep"),
        F.col("_event.scan_location").alias("scanLocation"),
        F.date_format("_event.event_time", "yyyy-MM-dd HH:mm:ss").alias("eventTime"),
        verdicts.type_name(F.col("primaryAnomaly")).alias("anomalyType"),
        verdicts.finding_description(
            F.col("primaryAnomaly"), F.col("_event.scan_location"), F.col("_event.business_step")).alias("description"),
    )


def summary_stats(findings: DataFrame) -> DataFrame:
    """Items per type, items with several types, all items with findings; one row."""
    types = F.col("anomalyTypes")
    counts = [F.count_if(F.array_contains(types, t)).alias(f"{t}Count") for t in C.STATS_TYPES]
    return findings.agg(
        *counts, F.count_if(F.size(types) > 1).alias("multiAnomalyCount"), F.count("*").alias("totalAnomalyCount"))


def statistical_jump(
    df: DataFrame, variant: str = "bands", *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
    hot: HotKeys | str | None = MEASURE,
) -> DataFrame:
    """Travel score of an item from its own gaps.

    ``bands``: largest z above 2/3/4 times 10/15/20, capped at 60/80/100. ``simple``: 20 z above 2.
    ``range``: very short (< 0.1 h) or very long (> 168 h) gaps. Gaps are at least 0.
    """
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = over_sequence(
        df, lambda d, s: d.withColumn("_gap", clock.hours_between(F.col("event_time"), s.back("event_time"))),
        keys=keys, order=order, hot=hot)
    rows = rows.withColumn("_gap", F.when(F.col("_gap") < 0, 0.0).otherwise(F.col("_gap")))
    stats = rows.groupBy(*keys).agg(
        F.count("_gap").alias("_n"), F.avg("_gap").alias("_mean"), F.stddev_pop("_gap").alias("_std"),
        F.min("_gap").alias("_low"), F.max("_gap").alias("_high"))
    away = F.greatest(F.col("_high") - F.col("_mean"), F.col("_mean") - F.col("_low"))
    z = F.when((F.col("_n") > 1) & (F.col("_std") > 1e-9), away / F.col("_std")).otherwise(0.0)
    if variant == "bands":
        score = (
            F.when(z > 4, F.least(F.lit(100.0), z * 20)).when(z > 3, F.least(F.lit(80.0), z * 15))
            .when(z > 2, F.least(F.lit(60.0), z * 10)).otherwise(0.0)
        )
    elif variant == "simple":
        score = F.when(z > 2, F.least(F.lit(100.0), z * 20)).otherwise(0.0)
    elif variant == "range":
        score = F.when(
            (F.col("_n") > 0) & ((F.col("_low") < 0.1) | (F.col("_high") > C.MAX_REASONABLE_GAP_HOURS)),
            F.when(F.col("_high") > 24, F.least(F.lit(50.0), F.col("_high") / 24 * 10))
            .when(F.col("_low") < 0.1, 30.0).otherwise(0.0)).otherwise(0.0)
    else:
        raise ValueError(f"unknown variant {variant}")
    return stats.select(*keys, score.alias("jump_stat"))


def all_types(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{t}") for t in C.ANOMALY_TYPES]


def any_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)

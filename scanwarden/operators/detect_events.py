"""Findings per scan event, and their roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanwarden import constants as C
from scanwarden.functions import clock, epc, moves
from scanwarden.skew import EPC_KEYS, EVENT_ORDER, MEASURE, HotKeys, Steps, hot_keys, join_on, over_sequence


def _no(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def _previous(df: DataFrame, steps: Steps) -> DataFrame:
    """Predecessor values, so that the rules below are plain expressions over one window."""
    return df.withColumns({
        "_p_time": steps.back("event_time"), "_p_type": steps.back("event_type"), "_p_step": steps.back("business_step")})


PREVIOUS = ("_p_time", "_p_type", "_p_step")


def _order_flag(use_direction: bool) -> Column:
    def inbound(column: str) -> Column:
        if use_direction:
            return moves.classify_event(F.col(column))["direction"] == "inbound"
        return F.col(column) == "Inbound"

    early = F.col("event_time") < F.col("_p_time")
    again = inbound("event_type") & inbound("_p_type") & (F.col("business_step") == F.col("_p_step"))
    return _no(early) | _no(again)


def _location_flag() -> Column:
    level, prior = moves.step_level(F.col("business_step")), moves.step_level(F.col("_p_step"))
    reverse = (level < prior) & (level != C.UNKNOWN_LEVEL) & (prior != C.UNKNOWN_LEVEL)
    skipped = F.lit(False)
    for a, b in C.SKIPPED_LEVELS:
        skipped = skipped | ((prior == a) & (level == b))
    at_once = (prior == 1) & (level == 2) & (F.col("event_time") == F.col("_p_time"))
    return _no(reverse) | _no(skipped) | _no(at_once)


def event_order_error(
    df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
    use_direction: bool = False, hot: HotKeys | str | None = MEASURE,
) -> DataFrame:
    """Adds ``evtOrderErr``: earlier than its predecessor, or inbound twice at one business step."""
    out = over_sequence(df, _previous, keys=keys, order=order, hot=hot)
    return out.withColumn("evtOrderErr", _order_flag(use_direction)).drop(*PREVIOUS)


def event_location_error(
    df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
    hot: HotKeys | str | None = MEASURE,
) -> DataFrame:
    """Adds ``locErr``: a step back or a skipped step of the chain."""
    out = over_sequence(df, _previous, keys=keys, order=order, hot=hot)
    return out.withColumn("locErr", _location_flag()).drop(*PREVIOUS)


def _tie_aggs() -> dict[str, Column]:
    step, place = F.col("business_step"), F.coalesce(F.col("scan_location"), F.lit(""))
    return {
        "_n": F.count(F.lit(1)),
        "_factory": F.max(step == "Factory"),
        "_wms": F.max(step == "WMS"),
        "_at_factory": F.max(place.contains(C.FACTORY_WORD)),
        "_at_store": F.max(place.contains(C.WAREHOUSE_WORD)),
    }


def _factory_pair() -> Column:
    pair = (F.col("_n") == 2) & F.col("_factory") & F.col("_wms")
    return _no(pair & F.col("_at_factory") & F.col("_at_store"))


def event_duplicate(
    df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, hot: HotKeys | str | None = MEASURE
) -> DataFrame:
    """Adds ``epcDup``: other events of the item at the same time, except a factory/warehouse pair.

    Only times shared by several events are joined back; most items have none.
    """
    ties = [*keys, "event_time"]
    groups = df.groupBy(*ties).agg(*[a.alias(n) for n, a in _tie_aggs().items()]).where(F.col("_n") > 1)
    groups = groups.where(~_factory_pair()).select(*ties, F.lit(True).alias("epcDup"))
    return join_on(df, groups, ties).withColumn("epcDup", _no(F.col("epcDup")))


def detect_events(
    df: DataFrame, as_of: Column, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
    use_direction: bool = False, include_jump: bool = False, transitions: DataFrame | None = None,
    geo: DataFrame | None = None, only_findings: bool = True, hot: HotKeys | str | None = MEASURE,
) -> DataFrame:
    """All event-level rules in one pass.

    One row per event with a finding; flags are null when the rule did not fire and scores
    go with the flags. ``include_jump`` adds the pairwise travel rule, which needs the
    transition statistics (and optionally coordinates).
    """
    if hot == MEASURE:
        hot = hot_keys(df, keys)

    found = over_sequence(df, _previous, keys=keys, order=order, hot=hot)
    found = found.withColumns({"_order": _order_flag(use_direction), "_loc": _location_flag()}).drop(*PREVIOUS)
    # scored between two windows: the final filter cannot be pushed down and evaluate the score again
    found = epc.with_fake_score(found, as_of, "_fake")
    if hot is None:
        # same partitioning and sort as the sequence window: no further exchange
        ties = Window.partitionBy(*keys, "event_time")
        aggs = {n: a.over(ties) for n, a in _tie_aggs().items()}
        found = found.withColumns(aggs).withColumn("epcDup", (F.col("_n") > 1) & ~_factory_pair()).drop(*aggs)
    else:
        found = event_duplicate(found, keys=keys, hot=hot)
    if include_jump:
        found = travel_scores(found, transitions, geo, keys=keys, order=order, hot=hot)
    else:
        found = found.withColumn("_jump", F.lit(None).cast("int"))
    hit = {
        "epcFake": (F.col("_fake") > 0, F.col("_fake").cast("double")),
        "epcDup": (F.col("epcDup"), F.lit(C.EVENT_DUPLICATE_SCORE)),
        "locErr": (F.col("_loc"), F.lit(C.EVENT_LOCATION_SCORE)),
        "evtOrderErr": (F.col("_order"), F.lit(C.EVENT_ORDER_SCORE)),
        "jump": (F.coalesce(F.col("_jump"), F.lit(0)) > 0, F.col("_jump").cast("double")),
    }
    columns = [F.when(test, F.lit(True)).alias(t) for t, (test, _) in hit.items()]
    columns += [F.when(test, score).alias(f"{t}Score") for t, (test, score) in hit.items()]
    out = found.select(*keys, "event_id", "event_time", *columns)
    if only_findings:
        out = out.where(F.coalesce(*[F.col(t) for t in hit]))
    return out


def travel_scores(
    df: DataFrame, transitions: DataFrame, geo: DataFrame | None, *, keys: Sequence[str] = EPC_KEYS,
    order: Sequence[str] = EVENT_ORDER, hot: HotKeys | str | None = MEASURE,
) -> DataFrame:
    """Adds ``_jump``: travel score of each event against its predecessor, null without statistics."""

    def previous(d: DataFrame, s: Steps) -> DataFrame:
        return d.withColumns({
            "_from": s.back("scan_location"),
            "_gap_h": clock.hours_between(F.col("event_time"), s.back("event_time")),
            "_pos": s.position(),
        })

    pairs = over_sequence(df, previous, keys=keys, order=order, hot=hot)
    stats = transitions.select(
        F.col("from_scan_location").alias("_from"), F.col("to_scan_location").alias("_to"),
        F.col("time_taken_hours_mean").alias("_mean"), F.col("time_taken_hours_std").alias("_std"))
    pairs = pairs.join(stats, (pairs["_from"] == stats["_from"]) & (pairs["scan_location"] == stats["_to"]), "left")
    pairs = pairs.drop(stats["_from"])
    if geo is not None:
        start = geo.select(F.col("scan_location").alias("_g1"), F.col("Latitude").alias("_a1"), F.col("Longitude").alias("_o1"))
        end = geo.select(F.col("scan_location").alias("_g2"), F.col("Latitude").alias("_a2"), F.col("Longitude").alias("_o2"))
        pairs = pairs.join(start, F.col("_from") == F.col("_g1"), "left")
        pairs = pairs.join(end, F.col("scan_location") == F.col("_g2"), "left")
        km = moves.haversine_km(F.col("_a1"), F.col("_o1"), F.col("_a2"), F.col("_o2"))
        km = F.when(F.col("_from") != F.col("scan_location"), km)
    else:
        km = F.lit(None).cast("double")
    score = moves.jump_score(F.col("_gap_h"), F.col("_mean"), F.col("_std"), km)
    pairs = pairs.withColumn("_jump", F.when(F.col("_to").isNotNull(), score).cast("int"))
    return pairs.drop("_from", "_gap_h", "_to", "_mean", "_std", "_g1", "_a1", "_o1", "_g2", "_a2", "_o2")


def _counts() -> list[Column]:
    counts = [F.count_if(F.coalesce(F.col(t), F.lit(False))).alias(f"{t}Count") for t in C.STATS_TYPES]
    return counts


def _total() -> Column:
    total = F.lit(0)
    for t in C.STATS_TYPES:
        total = total + F.col(f"{t}Count")
    return total.alias("totalEvents")


def epc_stats(findings: DataFrame, keys: Sequence[str] = EPC_KEYS) -> DataFrame:
    """Findings per item, items without any left out."""
    out = findings.groupBy(*keys).agg(*_counts()).withColumn("totalEvents", _total())
    return out.where(F.col("totalEvents") > 0)


def file_stats(findings: DataFrame, key: str = "file_id") -> DataFrame:
    """Findings per file."""
    return findings.groupBy(key).agg(*_counts()).withColumn("totalEvents", _total())


def rollup_stats(findings: DataFrame) -> DataFrame:
    """Item and file totals in one aggregation; file rows have a null item."""
    out = findings.rollup("file_id", "epc_code").agg(F.grouping_id().alias("level"), *_counts())
    return out.where(F.col("level") < 3).withColumn("totalEvents", _total())

"""Places, steps, travel and event types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanwarden import constants as C


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * C.EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def jump_score(gap_h: Column, mean_h: Column, std_h: Column, km: Column) -> Column:
    """Impossible travel. ``km`` is null when the places are equal or not geocoded."""
    deviation = F.abs(gap_h - mean_h) / std_h
    bands = F.when((mean_h == 0) | (std_h == 0) | mean_h.isNull() | std_h.isNull(), 0)
    for upper, score in C.JUMP_BANDS:
        bands = bands.when(deviation <= upper, score)
    return (
        F.when(gap_h < 0, C.JUMP_IMPOSSIBLE)
        .when(km / C.MAX_SPEED_KMH > gap_h, C.JUMP_IMPOSSIBLE)
        .otherwise(bands.otherwise(C.JUMP_IMPOSSIBLE))
    )


def classify_event(event_type: Column) -> Column:
    """struct<direction, step> by the first keyword contained in the event type."""
    lower = F.lower(event_type)
    empty = event_type.isNull() | (event_type == "")
    direction, step = F.when(empty, "missing"), F.when(empty, "unknown")
    for word, way, where in C.EVENT_KEYWORDS:
        direction = direction.when(lower.contains(word), way)
        step = step.when(lower.contains(word), where)
    return F.struct(direction.otherwise("other").alias("direction"), step.otherwise("unknown").alias("step"))


def with_event_kind(df: DataFrame, type_column: str, name: str = "_kind") -> DataFrame:
    """Adds ``direction/step`` as one text; the type is lower-cased once per row in its own projection."""
    df = df.withColumn("_type_lower", F.lower(F.coalesce(F.col(type_column), F.lit(""))))
    lower = F.col("_type_lower")
    kind = F.when(lower == "", "missing/unknown")
    for word, way, where in C.EVENT_KEYWORDS:
        kind = kind.when(lower.contains(word), f"{way}/{where}")
    return df.withColumn(name, kind.otherwise("other/unknown")).drop("_type_lower")


def stage_of_kind(kind: Column) -> Column:
    """Stage of a ``direction/step`` text."""
    out = None
    for _, way, where in C.EVENT_KEYWORDS:
        test, stage = kind == f"{way}/{where}", C.STAGE_OF_STEP[where]
        out = F.when(test, stage) if out is None else out.when(test, stage)
    return out


def with_location_level(df: DataFrame, name: str = "_level", place: str = "scan_location") -> DataFrame:
    """Adds the hierarchy level; the place is lower-cased once per row in its own projection."""
    df = df.withColumn("_place_lower", F.lower(F.trim(F.col(place))))
    lower = F.col("_place_lower")
    level = F.when(lower.isNull(), C.UNKNOWN_LEVEL)
    for word, rank in C.LOCATION_KEYWORDS:
        level = level.when(lower.contains(word), rank)
    return df.withColumn(name, level.otherwise(C.UNKNOWN_LEVEL)).drop("_place_lower")


def event_stage(event_type: Column) -> Column:
    """production / logistics / retail, null for other events."""
    step = classify_event(event_type)["step"]
    out = None
    for name, stage in C.STAGE_OF_STEP.items():
        out = F.when(step == name, stage) if out is None else out.when(step == name, stage)
    return out


def stage_rank(stage: Column) -> Column:
    out = None
    for name, rank in C.STAGE_RANK.items():
        out = F.when(stage == name, rank) if out is None else out.when(stage == name, rank)
    return out


def location_level(name: Column, longest_match: bool = False) -> Column:
    """0 factory, 1 logistics, 2 wholesale, 3 retail, 99 unknown.

    The first keyword of the list that the name contains decides; ``longest_match`` tries
    longer keywords first.
    """
    words = C.LOCATION_KEYWORDS
    if longest_match:
        words = sorted(words, key=lambda pair: -len(pair[0]))
    lower = F.lower(F.trim(name))
    out = F.when(name.isNull() | (name == ""), C.UNKNOWN_LEVEL)
    for word, level in words:
        out = out.when(lower.contains(word), level)
    return out.otherwise(C.UNKNOWN_LEVEL)


def step_level(step: Column) -> Column:
    out = None
    for name, level in C.STEP_LEVEL.items():
        out = F.when(step == name, level) if out is None else out.when(step == name, level)
    return out.otherwise(C.UNKNOWN_LEVEL)


def business_step_ordinal(step: Column, variant: str = "basic") -> Column:
    """Position of a step in the chain; ``variant`` picks the map and its default."""
    ordinals, default = C.STEP_ORDINALS[variant]
    out = None
    for name, rank in ordinals.items():
        out = F.when(step == name, rank) if out is None else out.when(step == name, rank)
    return out.otherwise(F.lit(default).cast("int"))


def location_name(scan_location: Column, location_id: Column) -> Column:
    return F.coalesce(scan_location, location_id.cast("string"))

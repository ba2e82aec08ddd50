"""Time columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BUSINESS_HOURS = {"nine_to_five": (9, 17), "eight_to_six": (8, 18), "eight_to_five": (8, 17)}


def seconds(ts: Column) -> Column:
    """Epoch seconds with fraction."""
    return F.unix_micros(ts) / 1e6


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3.6e9


def calendar(ts: Column, business: str = "nine_to_five") -> dict[str, Column]:
    """hour, day of week (Monday 0), day, month and flags."""
    first, last = BUSINESS_HOURS[business]
    hour, weekday = F.hour(ts), F.weekday(ts)
    return {
        "hour": hour,
        "day_of_week": weekday,
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "is_weekend": (weekday >= 5).cast("int"),
        "is_business_hour": hour.between(first, last).cast("int"),
        "is_night": ((hour <= 5) | (hour >= 22)).cast("int"),
    }


def cyclic(ts: Column) -> dict[str, Column]:
    hour = F.hour(ts) * (2 * math.pi / 24)
    day = F.weekday(ts) * (2 * math.pi / 7)
    return {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "dow_sin": F.sin(day), "dow_cos": F.cos(day)}


def time_cluster(hour: Column) -> Column:
    """Right-closed quarters of the day; hour 0 belongs to none."""
    return (
        F.when((hour > 0) & (hour <= 6), "Night")
        .when((hour > 6) & (hour <= 12), "Morning")
        .when((hour > 12) & (hour <= 18), "Afternoon")
        .when((hour > 18) & (hour <= 24), "Evening")
    )


def days_since_manufacture(ts: Column, made: Column) -> Column:
    return F.floor((seconds(ts) - seconds(made)) / 86400)


def scan_before_manufacture(ts: Column, made: Column) -> Column:
    return (ts < made).cast("int")


def log_gap(gap_seconds: Column) -> Column:
    return F.log1p(gap_seconds)

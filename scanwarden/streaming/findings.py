"""Streaming detection with every row accounted for: findings as the watermark passes, and late rows as rows of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanwarden.streaming.in_order import InOrder, in_buckets, moment_and_id, out_of_buckets
from scanwarden.streaming.jobs import item_flags

KEYS = "file_id int, epc_code string"
_FOUND = "item string, number long, moment long, kind string, evtOrderErr boolean, epcDup boolean, locErr boolean"


class ItemRules(InOrder):
    """Rules of items, each with the last event that the watermark has passed."""

    columns = ("event_type", "business_step", "scan_location")
    names = ("item", "number", "moment", "kind", "evtOrderErr", "epcDup", "locErr")

    def late(self, item: str, event: list) -> tuple:
        return item, event[1], event[0], "late", None, None, None

    def passed(self, item: str, events: list[list], kept: dict | None) -> tuple[dict, list[tuple]]:
        last, flagged = item_flags(events, kept)
        return last, [(item, e["id"], e["time"], "finding", order, duplicate, place) for e, order, duplicate, place in flagged]


def stream_findings(events: DataFrame, ttl_days: float = 30.0) -> DataFrame:
    """Order, duplicate and location findings (``kind`` finding) as the batch rules give them, and every row that came after the watermark
    had passed its time (``kind`` late): none is dropped unseen, and none changes what was already said.

    Ties in time are seen together, so an item's events wait until the watermark passes them. An item is forgotten ``ttl_days`` of event
    time after its last event; a later one starts anew. Needs ``in_order.prepare``.
    """
    # a time without the watermark's mark: rows behind it would be dropped before they are seen
    rows = in_buckets(events, ("file_id", "epc_code"), *moment_and_id(), *ItemRules.columns)
    found = rows.groupBy("bucket").transformWithStateInPandas(ItemRules(int(ttl_days * 86_400_000)), _FOUND, "Append", "EventTime")
    return out_of_buckets(found, KEYS, F.timestamp_micros("moment").alias("event_time"), "kind", "evtOrderErr", "epcDup", "locErr")

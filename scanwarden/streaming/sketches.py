"""Drift of recent events against a sliding reference, from quantile sketches per span of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; its error in rank is about 0.7 % (``rank_error``), whatever the number of values.
SIZE = 400


def rank_error(k: int = SIZE) -> float:
    """Error of a sketch's ranks that 99 % of them keep."""
    return 2.296 / k**0.9723


def bucket_sketches(events: DataFrame, features: Sequence[str], width: str, k: int = SIZE) -> DataFrame:
    """``start``, ``feature``, ``n``, ``low``, ``high`` and ``sketch`` of each feature's values in each span of ``width``.

    For a stream the state is one sketch per open span and feature, and a span comes out when the watermark has passed it. Sketches are merged map-side,
    so a span with very many events is no hot group. Rows without a value count nothing.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    rows = events.select("event_time", F.inline(cells)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    found = rows.groupBy(F.window("event_time", width).alias("w"), "feature").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.kll_sketch_agg_double("value", k).alias("sketch"))
    return found.select(F.col("w.start").alias("start"), "feature", "n", "low", "high", "sketch")


def _area(a: Column, b: Column, ranks: int) -> Column:
    """Mean gap between two sketches' quantiles."""
    at = F.array(*[F.lit((i + 0.5) / ranks) for i in range(ranks)])
    gaps = F.zip_with(F.kll_sketch_get_quantile_double(a, at), F.kll_sketch_get_quantile_double(b, at), lambda x, y: F.abs(x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / ranks


def sliding_drift(buckets: DataFrame, seconds: int, reference: int = 10, test: int = 2, threshold: float = 0.1, k: int = SIZE, ranks: int = 200) -> DataFrame:
    """For each feature and each span with events: the distance between the ``test`` spans that end with it and the ``reference`` spans before those.

    ``buckets`` come from ``bucket_sketches`` with spans of ``seconds``; those of several runs of a stream may be put together. Returns ``start`` (of
    the last span), ``feature``, ``n_reference``, ``n_test``, ``emd``, ``bound`` (how far ``emd`` may be from the exact distance) and ``drifted``. Ends whose
    reference or test has no events are left out. Each sketch is merged into as many windows as hold its span, so work is linear in spans.
    """
    number = F.expr(f"unix_seconds(start) div {seconds}")
    rows = buckets.withColumn("bucket", number)
    ends = rows.select("feature", F.col("bucket").alias("end")).distinct()
    spread = rows.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(reference + test - 1)))).withColumn("end", F.col("bucket") + F.col("back"))
    spread = spread.join(ends, ["feature", "end"], "left_semi").withColumn("side", F.when(F.col("back") < test, 1).otherwise(0))
    merged = spread.groupBy("feature", "end", "side").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    old, new = (merged.where(F.col("side") == s).select("feature", "end", *[F.col(c).alias(f"{c}{s}") for c in ("n", "low", "high", "sketch")]) for s in (0, 1))
    both = old.join(new, ["feature", "end"])
    width = F.greatest("high0", "high1") - F.least("low0", "low1")
    emd = _area(F.col("sketch0"), F.col("sketch1"), ranks)
    return both.select(
        F.timestamp_seconds(F.col("end") * seconds).alias("start"), "feature", F.col("n0").alias("n_reference"), F.col("n1").alias("n_test"),
        emd.alias("emd"), (width * (2 * rank_error(k) + 1 / ranks)).alias("bound")).withColumn("drifted", F.col("emd") > threshold)

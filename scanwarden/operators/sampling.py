"""Samples and splits. All draws rank by a hash of the row key, so they repeat exactly."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanwarden.skew import HOT_ROWS, broadcast_if_small, join_on, quantiles, running_totals

DAY_US = 86_400_000_000
#: A stratum beyond the limit is cut into ranges of at most about this part of it.
RANGES_TO_LIMIT = 8


def draw(key: Sequence[str], seed: int) -> Column:
    """Whole number in 0 .. 2^48-1 drawn from the row key."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def hash_rank(df: DataFrame, strata: Sequence[str], key: Sequence[str], seed: int, name: str = "rank",
              limit: int | None = None, size: str | None = None, most: Column | None = None) -> DataFrame:
    """Rank (from 1) of each row within its stratum in the order of its draw, and the stratum's ``size``.

    A stratum may hold most of the table. Beyond the row limit, draws are cut into equal ranges: counts per range give the
    rows before it, and rows are ranked range by range. ``most`` (it may use ``size``) keeps only ranks up to it; ranges
    beyond it are not moved.
    """
    strata, size_of, limit = list(strata), size or "_of", HOT_ROWS if limit is None else limit
    top = df.groupBy(*strata).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    rows = df.withColumn("_draw", draw(key, seed))
    if top <= limit:
        whole = Window.partitionBy(*strata)
        out = rows.withColumns({name: F.row_number().over(whole.orderBy("_draw", *key)).cast("long"), size_of: F.count("*").over(whole)})
    else:
        bits = min(30, math.ceil(math.log2(top / max(1, limit // RANGES_TO_LIMIT))))
        rows = rows.withColumn("_range", F.shiftright("_draw", 48 - bits).cast("int"))
        whole = Window.partitionBy(*strata)  # one row per range
        counts = rows.groupBy(*strata, "_range").agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.select(*strata, "_range", (upto - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias(size_of))
        if most is not None:
            counts = counts.where(F.col("_before") < most)
        near = Window.partitionBy(*strata, "_range").orderBy("_draw", *key)
        out = join_on(rows, broadcast_if_small(counts), [*strata, "_range"], "inner")
        out = out.withColumn(name, F.col("_before") + F.row_number().over(near)).drop("_range", "_before")
    out = out.drop("_draw") if most is None else out.where(F.col(name) <= most).drop("_draw")
    return out if size else out.drop(size_of)


def stratified_sample(df: DataFrame, ratio: float, strata: Sequence[str], key: Sequence[str], minimum: int = 500,
                      seed: int = 42) -> DataFrame:
    """Per stratum the larger of ``minimum`` and ``ratio`` of its rows; whole small strata."""
    wanted = F.greatest(F.lit(minimum), F.floor(F.col("_size") * ratio))
    return hash_rank(df, strata, key, seed, "_rank", size="_size", most=wanted).drop("_rank", "_size")


def sampling_quality(full: DataFrame, sample: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Relative bias of column means, and for 0/1 flags the earth mover's distance (difference of shares)."""
    def means(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
        return one.unpivot([], list(columns), "column", name)

    both = means(full, "full_mean").join(means(sample, "sample_mean"), "column")
    difference = F.abs(F.col("sample_mean") - F.col("full_mean"))
    return both.withColumns({
        "relative_bias": F.when(F.col("full_mean") != 0, difference / F.abs("full_mean")).otherwise(difference),
        "wasserstein_if_flag": difference})


def _split_time(df: DataFrame, test_ratio: float) -> DataFrame:
    """One row: the time that leaves ``test_ratio`` of the events after it, in microseconds."""
    stamped = df.select(F.unix_micros("event_time").alias("_us"))
    return quantiles(stamped, [], "_us", {"_split": 1 - test_ratio})


def temporal_split(df: DataFrame, test_ratio: float = 0.2, buffer_days: int = 7) -> DataFrame:
    """Adds ``split``: train up to the buffer before the split time, test from it on; the buffer is left out."""
    rows = df.crossJoin(F.broadcast(_split_time(df, test_ratio)))
    us = F.unix_micros("event_time")
    part = F.when(us <= F.col("_split") - buffer_days * DAY_US, "train").when(us >= F.col("_split"), "test")
    return rows.withColumn("split", part).where(F.col("split").isNotNull()).drop("_split")


def split_rules(df: DataFrame, test_ratio: float = 0.2, buffer_days: int = 7, variant: str = "near",
                keys: Sequence[str] = ("epc_code",)) -> tuple[DataFrame, DataFrame]:
    """The split time (one row) and per item whether it lies on the boundary."""
    time = _split_time(df, test_ratio)
    us, gap = F.unix_micros("event_time"), buffer_days * DAY_US
    rows = df.select(*keys, "event_time").crossJoin(F.broadcast(time))
    early, late = us <= F.col("_split") - gap, us >= F.col("_split")
    near = us.between(F.col("_split") - gap, F.col("_split") + gap)
    items = rows.groupBy(*keys).agg(
        F.max(early).alias("_early"), F.max(late).alias("_late"), F.max(near).alias("_near"))
    both = F.col("_early") & F.col("_late")
    items = items.withColumn("boundary", (F.col("_near") | both) if variant == "near" else both)
    if variant == "span":
        items = items.crossJoin(F.broadcast(items.agg(F.min("boundary").alias("_all"))))
    else:
        items = items.withColumn("_all", F.lit(False))
    return time, items.select(*keys, "boundary", "_all")


def apply_split(df: DataFrame, rules: tuple[DataFrame, DataFrame], buffer_days: int = 7,
                keys: Sequence[str] = ("epc_code",)) -> DataFrame:
    """Adds ``split`` and ``boundary`` by rules measured before; rows in the buffer are left out."""
    time, items = rules
    us, gap = F.unix_micros("event_time"), buffer_days * DAY_US
    out = join_on(df.crossJoin(F.broadcast(time)), items, keys)
    part = (
        F.when(F.col("_all"), F.when(us <= F.col("_split"), "train").otherwise("test"))
        .when(F.col("boundary") | (us <= F.col("_split") - gap), "train").when(us >= F.col("_split"), "test")
    )
    out = out.withColumn("split", part).withColumn("boundary", F.col("boundary") & ~F.col("_all"))
    return out.where(F.col("split").isNotNull()).drop("_split", "_all")


def epc_temporal_split(df: DataFrame, test_ratio: float = 0.2, buffer_days: int = 7, variant: str = "near",
                       keys: Sequence[str] = ("epc_code",)) -> DataFrame:
    """Adds ``split`` so that no item is in both parts, and ``boundary`` for items at the split.

    ``near``: items with an event within the buffer around the split go to train, as do items
    with events before and after it. ``span``: items that start before the buffer and end after
    the split go to train. If every item is a boundary item, plain time decides.
    """
    return apply_split(df, split_rules(df, test_ratio, buffer_days, variant, keys), buffer_days, keys)


def split_overlap(df: DataFrame, keys: Sequence[str] = ("epc_code",)) -> DataFrame:
    """Items in both parts; must be empty."""
    train = df.where(F.col("split") == "train").select(*keys)
    return train.intersect(df.where(F.col("split") == "test").select(*keys))


def split_report(df: DataFrame, keys: Sequence[str] = ("epc_code",)) -> DataFrame:
    """Rows, items, dates and boundary share per part, with a flag for items in both."""
    per_item = df.groupBy(*keys, "split").agg(
        F.count("*").alias("n"), F.min("event_time").alias("lo"), F.max("event_time").alias("hi"),
        F.sum(F.col("boundary").cast("long")).alias("b"))
    parts = per_item.groupBy("split").agg(
        F.sum("n").alias("rows"), F.count("*").alias("items"), F.min("lo").alias("first_time"), F.max("hi").alias("last_time"),
        (F.sum("b") / F.sum("n")).alias("boundary_share"))
    overlap = per_item.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.coalesce(F.max("k") > 1, F.lit(False)).alias("overlap"))
    return parts.crossJoin(F.broadcast(overlap))


def train_test_split(df: DataFrame, key: Sequence[str], label: str = "label", test_share: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``split``, drawn within each label."""
    ranked = hash_rank(df, [label], key, seed, "_rank", size="_size")
    test = F.col("_rank") <= F.floor(F.col("_size") * test_share + F.lit(0.5))
    return ranked.withColumn("split", F.when(test, "test").otherwise("train")).drop("_rank", "_size")


def file_split(df: DataFrame, train_share: float = 0.8, source: str = "source_file", seed: int = 42) -> DataFrame:
    """Adds ``split``: whole files to train or eval."""
    files = df.select(source).distinct()
    ranked = hash_rank(files, [], [source], seed, "_rank")
    total = files.agg(F.count("*").alias("_files"))
    ranked = ranked.crossJoin(F.broadcast(total))
    part = F.when(F.col("_rank") <= F.floor(F.col("_files") * train_share), "train").otherwise("eval")
    return join_on(df, ranked.select(source, part.alias("split")), [source])


def per_epc_sample(df: DataFrame, key: Sequence[str], cap: int = 20000, keys: Sequence[str] = ("epc_code",),
                   seed: int = 42) -> DataFrame:
    """At most cap/items rows of each item (one at least), then at most ``cap`` rows."""
    items = df.select(*keys).distinct().agg(F.count("*").alias("_items"))
    each = F.greatest(F.lit(1), F.floor(F.lit(cap) / F.col("_items")))
    ranked = hash_rank(df, list(keys), key, seed, "_rank").crossJoin(F.broadcast(items))
    kept = ranked.where(F.col("_rank") <= each).drop("_rank", "_items")
    return hash_rank(kept, [], key, seed, "_rank", most=F.lit(cap)).drop("_rank")


def top_frequency_epcs(df: DataFrame, share: float = 0.05, keys: Sequence[str] = ("epc_code",)) -> DataFrame:
    """The most frequent items (ties by code), rounded up."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("events"))
    ranked = running_totals(counted.withColumn("_neg", -F.col("events")), [], ["_neg", *keys], {"_rank": F.lit(1)})
    total = counted.agg(F.count("*").alias("_items"))
    ranked = ranked.crossJoin(F.broadcast(total))
    return ranked.where(F.col("_rank") <= F.ceil(F.col("_items") * share)).select(*keys, "events")


def spatial_outlier_epcs(df: DataFrame, keys: Sequence[str] = ("epc_code",), column: str = "location_id") -> DataFrame:
    """Items whose mean place lies outside 1.5 quartile distances."""
    centers = df.groupBy(*keys).agg(F.avg(column).alias("center"))
    bounds = quantiles(centers, [], "center", {"_q1": 0.25, "_q3": 0.75})
    reach = (F.col("_q3") - F.col("_q1")) * 1.5
    far = (F.col("center") < F.col("_q1") - reach) | (F.col("center") > F.col("_q3") + reach)
    return centers.crossJoin(F.broadcast(bounds)).where(far).select(*keys, "center")


def priority_epcs(df: DataFrame, share: float = 0.05, keys: Sequence[str] = ("epc_code",)) -> DataFrame:
    """Union of frequent items and spatial outliers."""
    frequent = top_frequency_epcs(df, share, keys).select(*keys)
    return frequent.union(spatial_outlier_epcs(df, keys).select(*keys)).distinct()


def priority_subset(df: DataFrame, priority: DataFrame, size: int, key: Sequence[str], flag: str,
                    keys: Sequence[str] = ("epc_code",), seed: int = 42) -> DataFrame:
    """Rows of priority items; above ``size`` rows, a sample with the same share of flagged rows."""
    rows = join_on(df, priority, keys, "left_semi")
    total = rows.count()
    wanted = F.col("_size") if total <= size else F.floor(F.col("_size") * size / F.lit(total))
    return hash_rank(rows, [flag], key, seed, "_rank", size="_size", most=wanted).drop("_rank", "_size")


def oversample_weights(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Adds ``weight``: the largest negative/positive ratio among the labels a row has, 1 without any."""
    counts = df.agg(F.count("*").alias("_n"), *[F.sum(F.col(x).cast("long")).alias(f"_p_{x}") for x in labels])
    rows = df.crossJoin(F.broadcast(counts))
    options = [
        F.when((F.col(x) == 1) & (F.col(f"_p_{x}") > 0), (F.col("_n") - F.col(f"_p_{x}")) / F.col(f"_p_{x}")) for x in labels]
    weight = F.coalesce(F.greatest(*options) if len(options) > 1 else options[0], F.lit(1.0))
    return rows.withColumn("weight", weight).drop("_n", *[f"_p_{x}" for x in labels])


def stratified_kfold(df: DataFrame, key: Sequence[str], flag: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` (0..folds-1), balanced on ``flag``."""
    ranked = hash_rank(df, [flag], key, seed, "_rank")
    return ranked.withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_rank")

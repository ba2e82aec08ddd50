"""Resampling tests on counts: what is drawn is how many of each value's rows go to a side, never the rows themselves."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanwarden.operators.drift import distances, two_sides, value_counts
from scanwarden.session import ensure_checkpoint_dir
from scanwarden.skew import join_on

#: Distinct values that one task draws for; a feature with more is cut into ranges of values.
PIECE_VALUES = 50_000
_EXACT = 10**9  # numpy draws from urns of fewer balls; beyond, the normal law differs by less than one row in thousands


def _from_urn(rng: np.random.Generator, good: int, total: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """How many of ``good`` among ``total`` are drawn, if ``drawn`` are taken without putting back."""
    total, drawn = np.broadcast_arrays(total, drawn)
    if int(total.max()) < _EXACT:
        return rng.hypergeometric(good, total - good, drawn)
    share = good / total
    spread = np.sqrt(drawn * share * (1 - share) * (total - drawn) / np.maximum(total - 1, 1))
    found = np.rint(drawn * share + spread * rng.standard_normal(drawn.shape)).astype(np.int64)
    return np.clip(found, np.maximum(0, drawn - (total - good)), np.minimum(good, drawn))


def _split(rng: np.random.Generator, counts: np.ndarray, drawn: np.ndarray, replace: bool):
    """For each count in turn, how many of the draws fall on it: the rest goes on to the counts after it."""
    rest, left = int(counts.sum()), drawn.copy()
    for c in counts.tolist():
        own = rng.binomial(left, min(1.0, c / rest)) if replace else _from_urn(rng, c, rest, left)
        rest, left = rest - c, left - own
        yield own


def _rng(seed: int, *parts) -> np.random.Generator:
    return np.random.default_rng([seed, *[int.from_bytes(str(p).encode(), "big") for p in parts]])


def resampled_distances(counts: DataFrame, sizes: DataFrame, n: int = 1000, replace: bool = False, seed: int = 42,
                        piece_values: int = PIECE_VALUES) -> DataFrame:
    """``feature``, ``replicate`` and ``emd``: the distance between two sides drawn at random from the pooled ``counts``.

    ``counts`` has feature, value and ``n`` rows, ``sizes`` feature, ``n0`` and ``n1`` draws of the sides. Without ``replace``
    the pooled rows are dealt to the sides (n0 + n1 of them); with it each side is drawn with replacement. Values
    are cut into ranges of about ``piece_values``. First each range of a feature gets its number of draws, then each range, on its own,
    deals those to its values and adds up its part of the area between the two curves. One row per range and replicate is
    shuffled, so the work follows the number of distinct values and replicates, not the number of rows.
    """
    ensure_checkpoint_dir(counts.sparkSession)
    counts = counts.where(F.col("value").isNotNull()).select("feature", F.col("value").cast("double").alias("value"), "n")
    pieces = max(1, -(-counts.count() // piece_values))
    # frozen, as the bounds of ranges come from a sample
    ranged = counts.repartitionByRange(pieces, "feature", "value").withColumn("piece", F.spark_partition_id()).checkpoint()
    heads = ranged.groupBy("feature", "piece").agg(F.sum("n").alias("n"), F.min("value").alias("low"))
    heads = join_on(heads, sizes, ["feature"])
    sides = 2 if replace else 1

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        """One row per range of a feature: the draws in earlier ranges and in its own."""
        rows = rows.sort_values("low")
        rng, totals = _rng(seed, rows["feature"].iloc[0]), rows["n"].to_numpy()
        own = [list(_split(rng, totals, np.full(n, rows[f"n{s}"].iloc[0], np.int64), replace)) for s in range(sides)]
        if not replace:
            own.append([t - x for t, x in zip(totals.tolist(), own[0])])
        before = [np.cumsum([np.zeros(n, np.int64), *x[:-1]], axis=0) for x in own]
        ahead = np.append(rows["low"].to_numpy()[1:], np.nan)
        return pd.DataFrame({
            "feature": rows["feature"], "piece": rows["piece"], "n0": rows["n0"], "n1": rows["n1"], "next": ahead,
            **{f"own{s}": own[s] for s in (0, 1)}, **{f"before{s}": list(before[s]) for s in (0, 1)}})

    plan = heads.groupBy("feature").applyInPandas(
        deal, "feature string, piece int, n0 long, n1 long, next double, own0 array<long>, own1 array<long>, before0 array<long>, before1 array<long>")

    def area(values: pd.DataFrame, plans: pd.DataFrame) -> pd.DataFrame:
        if not len(values) or not len(plans):
            return pd.DataFrame({"feature": [], "parts": []})
        p, values = plans.iloc[0], values.sort_values("value")
        rng, found = _rng(seed + 1, p["feature"], p["piece"]), values["n"].to_numpy()
        steps = np.diff(np.append(values["value"].to_numpy(), p["next"]))
        passed, total = [np.array(p[f"before{s}"]) for s in (0, 1)], np.zeros(n)
        draws = [_split(rng, found, np.array(p[f"own{s}"]), replace) for s in range(sides)]
        for c, step, *own in zip(found.tolist(), steps.tolist(), *draws):
            passed = [passed[0] + own[0], passed[1] + (own[1] if replace else c - own[0])]
            if step == step:  # none after the last value
                total += step * np.abs(passed[0] / p["n0"] - passed[1] / p["n1"])
        return pd.DataFrame({"feature": [p["feature"]], "parts": [total]})

    keys = ["feature", "piece"]
    parts = ranged.groupBy(*keys).cogroup(plan.groupBy(*keys)).applyInPandas(area, "feature string, parts array<double>")
    return parts.select("feature", F.posexplode("parts").alias("replicate", "part")).groupBy("feature", "replicate").agg(F.sum("part").alias("emd"))


def drift_test(rows: DataFrame, n: int = 1000, replace: bool = False, seed: int = 42, piece_values: int = PIECE_VALUES) -> DataFrame:
    """``feature``, ``observed``, ``p_value``, ``null_mean``, ``null_std``: the distance between the sides against ``n`` random ones.

    ``rows`` has feature, value and side (0 or 1). Without ``replace`` it is the permutation test, whose p-value counts the observed table too;
    with it both sides are drawn anew from the pooled rows (bootstrap). Rows without a value take no part; a feature needs both sides.
    """
    rows = rows.withColumn("feature", F.col("feature").cast("string")).where(F.col("value").isNotNull())
    sizes = rows.groupBy("feature").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    sizes = sizes.where((F.col("n0") > 0) & (F.col("n1") > 0))
    rows = join_on(rows, sizes.select("feature"), ["feature"], "left_semi")
    counts = rows.groupBy("feature", "value").agg(F.count("*").alias("n"))
    observed = distances(rows).select("feature", F.col("emd").alias("observed"))
    null = join_on(resampled_distances(counts, sizes, n, replace, seed, piece_values), observed, ["feature"])
    more = 0 if replace else 1
    # equal areas may differ in their last bits by the order of the sums
    reached = F.count_if(F.col("emd") >= F.col("observed") - 1e-12 * F.abs("observed"))
    return null.groupBy("feature", "observed").agg(
        ((reached + more) / (F.count("*") + more)).alias("p_value"), F.avg("emd").alias("null_mean"), F.stddev_pop("emd").alias("null_std"))


def permutation_drift(baseline: DataFrame, recent: DataFrame, features: Sequence[str], **options) -> DataFrame:
    return drift_test(two_sides(baseline, recent, features), replace=False, **options)


def bootstrap_drift(baseline: DataFrame, recent: DataFrame, features: Sequence[str], **options) -> DataFrame:
    return drift_test(two_sides(baseline, recent, features), replace=True, **options)


def half_thresholds(df: DataFrame, features: Sequence[str], n: int = 1000, seed: int = 42, piece_values: int = PIECE_VALUES) -> DataFrame:
    """``feature``, ``p95``, ``p99``, ``mean``, ``std`` of the distance between random halves of a table: what drift must exceed."""
    counts = value_counts(df, features).where(F.col("value").isNotNull())
    totals = counts.groupBy("feature").agg(F.sum("n").alias("t")).where(F.col("t") > 1)
    sizes = totals.select("feature", F.expr("t div 2").alias("n0"), F.expr("t - t div 2").alias("n1"))
    null = resampled_distances(join_on(counts, sizes.select("feature"), ["feature"], "left_semi"), sizes, n, False, seed, piece_values)
    # one row per replicate
    return null.groupBy("feature").agg(F.percentile("emd", 0.95).alias("p95"), F.percentile("emd", 0.99).alias("p99"),
                                       F.avg("emd").alias("mean"), F.stddev_pop("emd").alias("std"))

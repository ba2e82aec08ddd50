"""Changes between a baseline and a recent table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanwarden.functions import tests_of_significance as sig
from scanwarden.operators import draws
from scanwarden.operators.profile import long_form
from scanwarden.skew import join_on, running_totals

IMPACT = {"feature_distribution": 0.3, "embedding_space": 0.4, "performance": 0.6, "attention_patterns": 0.2}
ALERT_WEIGHT = {"none": 1.0, "low": 0.8, "medium": 0.5, "high": 0.2}
ADVICE = {
    "performance": "URGENT: Schedule immediate model retraining due to performance degradation",
    "feature_distribution": "Review data pipeline for changes in feature extraction or data sources",
    "embedding_space": "Analyze recent data patterns for new behavioral modes not seen in training",
    "attention_patterns": "Investigate changes in sequence patterns and temporal dependencies"}
LEVEL_ADVICE = {
    "high": "Consider emergency fallback to rule-based detection system",
    "medium": "Increase monitoring frequency and prepare retraining pipeline"}
CALM_ADVICE = "System operating normally - continue standard monitoring"


def value_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, value and how often it occurs (``n``): all that the distances need of a table."""
    return long_form(df, features, cast="double", name="feature").groupBy("feature", "value").agg(F.count("*").alias("n"))


def two_sides(baseline: DataFrame, recent: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, value, side (0 baseline, 1 recent)."""
    first = long_form(baseline, features, cast="double", name="feature").withColumn("side", F.lit(0))
    return first.unionByName(long_form(recent, features, cast="double", name="feature").withColumn("side", F.lit(1)))


def distances(rows: DataFrame, by: Sequence[str] = ("feature",), weight: Column | None = None, bounded: bool = False,
              limit: int | None = None) -> DataFrame:
    """Earth mover's distance and Kolmogorov-Smirnov statistic between the two sides of each group.

    Equal values are counted first. With D the difference of the two cumulative shares, the
    area between the curves is summed as value * (|D before| - |D after|), which needs no look
    at the next value.
    """
    w = F.lit(1) if weight is None else weight
    rows = rows.where(F.col("value").isNotNull())
    side = F.col("side")
    counted = rows.groupBy(*by, "value").agg(
        F.sum(F.when(side == 0, w).otherwise(0)).alias("_a"), F.sum(F.when(side == 1, w).otherwise(0)).alias("_b"))
    options = {"bounded": bounded} if limit is None else {"limit": limit}
    ranked = running_totals(counted, by, ["value"], {"_ca": F.col("_a"), "_cb": F.col("_b")}, **options)
    totals = counted.groupBy(*by).agg(F.sum("_a").alias("n_baseline"), F.sum("_b").alias("n_recent"), F.min("value").alias("_low"))
    ranked = join_on(ranked, totals, by)
    na, nb = F.col("n_baseline"), F.col("n_recent")
    after = F.abs(F.col("_ca") / na - F.col("_cb") / nb)
    before = F.abs((F.col("_ca") - F.col("_a")) / na - (F.col("_cb") - F.col("_b")) / nb)
    return ranked.groupBy(*by, "n_baseline", "n_recent").agg(
        F.sum((F.col("value") - F.col("_low")) * (before - after)).alias("emd"), F.max(after).alias("ks"))


def wasserstein(baseline: DataFrame, recent: DataFrame, features: Sequence[str], **options) -> DataFrame:
    return distances(two_sides(baseline, recent, features), **options).select("feature", "emd")


def ks_test(baseline: DataFrame, recent: DataFrame, features: Sequence[str], **options) -> DataFrame:
    out = distances(two_sides(baseline, recent, features), **options)
    p = sig.ks_pvalue(F.col("ks"), F.col("n_baseline").cast("double"), F.col("n_recent").cast("double"))
    return out.select("feature", "ks", p.alias("p_value"))


def drift_baseline(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, population deviation and size per feature."""
    rows = long_form(df, features, cast="double", name="feature")
    return rows.groupBy("feature").agg(
        F.count("value").alias("samples"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def feature_drift(baseline: DataFrame, recent: DataFrame, features: Sequence[str], threshold: float) -> DataFrame:
    """Distance, KS, effect size and mean shift per feature; drift of the table above 10 % of features."""
    rows = two_sides(baseline, recent, features)
    stats = rows.groupBy("feature").agg(
        F.avg(F.when(F.col("side") == 0, F.col("value"))).alias("baseline_mean"),
        F.stddev_pop(F.when(F.col("side") == 0, F.col("value"))).alias("_std"),
        F.avg(F.when(F.col("side") == 1, F.col("value"))).alias("recent_mean"))
    out = join_on(distances(rows), stats, ["feature"])
    out = out.withColumns({
        "effect_size": F.col("emd") / (F.col("_std") + 1e-10), "mean_shift": F.col("recent_mean") - F.col("baseline_mean"),
        "drifted": F.col("emd") > threshold})
    share = out.agg(F.avg(F.col("drifted").cast("double")).alias("_share"))
    out = out.crossJoin(F.broadcast(share)).withColumn("table_drifted", F.col("_share") > 0.1)
    return out.drop("_std", "_share", "n_baseline", "n_recent")


def embedding_drift(baseline: DataFrame, recent: DataFrame, column: str = "embedding", threshold: float = 0.1) -> DataFrame:
    """Mean and largest distance over dimensions, centroid shift and change of spread; one row."""
    def sided(df: DataFrame, side: int) -> DataFrame:
        return df.select(F.posexplode(column).alias("feature", "value"), F.lit(side).alias("side")).withColumn(
            "value", F.col("value").cast("double"))

    rows = sided(baseline, 0).unionByName(sided(recent, 1))
    emd = distances(rows)
    old, new = (F.when(F.col("side") == s, F.col("value")) for s in (0, 1))
    stats = rows.groupBy("feature").agg(
        F.avg(old).alias("_m0"), F.avg(new).alias("_m1"), F.stddev_pop(old).alias("_s0"), F.stddev_pop(new).alias("_s1"))
    out = join_on(emd, stats, ["feature"]).agg(
        F.avg("emd").alias("mean_emd"), F.max("emd").alias("max_emd"),
        F.sqrt(F.sum(F.pow(F.col("_m1") - F.col("_m0"), F.lit(2.0)))).alias("centroid_shift"),
        (F.avg("_s1") / F.avg("_s0")).alias("spread_change"))
    hit = (F.col("mean_emd") > threshold) | (F.col("centroid_shift") > 0.5) | (F.abs(F.col("spread_change") - 1) > 0.3)
    return out.withColumn("drifted", hit)


def _added(counts: DataFrame) -> DataFrame:
    """Counts of all tasks added up."""
    return counts.groupBy("replicate", "feature", "value", "side").agg(F.sum("n").alias("n"))


def bootstrap_threshold(df: DataFrame, features: Sequence[str], key: Sequence[str], n: int = 100, seed: int = 42) -> DataFrame:
    """Percentiles, mean and deviation of the distance between random halves of the baseline; one row.

    A replicate's distance is the mean over the features. Halves are drawn by hash per replicate, once for all
    features of a row, so the draw is part of the map stage; what is shuffled are counts per replicate, feature and value.
    """
    def halves(_, drawn):
        odd = drawn[0] & 1
        return 1 - odd, odd

    counts = draws.counted_beside(df, key, features, [[f"{r}|{seed}"] for r in range(n)], halves)
    per = distances(_added(counts), ["replicate", "feature"], F.col("n")).groupBy("replicate").agg(F.avg("emd").alias("emd"))
    # one row per replicate
    return per.agg(
        F.percentile("emd", 0.95).alias("p95"), F.percentile("emd", 0.99).alias("p99"),
        F.avg("emd").alias("mean"), F.stddev_pop("emd").alias("std"))


RANGE_BITS = 10


def _cuts(rows: DataFrame, key: Sequence[str], suffixes: Sequence[str]) -> dict[tuple[int, str], int]:
    """The draw up to which a row is on side 0, per replicate and feature with rows of the baseline.

    Counts of the leading bits tell the range it lies in, so that only the draws of one of 1,024 ranges are ranked.
    """
    by = ["replicate", "feature"]
    known = rows.where(F.col("value").isNotNull())
    sizes = known.groupBy("feature").agg(F.count_if(F.col("side") == 0).alias("_n0"))
    counted = draws.ranges_counted(known, key, suffixes, RANGE_BITS).groupBy(*by, "_range").agg(F.sum("n").alias("_n"))
    up_to = Window.partitionBy(*by).orderBy("_range")  # at most 1,024 rows
    found = join_on(counted.withColumn("_sum", F.sum("_n").over(up_to)), sizes, ["feature"])
    found = found.where((F.col("_sum") >= F.col("_n0")) & (F.col("_sum") - F.col("_n") < F.col("_n0")))
    # one row per replicate and feature
    places = {(r["replicate"], r["feature"]): r for r in found.select(*by, "_range", (F.col("_n0") - F.col("_sum") + F.col("_n")).alias("_place")).collect()}
    near = draws.draws_in(known, key, suffixes, RANGE_BITS, {k: r["_range"] for k, r in places.items()})
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_draw")))
    place = near.sparkSession.createDataFrame([(*k, int(r["_place"])) for k, r in places.items()], "replicate int, feature string, _place long")
    cut = join_on(ranked, F.broadcast(place), by, "inner").where(F.col("_rank") == F.col("_place"))
    return {(r["replicate"], r["feature"]): r["_draw"] for r in cut.select(*by, "_draw").collect()}


def _relabeled(rows: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """Counts of each replicate, the baseline's number of smallest draws as side 0, the others as side 1.

    Rows without a value take no part.
    """
    suffixes = [f"{r}|{seed}" for r in range(n)]
    cuts = _cuts(rows, key, suffixes)

    def parted(r, drawn, at, names):
        first = drawn[0] <= np.array([cuts.get((r, f), -1) for f in names])[at]
        return first, ~first

    return _added(draws.counted(rows, key, [[s] for s in suffixes], parted))


def permutation_test(rows: DataFrame, key: Sequence[str], n: int = 100, statistic: str = "emd", seed: int = 42) -> DataFrame:
    """Share of random relabelings whose difference is at least the observed one, and mean and deviation of theirs, per feature.

    ``rows`` has feature, value, side and the key. Each replicate keeps the sizes of the sides.
    """
    def measure(df: DataFrame, by: Sequence[str], n: Column) -> DataFrame:
        if statistic == "emd":
            return distances(df, by, n).select(*by, F.col("emd").alias("stat"))
        weights = [F.when((F.col("side") == s) & F.col("value").isNotNull() & (n > 0), n) for s in (0, 1)]
        a, b = (F.sum(F.col("value") * w) / F.nullif(F.sum(w), F.lit(0)) for w in weights)
        return df.groupBy(*by).agg(F.abs(a - b).alias("stat"))

    observed = measure(rows, ["feature"], F.lit(1)).withColumnRenamed("stat", "observed")
    null = join_on(measure(_relabeled(rows, key, n, seed), ["replicate", "feature"], F.col("n")), observed, ["feature"])
    return null.groupBy("feature", "observed").agg(
        ((F.count_if(F.col("stat") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p_value"),
        F.avg("stat").alias("null_mean"), F.stddev_pop("stat").alias("null_std"))


def poisson_weights(u: np.ndarray) -> np.ndarray:
    """Poisson(1) counts from uniform draws, by their cumulative probabilities."""
    totals, total, term = [], 0.0, 0.36787944117144233
    for k in range(9):
        total += term
        totals.append(total)
        term /= k + 1
    return np.searchsorted(totals, u, side="right")


def bootstrap_emd_test(rows: DataFrame, key: Sequence[str], n: int = 100, seed: int = 42) -> DataFrame:
    """p-value of the distance against resamples of the pooled table (Poisson weights for both sides)."""
    observed = distances(rows).select("feature", F.col("emd").alias("observed"))
    # both sides are drawn from the pooled rows, so the distance of a replicate is pure chance
    suffixes = [[f"{side}|{r}|{seed}" for side in (0, 1)] for r in range(n)]
    counts = draws.counted(rows, key, suffixes, lambda _, drawn, *__: tuple(poisson_weights(d / 2**48) for d in drawn))
    null = join_on(distances(_added(counts), ["replicate", "feature"], F.col("n")), observed, ["feature"])
    return null.groupBy("feature", "observed").agg(
        (F.count_if(F.col("emd") >= F.col("observed")) / F.count("*")).alias("p_value"))


def multivariate_drift(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Bonferroni decision over features, and the share of features below ``alpha``; one row."""
    size = tests.agg(F.count("*").alias("features"))
    rows = tests.crossJoin(F.broadcast(size))
    return rows.groupBy("features").agg(
        F.count_if(F.col("p_value") < alpha).alias("significant"),
        F.count_if(F.col("p_value") < alpha / F.col("features")).alias("bonferroni_significant"),
    ).withColumns({
        "drift": F.col("bonferroni_significant") > 0, "severity": F.col("significant") / F.col("features")})


def performance_drift(history: DataFrame, baseline: DataFrame, threshold: float = 0.05, recent: int = 30) -> DataFrame:
    """Drop of each metric against its baseline; t-test over the last 30 runs when there are as many.

    ``history``: metric, run, value. ``baseline``: metric, baseline.
    """
    back = Window.partitionBy("metric").orderBy(F.desc("run"))  # one row per run of a metric
    rows = history.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= recent)
    stats = rows.groupBy("metric").agg(
        F.max(F.when(F.col("_r") == 1, F.col("value"))).alias("current"), F.count("*").alias("runs"),
        F.avg("value").alias("_m"), F.stddev("value").alias("_s"))
    out = baseline.join(stats, "metric")
    t = F.when((F.col("runs") >= recent) & (F.col("_s") > 0),
               (F.col("_m") - F.col("baseline")) / (F.col("_s") / F.sqrt(F.col("runs").cast("double"))))
    out = out.withColumns({"drop": F.col("baseline") - F.col("current"), "t_statistic": t})
    out = out.withColumn("p_value", sig.t_pvalue(F.col("t_statistic"), (F.col("runs") - 1).cast("double")))
    sure = F.when(F.col("runs") >= recent, (F.coalesce("p_value", F.lit(1.0)) < 0.05) & (F.col("drop") > 0)).otherwise(
        F.col("drop") > threshold)
    weight = F.when(F.col("metric").contains("cost"), 10.0).otherwise(1.0)
    return out.withColumns({
        "relative_drop": F.when(F.col("baseline") > 0, F.col("drop") / F.col("baseline")).otherwise(0.0),
        "drifted": (F.col("drop") > threshold) & sure, "impact": F.col("drop") * weight}).drop("_m", "_s")


def distribution_js_drift(baseline: DataFrame, recent: DataFrame, by: Sequence[str], position: str, weight: str,
                          js_cut: float = 0.2, entropy_cut: float = 0.5, concentration_cut: float = 0.3) -> DataFrame:
    """Jensen-Shannon distance, entropy change and concentration change of weights over positions."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*by, position).agg(F.sum(weight).alias(name))

    both = side(baseline, "_p").join(side(recent, "_q"), [*by, position], "full").fillna(0, ["_p", "_q"])
    totals = both.groupBy(*by).agg(F.sum("_p").alias("_tp"), F.sum("_q").alias("_tq"))
    rows = join_on(both, totals, by).withColumns({
        "p": F.col("_p") / (F.col("_tp") + 1e-10), "q": F.col("_q") / (F.col("_tq") + 1e-10)})
    m = (F.col("p") + F.col("q")) / 2

    def divergence(c: str) -> Column:
        return F.sum(F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / m)).otherwise(0.0))

    def bits(c: str) -> Column:
        return -F.sum(F.col(c) * F.log(F.col(c) + 1e-10))

    out = rows.groupBy(*by).agg(
        F.sqrt(F.greatest((divergence("p") + divergence("q")) / 2, F.lit(0.0))).alias("js_distance"),
        (bits("q") - bits("p")).alias("entropy_change"),
        (F.stddev_pop("q") - F.stddev_pop("p")).alias("concentration_change"))
    hit = (F.col("js_distance") > js_cut) | (F.abs("entropy_change") > entropy_cut) | (F.abs("concentration_change") > concentration_cut)
    return out.withColumn("drifted", hit)


def drift_assessment(kinds: DataFrame, retrain_at: int = 2) -> DataFrame:
    """Level, retraining, impact and advice per run. ``kinds``: run and one boolean column per kind of drift."""
    names = list(IMPACT)
    count = sum((F.col(k).cast("int") for k in names), F.lit(0))
    impact = sum((F.when(F.col(k), w).otherwise(0.0) for k, w in IMPACT.items()), F.lit(0.0))
    out = kinds.withColumns({"kinds": count, "impact_score": impact})
    level = F.when(F.col("kinds") >= 3, "high").when(F.col("kinds") >= 2, "medium").when(F.col("kinds") >= 1, "low").otherwise("none")
    out = out.withColumn("alert_level", level)
    texts = [F.when(F.col(k), ADVICE[k]) for k in ADVICE]
    texts += [F.when(F.col("alert_level") == k, v) for k, v in LEVEL_ADVICE.items()]
    texts.append(F.when(F.col("kinds") == 0, CALM_ADVICE))
    severity = F.when(F.col("impact_score") > 0.8, "high").when(F.col("impact_score") > 0.4, "medium").otherwise("low")
    return out.withColumns({
        "retrain": F.col("kinds") >= retrain_at, "severity": severity, "confidence": 1 - F.col("kinds") / 4.0,
        "cost_increase_percent": F.col("impact_score") * 15, "detection_loss_percent": F.col("impact_score") * 5,
        "advice": F.array_compact(F.array(*texts))})


def drift_summary(assessments: DataFrame, recent: int = 10) -> DataFrame:
    """Alert distribution, trend of the last runs and stability over a history of assessments; one row."""
    ranks = {"none": 0, "low": 1, "medium": 2, "high": 3}
    value = None
    weight = None
    for name in ranks:
        value = F.when(F.col("alert_level") == name, ranks[name]) if value is None else value.when(F.col("alert_level") == name, ranks[name])
        weight = F.when(F.col("alert_level") == name, ALERT_WEIGHT[name]) if weight is None else weight.when(
            F.col("alert_level") == name, ALERT_WEIGHT[name])
    totals = assessments.agg(
        F.count("*").alias("runs"), *[F.count_if(F.col("alert_level") == n).alias(f"{n}_alerts") for n in ranks],
        *[F.count_if(k).alias(f"{k}_runs") for k in IMPACT], F.avg(weight).alias("stability"),
        F.max_by("alert_level", "run").alias("current_status"))
    last = assessments.orderBy(F.desc("run")).limit(recent).withColumn("_v", value)
    w = Window.orderBy("run")  # at most ``recent`` rows
    steps = last.withColumn("_d", F.col("_v") - F.lag("_v").over(w))
    trend = steps.agg(F.count("*").alias("_n"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi")).select(
        F.when(F.col("_n") < 3, "insufficient_data").when(F.col("_lo") >= 0, "deteriorating")
        .when(F.col("_hi") <= 0, "improving").otherwise("stable").alias("recent_trend"))
    return totals.crossJoin(F.broadcast(trend))

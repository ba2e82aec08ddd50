"""Labels from rule scores and findings, and thresholds for them."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanwarden import constants as C
from scanwarden.functions import clock
from scanwarden.operators.detect_epc import epc_duplicate, epc_event_order, epc_location_error, statistical_jump
from scanwarden.skew import EPC_KEYS, EVENT_ORDER, MEASURE, HotKeys, hot_keys, join_on, quantiles

Hot = HotKeys | str | None

# priority of a type for the business, and the weight of each level
BUSINESS_PRIORITY = {"epcFake": "HIGH", "epcDup": "MEDIUM", "locErr": "MEDIUM", "evtOrderErr": "LOW", "jump": "HIGH"}
LEVEL_WEIGHT = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
# thresholds in business use today, which recommendations scale from
BUSINESS_THRESHOLDS = {"epcFake": 60, "epcDup": 30, "locErr": 40, "evtOrderErr": 35, "jump": 50}
SWEEP_RANGES = {
    "very_strict": range(0, 20, 2), "strict": range(0, 40, 4), "moderate": range(0, 60, 6),
    "lenient": range(0, 80, 8), "very_lenient": range(0, 100, 10)}
CURRENT_THRESHOLD = 20


def lookup(mapping: dict, key: Column) -> Column:
    """Literal map lookup."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])[key]


def long_scores(item_scores: DataFrame, keys: Sequence[str] = EPC_KEYS, dataset: Column | None = None) -> DataFrame:
    """One row per item and type, from one column per type."""
    name = F.lit("all") if dataset is None else dataset
    rows = item_scores.select(*keys, name.alias("dataset"), *[F.col(t).cast("int") for t in C.ANOMALY_TYPES])
    return rows.unpivot([*keys, "dataset"], list(C.ANOMALY_TYPES), "anomaly_type", "score")


def rule_labels(scores: DataFrame, thresholds: dict[str, int] | None = None) -> DataFrame:
    """Adds ``label``: 1 where the score reaches the threshold of its type (50 by default)."""
    cuts = {t: C.LABEL_THRESHOLD for t in C.ANOMALY_TYPES} | (thresholds or {})
    return scores.withColumn("label", (F.col("score") >= lookup(cuts, F.col("anomaly_type"))).cast("int"))


def rule_labels_per_event(events: DataFrame, labels: DataFrame, keys: Sequence[str] = EPC_KEYS) -> DataFrame:
    """Item labels copied to the events of the item."""
    return join_on(events.select(*keys, "event_id"), labels.select(*keys, "anomaly_type", "label", "score"), keys, "inner")


def labels_from_findings(events: DataFrame, findings: DataFrame, keys: Sequence[str] = EPC_KEYS) -> DataFrame:
    """Item labels: 1 for a type that any event of the item was found with."""
    found = findings.groupBy(*keys).agg(*[F.max(F.coalesce(F.col(t), F.lit(False)).cast("int")).alias(t) for t in C.STATS_TYPES])
    return join_on(events.select(*keys).distinct(), found, keys).fillna(0, list(C.STATS_TYPES))


def simulation_labels(features: DataFrame) -> DataFrame:
    """Labels straight from feature columns, without looking at future dates."""
    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("int")

    return features.withColumns({
        "epcFake": flag((F.col("location_entropy") > 2.0) | (F.col("operator_entropy") > 1.5)),
        "epcDup": flag(F.col("time_gap_log") < 1.0),
        "locErr": flag((F.col("business_step_regression") == 1) | (F.col("location_backtrack") == 1)),
        "evtOrderErr": flag(F.col("business_step_advancement") < 0),
        "jump": flag(F.col("time_gap_log") > 10.0)})


def reduced_threshold_labels(df: DataFrame, as_of: Column, thresholds: dict[str, int] | None = None, *,
                             type_column: str = "event_type", keys: Sequence[str] = EPC_KEYS,
                             order: Sequence[str] = EVENT_ORDER, hot: Hot = MEASURE) -> DataFrame:
    """Item labels at low thresholds: repeated times count as duplicates, gap ranges as jumps.

    Expects ``normalize_scans`` output.
    """
    from scanwarden.functions import epc

    cuts = thresholds or C.REDUCED_THRESHOLDS
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    options = {"keys": keys, "order": order, "hot": hot}
    out = epc.with_fake_score(df.select(*keys).distinct(), as_of, "_fake")
    out = join_on(out, epc_location_error(df, **options), keys)
    out = join_on(out, epc_event_order(df, type_column=type_column, **options), keys)
    out = join_on(out, statistical_jump(df, "range", **options), keys)
    times = df.groupBy(*keys, "event_time").agg(F.count("*").alias("_n"))
    repeated = times.groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("_repeated"))
    out = join_on(out, repeated, keys)
    return out.select(
        *keys,
        (F.col("_fake") >= cuts["epcFake"]).cast("int").alias("epcFake"),
        (F.col("_repeated") > 0).cast("int").alias("epcDup"),
        (F.col("locErr") >= cuts["locErr"]).cast("int").alias("locErr"),
        (F.col("evtOrderErr") >= cuts["evtOrderErr"]).cast("int").alias("evtOrderErr"),
        (F.col("jump_stat") >= cuts["jump"]).cast("int").alias("jump"))


def threshold_for_ratio(scores: DataFrame, ratios: dict[str, float] | None = None) -> DataFrame:
    """Threshold per type that leaves about the wanted share of positives, a whole number 0-100."""
    ratios = ratios or C.TARGET_POSITIVE_RATIO
    marks = {f"q{i}": 1 - r for i, r in enumerate(sorted(set(ratios.values())))}
    table = quantiles(scores, ["anomaly_type"], "score", marks, bounded=True)
    value = None
    for t, r in ratios.items():
        mark = next(n for n, p in marks.items() if p == 1 - r)
        value = F.when(F.col("anomaly_type") == t, F.col(mark)) if value is None else value.when(F.col("anomaly_type") == t, F.col(mark))
    # halves go to the even neighbour
    cut = F.least(F.greatest(F.bround(value), F.lit(0.0)), F.lit(100.0)).cast("int")
    return table.select("anomaly_type", cut.alias("threshold"))


def calibrate(scores: DataFrame, config: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """Threshold per dataset and type at the target rate, kept inside the business range.

    Scores are counted per value first; both passes run over those counts.
    """
    config = config or C.CALIBRATION
    kind = F.col("anomaly_type")
    marks = {t: 1 - rate for t, (rate, _, _) in config.items()}
    table = quantiles(scores, ["dataset", "anomaly_type"], "score", marks, bounded=True)
    raw = lookup_column({t: F.col(t) for t in config}, kind)
    low, high = lookup({t: v[1] for t, v in config.items()}, kind), lookup({t: v[2] for t, v in config.items()}, kind)
    table = table.select(
        "dataset", "anomaly_type", raw.alias("raw_threshold"), F.least(F.greatest(raw, low), high).alias("threshold"))
    counted = scores.groupBy("dataset", "anomaly_type", "score").agg(F.count("*").alias("_n"))
    joined = counted.join(table, ["dataset", "anomaly_type"])
    out = joined.groupBy("dataset", "anomaly_type", "raw_threshold", "threshold").agg(
        F.sum("_n").alias("samples"),
        F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("_n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("score") >= CURRENT_THRESHOLD, F.col("_n")).otherwise(0)).alias("current"))
    rate, now = F.col("predicted") / F.col("samples"), F.col("current") / F.col("samples")
    return out.select(
        "dataset", "anomaly_type", "raw_threshold", "threshold", "samples", "predicted", rate.alias("actual_rate"),
        now.alias("current_rate"), F.when(rate > 0, now / rate).alias("improvement_ratio"),
        lookup({t: v[0] for t, v in config.items()}, kind).alias("target_rate"),
        F.when(F.col("raw_threshold") != F.col("threshold"), "percentile_constrained").otherwise("percentile_pure").alias("source"))


def lookup_column(mapping: dict[str, Column], key: Column) -> Column:
    out = None
    for name, value in mapping.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def optimize_cost(scores: DataFrame, calibration: DataFrame, config: dict[str, tuple[float, float, float]] | None = None,
                  steps: int = 20) -> DataFrame:
    """Cheapest of evenly spaced thresholds around the calibrated one, first on ties.

    The target rate stands in for the truth: at most 1.5 times that many alerts are right.
    """
    config = config or C.CALIBRATION
    kind = F.col("anomaly_type")
    low, high = (lookup({t: v[i] for t, v in config.items()}, kind) for i in (1, 2))
    start, end = F.greatest(F.col("threshold") * 0.5, low), F.least(F.col("threshold") * 1.5, high)
    grid = calibration.select("dataset", "anomaly_type", "samples", "target_rate", F.col("threshold").alias("original"),
                              F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)),
                                                       lambda i: start + (end - start) * i / (steps - 1))).alias("step", "trial"))
    counted = scores.groupBy("dataset", "anomaly_type", "score").agg(F.count("*").alias("_n"))
    hits = grid.join(counted, ["dataset", "anomaly_type"]).groupBy(
        "dataset", "anomaly_type", "samples", "target_rate", "original", "step", "trial").agg(
        F.sum(F.when(F.col("score") >= F.col("trial"), F.col("_n")).otherwise(0)).alias("positives"))
    true = F.floor(F.col("target_rate") * F.col("samples"))
    right = F.least(F.col("positives"), F.floor(true * 1.5))
    false_alerts, missed = F.greatest(F.col("positives") - right, F.lit(0)), F.greatest(true - right, F.lit(0))
    cost = C.ALERT_COST * false_alerts + lookup(C.MISS_COST, kind) * missed
    costs = hits.withColumn("cost", cost.cast("double"))
    out = costs.groupBy("dataset", "anomaly_type", "original").agg(
        F.min("cost").alias("minimum_cost"),
        F.min_by("trial", F.struct("cost", "step")).alias("cost_threshold"),
        F.max(F.when(F.col("step") == 0, F.col("cost"))).alias("_first"))
    better = F.when(F.col("_first") != 0, 100 * (1 - F.col("minimum_cost") / F.col("_first")))
    return out.withColumn("cost_improvement_pct", better).drop("_first")


def consensus(calibration: DataFrame) -> DataFrame:
    """Median threshold and rate over datasets, consistency, confidence and saved alerts per type."""
    base = calibration.groupBy("anomaly_type").agg(
        F.percentile("threshold", F.lit(0.5)).alias("consensus_threshold"),
        F.percentile("actual_rate", F.lit(0.5)).alias("consensus_rate"),
        (F.stddev_pop("threshold") / F.avg("threshold")).alias("threshold_cv"),
        F.avg("current_rate").alias("avg_current_rate"),
        F.sum(F.col("samples") * F.col("current_rate")).alias("current_anomalies"), F.sum("samples").alias("samples"))
    reduced = calibration.join(base.select("anomaly_type", "consensus_rate"), "anomaly_type").groupBy("anomaly_type").agg(
        F.sum(F.greatest(F.col("samples") * (F.col("current_rate") - F.col("consensus_rate")), F.lit(0.0))).alias("alerts_saved"))
    confidence = F.when(F.col("threshold_cv") < 0.1, "HIGH").when(F.col("threshold_cv") < 0.3, "MEDIUM").otherwise("LOW")
    return base.join(reduced, "anomaly_type").withColumns({
        "threshold_consistency": 1 - F.col("threshold_cv"), "confidence": confidence,
        "cost_saved": F.col("alerts_saved") * C.ALERT_COST})


def priority_ranking(consensus_rows: DataFrame) -> DataFrame:
    """Types by improvement times business weight times confidence weight, largest first."""
    kind = F.col("anomaly_type")
    priority = lookup(BUSINESS_PRIORITY, kind)
    improvement = F.when(F.col("consensus_rate") > 0, F.col("avg_current_rate") / F.col("consensus_rate"))
    score = improvement * lookup(LEVEL_WEIGHT, priority) * lookup(LEVEL_WEIGHT, F.col("confidence"))
    return consensus_rows.select(
        "anomaly_type", "consensus_threshold", improvement.alias("improvement_factor"), priority.alias("business_priority"),
        "confidence", score.alias("priority_score")).orderBy(F.desc_nulls_last("priority_score"), "anomaly_type")


def recommend_thresholds(sweep: DataFrame, target: float = C.CALIBRATION["epcFake"][0]) -> DataFrame:
    """Swept threshold of the product-code score closest to the target rate; other types scale with it.

    ``sweep`` holds threshold and positive_ratio per dataset; the first of equally close ones wins.
    """
    best = sweep.groupBy("dataset").agg(
        F.min_by(F.struct("threshold", "positive_ratio"), F.struct(F.abs(F.col("positive_ratio") - target), F.col("step"))).alias("b"))
    factor = F.when(F.col("b.threshold") != 0, F.col("b.threshold") / BUSINESS_THRESHOLDS["epcFake"]).otherwise(0.3)
    rows = F.array(*[
        F.struct(F.lit(t).alias("anomaly_type"),
                 (F.col("b.threshold") if t == "epcFake" else F.bround(base * factor)).cast("double").alias("threshold"),
                 F.lit(C.CALIBRATION[t][0]).alias("target_rate"))
        for t, base in BUSINESS_THRESHOLDS.items()])
    return best.select("dataset", F.inline(rows))


def sweep_ranges(scores: DataFrame) -> DataFrame:
    """Positive share of the product-code score per dataset over five ranges of thresholds."""
    grid = [(i, name, float(t)) for i, (name, t) in enumerate((n, t) for n, r in SWEEP_RANGES.items() for t in r)]
    steps = scores.sparkSession.createDataFrame(grid, "step int, category string, threshold double")
    counted = scores.where(F.col("anomaly_type") == "epcFake").groupBy("dataset", "score").agg(F.count("*").alias("_n"))
    out = counted.join(F.broadcast(steps), F.lit(True)).groupBy("dataset", "step", "category", "threshold").agg(
        F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("_n")).otherwise(0)).alias("positives"), F.sum("_n").alias("_t"))
    return out.withColumn("positive_ratio", F.col("positives") / F.col("_t")).drop("_t")


def data_cleanliness_verdict(stats: DataFrame, cut: float = 0.01) -> DataFrame:
    """Whether all mean non-zero rates are below 1 %, and the lower thresholds to use then."""
    ranges = {"epcFake": "20-30", "epcDup": "10-15", "locErr": "15-25", "evtOrderErr": "10-20", "jump": "20-30"}
    rates = stats.groupBy("anomaly_type").agg(F.avg("non_zero_rate").alias("mean_rate"))
    verdict = rates.agg(F.max("mean_rate").alias("_top"))
    clean = F.col("_top") < cut
    return rates.crossJoin(F.broadcast(verdict)).select(
        "anomaly_type", "mean_rate",
        F.when(clean, "EXTREMELY_CLEAN_OR_SYNTHETIC").otherwise("SYNTHETIC_OR_HIGHLY_CLEAN").alias("verdict"),
        F.when(clean, lookup(ranges, F.col("anomaly_type"))).alias("suggested_range"))


def borderline(scores: DataFrame, threshold: float = C.LABEL_THRESHOLD, window: float = 5) -> DataFrame:
    """Scores close to the threshold, closest first."""
    distance = F.abs(F.col("score") - threshold)
    rows = scores.withColumns({
        "distance": distance, "predicted_label": (F.col("score") >= threshold).cast("int")})
    return rows.where(F.col("distance") <= window).orderBy("distance")

"""Whole jobs: answer a request, train one-class models from files, prepare sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanwarden import constants as C
from scanwarden.functions.moves import location_name
from scanwarden.operators import detect_epc, features, labels, oneclass, sampling
from scanwarden.operators.detect_events import detect_events
from scanwarden.plans import registry
from scanwarden.skew import MEASURE, HotKeys, hot_keys, join_on
from scanwarden.sources import findings_log, scan_files

Hot = HotKeys | str | None


def answer_envelopes(spark: SparkSession, path: str, as_of: Column, locations: DataFrame | None = None,
                     page_rows: int = 10_000) -> DataFrame:
    """Event envelopes in, response documents out."""
    events = scan_files.read_event_envelopes(spark, path)
    if locations is not None and not locations.isEmpty():
        events = events.join(locations.select("location_id", "scan_location"), "location_id", "left")
    else:
        events = events.withColumn("scan_location", F.lit(None).cast("string"))
    events = events.withColumn("scan_location", location_name(F.col("scan_location"), F.col("location_id")))
    return findings_log.to_response_json(detect_events(events, as_of), page_rows)


def train_from_scans(scans: DataFrame, as_of: Column, types: Sequence[str] = C.STATS_TYPES, transitions: DataFrame | None = None,
                     thresholds: dict[str, int] | None = None, steps: int = 15, hot: Hot = MEASURE) -> tuple[DataFrame, DataFrame]:
    """One-class models from the training files, rule labels as truth; also returns the file split."""
    if hot == MEASURE:
        hot = hot_keys(scans)
    split = sampling.file_split(scans)
    train = detect_epc.normalize_scans(split.where(F.col("split") == "train"))
    scores = detect_epc.detect_epc(train, as_of, transitions, only_findings=False, hot=hot)
    marked = labels.rule_labels(labels.long_scores(scores), thresholds)
    models = None
    for kind in types:
        cells = registry.item_features(kind, train, as_of, **({} if kind == "epcFake" else {"hot": hot}))
        rows = join_on(cells, marked.where(F.col("anomaly_type") == kind).select("file_id", "epc_code", "label", "score"),
                       ["file_id", "epc_code"], "inner")
        model = oneclass.fit_one_class(rows, list(registry.FEATURE_NAMES[kind]), kind, steps=steps)
        if model is not None:
            models = model if models is None else models.unionByName(model)
    return models, split.select("source_file", "split").distinct()


def prepare_sequences(scans: DataFrame, columns: Sequence[str], test_ratio: float = 0.2, buffer_days: int = 7,
                      hot: Hot = MEASURE, **lengths) -> DataFrame:
    """Features, labels from features, leakage-free split and adaptive windows, tagged with ``split``."""
    if hot == MEASURE:
        hot = hot_keys(scans)
    keys = ("file_id", "epc_code")
    # the split is measured on the scans, so the feature plan is evaluated once
    rules = sampling.split_rules(scans, test_ratio, buffer_days, keys=keys)
    rows = labels.simulation_labels(features.run_features(scans, hot=hot))
    rows = sampling.apply_split(rows, rules, buffer_days, keys)
    return features.sequences_adaptive(rows, columns, C.STATS_TYPES, keep=["split"], hot=hot, **lengths)

"""Logs, response documents and reports of findings."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanwarden import constants as C
from scanwarden.operators.detect_events import epc_stats, file_stats
from scanwarden.skew import EPC_KEYS, join_on, paged


def run_summary(findings: DataFrame, events: DataFrame, run_id: str, run_ts: Column) -> DataFrame:
    """Input size, findings, rate, items and breakdown of a run; one row."""
    counts = events.agg(F.count("*").alias("input_events"))
    items = events.select(*EPC_KEYS).distinct().agg(F.count("*").alias("items"))
    found = findings.agg(
        F.count("*").alias("findings"), *[F.count_if(F.coalesce(F.col(t), F.lit(False))).alias(t) for t in C.STATS_TYPES])
    one = counts.crossJoin(F.broadcast(items)).crossJoin(F.broadcast(found))
    rate = F.when(F.col("input_events") > 0, F.col("findings") / F.col("input_events")).otherwise(0.0)
    return one.withColumns({"rate": rate, "run_id": F.lit(run_id), "run_ts": run_ts})


def write_findings_log(findings: DataFrame, events: DataFrame, path: str, run_id: str, run_ts: Column) -> None:
    """Writes the findings of a run and then its summary, which counts what was written and is the run's entry in the list of runs.

    The entry is one row in one file, which a job's commit moves into place, so a run is listed whole or not at all. Each call is an
    attempt of its own: a run that is written again is listed again, and readers take its newest attempt.
    """
    attempt = uuid.uuid4().hex
    tagged = findings.withColumns({"run_id": F.lit(run_id), "run_ts": run_ts, "attempt": F.lit(attempt), "run_date": run_ts.cast("date")})
    tagged.write.mode("append").partitionBy("run_date").parquet(f"{path}/findings")
    kept = events.sparkSession.read.schema(tagged.schema).parquet(f"{path}/findings")
    kept = kept.where((F.col("attempt") == attempt) & (F.col("run_date") == run_ts.cast("date")))
    summary = run_summary(kept, events, run_id, run_ts).withColumns({"attempt": F.lit(attempt), "written_at": F.current_timestamp(), "run_date": run_ts.cast("date")})
    summary.coalesce(1).write.mode("append").parquet(f"{path}/runs")


def _runs(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/runs")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def logged_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """The summary of each listed run, by its newest attempt; None when there is no log yet."""
    runs = _runs(spark, path)
    if runs is None:
        return None
    newest = F.max(F.struct("written_at", "attempt", *[c for c in runs.columns if c not in ("run_id", "written_at", "attempt")])).alias("r")
    return runs.groupBy("run_id").agg(newest).select("run_id", "r.*")


def logged_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of all listed runs, each by its newest attempt; what an attempt left that was not listed is not seen. An empty table
    with the columns of a run when there is no log yet."""
    runs = logged_runs(spark, path)
    if runs is None:
        flags = ", ".join(f"{t} boolean, {t}Score int" for t in C.STATS_TYPES)
        return spark.createDataFrame([], f"event_id long, file_id int, epc_code string, {flags}, run_id string, run_ts timestamp, run_date date")
    listed = runs.select("run_id", "attempt", "run_date")
    return spark.read.parquet(f"{path}/findings").join(listed, ["run_id", "attempt", "run_date"], "left_semi").drop("attempt")


def latest_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of the newest listed run; see ``logged_findings``."""
    runs = logged_runs(spark, path)
    every = logged_findings(spark, path)
    if runs is None:
        return every
    newest = runs.orderBy(F.desc("run_ts"), F.desc("written_at")).limit(1).select("run_id", "run_date")
    return every.join(F.broadcast(newest), ["run_id", "run_date"], "left_semi")


def to_response_json(findings: DataFrame, page_rows: int = 10_000) -> DataFrame:
    """One JSON document per file with event history, item and file statistics; nulls are left out.

    Files with more than ``page_rows`` findings are answered in several numbered documents,
    each with its share of events and items and the statistics of the whole file.
    """
    names = [*C.STATS_TYPES, *[f"{t}Score" for t in C.STATS_TYPES]]
    history = F.struct(F.col("event_id").alias("eventId"), *names)
    items = F.struct(F.col("epc_code").alias("epcCode"), *[f"{t}Count" for t in C.STATS_TYPES], "totalEvents")
    events = paged(findings, ["file_id"], ["epc_code", "event_id"], page_rows)
    events = events.groupBy("file_id", "page", "pages").agg(F.sort_array(F.collect_list(history)).alias("EventHistory"))
    per_item = paged(epc_stats(findings), ["file_id"], ["epc_code"], page_rows)
    per_item = per_item.groupBy("file_id", "page").agg(F.sort_array(F.collect_list(items)).alias("epcAnomalyStats"))
    # every page of items has events; a null file is a file of its own
    docs = join_on(join_on(events, per_item, ["file_id", "page"]), file_stats(findings), ["file_id"], "inner")
    document = F.struct(
        F.col("file_id").alias("fileId"), "EventHistory", "epcAnomalyStats",
        F.struct(*[f"{t}Count" for t in C.STATS_TYPES], "totalEvents").alias("fileAnomalyStats"))
    return docs.select("file_id", "page", "pages", F.to_json(document).alias("document"))


def split_anomalous_normal(events: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with findings (and ``<type>_detected`` flags) and events without."""
    keys = [*EPC_KEYS, "event_id"]
    flags = findings.select(*keys, *[F.coalesce(F.col(t), F.lit(False)).alias(f"{t}_detected") for t in C.STATS_TYPES])
    return join_on(events, flags, keys, "inner"), join_on(events, flags, keys, "left_anti")


def scored_report(df: DataFrame, types: Sequence[str] = C.STATS_TYPES, cut: float = 0.5) -> DataFrame:
    """Flags, largest score and number of types per row, highest scores first. Expects ``<type>_score``."""
    out = df.withColumns({f"{t}_detected": F.col(f"{t}_score") > cut for t in types})
    count = sum((F.col(f"{t}_detected").cast("int") for t in types), F.lit(0))
    out = out.withColumns({"anomaly_count": count, "max_score": F.greatest(*[F.col(f"{t}_score") for t in types])})
    return out.withColumn("any_anomaly", F.col("anomaly_count") > 0).orderBy(F.desc("max_score"))


def report_detail(findings: DataFrame) -> DataFrame:
    """Rows of a report page, from item findings, with kinds of sequence problems by keyword."""
    step = F.col("problemStep")
    problems = F.array_compact(F.array(
        F.when(step.contains("_to_"), "route"), F.when(step.contains("issue"), "timing"),
        F.when(step.contains("Format"), "format"), F.when(step.contains("Duplicate"), "duplicate")))
    return findings.select(
        *EPC_KEYS, "eventTime", "anomalyTypes", "sequencePosition", "scanLocation", "anomalyScores", "problemStep",
        problems.alias("sequenceProblems"))


def sequence_problems(details: DataFrame) -> DataFrame:
    """Distinct kinds of sequence problems per file; there are four kinds."""
    return details.select("file_id", F.explode("sequenceProblems").alias("problem")).distinct()


def head_middle_tail(df: DataFrame, n: int, source: str = "source_file", order: Sequence[str] = ("event_id",)) -> DataFrame:
    """First, middle and last third of ``n`` rows of each file."""
    from scanwarden.skew import broadcast_if_small, join_on, running_totals

    sizes = broadcast_if_small(df.groupBy(source).agg(F.count("*").alias("_size")))
    ranked = running_totals(join_on(df, sizes, [source]), [source], list(order), {"_rank": F.lit(1)})
    part = n // 3
    start = F.floor(F.col("_size") / 2) - part // 2
    inside = (F.col("_rank") <= part) | F.col("_rank").between(start + 1, start + part) | (F.col("_rank") > F.col("_size") - part)
    return ranked.where(inside | (F.col("_size") <= n)).drop("_rank", "_size")

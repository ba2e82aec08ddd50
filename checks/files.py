"""Reports, documents and runs over the scans."""

from pyspark.sql import functions as F

from checks.base import hot, query, scans, when
from checks.detection import findings
from checks.items import item_findings
from checks.models import CHANCE, scored
from scanwarden import constants as C
from scanwarden.plans import pipelines, registry
from scanwarden.sources import findings_log as log
from scanwarden.sources import scan_files
from scanwarden.sources.table_scans import as_of


@query("A4_clean_scans", """
SELECT event_id FROM scans WHERE scan_location IS NOT NULL AND event_type IS NOT NULL AND length(epc_code) > 10""")
def _(spark, d):
    return scan_files.clean_scans(scans(spark, d)).select("event_id")


@query("A6_events_from_scans", """
SELECT source_file, epc_code, row_number() OVER (PARTITION BY source_file ORDER BY epc_code NULLS FIRST, event_time NULLS FIRST,
  location_id NULLS FIRST, business_step NULLS FIRST, event_type NULLS FIRST) AS event_id FROM scans""")
def _(spark, d):
    return scan_files.events_from_scans(scans(spark, d)).select("source_file", "epc_code", "event_id")


@query("A8_run_summary", """
SELECT (SELECT count(*) FROM scans) AS input_events, (SELECT count(*) FROM (SELECT DISTINCT file_id, epc_code FROM scans)) AS items, count(*) AS findings,
  count(*) FILTER (f_fake) AS "epcFake", count(*) FILTER (f_dup) AS "epcDup", count(*) FILTER (f_loc) AS "locErr", count(*) FILTER (f_ord) AS "evtOrderErr",
  CAST(0 AS BIGINT) AS jump, round(count(*)/(SELECT count(*) FROM scans), 6) AS rate, 'run' AS run_id FROM findings""", "dated prev found")
def _(spark, d):
    df = log.run_summary(findings(spark, d), scans(spark, d), "run", as_of())
    return df.withColumn("rate", F.round("rate", 6)).drop("run_ts")


@query("A10_to_response_json", """
SELECT file_id, count(*) AS events, count(DISTINCT epc_code) AS items FROM findings GROUP BY 1""", "dated prev found")
def _(spark, d):
    docs = log.to_response_json(findings(spark, d), 500)
    shape = "EventHistory array<struct<eventId:bigint>>, epcAnomalyStats array<struct<epcCode:string>>"
    parsed = docs.select("file_id", F.from_json("document", shape).alias("p"))
    return parsed.groupBy("file_id").agg(
        F.sum(F.size(F.coalesce("p.EventHistory", F.array().cast("array<struct<eventId:bigint>>"))).cast("long")).alias("events"),
        F.sum(F.size(F.coalesce("p.epcAnomalyStats", F.array().cast("array<struct<epcCode:string>>"))).cast("long")).alias("items"))


@query("A15_split_anomalous_normal", """
SELECT event_id, f_fake AS "epcFake_detected", f_dup AS "epcDup_detected" FROM findings""", "dated prev found")
def _(spark, d):
    return log.split_anomalous_normal(scans(spark, d), findings(spark, d))[0].select("event_id", "epcFake_detected", "epcDup_detected")


@query("A16_scored_report", f"""
, p AS (SELECT event_id, {', '.join(f'{c} AS s{i}' for i, c in enumerate(CHANCE.values()))} FROM scans)
SELECT event_id, {' + '.join(f'(s{i} > 0.5)::INT' for i in range(5))} AS anomaly_count, greatest(s0, s1, s2, s3, s4) AS max_score, greatest(s0, s1, s2, s3, s4) > 0.5 AS any_anomaly FROM p""")
def _(spark, d):
    df = scored(spark, d).withColumnsRenamed({f"{t}_probability": f"{t}_score" for t in C.STATS_TYPES})
    return log.scored_report(df).select("event_id", "anomaly_count", "max_score", "any_anomaly")


@query("A17_file_inventory", "SELECT source_file, count(*) AS \"rows\", count(DISTINCT epc_code) AS items, 15 AS columns FROM scans GROUP BY 1")
def _(spark, d):
    return scan_files.file_inventory(scans(spark, d))


@query("A18_report_detail", """
SELECT file_id, epc_code, types AS "anomalyTypes", CAST(spot + 1 AS INTEGER) AS "sequencePosition", problem AS "problemStep",
  CASE WHEN contains(problem, '_to_') THEN 'route' WHEN contains(problem, 'issue') THEN 'timing' WHEN contains(problem, 'Format') THEN 'format'
  WHEN contains(problem, 'Duplicate') THEN 'duplicate' ELSE '' END AS problems FROM items""", "dated norm jumps runs_norm dups items")
def _(spark, d):
    df = log.report_detail(item_findings(spark, d))
    return df.select("file_id", "epc_code", F.concat_ws(",", "anomalyTypes").alias("anomalyTypes"), "sequencePosition", "problemStep",
                     F.concat_ws(",", "sequenceProblems").alias("problems"))


@query("S7_head_middle_tail", """
, r AS (SELECT event_id, row_number() OVER (PARTITION BY source_file ORDER BY event_id) AS k, count(*) OVER (PARTITION BY source_file) AS n FROM scans)
SELECT event_id FROM r WHERE k <= 100 OR k BETWEEN n // 2 - 50 + 1 AND n // 2 - 50 + 100 OR k > n - 100""")
def _(spark, d):
    return log.head_middle_tail(scans(spark, d), 300).select("event_id")


@query("U5_sql_functions", "SELECT event_id, fake AS score, lv AS step FROM prev", "dated prev")
def _(spark, d):
    registry.register_sql_functions(spark)
    scans(spark, d).createOrReplaceTempView("scan_rows")
    return spark.sql("""SELECT event_id, epc_fake_score(epc_code, TIMESTAMP '2000-07-01 00:00:00') AS score, step_level(business_step) AS step FROM scan_rows""")


@query("U1_registered_extractors", "SELECT file_id, epc_code, count(*)::DOUBLE AS event_count FROM scans GROUP BY ALL")
def _(spark, d):
    return registry.item_features("epcDup", scans(spark, d), hot=hot(spark, d)).select("file_id", "epc_code", "event_count")


@query("plan_prepare_sequences")
def _(spark, d):
    df = pipelines.prepare_sequences(scans(spark, d), ["time_gap_log", "hour_sin", "location_entropy"], hot=hot(spark, d), least=3)
    return df.select("event_id", "split", "sequence_length")

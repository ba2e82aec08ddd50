"""Event-level rules and their roll-ups."""

from pyspark.sql import functions as F

from checks.base import hot, query, scans, when
from scanwarden.operators import detect_events as det
from scanwarden.sources.table_scans import as_of

STATS_COLUMNS = """CAST(count(*) FILTER (f_fake) AS BIGINT) AS "epcFakeCount",
  CAST(count(*) FILTER (f_dup) AS BIGINT) AS "epcDupCount", CAST(count(*) FILTER (f_loc) AS BIGINT) AS "locErrCount",
  CAST(count(*) FILTER (f_ord) AS BIGINT) AS "evtOrderErrCount", CAST(0 AS BIGINT) AS "jumpCount",
  CAST(count(*) FILTER (f_fake) + count(*) FILTER (f_dup) + count(*) FILTER (f_loc) + count(*) FILTER (f_ord) AS BIGINT)
  AS "totalEvents" """


def findings(spark, d, **options):
    return det.detect_events(scans(spark, d), as_of(), hot=hot(spark, d), **options)


@query("E6_event_order_error", "SELECT event_id, ord AS \"evtOrderErr\" FROM found", "dated prev found")
def _(spark, d):
    return det.event_order_error(scans(spark, d), hot=hot(spark, d)).select("event_id", "evtOrderErr")


@query("E7_event_duplicate", "SELECT event_id, dup AS \"epcDup\" FROM found", "dated prev found")
def _(spark, d):
    return det.event_duplicate(scans(spark, d), hot=hot(spark, d)).select("event_id", "epcDup")


@query("E8_event_location_error", "SELECT event_id, loc AS \"locErr\" FROM found", "dated prev found")
def _(spark, d):
    return det.event_location_error(scans(spark, d), hot=hot(spark, d)).select("event_id", "locErr")


@query("E9_detect_events", """
SELECT file_id, epc_code, event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time,
  CASE WHEN f_fake THEN true END AS "epcFake", CASE WHEN f_dup THEN true END AS "epcDup",
  CASE WHEN f_loc THEN true END AS "locErr", CASE WHEN f_ord THEN true END AS "evtOrderErr",
  CASE WHEN f_fake THEN CAST(fake AS DOUBLE) END AS "epcFakeScore", CASE WHEN f_dup THEN 90.0::DOUBLE END AS "epcDupScore",
  CASE WHEN f_loc THEN 30.0::DOUBLE END AS "locErrScore", CASE WHEN f_ord THEN 25.0::DOUBLE END AS "evtOrderErrScore"
FROM findings""", "dated prev found")
def _(spark, d):
    return findings(spark, d).drop("jump", "jumpScore").withColumn("event_time", when())


@query("D1_epc_stats", f"SELECT file_id, epc_code, {STATS_COLUMNS} FROM findings GROUP BY ALL", "dated prev found")
def _(spark, d):
    return det.epc_stats(findings(spark, d))


@query("D2_file_stats", f"SELECT file_id, {STATS_COLUMNS} FROM findings GROUP BY ALL", "dated prev found")
def _(spark, d):
    return det.file_stats(findings(spark, d))


@query("D1_D2_rollup_stats", f"""
SELECT file_id, epc_code, CAST(0 AS BIGINT) AS level, {STATS_COLUMNS} FROM findings GROUP BY ALL
UNION ALL SELECT file_id, NULL, CAST(1 AS BIGINT), {STATS_COLUMNS} FROM findings GROUP BY ALL""", "dated prev found")
def _(spark, d):
    return det.rollup_stats(findings(spark, d))


def flagship(spark, d):
    """Rule detection over all scans, rolled up per file."""
    return det.file_stats(findings(spark, d)).orderBy("file_id")

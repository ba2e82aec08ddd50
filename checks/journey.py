"""Columns from neighbouring events."""

from pyspark.sql import functions as F

from checks.base import W, hot, query, scans, step_sql, when
from checks.base import SHARED
from scanwarden.operators import windows as win

SHARED["gaps"] = f"""
gaps AS (SELECT *, (epoch_us(event_time) - epoch_us(lag(event_time) OVER {W}))/1e6 AS gap0,
  coalesce((epoch_us(event_time) - epoch_us(lag(event_time) OVER {W}))/1e6, 0) AS gap FROM scans)"""


def rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("E10_time_gap", "SELECT event_id, gap AS time_gap_seconds FROM gaps", "gaps")
def _(spark, d):
    return win.time_gap(scans(spark, d), hot=hot(spark, d)).select("event_id", "time_gap_seconds")


@query("E11_gap_zscore", """
SELECT event_id, round(CASE WHEN stddev_samp(gap) OVER p > 0 THEN (gap - avg(gap) OVER p)/stddev_samp(gap) OVER p ELSE 0 END, 4) AS time_gap_zscore
FROM gaps WINDOW p AS (PARTITION BY file_id, epc_code)""", "gaps")
def _(spark, d):
    return rounded(win.gap_zscore(scans(spark, d), hot=hot(spark, d)), "time_gap_zscore").select("event_id", "time_gap_zscore")


@query("E12_rolling_gap", """
SELECT event_id, round(avg(gap) OVER p, 4) AS gap_mean_recent, round(coalesce(stddev_samp(gap) OVER p, 0), 4) AS gap_std_recent
FROM gaps WINDOW p AS (PARTITION BY file_id, epc_code ORDER BY event_time, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""", "gaps")
def _(spark, d):
    df = win.rolling_gap(scans(spark, d), hot=hot(spark, d))
    return rounded(df, "gap_mean_recent", "gap_std_recent").select("event_id", "gap_mean_recent", "gap_std_recent")


@query("E13_location_moves", f"""
SELECT event_id, lag(location_id) OVER w AS prev_location_id, lead(location_id) OVER w AS next_location_id,
  CAST(location_id IS DISTINCT FROM lag(location_id) OVER w AS INTEGER) AS location_changed,
  CAST(coalesce(location_id = lag(location_id, 2) OVER w AND location_id <> lag(location_id) OVER w, false) AS INTEGER) AS location_backtrack,
  coalesce(abs(location_id - lag(location_id) OVER w), 0) AS location_distance_proxy
FROM scans WINDOW w AS {W}""")
def _(spark, d):
    return win.location_moves(scans(spark, d), hot=hot(spark, d)).select(
        "event_id", "prev_location_id", "next_location_id", "location_changed", "location_backtrack", "location_distance_proxy")


@query("E14_step_moves", f"""
SELECT event_id, lv AS business_step_numeric, CAST(coalesce(lv < p, false) AS INTEGER) AS business_step_regression,
  CAST(coalesce(lv - p > 1, false) AS INTEGER) AS business_step_skip, coalesce(lv - p, 0) AS business_step_advancement
FROM (SELECT *, {step_sql('business_step')} AS lv, lag({step_sql('business_step')}) OVER {W} AS p FROM scans)""")
def _(spark, d):
    return win.step_moves(scans(spark, d), hot=hot(spark, d)).select(
        "event_id", "business_step_numeric", "business_step_regression", "business_step_skip", "business_step_advancement")


@query("E15_scan_position", f"""
SELECT event_id, row_number() OVER {W} AS scan_position, count(*) OVER p AS total_scans,
  round(row_number() OVER {W} / count(*) OVER p, 6) AS scan_progress, CAST(row_number() OVER {W} = 1 AS INTEGER) AS is_first_scan
FROM scans WINDOW p AS (PARTITION BY file_id, epc_code)""")
def _(spark, d):
    df = win.scan_position(scans(spark, d), hot=hot(spark, d))
    return rounded(df, "scan_progress", digits=6).select("event_id", "scan_position", "total_scans", "scan_progress", "is_first_scan")


@query("E16_events_per_period", """
SELECT event_id, count(*) OVER (PARTITION BY file_id, epc_code, date_trunc('hour', event_time)) AS events_per_hour,
  count(*) OVER (PARTITION BY file_id, epc_code, date_trunc('day', event_time)) AS events_per_day FROM scans""")
def _(spark, d):
    return win.events_per_period(scans(spark, d)).select("event_id", "events_per_hour", "events_per_day")


@query("E17_scans_per_location", """
SELECT event_id, n AS scans_per_location, CAST(n > 1 AS INTEGER) AS repeated_location FROM
  (SELECT event_id, count(*) OVER (PARTITION BY file_id, epc_code, location_id) AS n FROM scans)""")
def _(spark, d):
    return win.scans_per_location(scans(spark, d)).select("event_id", "scans_per_location", "repeated_location")


@query("E18_unusual_gap", """
, q AS (SELECT quantile_cont(gap0, 0.05) AS lo, quantile_cont(gap0, 0.95) AS hi FROM gaps)
SELECT event_id, CAST(coalesce(gap0 > hi OR gap0 < lo, false) AS INTEGER) AS unusual_time_gap FROM gaps, q""", "gaps")
def _(spark, d):
    return win.unusual_gap(scans(spark, d), hot=hot(spark, d)).select("event_id", "unusual_time_gap")


@query("E18_iqr_outlier", """
, q AS (SELECT quantile_cont(operator_id, 0.25) AS a, quantile_cont(operator_id, 0.75) AS b FROM scans)
SELECT event_id, CAST(operator_id < a - 0.1*(b-a) OR operator_id > b + 0.1*(b-a) AS INTEGER) AS operator_id_outlier FROM scans, q""")
def _(spark, d):
    return win.iqr_outlier(scans(spark, d), "operator_id", 0.1).select("event_id", "operator_id_outlier")


@query("E19_location_cluster", """
, q AS (SELECT quantile_cont(location_id, [0.2, 0.4, 0.6, 0.8]) AS e FROM scans)
SELECT event_id, 'Cluster_' || CASE WHEN location_id <= e[1] THEN 1 WHEN location_id <= e[2] THEN 2 WHEN location_id <= e[3] THEN 3
  WHEN location_id <= e[4] THEN 4 ELSE 5 END AS location_cluster FROM scans, q""")
def _(spark, d):
    return win.location_cluster(scans(spark, d)).select("event_id", "location_cluster")


@query("E20_gap_skewness", """
, c AS (SELECT file_id, epc_code, gap - avg(gap) OVER (PARTITION BY file_id, epc_code) AS dv FROM gaps)
SELECT file_id, epc_code, round(CASE WHEN count(*) > 2 AND sum(dv*dv) > 0
  THEN (sum(dv*dv*dv)/count(*)) / pow(sum(dv*dv)/count(*), 1.5) ELSE 0 END, 4) AS gap_skewness FROM c GROUP BY ALL""", "gaps")
def _(spark, d):
    return rounded(win.gap_skewness(scans(spark, d), hot=hot(spark, d)), "gap_skewness")


def with_holes(spark, d):
    """Scans without a time where the place is missing."""
    known = F.col("scan_location").isNotNull()
    return scans(spark, d).withColumn("event_time", F.when(known, F.col("event_time")))


HOLES = "holes AS (SELECT file_id, epc_code, event_id, CASE WHEN scan_location IS NOT NULL THEN event_time END AS t FROM scans)"
SHARED["holes"] = HOLES


@query("E21_fill_time", """
SELECT event_id, strftime(coalesce(t, last_value(t IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  first_value(t IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), '%Y-%m-%d %H:%M:%S') AS event_time_filled
FROM holes WINDOW w AS (PARTITION BY file_id, epc_code ORDER BY event_id)""", "holes")
def _(spark, d):
    df = win.fill_time(with_holes(spark, d), hot=hot(spark, d))
    return df.select("event_id", when("event_time_filled").alias("event_time_filled"))


@query("E22_interpolate_time", """
, n AS (SELECT *, row_number() OVER w AS p FROM holes WINDOW w AS (PARTITION BY file_id, epc_code ORDER BY event_id)),
k AS (SELECT *, last_value(CASE WHEN t IS NOT NULL THEN {'t': epoch_us(t), 'p': p} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(CASE WHEN t IS NOT NULL THEN {'t': epoch_us(t), 'p': p} END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b
  FROM n WINDOW w AS (PARTITION BY file_id, epc_code ORDER BY event_id))
SELECT event_id, CASE WHEN t IS NOT NULL THEN epoch_us(t) ELSE a.t + CAST(round((p - a.p)/(b.p - a.p)*(b.t - a.t)) AS BIGINT) END AS micros FROM k""", "holes")
def _(spark, d):
    df = win.interpolate_time(with_holes(spark, d), hot=hot(spark, d))
    return df.select("event_id", F.unix_micros("event_time_interpolated").alias("micros"))


@query("E23_backward_steps", f"""
, l AS (SELECT *, CASE WHEN location_id % 7 <> 0 THEN {step_sql('business_step')} END AS lv FROM scans),
k AS (SELECT event_id, lv, last_value(lv IGNORE NULLS) OVER (PARTITION BY file_id, epc_code ORDER BY event_time, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM l)
SELECT event_id, lv AS step, known AS last_known_step FROM k WHERE lv < known""")
def _(spark, d):
    df = scans(spark, d).withColumn("business_step", F.when(F.col("location_id") % 7 != 0, F.col("business_step")))
    return win.backward_steps(df, hot=hot(spark, d)).select("event_id", "step", "last_known_step")


@query("E24_hub_type_changed", f"""
SELECT event_id, CAST(hub_type IS DISTINCT FROM lag(hub_type) OVER {W} AS INTEGER) AS hub_type_changed FROM scans""")
def _(spark, d):
    return win.hub_type_changed(scans(spark, d), hot=hot(spark, d)).select("event_id", "hub_type_changed")


@query("E26_ordering_violations", """
, v AS (SELECT file_id, epc_code, event_time < lag(event_time) OVER (PARTITION BY file_id, epc_code ORDER BY event_id) AS b FROM scans)
SELECT file_id, epc_code, count(*) AS violations FROM v WHERE b GROUP BY ALL""")
def _(spark, d):
    return win.ordering_violations(scans(spark, d), hot=hot(spark, d))


@query("E27_near_duplicate_scans", f"""
, v AS (SELECT file_id, epc_code, count(*) OVER (PARTITION BY file_id, epc_code, scan_location, event_type) AS n,
  coalesce(epoch_us(event_time) - epoch_us(lag(event_time) OVER {W}) < 60000000 AND scan_location = lag(scan_location) OVER {W}, false) AS near FROM scans)
SELECT file_id, epc_code, count(*) FILTER (n > 1) AS exact_duplicates, count(*) FILTER (near) AS temporal_duplicates,
  count(*) AS total_events, round(count(*) FILTER (n > 1) / count(*), 6) AS duplicate_ratio FROM v GROUP BY ALL""")
def _(spark, d):
    return rounded(win.near_duplicate_scans(scans(spark, d), hot=hot(spark, d)), "duplicate_ratio", digits=6)


ALLOWED = [("공장", "Factory"), ("factory", "Factory"), ("창고", "WMS"), ("logistics", "WMS"), ("도매상", "Wholesaler"),
           ("wholesale", "Wholesaler"), ("소매상", "Retailer")]


@query("E28_T3_cross_field_conflicts", f"""
, pairs AS (SELECT split_part(scan_location, '_', 1) AS hub, business_step AS step, count(*) AS events FROM scans GROUP BY ALL)
SELECT 'before_manufacture' AS conflict, NULL::VARCHAR AS hub, NULL::VARCHAR AS step, count(*) AS events FROM scans
  WHERE event_time < manufacture_date HAVING count(*) > 0
UNION ALL SELECT 'hub_step', hub, step, events FROM pairs WHERE NOT EXISTS (SELECT 1 FROM (VALUES
  {', '.join(str(p) for p in ALLOWED)}) a(h, s) WHERE a.h = hub AND a.s = step)""")
def _(spark, d):
    return win.cross_field_conflicts(scans(spark, d), ALLOWED, F.substring_index("scan_location", "_", 1))

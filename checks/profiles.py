"""Profiles and aggregates."""

from pyspark.sql import functions as F

from checks.base import AS_OF_SQL, SHARED, W, hot, level_sql, query, scans, when
from checks.detection import findings
from checks.items import item_findings, norm
from checks.journey import rounded
from scanwarden import constants as C
from scanwarden.operators import detect_epc as det
from scanwarden.operators import profile as pro
from scanwarden.operators import windows as win
from scanwarden.sources.table_scans import as_of

TYPES = C.ANOMALY_TYPES
NAMES = dict(zip(TYPES, ("fake", "d", "jmp", "o", "l")))
SHARED["type_scores"] = "type_scores AS (" + " UNION ALL ".join(
    f"SELECT file_id, epc_code, 'file_' || file_id AS dataset, '{t}' AS anomaly_type, {c} AS score FROM item0" for t, c in NAMES.items()) + ")"
SCORES = "dated norm jumps runs_norm dups items type_scores"


def type_scores(spark, d):
    """All five scores of all items, one row per item and type."""
    wide = item_findings(spark, d, only_findings=False)
    rows = wide.unpivot(["file_id", "epc_code"], list(TYPES), "anomaly_type", "score")
    return rows.withColumn("dataset", F.concat(F.lit("file_"), F.col("file_id").cast("string")))


@query("D4_score_stats", """
SELECT dataset, anomaly_type, count(*) AS samples, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
  min(score)::DOUBLE AS min, max(score)::DOUBLE AS max, count(*) FILTER (score > 0) AS non_zero_count,
  round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.95), 6) AS p95,
  round(quantile_cont(score, 0.99), 6) AS p99, round(quantile_cont(score, 0.999), 6) AS p999,
  round(count(*) FILTER (score > 0) / count(*), 6) AS non_zero_rate FROM type_scores GROUP BY ALL""", SCORES)
def _(spark, d):
    return rounded(pro.score_stats(type_scores(spark, d)), "mean", "std", "p50", "p90", "p95", "p99", "p999", "non_zero_rate", digits=6)


@query("D5_label_distribution", """
SELECT anomaly_type, count(*) AS total, count(*) FILTER (score >= 50) AS positives, count(*) FILTER (score < 50) AS negatives,
  round(avg(score) FILTER (score >= 50), 6) AS positive_score_mean, round(avg(score) FILTER (score < 50), 6) AS negative_score_mean,
  min(score) FILTER (score >= 50)::DOUBLE AS positive_score_min, max(score) FILTER (score < 50)::DOUBLE AS negative_score_max,
  round(count(*) FILTER (score >= 50) / count(*), 6) AS positive_ratio,
  round(count(*) FILTER (score < 50) / nullif(count(*) FILTER (score >= 50), 0), 6) AS imbalance_ratio
FROM type_scores GROUP BY ALL""", SCORES)
def _(spark, d):
    rows = type_scores(spark, d).withColumn("label", (F.col("score") >= C.LABEL_THRESHOLD).cast("int"))
    return rounded(pro.label_distribution(rows), "positive_score_mean", "negative_score_mean", "positive_ratio", "imbalance_ratio", digits=6)


@query("D6_threshold_sweep", """
SELECT anomaly_type, t::DOUBLE AS threshold, count(*) FILTER (score >= t) AS positives,
  round(count(*) FILTER (score >= t) / count(*), 6) AS positive_ratio FROM type_scores, (SELECT unnest(range(10, 100, 10)) AS t) GROUP BY ALL""", SCORES)
def _(spark, d):
    return rounded(pro.threshold_sweep(type_scores(spark, d), range(10, 100, 10)), "positive_ratio", digits=6)


@query("D7_epc_corpus_stats", """
SELECT count(*) AS epcs, CAST(sum(n) AS BIGINT) AS events, round(avg(n), 6) AS avg_events, max(n) AS max_events, count(*) FILTER (n = 1) AS single_event_epcs
FROM (SELECT count(*) AS n FROM scans GROUP BY epc_code)""")
def _(spark, d):
    return rounded(pro.epc_corpus_stats(scans(spark, d)), "avg_events", digits=6)


PROFILED = ["epc_code", "business_step", "event_type", "scan_location", "location_id", "device_id"]
KINDS = {"location_id": "int", "device_id": "int"}


@query("D8_column_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values,
  round(100.0*(count(*) - count({c}))/count(*), 6)::DOUBLE AS null_percent, '{KINDS.get(c, 'string')}' AS type FROM scans""" for c in PROFILED))
def _(spark, d):
    return rounded(pro.column_profile(scans(spark, d), PROFILED), "null_percent", digits=6)


@query("D9_missing_by_column", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round(100.0*(count(*) - count({c}))/count(*), 6)::DOUBLE AS missing_percent FROM scans"
    for c in PROFILED))
def _(spark, d):
    return rounded(pro.missing_by_column(scans(spark, d), PROFILED), "missing_percent", digits=6)


@query("D9_missing_by_source", " UNION ALL ".join(
    f"SELECT source_file, '{c}' AS \"column\", count(*) - count({c}) AS missing, round(100.0*(count(*) - count({c}))/count(*), 6)::DOUBLE AS missing_percent FROM scans GROUP BY source_file"
    for c in PROFILED))
def _(spark, d):
    return rounded(pro.missing_by_source(scans(spark, d), PROFILED), "missing_percent", digits=6)


def gappy(spark, d):
    return scans(spark, d).withColumn("device_id", F.when(F.col("device_id") > 3, F.col("device_id"))).withColumn(
        "event_type", F.when(F.col("device_id") % 2 == 0, F.col("event_type")))


GAPPY = """gappy AS (SELECT scan_location, CASE WHEN device_id > 3 THEN device_id END AS device_id,
  CASE WHEN (CASE WHEN device_id > 3 THEN device_id END) % 2 = 0 THEN event_type END AS event_type FROM scans)"""
SHARED["gappy"] = GAPPY


@query("D10_missing_patterns", """
SELECT concat(CASE WHEN scan_location IS NULL THEN '1' ELSE '0' END, CASE WHEN device_id IS NULL THEN '1' ELSE '0' END,
  CASE WHEN event_type IS NULL THEN '1' ELSE '0' END) AS pattern, count(*) AS "rows" FROM gappy GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 10""", "gappy")
def _(spark, d):
    return pro.missing_patterns(gappy(spark, d), ["scan_location", "device_id", "event_type"])


def _corr(a, b):
    return f"SELECT '{a}' AS first, '{b}' AS second, round(corr(CAST({a} IS NULL AS DOUBLE), CAST({b} IS NULL AS DOUBLE)), 6) AS correlation FROM gappy"


@query("D10_missing_correlation", " UNION ALL ".join(
    [_corr("scan_location", "device_id"), _corr("scan_location", "event_type"), _corr("device_id", "event_type")]), "gappy")
def _(spark, d):
    return rounded(pro.missing_correlation(gappy(spark, d), ["scan_location", "device_id", "event_type"]), "correlation", digits=6)


QUALITY_COLUMNS = ["epc_code", "event_time", "event_type", "business_step", "location_id", "scan_location"]


@query("D11_quality_scores", f"""
, s AS (SELECT count(*) AS n, count(*) FILTER (epc_code IS NULL OR NOT regexp_full_match(epc_code, '[0-9]{{3}}\\.[0-9]{{7}}\\.[0-9]{{7}}\\.[0-9]{{6}}\\.[0-9]{{8}}\\.[0-9]{{9}}')) AS b0,
   count(*) FILTER (event_time IS NULL) AS b1, count(*) FILTER (location_id IS NULL OR location_id < 0) AS b2,
   count(*) FILTER (business_step NOT IN ('Factory','WMS','Logistics_HUB','Distribution','Retail','Customer')) AS b3,
   sum((event_type IS NULL)::INT + (scan_location IS NULL)::INT) AS missing, count(*) FILTER (event_time > {AS_OF_SQL}) AS late FROM scans),
g AS (SELECT count(*) FILTER (gap0 > 86400*365) AS long_gaps FROM gaps),
u AS (SELECT sum(k - 1) AS copies FROM (SELECT count(*) AS k FROM scans GROUP BY {', '.join(QUALITY_COLUMNS)})),
q AS (SELECT n AS "rows", 100.0*(1 - missing/(n*6)) AS completeness, 100.0*(4 - (b0>0)::INT - (b1>0)::INT - (b2>0)::INT - (b3>0)::INT)/4 AS consistency,
   100.0*(2 - (late > n*0.8)::INT - (long_gaps > 0)::INT)/2 AS validity, 100.0*(1 - copies/n) AS uniqueness FROM s, g, u)
SELECT "rows", round(completeness::DOUBLE, 6) AS completeness, round(consistency::DOUBLE, 6) AS consistency, round(validity::DOUBLE, 6) AS validity,
  round(uniqueness::DOUBLE, 6) AS uniqueness, round(((completeness + consistency + validity + uniqueness)/4)::DOUBLE, 6) AS overall FROM q""", "gaps")
def _(spark, d):
    df = pro.quality_scores(scans(spark, d), as_of(), QUALITY_COLUMNS, hot=hot(spark, d))
    return rounded(df, "completeness", "consistency", "validity", "uniqueness", "overall", digits=6)


@query("D12_quality_issues", f"""
, i AS (SELECT 'invalid_epc' AS issue, count(*) FILTER (NOT regexp_full_match(epc_code, '[0-9]{{3}}\\.[0-9]{{7}}\\.[0-9]{{7}}\\.[0-9]{{6}}\\.[0-9]{{8}}\\.[0-9]{{9}}')) AS "rows" FROM scans
UNION ALL SELECT 'future_event', count(*) FILTER (event_time > {AS_OF_SQL}) FROM scans
UNION ALL SELECT 'negative_location', count(*) FILTER (location_id < 0) FROM scans
UNION ALL SELECT 'duplicate_row', CAST(sum(k - 1) AS BIGINT) FROM (SELECT count(*) AS k FROM scans GROUP BY {', '.join(QUALITY_COLUMNS)}))
SELECT * FROM i WHERE "rows" > 0""")
def _(spark, d):
    return pro.quality_issues(scans(spark, d), as_of(), QUALITY_COLUMNS)


NUMERIC = ["location_id", "device_id", "operator_id"]


def _moments(c):
    return f"""SELECT '{c}' AS "column", count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
  round(avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5), 6) AS skewness, round(avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3, 6) AS kurtosis,
  count(DISTINCT x) AS distinct_values, quantile_cont(x, 0.5)::DOUBLE AS median, false AS is_normal
  FROM (SELECT {c}::DOUBLE AS x, avg({c}) OVER () AS m FROM scans)"""


@query("D13_moments", " UNION ALL ".join(_moments(c) for c in NUMERIC))
def _(spark, d):
    return rounded(pro.moments(scans(spark, d), NUMERIC), "mean", "std", "skewness", "kurtosis", digits=6)


@query("D14_distribution_check", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", a AS q25, b AS q75, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  count(*) FILTER ({c} < a - 1.5*(b-a) OR {c} > b + 1.5*(b-a)) AS outliers
FROM scans, (SELECT quantile_cont({c}, 0.25)::DOUBLE AS a, quantile_cont({c}, 0.75)::DOUBLE AS b FROM scans) GROUP BY a, b""" for c in NUMERIC))
def _(spark, d):
    return rounded(pro.distribution_check(scans(spark, d), NUMERIC), "mean", "std", digits=6)


@query("D15_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS first, '{b}' AS second, round(corr({a}, {b}), 6) AS correlation FROM scans"
    for a, b in (("location_id", "device_id"), ("location_id", "operator_id"), ("device_id", "operator_id"))))
def _(spark, d):
    return rounded(pro.correlation_pairs(scans(spark, d), NUMERIC), "correlation", digits=6)


@query("D15_high_corr_pairs", """
SELECT 'location_id' AS first, 'latitude' AS second, round(corr(location_id, latitude), 6) AS correlation FROM scans HAVING abs(corr(location_id, latitude)) > 0.01
UNION ALL SELECT 'location_id', 'longitude', round(corr(location_id, longitude), 6) FROM scans HAVING abs(corr(location_id, longitude)) > 0.01
UNION ALL SELECT 'latitude', 'longitude', round(corr(latitude, longitude), 6) FROM scans HAVING abs(corr(latitude, longitude)) > 0.01""")
def _(spark, d):
    return rounded(pro.high_corr_pairs(scans(spark, d), ["location_id", "latitude", "longitude"], 0.01), "correlation", digits=6)


@query("D16_temporal_counts", """
SELECT source_file, 'hour' AS period, CAST(hour(event_time) AS VARCHAR) AS value, count(*) AS events FROM scans GROUP BY ALL
UNION ALL SELECT source_file, 'weekday', CAST(isodow(event_time) - 1 AS VARCHAR), count(*) FROM scans GROUP BY ALL
UNION ALL SELECT source_file, 'date', strftime(event_time, '%Y-%m-%d'), count(*) FROM scans GROUP BY ALL
UNION ALL SELECT source_file, 'month', strftime(event_time, '%Y-%m'), count(*) FROM scans GROUP BY ALL""")
def _(spark, d):
    return pro.temporal_counts(scans(spark, d))


@query("D16_temporal_summary", f"""
, h AS (SELECT count(*) AS n, min(event_time) AS lo, max(event_time) AS hi, count(*) FILTER (event_time > {AS_OF_SQL}) AS late FROM scans GROUP BY hour(event_time))
SELECT round(stddev_samp(n)/avg(n), 6) AS hourly_variation, CAST(floor((epoch_us(max(hi)) - epoch_us(min(lo)))/8.64e10) AS BIGINT) AS span_days,
  round((100.0*sum(late)/sum(n))::DOUBLE, 6) AS future_percent FROM h""")
def _(spark, d):
    return rounded(pro.temporal_summary(scans(spark, d), as_of()), "hourly_variation", "future_percent", digits=6)


@query("D17_top_values", "SELECT scan_location AS value, count(*) AS \"rows\" FROM scans GROUP BY ALL ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 10")
def _(spark, d):
    return pro.top_values(scans(spark, d), "scan_location")


@query("D17_nunique_by_source", " UNION ALL ".join(
    f"SELECT source_file, '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM scans GROUP BY source_file" for c in PROFILED))
def _(spark, d):
    return pro.nunique_by_source(scans(spark, d), PROFILED)


@query("D17_mode", " UNION ALL ".join(
    f"(SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS mode FROM scans WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)"
    for c in ("business_step", "event_type", "location_id")))
def _(spark, d):
    return pro.modes(scans(spark, d), ["business_step", "event_type", "location_id"])


ENTROPY_SQL = {
    "plain": ("p*log2(p)", "-sum(t)"), "normalized": ("p*log2(p)", "CASE WHEN any_value(k) > 1 THEN -sum(t)/log2(any_value(k)) ELSE -sum(t) END"),
    "guarded": ("p*log2(p + 1e-10)", "CASE WHEN any_value(total) <= 1 THEN 0 ELSE -sum(t) END"),
    "smoothed": ("((p+0.01)/(1+0.01*k))*log2((p+0.01)/(1+0.01*k))", "CASE WHEN any_value(total) < 3 THEN 0 ELSE -sum(t) END"),
    "jeffreys": ("((p+0.5)/(1.5*k))*log2((p+0.5)/(1.5*k))", "CASE WHEN any_value(total) < 3 THEN 0 ELSE -sum(t) END"),
    "similarity": ("p*log2(p + 1e-8)", "CASE WHEN any_value(k) <= 1 THEN 0 ELSE -sum(t) END"),
}


def entropy_sql(term, final, column="location_id"):
    return f"""(SELECT file_id, epc_code, {final} + 0 AS e FROM (SELECT *, {term} AS t FROM (
  SELECT *, n/total AS p FROM (SELECT file_id, epc_code, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY file_id, epc_code) AS total,
    count(*) OVER (PARTITION BY file_id, epc_code) AS k FROM scans GROUP BY file_id, epc_code, {column}))) GROUP BY file_id, epc_code)"""


for _v, (_t, _f) in ENTROPY_SQL.items():
    @query(f"D20_entropy_{_v}", f"SELECT file_id, epc_code, round(CAST(e AS DOUBLE), 5) + 0 AS location_id_entropy FROM {entropy_sql(_t, _f)}")
    def _(spark, d, v=_v):
        return rounded(pro.entropy(scans(spark, d), "location_id", v, hot=hot(spark, d)), "location_id_entropy", digits=5)


@query("D21_epc_behaviour", """
SELECT file_id, epc_code, count(*) AS scans, round(avg(gap), 4) AS gap_mean, round(coalesce(stddev_samp(gap), 0), 4) AS gap_std, min(gap) AS gap_min,
  max(gap) AS gap_max, round(avg(location_id), 4) AS location_mean, round(coalesce(stddev_samp(location_id), 0), 4) AS location_std,
  count(DISTINCT location_id) AS locations, count(DISTINCT business_step) AS steps, count(DISTINCT operator_id) AS operators,
  count(DISTINCT device_id) AS devices, round(count(DISTINCT location_id)/count(*), 4) AS location_ratio,
  round(count(DISTINCT operator_id)/count(*), 4) AS operator_ratio,
  round(CASE WHEN avg(gap) > 0 THEN coalesce(stddev_samp(gap), 0)/avg(gap) ELSE 0 END, 4) AS gap_cv FROM gaps GROUP BY ALL""", "gaps")
def _(spark, d):
    df = pro.epc_behaviour(scans(spark, d), hot=hot(spark, d))
    return rounded(df, "gap_mean", "gap_std", "location_mean", "location_std", "location_ratio", "operator_ratio", "gap_cv")


@query("D22_epc_profile", f"""
SELECT file_id, epc_code, count(*) AS total_scans, round(greatest((epoch_us(max(event_time)) - epoch_us(min(event_time)))/3.6e9, 0.1), 5) AS scan_duration_hours,
  round(avg((hour(event_time) BETWEEN 8 AND 18)::INT), 5) AS business_hour_rate, round(avg((isodow(event_time) >= 6)::INT), 5) AS weekend_scan_rate,
  round(count(*)/greatest((epoch_us(max(event_time)) - epoch_us(min(event_time)))/3.6e9, 0.1), 5) AS scan_frequency,
  count(DISTINCT location_id) AS unique_locations, count(DISTINCT business_step) AS business_step_count,
  round(any_value(a.e)::DOUBLE, 5) AS location_entropy, round(any_value(b.e)::DOUBLE, 5) AS time_entropy
FROM scans JOIN {entropy_sql(*ENTROPY_SQL['similarity'])} a USING (file_id, epc_code)
  JOIN {entropy_sql(*ENTROPY_SQL['similarity'], column='hour(event_time)')} b USING (file_id, epc_code) GROUP BY ALL""")
def _(spark, d):
    return rounded(pro.epc_profile(scans(spark, d), hot=hot(spark, d)), "scan_duration_hours", "business_hour_rate", "weekend_scan_rate", "scan_frequency",
                   "location_entropy", "time_entropy", digits=5)


@query("D23_outlier_ratio_and_nu", """
, c AS (SELECT count(*) FILTER (f_fake) AS a, count(*) FILTER (f_dup) AS b, count(*) FILTER (f_loc) AS l, count(*) FILTER (f_ord) AS o FROM findings),
n AS (SELECT count(*) AS total_events FROM scans),
r AS (SELECT 'epcFake' AS anomaly_type, a AS events_found FROM c UNION ALL SELECT 'epcDup', b FROM c UNION ALL SELECT 'locErr', l FROM c
  UNION ALL SELECT 'evtOrderErr', o FROM c UNION ALL SELECT 'jump', 0 FROM c)
SELECT anomaly_type, CAST(events_found AS BIGINT) AS events_found, total_events, round(events_found/total_events, 6) AS ratio,
  round(CASE WHEN events_found > 0 THEN least(events_found/total_events*0.8, 0.1) ELSE 0.01 END, 6) AS nu FROM r, n""", "dated prev found")
def _(spark, d):
    return rounded(pro.outlier_ratio_and_nu(findings(spark, d), scans(spark, d), C.STATS_TYPES), "ratio", "nu", digits=6)


@query("D24_sequence_length_stats", """
SELECT min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, count(*) AS sequences, quantile_cont(n, 0.25) AS q25,
  quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q75, quantile_cont(n, 0.9) AS q90, quantile_cont(n, 0.95) AS q95
FROM (SELECT count(*) AS n FROM scans GROUP BY file_id, epc_code)""")
def _(spark, d):
    return rounded(pro.sequence_length_stats(scans(spark, d)), "mean", "std", digits=6)


@query("D25_duplicate_rows", "SELECT CAST(sum(k - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS k FROM scans GROUP BY epc_code, business_step)")
def _(spark, d):
    return pro.duplicate_rows(scans(spark, d).select("epc_code", "business_step"))


@query("D26_duplicate_timestamps", """
SELECT file_id, epc_code, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, count(*) AS "rows" FROM scans GROUP BY ALL HAVING count(*) > 1""")
def _(spark, d):
    return pro.duplicate_timestamps(scans(spark, d)).withColumn("event_time", when())


@query("D27_gap_summary", """
SELECT round(avg(gap0/3600), 6) AS mean_hours, min(gap0/3600) AS min_hours, max(gap0/3600) AS max_hours, count(*) FILTER (gap0/3600 < 0.1) AS short_gaps FROM gaps""", "gaps")
def _(spark, d):
    return rounded(pro.gap_summary(scans(spark, d), hot=hot(spark, d)), "mean_hours", digits=6)


@query("D28_epc_component_profile", """
, p AS (SELECT DISTINCT epc_code, string_split(epc_code, '.') AS a FROM scans)
SELECT count(*) AS codes, count(*) FILTER (len(a) = 6) AS valid_structures, count(DISTINCT CASE WHEN len(a) = 6 THEN a[1] END) AS distinct_headers,
  count(DISTINCT CASE WHEN len(a) = 6 THEN a[2] END) AS distinct_companys, count(DISTINCT CASE WHEN len(a) = 6 THEN a[5] END) AS distinct_dates FROM p""")
def _(spark, d):
    return pro.epc_component_profile(scans(spark, d))


@query("D29_location_profile", """
SELECT count(DISTINCT scan_location) AS locations, count(DISTINCT business_step) AS steps, (SELECT count(*) FROM loc_scores WHERE l > 0) AS epcs_with_violations FROM norm""",
       "dated norm jumps runs_norm dups items")
def _(spark, d):
    df = norm(spark, d)
    return pro.location_profile(df, det.epc_location_error(df, hot=hot(spark, d)))


@query("D30_location_conflicts", """
SELECT location_id, count(DISTINCT scan_location) AS names, min(scan_location) AS first_name, max(scan_location) AS last_name, count(*) AS events
FROM scans GROUP BY location_id HAVING count(DISTINCT scan_location) > 1 OR location_id < 0""")
def _(spark, d):
    return pro.location_conflicts(scans(spark, d))

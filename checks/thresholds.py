"""Labels, thresholds, rankings."""

from pyspark.sql import functions as F

from checks.base import SHARED, W, hot, query, scans
from checks.detection import findings
from checks.items import norm_raw
from checks.journey import rounded
from checks.profiles import SCORES, type_scores
from scanwarden import constants as C
from scanwarden.operators import detect_epc as det
from scanwarden.operators import features as fe
from scanwarden.operators import labels as lab
from scanwarden.operators import profile as pro
from scanwarden.sources.table_scans import as_of

LABELS = """SELECT file_id, epc_code, anomaly_type, score, CAST(score >= CASE anomaly_type WHEN 'epcFake' THEN 60 ELSE 50 END AS INTEGER) AS label FROM type_scores"""


@query("L1_rule_labels", LABELS, SCORES)
def _(spark, d):
    return lab.rule_labels(type_scores(spark, d), {"epcFake": 60}).drop("dataset")


@query("L2_rule_labels_per_event", f"""
SELECT event_id, anomaly_type, label FROM scans JOIN ({LABELS}) USING (file_id, epc_code)""", SCORES)
def _(spark, d):
    labels = lab.rule_labels(type_scores(spark, d), {"epcFake": 60})
    return lab.rule_labels_per_event(scans(spark, d), labels).select("event_id", "anomaly_type", "label")


@query("L3_labels_from_findings", """
SELECT file_id, epc_code, CAST(coalesce(bool_or(f_fake), false) AS INTEGER) AS "epcFake", CAST(coalesce(bool_or(f_dup), false) AS INTEGER) AS "epcDup",
  CAST(coalesce(bool_or(f_loc), false) AS INTEGER) AS "locErr", CAST(coalesce(bool_or(f_ord), false) AS INTEGER) AS "evtOrderErr", 0 AS jump
FROM (SELECT DISTINCT file_id, epc_code FROM scans) LEFT JOIN findings USING (file_id, epc_code) GROUP BY ALL""", "dated prev found")
def _(spark, d):
    return lab.labels_from_findings(scans(spark, d), findings(spark, d))


@query("L4_simulation_labels", f"""
, g AS (SELECT *, lag(location_id) OVER w AS p, lag(location_id, 2) OVER w AS p2, CASE business_step WHEN 'Factory' THEN 1 WHEN 'WMS' THEN 2 WHEN 'Wholesaler' THEN 3 ELSE 4 END AS lv,
  lag(CASE business_step WHEN 'Factory' THEN 1 WHEN 'WMS' THEN 2 WHEN 'Wholesaler' THEN 3 ELSE 4 END) OVER w AS plv FROM gaps WINDOW w AS (PARTITION BY file_id, epc_code ORDER BY event_time, event_id)),
en AS (SELECT f2, e2, sum(CASE WHEN kind = 'l' THEN e END) AS le, sum(CASE WHEN kind = 'o' THEN e END) AS oe FROM (
  SELECT file_id AS f2, epc_code AS e2, kind, CASE WHEN any_value(total) < 3 THEN 0 ELSE -sum(((c/total+0.01)/(1+0.01*k))*log2((c/total+0.01)/(1+0.01*k))) END AS e FROM (
    SELECT file_id, epc_code, kind, c, sum(c) OVER (PARTITION BY file_id, epc_code, kind) AS total, count(*) OVER (PARTITION BY file_id, epc_code, kind) AS k FROM (
      SELECT file_id, epc_code, 'l' AS kind, location_id AS v, count(*)::DOUBLE AS c FROM scans GROUP BY ALL UNION ALL
      SELECT file_id, epc_code, 'o', operator_id, count(*)::DOUBLE FROM scans GROUP BY ALL)) GROUP BY ALL) GROUP BY ALL)
SELECT event_id, CAST(le > 2 OR oe > 1.5 AS INTEGER) AS "epcFake", CAST(ln(1+gap) < 1 AS INTEGER) AS "epcDup",
  CAST(coalesce(lv < plv, false) OR coalesce(location_id = p2 AND location_id <> p, false) AS INTEGER) AS "locErr",
  CAST(coalesce(lv < plv, false) AS INTEGER) AS "evtOrderErr", CAST(ln(1+gap) > 10 AS INTEGER) AS jump FROM g JOIN en ON f2 = file_id AND e2 = epc_code""", "gaps")
def _(spark, d):
    return lab.simulation_labels(fe.run_features(scans(spark, d), hot=hot(spark, d))).select("event_id", *C.STATS_TYPES)


@query("L5_reduced_threshold_labels", """
, g AS (SELECT file_id, epc_code, greatest(gap0/3600, 0) AS g, gap0 FROM gaps),
z AS (SELECT file_id, epc_code, count(gap0) AS n, min(CASE WHEN gap0 IS NOT NULL THEN g END) AS lo, max(CASE WHEN gap0 IS NOT NULL THEN g END) AS hi FROM g GROUP BY ALL),
r AS (SELECT file_id, epc_code, count(*) - count(DISTINCT event_time) AS rep FROM scans GROUP BY ALL)
SELECT file_id, epc_code, CAST(fake >= 15 AS INTEGER) AS "epcFake", CAST(rep > 0 AS INTEGER) AS "epcDup", CAST(l >= 8 AS INTEGER) AS "locErr",
  CAST(o >= 12 AS INTEGER) AS "evtOrderErr", CAST(CASE WHEN n > 0 AND (lo < 0.1 OR hi > 168) THEN CASE WHEN hi > 24 THEN least(50, hi/24*10) WHEN lo < 0.1 THEN 30 ELSE 0 END ELSE 0 END >= 15 AS INTEGER) AS jump
FROM item0 JOIN z USING (file_id, epc_code) JOIN r USING (file_id, epc_code)""", "dated norm jumps runs_norm dups items gaps")
def _(spark, d):
    return lab.reduced_threshold_labels(norm_raw(spark, d), as_of(), hot=hot(spark, d))


RATIOS = " ".join(f"WHEN '{t}' THEN quantile_cont(score, {1 - r})" for t, r in C.TARGET_POSITIVE_RATIO.items())


@query("L6_threshold_for_ratio", f"""
SELECT anomaly_type, CAST(least(greatest(round_even(CASE anomaly_type {RATIOS} END, 0), 0), 100) AS INTEGER) AS threshold FROM type_scores GROUP BY anomaly_type""", SCORES)
def _(spark, d):
    return lab.threshold_for_ratio(type_scores(spark, d))


RAW = " ".join(f"WHEN '{t}' THEN quantile_cont(score, {1 - v[0]})" for t, v in C.CALIBRATION.items())
LOW, HIGH, RATE = (" ".join(f"WHEN '{t}' THEN {v[i]}::DOUBLE" for t, v in C.CALIBRATION.items()) for i in (1, 2, 0))
SHARED["calibrated"] = f"""
cal0 AS (SELECT dataset, anomaly_type, CASE anomaly_type {RAW} END AS raw FROM type_scores GROUP BY dataset, anomaly_type),
cal1 AS (SELECT *, least(greatest(raw, CASE anomaly_type {LOW} END), CASE anomaly_type {HIGH} END) AS threshold FROM cal0),
cal AS (SELECT dataset, anomaly_type, raw, threshold, count(*) AS samples, count(*) FILTER (score >= threshold) AS predicted, count(*) FILTER (score >= 20) AS cur,
  CASE anomaly_type {RATE} END AS target_rate FROM type_scores JOIN cal1 USING (dataset, anomaly_type) GROUP BY dataset, anomaly_type, raw, threshold)"""


@query("L7_calibrate", """
SELECT dataset, anomaly_type, round(raw, 6) AS raw_threshold, round(threshold, 6) AS threshold, samples, predicted, round(predicted/samples, 6) AS actual_rate,
  round(cur/samples, 6) AS current_rate, CASE WHEN predicted > 0 THEN round((cur/samples)/(predicted/samples), 6) END AS improvement_ratio, target_rate,
  CASE WHEN raw <> threshold THEN 'percentile_constrained' ELSE 'percentile_pure' END AS source FROM cal""", SCORES + " calibrated")
def _(spark, d):
    return rounded(lab.calibrate(type_scores(spark, d)), "raw_threshold", "threshold", "actual_rate", "current_rate", "improvement_ratio", digits=6)


MISS = " ".join(f"WHEN '{t}' THEN {v}" for t, v in C.MISS_COST.items())


@query("L8_optimize_cost", f"""
, b AS (SELECT *, greatest(threshold*0.5, CASE anomaly_type {LOW} END) AS s, least(threshold*1.5, CASE anomaly_type {HIGH} END) AS e FROM cal),
t AS (SELECT *, s + (e - s)*i/19 AS trial FROM b, (SELECT unnest(range(20)) AS i)),
h AS (SELECT t.dataset, t.anomaly_type, threshold, samples, target_rate, i, trial, count(*) FILTER (score >= trial) AS pos
  FROM t JOIN type_scores ts ON ts.dataset = t.dataset AND ts.anomaly_type = t.anomaly_type GROUP BY ALL),
r AS (SELECT *, floor(target_rate*samples) AS tr, least(pos, floor(floor(target_rate*samples)*1.5)) AS rt FROM h),
c AS (SELECT *, 50*greatest(pos - rt, 0) + CASE anomaly_type {MISS} END * greatest(tr - rt, 0) AS cost FROM r)
SELECT dataset, anomaly_type, round(threshold, 6) AS original, min(cost)::DOUBLE AS minimum_cost, round(first(trial ORDER BY cost, i), 6) AS cost_threshold,
  round(CASE WHEN max(cost) FILTER (i = 0) <> 0 THEN 100*(1 - min(cost)/max(cost) FILTER (i = 0)) END, 6)::DOUBLE AS cost_improvement_pct FROM c GROUP BY dataset, anomaly_type, threshold""",
       SCORES + " calibrated")
def _(spark, d):
    scores = type_scores(spark, d)
    return rounded(lab.optimize_cost(scores, lab.calibrate(scores)), "original", "cost_threshold", "cost_improvement_pct", digits=6)


CONSENSUS = """
, k AS (SELECT *, predicted/samples AS ar, cur/samples AS cr FROM cal),
m AS (SELECT anomaly_type, median(threshold) AS ct, median(ar) AS rt, stddev_pop(threshold)/avg(threshold) AS cv, avg(cr) AS ac, sum(samples*cr) AS ca, sum(samples) AS n FROM k GROUP BY 1),
s AS (SELECT anomaly_type, sum(greatest(samples*(cr - rt), 0)) AS saved FROM k JOIN m USING (anomaly_type) GROUP BY 1),
con AS (SELECT *, CASE WHEN cv < 0.1 THEN 'HIGH' WHEN cv < 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM m JOIN s USING (anomaly_type))"""


@query("L9_consensus", CONSENSUS + """
SELECT anomaly_type, round(ct, 4) AS consensus_threshold, round(rt, 6) AS consensus_rate, round(cv, 6) AS threshold_cv, round(ac, 6) AS avg_current_rate,
  round(ca, 3) AS current_anomalies, CAST(n AS BIGINT) AS samples, round(1 - cv, 6) AS threshold_consistency, confidence, round(saved, 3) AS alerts_saved, round(saved*50, 3) AS cost_saved FROM con""",
       SCORES + " calibrated")
def _(spark, d):
    df = rounded(lab.consensus(lab.calibrate(type_scores(spark, d))), "consensus_rate", "threshold_cv", "avg_current_rate", "threshold_consistency", digits=6)
    return rounded(rounded(df, "consensus_threshold"), "current_anomalies", "alerts_saved", "cost_saved", digits=3)


@query("S3_priority_ranking", CONSENSUS + """
, p AS (SELECT *, CASE WHEN rt > 0 THEN ac/rt END AS imp, CASE WHEN anomaly_type IN ('epcFake','jump') THEN 'HIGH' WHEN anomaly_type IN ('epcDup','locErr') THEN 'MEDIUM' ELSE 'LOW' END AS bp FROM con)
SELECT anomaly_type, round(ct, 4) AS consensus_threshold, round(imp, 6) AS improvement_factor, bp AS business_priority, confidence,
  round(imp * CASE bp WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END * CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END, 6) AS priority_score FROM p""",
       SCORES + " calibrated")
def _(spark, d):
    df = lab.priority_ranking(lab.consensus(lab.calibrate(type_scores(spark, d))))
    return rounded(rounded(df, "consensus_threshold"), "improvement_factor", "priority_score", digits=6)


GRID = [(i, float(t)) for i, t in enumerate(t for r in lab.SWEEP_RANGES.values() for t in r)]


@query("L10_recommend_thresholds", f"""
, g AS (SELECT * FROM (VALUES {', '.join(str(x) for x in GRID)}) v(i, t)),
s AS (SELECT dataset, i, t, count(*) FILTER (score >= t)/count(*) AS r FROM type_scores, g WHERE anomaly_type = 'epcFake' GROUP BY ALL),
b AS (SELECT dataset, first(t ORDER BY abs(r - 0.005), i)::DOUBLE AS t FROM s GROUP BY 1),
f AS (SELECT dataset, t, CASE WHEN t <> 0 THEN t/60 ELSE 0.3 END AS k FROM b)
SELECT dataset, 'epcFake' AS anomaly_type, t AS threshold, 0.005::DOUBLE AS target_rate FROM f
UNION ALL SELECT dataset, 'epcDup', round_even(30*k, 0), 0.025 FROM f UNION ALL SELECT dataset, 'locErr', round_even(40*k, 0), 0.015 FROM f
UNION ALL SELECT dataset, 'evtOrderErr', round_even(35*k, 0), 0.02 FROM f UNION ALL SELECT dataset, 'jump', round_even(50*k, 0), 0.008 FROM f""", SCORES)
def _(spark, d):
    return lab.recommend_thresholds(lab.sweep_ranges(type_scores(spark, d)))


@query("L11_data_cleanliness_verdict", """
, r AS (SELECT dataset, anomaly_type, count(*) FILTER (score > 0)/count(*) AS nz FROM type_scores GROUP BY ALL),
m AS (SELECT anomaly_type, avg(nz) AS mean_rate FROM r GROUP BY 1)
SELECT anomaly_type, round(mean_rate, 6) AS mean_rate, CASE WHEN (SELECT max(mean_rate) FROM m) < 0.01 THEN 'EXTREMELY_CLEAN_OR_SYNTHETIC' ELSE 'SYNTHETIC_OR_HIGHLY_CLEAN' END AS verdict,
  NULL::VARCHAR AS suggested_range FROM m""", SCORES)
def _(spark, d):
    return rounded(lab.data_cleanliness_verdict(pro.score_stats(type_scores(spark, d))), "mean_rate", digits=6)


@query("S2_borderline", """
SELECT file_id, epc_code, anomaly_type, score, CAST(abs(score - 50) AS INTEGER) AS distance, CAST(score >= 50 AS INTEGER) AS predicted_label FROM type_scores WHERE abs(score - 50) <= 5""", SCORES)
def _(spark, d):
    return lab.borderline(type_scores(spark, d), 50, 5).drop("dataset")


BIG = """wide AS (SELECT file_id, epc_code, fake::DOUBLE AS f1, jmp::DOUBLE AS f2, (total * 10)::DOUBLE AS f3 FROM item0)"""
SHARED["wide"] = BIG


@query("D31_training_summary", """
SELECT count(*) AS samples, count(*) FILTER (fake >= 50) AS positives, count(*) FILTER (fake < 50) AS negatives, round(count(*) FILTER (fake >= 50)/count(*), 6) AS positive_ratio,
  3 AS dimensions, min(fake)::DOUBLE AS score_min, max(fake)::DOUBLE AS score_max, 1 AS zero_variance_features,
  CASE WHEN count(*) FILTER (fake >= 50)/count(*) < 0.01 THEN 'poor_balance' WHEN count(*) < 100 THEN 'low_samples' WHEN count(*) FILTER (fake >= 50)/count(*) < 0.05 THEN 'imbalanced' ELSE 'good' END AS quality
FROM (SELECT DISTINCT file_id, epc_code, fake FROM scored)""", "dated")
def _(spark, d):
    return rounded(pro.training_summary(training(spark, d), ["structure_valid", "epc_length", "constant"]), "positive_ratio", digits=6)


def training(spark, d):
    from scanwarden.functions import epc

    df = epc.with_fake_score(fe.fake_features(scans(spark, d), as_of()), as_of(), "score")
    return df.withColumn("label", (F.col("score") >= 50).cast("int")).withColumn("constant", F.lit(1.0))


@query("D31_feature_stats", """
, i AS (SELECT DISTINCT epc_code, fake FROM scored)
SELECT 'epc_length' AS feature, round(avg(least(length(epc_code)/100.0, 1)), 6)::DOUBLE AS mean, round(var_pop(least(length(epc_code)/100.0, 1)), 6)::DOUBLE AS variance FROM i
UNION ALL SELECT 'score', round(avg(fake), 6), round(var_pop(fake), 6) FROM i""", "dated")
def _(spark, d):
    return rounded(pro.feature_stats(training(spark, d), ["epc_length", "score"]), "mean", "variance", digits=6)


@query("D32_class_weights", """
SELECT anomaly_type, round(CASE WHEN count(*) FILTER (score >= 50) > 0 THEN count(*)/(2*count(*) FILTER (score >= 50)) END, 6) AS positive_weight,
  round(CASE WHEN count(*) FILTER (score < 50) > 0 THEN count(*)/(2*count(*) FILTER (score < 50)) END, 6) AS negative_weight FROM type_scores GROUP BY 1""", SCORES)
def _(spark, d):
    return rounded(pro.class_weights(lab.rule_labels(type_scores(spark, d))), "positive_weight", "negative_weight", digits=6)

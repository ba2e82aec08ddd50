"""Drift between earlier and later scans, and between embeddings."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import AS_OF_SQL, SHARED, plain, query, scans
from checks.journey import rounded
from scanwarden.operators import drift as dr
from scanwarden.operators import resampling as rs
from scanwarden.sources.table_scans import table

FEATURES = ["location_id", "device_id", "hour"]


def sides(spark, d):
    """Scans before 1998 as baseline, later ones as recent."""
    df = scans(spark, d).withColumn("hour", F.hour("event_time")).select("event_id", "event_time", *FEATURES)
    old = F.col("event_time") < F.lit("1998-01-01").cast("timestamp")
    return df.where(old), df.where(~old)


SHARED["dist"] = """
sided AS (SELECT event_id, CAST(event_time >= TIMESTAMP '1998-01-01' AS INTEGER) AS side, location_id, device_id, hour(event_time) AS hour FROM scans),
vals AS (SELECT 'location_id' AS feature, location_id::DOUBLE AS value, side FROM sided UNION ALL SELECT 'device_id', device_id, side FROM sided UNION ALL SELECT 'hour', hour, side FROM sided),
cnt AS (SELECT feature, value, count(*) FILTER (side=0) AS a, count(*) FILTER (side=1) AS b FROM vals GROUP BY ALL),
cum AS (SELECT *, sum(a) OVER w / sum(a) OVER t AS fa, sum(b) OVER w / sum(b) OVER t AS fb, lead(value) OVER w AS nx FROM cnt
  WINDOW w AS (PARTITION BY feature ORDER BY value), t AS (PARTITION BY feature)),
dist AS (SELECT feature, coalesce(sum(abs(fa-fb)*(nx-value)), 0) AS emd, max(abs(fa-fb)) AS ks FROM cum GROUP BY 1)"""


@query("N1_wasserstein", "SELECT feature, round(emd, 6) AS emd FROM dist", "dist")
def _(spark, d):
    return rounded(dr.wasserstein(*sides(spark, d), FEATURES), "emd", digits=6)


@query("N2_ks", "SELECT feature, round(ks, 6) AS ks FROM dist", "dist")
def _(spark, d):
    return rounded(dr.ks_test(*sides(spark, d), FEATURES), "ks", digits=6).select("feature", "ks")


SHARED["ks"] = """
size AS (SELECT feature, sum(a) AS n, sum(b) AS m FROM cnt GROUP BY 1),
root AS (SELECT feature, ks, ks * sqrt(n::DOUBLE * m / (n + m)) AS x FROM dist JOIN size USING (feature)),
tests AS (SELECT feature, ks, CASE WHEN x < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101),
  lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * x * x))))) END AS p_value FROM root)"""


@query("N2_ks_pvalue", "SELECT feature, round(ks, 6) AS ks, round(p_value, 6)::DOUBLE AS p_value FROM tests", "dist ks")
def _(spark, d):
    return rounded(dr.ks_test(*sides(spark, d), FEATURES), "ks", "p_value", digits=6)


@query("N3_drift_baseline", """
SELECT feature, count(*) AS samples, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM vals WHERE side = 0 GROUP BY 1""", "dist")
def _(spark, d):
    return rounded(dr.drift_baseline(sides(spark, d)[0], FEATURES), "mean", "std", digits=6)


def replicate_emd_sql(source: str, a: str, b: str) -> str:
    """Distance per replicate and feature; ``a`` and ``b`` are the weights of the two sides."""
    return f"""
rc AS (SELECT replicate, feature, value, {a} AS a, {b} AS b FROM {source} GROUP BY replicate, feature, value),
ru AS (SELECT *, sum(a) OVER w / sum(a) OVER t AS fa, sum(b) OVER w / sum(b) OVER t AS fb, lead(value) OVER w AS nx FROM rc
  WINDOW w AS (PARTITION BY replicate, feature ORDER BY value), t AS (PARTITION BY replicate, feature)),
rd AS (SELECT replicate, feature, coalesce(sum(abs(fa-fb)*(nx-value)), 0) AS emd FROM ru GROUP BY ALL)"""


def replicate_draw_sql(rest: str = "replicate") -> str:
    return f"CAST('0x' || substr(md5(event_id || '|' || {rest} || '|42'), 1, 12) AS BIGINT)"


SIDE_COUNTS = ("count(*) FILTER (side = 0)", "count(*) FILTER (side = 1)")


@query("N4_bootstrap_threshold", f"""
, dw AS (SELECT location_id, device_id, hour, replicate, {replicate_draw_sql()} % 2 AS side FROM sided, range(100) r(replicate) WHERE sided.side = 0),
rv AS (SELECT replicate, side, 'location_id' AS feature, location_id::DOUBLE AS value FROM dw UNION ALL SELECT replicate, side, 'device_id', device_id FROM dw
  UNION ALL SELECT replicate, side, 'hour', hour FROM dw), {replicate_emd_sql("rv", *SIDE_COUNTS)},
m AS (SELECT replicate, avg(emd) AS emd FROM rd GROUP BY 1)
SELECT round(quantile_cont(emd, 0.95), 6) AS p95, round(quantile_cont(emd, 0.99), 6) AS p99, round(avg(emd), 6) AS mean, round(stddev_pop(emd), 6) AS std FROM m""", "dist")
def _(spark, d):
    return rounded(dr.bootstrap_threshold(sides(spark, d)[0], FEATURES, ["event_id"]), "p95", "p99", "mean", "std", digits=6)


@query("N5_feature_drift", """
, m AS (SELECT feature, avg(value) FILTER (side=0) AS m0, avg(value) FILTER (side=1) AS m1, stddev_pop(value) FILTER (side=0) AS s FROM vals GROUP BY 1)
SELECT feature, round(emd, 6) AS emd, round(ks, 6) AS ks, round(m0, 6) AS baseline_mean, round(m1, 6) AS recent_mean, round(emd/(s+1e-10), 6) AS effect_size,
  round(m1-m0, 6) AS mean_shift, emd > 0.1 AS drifted, (SELECT avg((emd > 0.1)::INT) > 0.1 FROM dist) AS table_drifted FROM dist JOIN m USING (feature)""", "dist")
def _(spark, d):
    return rounded(dr.feature_drift(*sides(spark, d), FEATURES, 0.1), "emd", "ks", "baseline_mean", "recent_mean", "effect_size", "mean_shift", digits=6)


def vectors(spark, d):
    df = table(spark, d, "embeddings")
    return df.where(F.col("vec_id") % 2 == 0), df.where(F.col("vec_id") % 2 == 1)


@plain("N6_embedding_drift", """
WITH e AS (SELECT vec_id % 2 AS side, unnest(range(64)) AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings),
cnt AS (SELECT feature, value, count(*) FILTER (side=0) AS a, count(*) FILTER (side=1) AS b FROM e GROUP BY ALL),
cum AS (SELECT *, sum(a) OVER w / sum(a) OVER t AS fa, sum(b) OVER w / sum(b) OVER t AS fb, lead(value) OVER w AS nx FROM cnt
  WINDOW w AS (PARTITION BY feature ORDER BY value), t AS (PARTITION BY feature)),
dist AS (SELECT feature, sum(abs(fa-fb)*(nx-value)) AS emd FROM cum GROUP BY 1),
s AS (SELECT feature, avg(value) FILTER (side=0) AS m0, avg(value) FILTER (side=1) AS m1, stddev_pop(value) FILTER (side=0) AS s0, stddev_pop(value) FILTER (side=1) AS s1 FROM e GROUP BY 1),
r AS (SELECT avg(emd) AS mean_emd, max(emd) AS max_emd, sqrt(sum(pow(m1-m0, 2))) AS centroid_shift, avg(s1)/avg(s0) AS spread_change FROM dist JOIN s USING (feature))
SELECT round(mean_emd, 6) AS mean_emd, round(max_emd, 6) AS max_emd, round(centroid_shift, 6) AS centroid_shift, round(spread_change, 6) AS spread_change,
  mean_emd > 0.1 OR centroid_shift > 0.5 OR abs(spread_change-1) > 0.3 AS drifted FROM r""")
def _(spark, d):
    return rounded(dr.embedding_drift(*vectors(spark, d)), "mean_emd", "max_emd", "centroid_shift", "spread_change", digits=6)


def history(spark, d):
    """Monthly share of outbound and night scans as metrics of a run."""
    df = scans(spark, d).withColumn("run", F.date_format("event_time", "yyyy-MM"))
    rows = df.groupBy("run").agg(
        F.avg((F.col("event_type") == "Outbound").cast("double")).alias("outbound"),
        F.avg((F.hour("event_time") >= 12).cast("double")).alias("late_cost"))
    return rows.unpivot(["run"], ["outbound", "late_cost"], "metric", "value")


@query("N7_performance_drift", """
, m AS (SELECT strftime(event_time, '%Y-%m') AS run, avg(CASE WHEN event_type IS NOT NULL THEN (event_type = 'Outbound')::INT END) AS outbound, avg((hour(event_time) >= 12)::INT) AS late_cost FROM scans GROUP BY 1),
h AS (SELECT run, 'outbound' AS metric, outbound AS value FROM m UNION ALL SELECT run, 'late_cost', late_cost FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY run DESC) AS k FROM h),
b AS (SELECT metric, avg(value) AS baseline FROM h GROUP BY 1),
s AS (SELECT metric, max(value) FILTER (k = 1) AS current, count(*) AS runs, avg(value) AS m, stddev_samp(value) AS s FROM r WHERE k <= 30 GROUP BY 1)
SELECT metric, round(baseline, 6) AS baseline, round(current, 6) AS current, runs, round(baseline - current, 6) AS "drop", round((m-baseline)/(s/sqrt(runs)), 4) AS t_statistic,
  round((baseline-current)/baseline, 6) AS relative_drop, round((baseline-current)*CASE WHEN contains(metric, 'cost') THEN 10 ELSE 1 END, 6) AS impact FROM b JOIN s USING (metric)""")
def _(spark, d):
    rows = history(spark, d)
    df = dr.performance_drift(rows, rows.groupBy("metric").agg(F.avg("value").alias("baseline")))
    df = rounded(rounded(df, "baseline", "current", "drop", "relative_drop", "impact", digits=6), "t_statistic")
    return df.drop("p_value", "drifted")


@query("N8_distribution_js_drift", """
, p AS (SELECT file_id, h, sum(w) FILTER (side=0) AS a, sum(w) FILTER (side=1) AS b FROM (SELECT file_id, hour(event_time) AS h, 1 AS w,
  CAST(event_time >= TIMESTAMP '1998-01-01' AS INTEGER) AS side FROM scans) GROUP BY ALL),
q AS (SELECT file_id, coalesce(a,0)/(sum(coalesce(a,0)) OVER w + 1e-10) AS p, coalesce(b,0)/(sum(coalesce(b,0)) OVER w + 1e-10) AS q FROM p WINDOW w AS (PARTITION BY file_id)),
r AS (SELECT file_id, sqrt(greatest((sum(CASE WHEN p > 0 THEN p*ln(p/((p+q)/2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q*ln(q/((p+q)/2)) ELSE 0 END))/2, 0)) AS js,
  -sum(q*ln(q+1e-10)) + sum(p*ln(p+1e-10)) AS ec, stddev_pop(q) - stddev_pop(p) AS cc FROM q GROUP BY 1)
SELECT file_id, round(js, 6) AS js_distance, round(ec, 6) AS entropy_change, round(cc, 6) AS concentration_change, js > 0.2 OR abs(ec) > 0.5 OR abs(cc) > 0.3 AS drifted FROM r""")
def _(spark, d):
    df = scans(spark, d).withColumn("hour", F.hour("event_time")).withColumn("w", F.lit(1))
    old = F.col("event_time") < F.lit("1998-01-01").cast("timestamp")
    out = dr.distribution_js_drift(df.where(old), df.where(~old), ["file_id"], "hour", "w")
    return rounded(out, "js_distance", "entropy_change", "concentration_change", digits=6)


def test_rows(spark, d):
    old, new = sides(spark, d)
    rows = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    return rows.select("event_id", "side", F.lit("device_id").alias("feature"), F.col("device_id").cast("double").alias("value"))


@query("N9_permutation_test", f"""
, dw AS (SELECT event_id, 'device_id' AS feature, device_id::DOUBLE AS value, replicate, {replicate_draw_sql()} AS d FROM sided, range(100) r(replicate)),
rv AS (SELECT *, (row_number() OVER (PARTITION BY replicate ORDER BY d) > (SELECT count(*) FROM sided WHERE side = 0))::INT AS side FROM dw),
{replicate_emd_sql("rv", *SIDE_COUNTS)}
SELECT feature, round(dist.emd, 6) AS observed, round((count(*) FILTER (rd.emd >= dist.emd) + 1) / (count(*) + 1), 6) AS p_value,
  round(avg(rd.emd), 6) AS null_mean, round(stddev_pop(rd.emd), 6) AS null_std FROM rd JOIN dist USING (feature) GROUP BY feature, dist.emd""", "dist")
def _(spark, d):
    return rounded(dr.permutation_test(test_rows(spark, d), ["event_id"]), "observed", "p_value", "null_mean", "null_std", digits=6)


def _poisson_sql(u: str) -> str:
    """Count whose cumulative Poisson(1) probability first exceeds the draw."""
    total, term, arms = 0.0, 0.36787944117144233, []
    for k in range(9):
        total += term
        arms.append(f"WHEN {u} < {total!r} THEN {k}")
        term /= k + 1
    return f"CASE {' '.join(arms)} ELSE 9 END"


@query("N10_bootstrap_emd_test", f"""
, dw AS (SELECT 'device_id' AS feature, device_id::DOUBLE AS value, replicate, s.side AS side, {replicate_draw_sql("s.side || '|' || replicate")} / 281474976710656.0::DOUBLE AS u
  FROM sided, range(100) r(replicate), (VALUES (0), (1)) s(side)),
rv AS (SELECT *, {_poisson_sql("u")} AS w FROM dw),
{replicate_emd_sql("rv", "sum(CASE WHEN side = 0 THEN w ELSE 0 END)", "sum(CASE WHEN side = 1 THEN w ELSE 0 END)")}
SELECT feature, round(dist.emd, 6) AS observed, round(count(*) FILTER (rd.emd >= dist.emd) / count(*), 6) AS p_value
FROM rd JOIN dist USING (feature) GROUP BY feature, dist.emd""", "dist")
def _(spark, d):
    return rounded(dr.bootstrap_emd_test(test_rows(spark, d), ["event_id"]), "observed", "p_value", digits=6)


@query("N11_multivariate_drift", """
, c AS (SELECT count(*) AS features, count(*) FILTER (p_value < 0.05) AS significant,
  count(*) FILTER (p_value < 0.05 / (SELECT count(*) FROM tests)) AS bonferroni_significant FROM tests)
SELECT *, bonferroni_significant > 0 AS drift, significant / features AS severity FROM c""", "dist ks")
def _(spark, d):
    return dr.multivariate_drift(dr.ks_test(*sides(spark, d), FEATURES))


def kinds(spark, d):
    """One run per month with flags that stand for kinds of drift."""
    df = scans(spark, d).withColumn("run", F.date_format("event_time", "yyyy-MM"))
    rows = df.groupBy("run").agg(F.count("*").alias("n"), F.sum("location_id").alias("s"), F.sum("device_id").alias("v"))
    return rows.select("run", (F.col("n") % 2 == 0).alias("feature_distribution"), (F.col("s") % 3 == 0).alias("embedding_space"),
                       (F.col("v") % 4 == 0).alias("performance"), (F.col("n") % 5 == 0).alias("attention_patterns"))


SHARED["assess"] = """
mon AS (SELECT strftime(event_time, '%Y-%m') AS run, count(*) AS n, sum(location_id) AS s, sum(device_id) AS v FROM scans GROUP BY 1),
fl AS (SELECT run, n % 2 = 0 AS a, s % 3 = 0 AS b, v % 4 = 0 AS c, n % 5 = 0 AS e FROM mon),
assess AS (SELECT *, a::INT + b::INT + c::INT + e::INT AS kinds, round(0.3*a::INT + 0.4*b::INT + 0.6*c::INT + 0.2*e::INT, 6)::DOUBLE AS impact,
  CASE WHEN a::INT + b::INT + c::INT + e::INT >= 3 THEN 'high' WHEN a::INT + b::INT + c::INT + e::INT = 2 THEN 'medium' WHEN a OR b OR c OR e THEN 'low' ELSE 'none' END AS level FROM fl)"""


@query("N12_drift_assessment", """
SELECT run, kinds, impact AS impact_score, level AS alert_level, kinds >= 2 AS retrain, CASE WHEN impact > 0.8 THEN 'high' WHEN impact > 0.4 THEN 'medium' ELSE 'low' END AS severity,
  concat_ws('; ', CASE WHEN c THEN 'URGENT: Schedule immediate model retraining due to performance degradation' END,
    CASE WHEN a THEN 'Review data pipeline for changes in feature extraction or data sources' END, CASE WHEN b THEN 'Analyze recent data patterns for new behavioral modes not seen in training' END,
    CASE WHEN e THEN 'Investigate changes in sequence patterns and temporal dependencies' END, CASE level WHEN 'high' THEN 'Consider emergency fallback to rule-based detection system'
    WHEN 'medium' THEN 'Increase monitoring frequency and prepare retraining pipeline' WHEN 'none' THEN 'System operating normally - continue standard monitoring' END) AS advice FROM assess""", "assess")
def _(spark, d):
    df = rounded(dr.drift_assessment(kinds(spark, d)), "impact_score", digits=6)
    return df.select("run", "kinds", "impact_score", "alert_level", "retrain", "severity", F.array_join("advice", "; ").alias("advice"))


@query("N13_drift_summary", """
, l AS (SELECT run, CASE level WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS v FROM assess ORDER BY run DESC LIMIT 10),
dd AS (SELECT v - lag(v) OVER (ORDER BY run) AS x FROM l)
SELECT count(*) AS runs, count(*) FILTER (level='none') AS none_alerts, count(*) FILTER (level='low') AS low_alerts, count(*) FILTER (level='medium') AS medium_alerts,
  count(*) FILTER (level='high') AS high_alerts, count(*) FILTER (a) AS feature_distribution_runs, count(*) FILTER (b) AS embedding_space_runs, count(*) FILTER (c) AS performance_runs,
  count(*) FILTER (e) AS attention_patterns_runs, round(avg(CASE level WHEN 'none' THEN 1 WHEN 'low' THEN 0.8 WHEN 'medium' THEN 0.5 ELSE 0.2 END), 6)::DOUBLE AS stability,
  arg_max(level, run) AS current_status, (SELECT CASE WHEN min(x) >= 0 THEN 'deteriorating' WHEN max(x) <= 0 THEN 'improving' ELSE 'stable' END FROM dd) AS recent_trend FROM assess""", "assess")
def _(spark, d):
    return rounded(dr.drift_summary(dr.drift_assessment(kinds(spark, d))), "stability", digits=6)


# ---- 1,000 replicates of every feature, drawn on counts -------------------------------------------
# SQL has the observed distance, and what chance must give on average: the area under sqrt(2 / pi) times the deviation of the
# difference between the two cumulative shares at each value.

EXPECTED = """
pool AS (SELECT feature, value, {weight} AS c FROM cnt),
size AS (SELECT feature, {n0} AS n0, {n1} AS n1 FROM cnt GROUP BY 1),
curve AS (SELECT feature, sum(c) OVER w / sum(c) OVER t AS f, lead(value) OVER w - value AS step, sum(c) OVER t AS n FROM pool
  WINDOW w AS (PARTITION BY feature ORDER BY value), t AS (PARTITION BY feature)),
chance AS (SELECT feature, coalesce(sum(sqrt(2 / pi() * f * (1 - f) * (1.0 / n0 + 1.0 / n1) {rest}) * step), 0) AS expected
  FROM curve JOIN size USING (feature) WHERE f < 1 GROUP BY feature)"""
SIDES = dict(weight="a + b", n0="sum(a)", n1="sum(b)")


def with_chance(out, spark, d, observed="observed", mean="null_mean", halves=False):
    """Whether the mean of the replicates is within 8 % of what chance gives, worked out from all values in order."""
    baseline, recent = sides(spark, d)
    rows = dr.two_sides(baseline, recent, FEATURES).where("value IS NOT NULL")
    if halves:
        rows = rows.where("side = 0")
    w = Window.partitionBy("feature").orderBy("value")
    every = Window.partitionBy("feature")
    cells = rows.groupBy("feature", "value").agg(F.count("*").alias("c"), F.count_if(F.col("side") == 0).alias("a"))
    n = F.sum("c").over(every)
    cells = cells.select("feature", (F.sum("c").over(w) / n).alias("f"), (F.lead("value").over(w) - F.col("value")).alias("step"),
                         n.alias("n"), (F.floor(n / 2) if halves else F.sum("a").over(every)).alias("n0"))
    spread = F.sqrt(2 / math.pi * F.col("f") * (1 - F.col("f")) * (1 / F.col("n0") + 1 / (F.col("n") - F.col("n0"))))
    chance = cells.where("f < 1").groupBy("feature").agg(F.sum(spread * F.col("step")).alias("expected"))
    joined = out.join(chance, "feature")
    return joined.withColumn("as_chance", F.abs(F.col(mean) / F.col("expected") - 1) < 0.08)


@query("N4_half_thresholds", ", " + EXPECTED.format(weight="a", n0="sum(a) // 2", n1="sum(a) - sum(a) // 2", rest="") + """
SELECT feature, round(expected, 6) AS expected, TRUE AS as_chance, TRUE AS ordered FROM chance""", "dist")
def _(spark, d):
    out = rs.half_thresholds(sides(spark, d)[0], FEATURES)
    out = with_chance(out, spark, d, mean="mean", halves=True).withColumn("ordered", (F.col("mean") < F.col("p95")) & (F.col("p95") < F.col("p99")))
    return rounded(out, "expected", digits=6).select("feature", "expected", "as_chance", "ordered")


#: A distance far from what chance gives must have the least or a large p-value.
CLEAR = """
SELECT feature, round(emd, 6) AS observed, round(expected, 6) AS expected, TRUE AS as_chance, TRUE AS clear
FROM dist JOIN chance USING (feature)"""


def clear(out):
    ratio = F.col("observed") / F.col("expected")
    right = F.when(ratio > 4, F.col("p_value") < 0.01).when(ratio < 0.6, F.col("p_value") > 0.5).otherwise(F.col("p_value").between(0, 1))
    return rounded(out.withColumn("clear", right), "observed", "expected", digits=6).select("feature", "observed", "expected", "as_chance", "clear")


@query("N9_permutation_counts", ", " + EXPECTED.format(rest="", **SIDES) + CLEAR, "dist")
def _(spark, d):
    return clear(with_chance(rs.permutation_drift(*sides(spark, d), FEATURES), spark, d))


@query("N10_bootstrap_counts", ", " + EXPECTED.format(rest="", **SIDES) + CLEAR, "dist")
def _(spark, d):
    return clear(with_chance(rs.bootstrap_drift(*sides(spark, d), FEATURES), spark, d))

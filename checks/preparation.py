"""Imputation, correction, scaling, encoding, selection."""

from pyspark.sql import functions as F

from checks.base import SHARED, hot, query, scans, when
from checks.journey import rounded
from scanwarden.operators import encode as en

NUMERIC = ["location_id", "device_id", "operator_id"]


@query("I1_impute_mode", """
, m AS (SELECT (SELECT event_type FROM scans WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS a,
  (SELECT scan_location FROM scans WHERE scan_location IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS b)
SELECT event_id, coalesce(event_type, a) AS event_type, coalesce(scan_location, b) AS scan_location FROM scans, m""")
def _(spark, d):
    return en.impute_mode(scans(spark, d), ["event_type", "scan_location"]).select("event_id", "event_type", "scan_location")


def holed(spark, d):
    return scans(spark, d).withColumn("target", F.when(F.col("operator_id") % 9 != 0, F.col("device_id")))


@query("I2_impute_knn", """
, h AS (SELECT event_id, operator_id, CASE WHEN operator_id % 9 <> 0 THEN device_id END AS target FROM scans),
g AS (SELECT operator_id AS spot, count(*) AS n, avg(target) AS mean FROM h WHERE target IS NOT NULL GROUP BY 1),
q AS (SELECT DISTINCT operator_id FROM h WHERE target IS NULL),
r AS (SELECT operator_id, n, mean, sum(n) OVER (PARTITION BY operator_id ORDER BY abs(spot - operator_id), spot) AS upto FROM q, g WHERE abs(spot - operator_id) <= 20),
v AS (SELECT operator_id, sum(least(n, 5 - (upto - n)) * mean)/sum(least(n, 5 - (upto - n))) AS imputed FROM r WHERE upto - n < 5 GROUP BY 1)
SELECT event_id, round(coalesce(target::DOUBLE, imputed), 6) AS target FROM h LEFT JOIN v USING (operator_id)""")
def _(spark, d):
    return rounded(en.impute_knn(holed(spark, d), "target", "operator_id"), "target", digits=6).select("event_id", "target")


@query("I3_impute_business", """
, h AS (SELECT *, CASE WHEN device_id % 7 <> 0 THEN business_step END AS bs, CASE WHEN device_id % 11 <> 0 THEN manufacture_date END AS md, p_name AS pn
  FROM scans LEFT JOIN part ON p_partkey = l_partkey),
n AS (SELECT location_id, min(scan_location) AS place FROM scans GROUP BY 1),
m AS (SELECT pn AS p2, round(quantile_cont(epoch_us(md), 0.5))::BIGINT AS us FROM h WHERE md IS NOT NULL GROUP BY 1)
SELECT event_id, coalesce(scan_location, place) AS scan_location, coalesce(bs, split_part(hub_type, '_', 1)) AS business_step, coalesce(epoch_us(md), us) AS made
FROM h JOIN n USING (location_id) LEFT JOIN m ON p2 IS NOT DISTINCT FROM pn""")
def _(spark, d):
    df = scans(spark, d, product=True)
    df = df.withColumns({
        "business_step": F.when(F.col("device_id") % 7 != 0, F.col("business_step")),
        "manufacture_date": F.when(F.col("device_id") % 11 != 0, F.col("manufacture_date"))})
    return en.impute_business(df).select("event_id", "scan_location", "business_step", F.unix_micros("manufacture_date").alias("made"))


def dirty(spark, d):
    n = F.col("device_id")
    return scans(spark, d).withColumns({
        "epc_code": F.when(n % 5 == 0, F.translate("epc_code", ".", "-")).otherwise(F.col("epc_code")),
        "event_time": F.when(n % 13 == 0, F.lit("not a time")).otherwise(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")),
        "location_id": F.when(n % 17 == 0, -F.col("location_id")).otherwise(F.col("location_id"))})


SHARED["dirty"] = """
dirty AS (SELECT event_id, CASE WHEN device_id % 5 = 0 THEN replace(epc_code, '.', '-') ELSE epc_code END AS code,
  CASE WHEN device_id % 13 = 0 THEN 'not a time' ELSE strftime(event_time, '%Y-%m-%d %H:%M:%S') END AS t, CASE WHEN device_id % 17 = 0 THEN -location_id ELSE location_id END AS l FROM scans),
fixed AS (SELECT *, CASE WHEN NOT contains(code, '.') AND length(code) >= 40 THEN
  concat_ws('.', substr(code,1,3), substr(code,4,7), substr(code,11,7), substr(code,18,6), substr(code,24,8), substr(code,32)) WHEN contains(code, '-') THEN replace(upper(code), '-', '.') WHEN contains(code, '_') THEN replace(upper(code), '_', '.') ELSE code END AS new_code FROM dirty)"""


@query("I4_correct", """
SELECT event_id, new_code AS epc_code, CASE WHEN t = 'not a time' THEN NULL ELSE t END AS event_time, abs(l) AS location_id FROM fixed""", "dirty")
def _(spark, d):
    return en.correct(dirty(spark, d))[0].select("event_id", "epc_code", when().alias("event_time"), "location_id")


@query("I4_correction_log", """
SELECT event_id, 'epc_format' AS kind, code AS "before", new_code AS after FROM fixed WHERE code <> new_code
UNION ALL SELECT event_id, 'event_time', t, NULL FROM fixed WHERE t = 'not a time'
UNION ALL SELECT event_id, 'location_id', l::VARCHAR, abs(l)::VARCHAR FROM fixed WHERE l < 0""", "dirty")
def _(spark, d):
    return en.correct(dirty(spark, d))[1]


def _scaled(c, kind):
    if kind == "standard":
        return f"({c} - avg({c}) OVER ())/stddev_samp({c}) OVER ()"
    if kind == "minmax":
        return f"({c} - min({c}) OVER ())/(max({c}) OVER () - min({c}) OVER ())"
    return f"({c} - (SELECT quantile_cont({c}, 0.5) FROM scans))/(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM scans)"


@query("I5_scale", f"""
SELECT event_id, round({_scaled('location_id', 'standard')}, 5) AS location_id_scaled, round({_scaled('device_id', 'minmax')}, 5) AS device_id_scaled,
  round({_scaled('operator_id', 'robust')}, 5) AS operator_id_scaled FROM scans""")
def _(spark, d):
    df = en.scale(scans(spark, d), NUMERIC, {"location_id": "standard", "device_id": "minmax"})
    names = [f"{c}_scaled" for c in NUMERIC]
    return rounded(df, *names, digits=5).select("event_id", *names)


@query("I6_normalize_features", f"""
, tr AS (SELECT * FROM scans WHERE file_id < 3)
SELECT event_id, {', '.join(f"round(({c} - (SELECT quantile_cont({c}, 0.5) FROM tr))/(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM tr), 5) AS {c}" for c in NUMERIC)} FROM scans""")
def _(spark, d):
    df = scans(spark, d)
    return rounded(en.normalize_features(df.where("file_id < 3"), df, NUMERIC), *NUMERIC, digits=5).select("event_id", *NUMERIC)


@query("I7_encode_categoricals", """
, p AS (SELECT scan_location AS sl, row_number() OVER (ORDER BY scan_location) - 1 AS k FROM (SELECT DISTINCT scan_location FROM scans WHERE scan_location IS NOT NULL))
SELECT event_id, (event_type IS NOT DISTINCT FROM 'Outbound')::INT AS event_type_encoded, (business_step = 'Factory')::INT AS "business_step_Factory",
  (business_step = 'WMS')::INT AS "business_step_WMS", (business_step = 'Wholesaler')::INT AS "business_step_Wholesaler", (business_step = 'Retailer')::INT AS "business_step_Retailer",
  0 AS business_step_nan, coalesce(k, -1)::INT AS scan_location_encoded, round(count(*) OVER (PARTITION BY hub_type)/count(*) OVER (), 8) AS hub_type_frequency,
  CASE business_step WHEN 'Factory' THEN 1 WHEN 'WMS' THEN 2 END AS business_step_ordinal FROM scans LEFT JOIN p ON sl = scan_location""")
def _(spark, d):
    df = scans(spark, d).select("event_id", "event_type", "business_step", "scan_location", "hub_type")
    out = en.encode_categoricals(df, ["event_type", "business_step", "scan_location", "hub_type"])
    return rounded(out, "hub_type_frequency", digits=8).drop("event_type", "business_step", "scan_location", "hub_type")


@query("I8_variance_filter", "SELECT event_id, location_id, device_id FROM scans")
def _(spark, d):
    df = scans(spark, d).select("event_id", "location_id", "device_id", (F.col("event_id") * 0 + 1).alias("constant"))
    return en.variance_filter(df, ["location_id", "device_id", "constant"])[0]


@query("I9_vif", """
, r AS (SELECT corr(location_id, device_id) AS a, corr(location_id, operator_id) AS b, corr(device_id, operator_id) AS c FROM scans),
dt AS (SELECT *, 1 + 2*a*b*c - a*a - b*b - c*c AS det FROM r)
SELECT 'location_id' AS feature, round((1-c*c)/det, 6) AS vif, (1-c*c)/det > 10 AS high FROM dt UNION ALL SELECT 'device_id', round((1-b*b)/det, 6), (1-b*b)/det > 10 FROM dt
UNION ALL SELECT 'operator_id', round((1-a*a)/det, 6), (1-a*a)/det > 10 FROM dt""")
def _(spark, d):
    return rounded(en.vif(scans(spark, d), NUMERIC), "vif", digits=6)


@query("V14_vif_convergence")
def _(spark, d):
    return en.vif_convergence(scans(spark, d), NUMERIC, ["event_id"], [0.1, 0.2, 0.5, 1.0])


@query("I10_correlation_prune", "SELECT event_id, location_id, device_id, operator_id FROM scans")
def _(spark, d):
    df = scans(spark, d).withColumn("twin", F.col("location_id") * 2)
    return df.select("event_id", *en.correlation_prune(df, ["location_id", "twin", "device_id", "operator_id"]))


@query("I11_redundancy_report", "SELECT 4 AS features, 2 AS high_vif, 1 AS high_pairs, false AS should_reduce FROM scans LIMIT 1")
def _(spark, d):
    df = scans(spark, d).withColumn("twin", F.col("location_id") * 2 + F.col("device_id") % 2)
    return en.redundancy_report(df, [*NUMERIC, "twin"])


@query("I12_pca")
def _(spark, d):
    return rounded(en.pca(scans(spark, d), NUMERIC, 3)[1], "explained", "cumulative", "loading", digits=6)


@query("I13_cluster")
def _(spark, d):
    return en.cluster(scans(spark, d), NUMERIC, components=3).groupBy("cluster").agg(F.count("*").alias("events"))


@query("I14_feature_importance", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(coalesce(abs(corr({c}, (event_type IS NOT DISTINCT FROM 'Outbound')::INT)), 0), 6) AS importance FROM scans" for c in NUMERIC))
def _(spark, d):
    df = scans(spark, d).withColumn("label", F.col("event_type").eqNullSafe("Outbound").cast("int"))
    return rounded(en.feature_importance(df, NUMERIC), "importance", digits=6)

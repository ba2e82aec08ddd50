"""Samples, splits and set operations."""

from pyspark.sql import functions as F

from checks.base import SHARED, W, hot, query, scans, when
from checks.detection import findings
from checks.items import norm
from checks.journey import rounded
from scanwarden.operators import sampling as smp

KEY = ["event_id"]


def draw_sql(column="event_id", seed=42):
    return f"CAST('0x' || substr(md5({column} || '|{seed}'), 1, 12) AS BIGINT)"


@query("P1_stratified_sample", f"""
, r AS (SELECT event_id, row_number() OVER (PARTITION BY business_step, file_id ORDER BY {draw_sql()}, event_id) AS k,
  count(*) OVER (PARTITION BY business_step, file_id) AS n FROM scans)
SELECT event_id FROM r WHERE k <= greatest(500, floor(n*0.1))""")
def _(spark, d):
    return smp.stratified_sample(scans(spark, d), 0.1, ["business_step", "file_id"], KEY).select("event_id")


@query("P2_sampling_quality", f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY business_step ORDER BY {draw_sql()}, event_id) AS k, count(*) OVER (PARTITION BY business_step) AS n FROM scans),
s AS (SELECT * FROM r WHERE k <= greatest(500, floor(n*0.1))),
m AS (SELECT 'location_id' AS "column", (SELECT avg(location_id) FROM scans) AS f, (SELECT avg(location_id) FROM s) AS g
  UNION ALL SELECT 'device_id', (SELECT avg(device_id) FROM scans), (SELECT avg(device_id) FROM s))
SELECT "column", round(f, 6) AS full_mean, round(g, 6) AS sample_mean, round(abs(g-f)/abs(f), 6) AS relative_bias, round(abs(g-f), 6) AS wasserstein_if_flag FROM m""")
def _(spark, d):
    df = scans(spark, d)
    sample = smp.stratified_sample(df, 0.1, ["business_step"], KEY)
    return rounded(smp.sampling_quality(df, sample, ["location_id", "device_id"]), "full_mean", "sample_mean", "relative_bias", "wasserstein_if_flag", digits=6)


SPLIT = "(SELECT quantile_cont(epoch_us(event_time), 0.8) AS sp FROM scans)"
SHARED["split"] = f"""
timed AS (SELECT s.*, epoch_us(event_time) AS us, sp FROM scans s, {SPLIT}),
marked AS (SELECT *, us <= sp - 7*86400000000 AS early, us >= sp AS late, us BETWEEN sp - 7*86400000000 AND sp + 7*86400000000 AS near FROM timed),
per AS (SELECT epc_code, bool_or(near) OR (bool_or(early) AND bool_or(late)) AS b1, bool_or(early) AND bool_or(late) AS b2 FROM marked GROUP BY 1)"""


@query("P3_temporal_split", "SELECT event_id, CASE WHEN early THEN 'train' ELSE 'test' END AS split FROM marked WHERE early OR late", "split")
def _(spark, d):
    return smp.temporal_split(scans(spark, d)).select("event_id", "split")


@query("P4_epc_temporal_split", """
SELECT event_id, CASE WHEN b1 OR early THEN 'train' ELSE 'test' END AS split, b1 AS boundary FROM marked JOIN per USING (epc_code) WHERE b1 OR early OR late""", "split")
def _(spark, d):
    return smp.epc_temporal_split(scans(spark, d)).select("event_id", "split", "boundary")


@query("P5_epc_temporal_split_span", """
SELECT event_id, CASE WHEN b2 OR early THEN 'train' ELSE 'test' END AS split, b2 AS boundary FROM marked JOIN per USING (epc_code) WHERE b2 OR early OR late""", "split")
def _(spark, d):
    return smp.epc_temporal_split(scans(spark, d), variant="span").select("event_id", "split", "boundary")


@query("D34_split_report", """
, t AS (SELECT *, CASE WHEN b1 OR early THEN 'train' ELSE 'test' END AS split FROM marked JOIN per USING (epc_code) WHERE b1 OR early OR late)
SELECT split, count(*) AS "rows", count(DISTINCT epc_code) AS items, strftime(min(event_time), '%Y-%m-%d %H:%M:%S') AS first_time,
  strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS last_time, round(avg(b1::INT), 6) AS boundary_share, false AS overlap FROM t GROUP BY split""", "split")
def _(spark, d):
    df = smp.split_report(smp.epc_temporal_split(scans(spark, d)))
    return rounded(df, "boundary_share", digits=6).withColumns({c: when(c) for c in ("first_time", "last_time")})


@query("T2_split_overlap", "SELECT epc_code FROM scans WHERE false")
def _(spark, d):
    return smp.split_overlap(smp.epc_temporal_split(scans(spark, d)))


@query("P6_train_test_split", f"""
, r AS (SELECT event_id, business_step, row_number() OVER (PARTITION BY business_step ORDER BY {draw_sql()}, event_id) AS k, count(*) OVER (PARTITION BY business_step) AS n FROM scans)
SELECT event_id, CASE WHEN k <= floor(n*0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r""")
def _(spark, d):
    return smp.train_test_split(scans(spark, d), KEY, "business_step").select("event_id", "split")


@query("P7_file_split", f"""
, f AS (SELECT source_file, row_number() OVER (ORDER BY {draw_sql('source_file')}, source_file) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source_file FROM scans))
SELECT event_id, CASE WHEN k <= floor(n*0.8) THEN 'train' ELSE 'eval' END AS split FROM scans JOIN f USING (source_file)""")
def _(spark, d):
    return smp.file_split(scans(spark, d)).select("event_id", "split")


@query("P8_per_epc_sample", f"""
, r AS (SELECT event_id, row_number() OVER (PARTITION BY epc_code ORDER BY {draw_sql()}, event_id) AS k, (SELECT count(DISTINCT epc_code) FROM scans) AS n FROM scans),
s AS (SELECT event_id, row_number() OVER (ORDER BY {draw_sql()}, event_id) AS j FROM r WHERE k <= greatest(1, floor(20000/n)))
SELECT event_id FROM s WHERE j <= 20000""")
def _(spark, d):
    return smp.per_epc_sample(scans(spark, d), KEY).select("event_id")


FREQUENT = """
, c AS (SELECT epc_code, count(*) AS events, avg(location_id) AS center FROM scans GROUP BY 1),
fr AS (SELECT epc_code, events FROM (SELECT *, row_number() OVER (ORDER BY events DESC, epc_code) AS k, count(*) OVER () AS n FROM c) WHERE k <= ceil(n*0.05)),
qq AS (SELECT quantile_cont(center, 0.25) AS a, quantile_cont(center, 0.75) AS b FROM c),
sp AS (SELECT epc_code, center FROM c, qq WHERE center < a - 1.5*(b-a) OR center > b + 1.5*(b-a)),
pr AS (SELECT epc_code FROM fr UNION SELECT epc_code FROM sp)"""


@query("S4_top_frequency_epcs", FREQUENT + "SELECT * FROM fr")
def _(spark, d):
    return smp.top_frequency_epcs(scans(spark, d))


@query("S4_T5_priority_epcs", FREQUENT + "SELECT * FROM pr")
def _(spark, d):
    return smp.priority_epcs(scans(spark, d))


@query("C8_priority_rows", FREQUENT + "SELECT event_id FROM scans SEMI JOIN pr USING (epc_code)")
def _(spark, d):
    df = scans(spark, d)
    return df.join(smp.priority_epcs(df), "epc_code", "left_semi").select("event_id")


@query("C9_normal_events", "SELECT event_id FROM scans ANTI JOIN findings USING (event_id)", "dated prev found")
def _(spark, d):
    keys = ["file_id", "epc_code", "event_id"]
    return scans(spark, d).join(findings(spark, d), keys, "left_anti").select("event_id")


@query("P9_priority_subset", FREQUENT + f"""
, f AS (SELECT event_id, event_type = 'Outbound' AS flag FROM scans SEMI JOIN pr USING (epc_code)),
r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY {draw_sql()}, event_id) AS k, count(*) OVER (PARTITION BY flag) AS n, count(*) OVER () AS t FROM f)
SELECT event_id FROM r WHERE k <= CASE WHEN t <= 2000 THEN n ELSE floor(n*2000/t) END""")
def _(spark, d):
    df = scans(spark, d).withColumn("flag", F.col("event_type") == "Outbound")
    return smp.priority_subset(df, smp.priority_epcs(df), 2000, KEY, "flag").select("event_id")


@query("P10_oversample_weights", """
, f AS (SELECT event_id, (location_id % 5 = 0)::INT AS a, (device_id % 10 = 0)::INT AS b FROM scans),
c AS (SELECT count(*) AS n, sum(a) AS pa, sum(b) AS pb FROM f)
SELECT event_id, round(coalesce(greatest(CASE WHEN a = 1 THEN (n-pa)/pa END, CASE WHEN b = 1 THEN (n-pb)/pb END), 1), 6) AS weight FROM f, c""")
def _(spark, d):
    df = scans(spark, d).select("event_id", (F.col("location_id") % 5 == 0).cast("int").alias("a"), (F.col("device_id") % 10 == 0).cast("int").alias("b"))
    return rounded(smp.oversample_weights(df, ["a", "b"]), "weight", digits=6).select("event_id", "weight")


@query("P11_stratified_kfold", f"""
SELECT event_id, CAST(row_number() OVER (PARTITION BY business_step ORDER BY {draw_sql()}, event_id) % 5 AS INTEGER) AS fold FROM scans""")
def _(spark, d):
    return smp.stratified_kfold(scans(spark, d), KEY, "business_step").select("event_id", "fold")


@query("T1_union_of_files", "SELECT file_id, count(*) AS events FROM scans GROUP BY 1")
def _(spark, d):
    df = scans(spark, d)
    low = df.where(F.col("file_id") < 2)
    return low.unionByName(df.where((F.col("file_id") >= 2) | F.col("file_id").isNull())).groupBy("file_id").agg(F.count("*").alias("events"))


@query("T4_distinct_items", "SELECT DISTINCT file_id, epc_code FROM scans")
def _(spark, d):
    return scans(spark, d).select("file_id", "epc_code").distinct()


@query("C1_location_map_join", """
, m AS (SELECT location_id, min(scan_location) AS name FROM scans WHERE location_id % 5 <> 0 GROUP BY 1)
SELECT event_id, coalesce(name, CAST(location_id AS VARCHAR)) AS place FROM scans LEFT JOIN m USING (location_id)""")
def _(spark, d):
    from scanwarden.operators import lookups

    df = scans(spark, d)
    names = df.where(F.col("location_id") % 5 != 0).groupBy("location_id").agg(F.min("scan_location").alias("scan_location"))
    return lookups.with_location_names(df.drop("scan_location"), names).select("event_id", F.col("scan_location").alias("place"))


@query("C4_item_aggregate_back_join", """
SELECT event_id, count(*) OVER p AS item_events, count(DISTINCT location_id) OVER p AS item_locations FROM scans WINDOW p AS (PARTITION BY file_id, epc_code)""")
def _(spark, d):
    from scanwarden.operators import lookups

    return lookups.with_item_diversity(scans(spark, d), {"location_id": "item_locations"}).select("event_id", "item_events", "item_locations")


@query("C5_product_stats_back_join", f"""
, g AS (SELECT *, p_name AS product_name FROM gaps LEFT JOIN part ON p_partkey = l_partkey),
s AS (SELECT product_name AS pn, count(DISTINCT location_id) AS product_locations, avg(gap) AS m FROM g GROUP BY 1)
SELECT event_id, product_locations, round(m, 4) AS product_gap_mean FROM g JOIN s ON product_name IS NOT DISTINCT FROM pn""", "gaps")
def _(spark, d):
    from scanwarden.operators import lookups

    df = lookups.with_product_stats(scans(spark, d, product=True), hot=hot(spark, d))
    return rounded(df, "product_gap_mean").select("event_id", "product_locations", "product_gap_mean")


@query("C6_value_count_lookups", """
, o AS (SELECT operator_id, count(DISTINCT location_id) AS k FROM scans GROUP BY 1)
SELECT event_id, count(*) OVER (PARTITION BY location_id) AS location_frequency, round(1/count(*) OVER (PARTITION BY location_id), 8) AS location_rarity_score, k AS operator_locations
FROM scans JOIN o USING (operator_id)""")
def _(spark, d):
    from scanwarden.operators import lookups

    df = lookups.with_value_counts(scans(spark, d))
    return rounded(df, "location_rarity_score", digits=8).select("event_id", "location_frequency", "location_rarity_score", "operator_locations")


@query("C10_finding_event_join", """
SELECT s.event_id, f.d AS item_dup FROM scans s JOIN dup_scores f USING (file_id, epc_code) WHERE f.d > 0""", "dated norm dups")
def _(spark, d):
    from scanwarden.operators import detect_epc as det
    from scanwarden.operators import lookups

    found = det.epc_duplicate(norm(spark, d)).where(F.col("epcDup") > 0)
    return lookups.findings_on_events(scans(spark, d), found).select("event_id", F.col("epcDup").alias("item_dup"))


@query("C11_same_time_events", """
SELECT event_id, count(*) OVER t AS same_time_events, count(DISTINCT scan_location) OVER t AS same_time_places FROM scans
WINDOW t AS (PARTITION BY file_id, epc_code, event_time)""")
def _(spark, d):
    from scanwarden.operators import lookups

    return lookups.with_same_time(scans(spark, d)).select("event_id", "same_time_events", "same_time_places")

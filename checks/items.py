"""Rules per item, travel and place statistics."""

from pyspark.sql import functions as F

from checks.base import W, direction_sql, hot, level_sql, place_step_sql, query, scans, when
from checks.base import SHARED
from scanwarden import constants as C
from scanwarden.operators import detect_epc as det
from scanwarden.operators import transitions as tr
from scanwarden.skew import broadcast_if_small
from scanwarden.sources.table_scans import as_of

SHARED["norm"] = f"""
norm AS (
  SELECT * REPLACE (coalesce(event_type, 'UNKNOWN') AS event_type, coalesce(scan_location, 'UNKNOWN_LOCATION') AS scan_location)
  FROM scored),
steps AS (
  SELECT *, {level_sql('scan_location')} AS level, lag({level_sql('scan_location')}) OVER w AS p_level,
    lag(scan_location) OVER w AS p_place, lead(scan_location) OVER w AS n_place,
    (epoch_us(event_time) - epoch_us(lag(event_time) OVER w))/3.6e9 AS gap_h,
    row_number() OVER w AS pos, count(*) OVER (PARTITION BY file_id, epc_code) AS total
  FROM norm WINDOW w AS (PARTITION BY file_id, epc_code ORDER BY event_time, event_id)),
trans AS (
  SELECT p_place AS f, scan_location AS t, avg(gap_h) AS mean, stddev_samp(gap_h) AS std, min(gap_h) AS lo,
    max(gap_h) AS hi, count(*) AS n FROM steps WHERE p_place IS NOT NULL GROUP BY ALL)"""
SHARED["jumps"] = """
geo AS (SELECT DISTINCT scan_location AS place, latitude AS la, longitude AS lo FROM scans WHERE scan_location IS NOT NULL),
jumped AS (
  SELECT s.*, CASE WHEN trans.f IS NULL THEN NULL WHEN gap_h < 0 THEN 95
    WHEN p_place <> scan_location AND a.la IS NOT NULL AND b.la IS NOT NULL AND
      2*6371*asin(sqrt(pow(sin((radians(b.la)-radians(a.la))/2),2)
        + cos(radians(a.la))*cos(radians(b.la))*pow(sin((radians(b.lo)-radians(a.lo))/2),2)))/100 > gap_h THEN 95
    WHEN mean = 0 OR coalesce(std, 0) = 0 THEN 0
    WHEN abs(gap_h-mean)/std <= 2 THEN 0 WHEN abs(gap_h-mean)/std <= 3 THEN 60 WHEN abs(gap_h-mean)/std <= 4 THEN 80
    ELSE 95 END AS j
  FROM steps s LEFT JOIN trans ON p_place = trans.f AND scan_location = trans.t
    LEFT JOIN geo a ON p_place = a.place LEFT JOIN geo b ON scan_location = b.place)"""


def runs_sql(source: str, column: str) -> str:
    """Points of runs of the same direction and step, by islands."""
    return f"""
runs0 AS (SELECT *, {direction_sql(column)} AS way, {place_step_sql(column)} AS spot FROM {source}),
runs1 AS (SELECT *, CASE WHEN way = lag(way) OVER w AND spot = lag(spot) OVER w THEN 0 ELSE 1 END AS fresh
  FROM runs0 WINDOW w AS (PARTITION BY file_id, epc_code ORDER BY event_time, event_id)),
runs2 AS (SELECT *, sum(fresh) OVER {W} AS island FROM runs1),
runs3 AS (SELECT *, row_number() OVER (PARTITION BY file_id, epc_code, island ORDER BY event_time, event_id) AS k FROM runs2),
order_scores AS (SELECT file_id, epc_code, CAST(least(100, sum(CASE WHEN way IN ('inbound','outbound') AND k > 1
  THEN 25 + CASE WHEN k >= 3 THEN (k-2)*15 ELSE 0 END ELSE 0 END)) AS INTEGER) AS o FROM runs3 GROUP BY ALL)"""


SHARED["runs_raw"] = runs_sql("scans", "event_type_raw")
SHARED["runs_norm"] = runs_sql("(SELECT * REPLACE (coalesce(event_type_raw,'UNKNOWN') AS event_type_raw) FROM norm)", "event_type_raw")
SHARED["dups"] = """
dup_scores AS (SELECT file_id, epc_code, max(CASE WHEN k > 1 THEN least(100, 80 + 10*(k-1)) ELSE 0 END)::INTEGER AS d FROM
  (SELECT file_id, epc_code, event_time, count(DISTINCT scan_location) AS k FROM norm GROUP BY ALL) GROUP BY ALL)"""


def norm(spark, d, product=False):
    return det.normalize_scans(scans(spark, d, product))


def norm_raw(spark, d, product=False):
    """Scans whose event types name the place, as in scan files."""
    return det.normalize_scans(scans(spark, d, product).drop("event_type").withColumnRenamed("event_type_raw", "event_type"))


def transitions(spark, d):
    return broadcast_if_small(tr.build_transition_stats(norm(spark, d), hot=hot(spark, d)))


def geo(spark, d):
    places = scans(spark, d).where(F.col("scan_location").isNotNull())
    places = places.groupBy("scan_location").agg(F.first("latitude").alias("Latitude"), F.first("longitude").alias("Longitude"))
    return broadcast_if_small(places)


@query("D18_transition_stats", """
SELECT f AS from_scan_location, t AS to_scan_location, round(mean, 4) AS time_taken_hours_mean,
  round(std, 4) AS time_taken_hours_std, lo AS time_taken_hours_min, hi AS time_taken_hours_max,
  n AS time_taken_hours_count FROM trans""", "dated norm")
def _(spark, d):
    df = tr.build_transition_stats(norm(spark, d), hot=hot(spark, d))
    return df.withColumns({c: F.round(c, 4) for c in ("time_taken_hours_mean", "time_taken_hours_std")})


@query("D19_transition_probabilities", f"""
SELECT f AS from_value, t AS to_value, n AS moves, round(n / sum(n) OVER (PARTITION BY f), 6) AS probability FROM (
  SELECT p AS f, location_id AS t, count(*) AS n FROM (SELECT location_id, lag(location_id) OVER {W} AS p FROM scans)
  WHERE p IS NOT NULL GROUP BY ALL)""")
def _(spark, d):
    return tr.transition_probabilities(scans(spark, d), hot=hot(spark, d)).withColumn("probability", F.round("probability", 6))


@query("C7_transition_probability_lookup", f"""
, m AS (SELECT *, lag(location_id) OVER {W} AS p FROM scans),
pr AS (SELECT p AS f, location_id AS t, count(*) / sum(count(*)) OVER (PARTITION BY p) AS pb FROM m WHERE p IS NOT NULL GROUP BY p, location_id)
SELECT event_id, round(coalesce(pb, 0), 6) AS transition_probability, CAST(coalesce(pb, 0) < 0.01 AS INTEGER) AS rare_transition
FROM m LEFT JOIN pr ON p = f AND location_id = t""")
def _(spark, d):
    df = scans(spark, d)
    table = broadcast_if_small(tr.transition_probabilities(df, hot=hot(spark, d)))
    out = tr.with_transition_probability(df, table, hot=hot(spark, d))
    return out.select("event_id", F.round("transition_probability", 6).alias("transition_probability"), "rare_transition")


@query("E1_epc_jump", """
SELECT file_id, epc_code, CAST(coalesce(max(j), 0) AS INTEGER) AS jump, min(CASE WHEN j > 0 THEN pos - 1 END) AS first_step
FROM jumped GROUP BY ALL""", "dated norm jumps")
def _(spark, d):
    return det.epc_jump(norm(spark, d), transitions(spark, d), geo(spark, d), hot=hot(spark, d))


@query("C2_C3_travel_per_event", "SELECT event_id, CAST(j AS INTEGER) AS jump FROM jumped WHERE j IS NOT NULL", "dated norm jumps")
def _(spark, d):
    df = det.travel_scores(norm(spark, d), transitions(spark, d), geo(spark, d), hot=hot(spark, d))
    return df.where(F.col("_jump").isNotNull()).select("event_id", F.col("_jump").alias("jump"))


@query("E2_epc_duplicate", 'SELECT file_id, epc_code, d AS "epcDup" FROM dup_scores', "dated norm dups")
def _(spark, d):
    return det.epc_duplicate(norm(spark, d))


@query("E3_epc_event_order", 'SELECT file_id, epc_code, o AS "evtOrderErr" FROM order_scores', "runs_raw")
def _(spark, d):
    return det.epc_event_order(scans(spark, d), type_column="event_type_raw", hot=hot(spark, d))


LOC_SQL = """SELECT file_id, epc_code, CAST(least(100, sum(CASE WHEN p_level IS NULL THEN 0 ELSE
  CASE WHEN level = 99 THEN 20 ELSE 0 END + CASE WHEN p_level = 99 THEN 20 ELSE 0 END
  + CASE WHEN level <> 99 AND p_level <> 99 AND level < p_level THEN 30 ELSE 0 END END)) AS INTEGER) AS l
FROM steps GROUP BY ALL"""


@query("E4_epc_location_error", f'SELECT file_id, epc_code, l AS "locErr" FROM ({LOC_SQL})', "dated norm")
def _(spark, d):
    return det.epc_location_error(norm(spark, d), hot=hot(spark, d))


SHARED["items"] = f"""
loc_scores AS ({LOC_SQL}),
item0 AS (
  SELECT j.file_id, j.epc_code, any_value(j.total) AS total, any_value(j.fake) AS fake, any_value(d) AS d, any_value(o) AS o, any_value(l) AS l,
    coalesce(max(j.j), 0)::INTEGER AS jmp, min(CASE WHEN j.j > 0 THEN pos - 1 END) AS jat
  FROM jumped j JOIN dup_scores USING (file_id, epc_code) JOIN order_scores USING (file_id, epc_code)
    JOIN loc_scores USING (file_id, epc_code) GROUP BY ALL),
item1 AS (
  SELECT *, greatest(fake, d, jmp, o, l) AS top,
    least(CASE WHEN jat IS NOT NULL THEN jat WHEN fake > 0 THEN 0 WHEN d > 0 THEN 1 ELSE total // 2 END, total - 1) AS spot
  FROM item0),
items AS (
  SELECT i.*, CASE WHEN fake = top THEN 'epcFake' WHEN d = top THEN 'epcDup' WHEN jmp = top THEN 'jump'
      WHEN o = top THEN 'evtOrderErr' ELSE 'locErr' END AS primary_type,
    concat_ws(',', CASE WHEN fake > 0 THEN 'epcFake' END, CASE WHEN d > 0 THEN 'epcDup' END, CASE WHEN jmp > 0 THEN 'jump' END,
      CASE WHEN o > 0 THEN 'evtOrderErr' END, CASE WHEN l > 0 THEN 'locErr' END) AS types,
    CASE WHEN jat IS NOT NULL AND jat < total - 1 THEN s.scan_location || '_to_' || s.n_place
      WHEN jat IS NOT NULL THEN 'Step_' || jat || '_issue' WHEN fake > 0 THEN 'EPC_Format_Error'
      WHEN d > 0 THEN 'Duplicate_Scan_Error' ELSE 'General_Analysis' END AS problem,
    s.scan_location AS place, s.event_time AS at_time, s.business_step AS step
  FROM item1 i JOIN (SELECT file_id AS f2, epc_code AS e2, pos, scan_location, n_place, event_time, business_step FROM steps) s
    ON s.f2 = i.file_id AND s.e2 = i.epc_code AND s.pos = spot + 1 WHERE top > 0)"""

SENTENCES = {
    "epcFake": "'EPC 코드 형식 위반 감지'", "epcDup": "'동일 시간 다른 위치 중복 스캔 감지'",
    "jump": "place || '에서 비논리적 시간점프 이동 발생'", "evtOrderErr": "step || ' 이벤트 순서 오류'",
    "locErr": "'위치 계층 순서 위반'"}
SENTENCE_SQL = "CASE primary_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SENTENCES.items()) + " END"


def item_findings(spark, d, **options):
    return det.detect_epc(norm_raw(spark, d), as_of(), transitions(spark, d), geo(spark, d), hot=hot(spark, d), **options)


@query("E5_detect_epc", f"""
SELECT file_id, epc_code, fake AS "epcFake", d AS "epcDup", jmp AS jump, o AS "evtOrderErr", l AS "locErr",
  primary_type AS "primaryAnomaly", types AS "anomalyTypes", CAST(spot + 1 AS INTEGER) AS "sequencePosition",
  CAST(total AS INTEGER) AS "totalSequenceLength", problem AS "problemStep", step AS "businessStep", place AS "scanLocation",
  strftime(at_time, '%Y-%m-%d %H:%M:%S') AS "eventTime", {SENTENCE_SQL} AS description
FROM items""", "dated norm jumps runs_norm dups items")
def _(spark, d):
    df = item_findings(spark, d).drop("anomalyScores", "productName", "anomalyType")
    return df.withColumn("anomalyTypes", F.concat_ws(",", "anomalyTypes"))


def _count(code):
    return f"CAST(count(*) FILTER (contains(types, '{code}')) AS BIGINT) AS \"{code}Count\""


@query("D3_summary_stats", f"""
SELECT {', '.join(_count(t) for t in C.STATS_TYPES)},
  CAST(count(*) FILTER (contains(types, ',')) AS BIGINT) AS "multiAnomalyCount", count(*) AS "totalAnomalyCount" FROM items""",
       "dated norm jumps runs_norm dups items")
def _(spark, d):
    return det.summary_stats(item_findings(spark, d))


@query("D18_transition_input_normalized", """
SELECT event_id, epc_code, event_type, scan_location, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time_rounded FROM norm""",
       "dated norm")
def _(spark, d):
    return norm(spark, d).select("event_id", "epc_code", "event_type", "scan_location", when("event_time_rounded").alias("event_time_rounded"))


QUANT = """
, g AS (SELECT file_id, epc_code, greatest((epoch_us(event_time) - epoch_us(lag(event_time) OVER w))/3.6e9, 0) AS gap,
    lag(event_time) OVER w AS p FROM scans WINDOW w AS (PARTITION BY file_id, epc_code ORDER BY event_time, event_id)),
z AS (SELECT file_id, epc_code, count(p) AS n, avg(CASE WHEN p IS NOT NULL THEN gap END) AS m, stddev_pop(CASE WHEN p IS NOT NULL THEN gap END) AS s,
    min(CASE WHEN p IS NOT NULL THEN gap END) AS lo, max(CASE WHEN p IS NOT NULL THEN gap END) AS hi FROM g GROUP BY ALL),
zz AS (SELECT *, CASE WHEN n > 1 AND s > 1e-9 THEN greatest(hi-m, m-lo)/s ELSE 0 END AS zs FROM z)
"""

for _variant, _score in {
    "bands": "CASE WHEN zs > 4 THEN least(100, zs*20) WHEN zs > 3 THEN least(80, zs*15) WHEN zs > 2 THEN least(60, zs*10) ELSE 0 END",
    "simple": "CASE WHEN zs > 2 THEN least(100, zs*20) ELSE 0 END",
    "range": "CASE WHEN n > 0 AND (lo < 0.1 OR hi > 168) THEN CASE WHEN hi > 24 THEN least(50, hi/24*10) WHEN lo < 0.1 THEN 30 ELSE 0 END ELSE 0 END",
}.items():
    @query(f"E25_statistical_jump_{_variant}", QUANT + f"SELECT file_id, epc_code, round(CAST({_score} AS DOUBLE), 4) AS jump_stat FROM zz")
    def _(spark, d, variant=_variant):
        return det.statistical_jump(scans(spark, d), variant, hot=hot(spark, d)).withColumn("jump_stat", F.round("jump_stat", 4))

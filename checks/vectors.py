"""Feature rows and sequences."""

from pyspark.sql import functions as F

from checks.base import AS_OF_SQL, PARTS, SHARED, W, direction_sql, hot, level_sql, place_step_sql, query, scans, when
from checks.items import norm, norm_raw
from checks.journey import rounded
from checks.profiles import ENTROPY_SQL
from scanwarden.functions import moves
from scanwarden.operators import features as fe
from scanwarden.plans import table_functions
from scanwarden.sources.table_scans import as_of


def rounded_all(df, names, digits=4):
    return rounded(df, *names, digits=digits)


@query("H1_fake_features", f"""
SELECT DISTINCT file_id, epc_code, (len(p)=6)::INT::DOUBLE AS structure_valid, (len(p)=6 AND p[1]='001')::INT::DOUBLE AS header_valid,
  (len(p)=6 AND p[2] IN ('8804823','8805843','8809437'))::INT::DOUBLE AS company_valid,
  (len(p)=6 AND regexp_full_match(p[3],'[0-9]{{7}}'))::INT::DOUBLE AS product_valid, (len(p)=6 AND regexp_full_match(p[4],'[0-9]{{6}}'))::INT::DOUBLE AS lot_valid,
  (len(p)=6 AND regexp_full_match(p[6],'[0-9]{{9}}'))::INT::DOUBLE AS serial_valid, (dstat='valid')::INT::DOUBLE AS date_valid,
  (dstat='future_date')::INT::DOUBLE AS date_future, (dstat='too_old')::INT::DOUBLE AS date_old, round(least(length(epc_code)/100.0, 1), 4)::DOUBLE AS epc_length
FROM (SELECT *, {PARTS} AS p FROM dated)""", "dated")
def _(spark, d):
    return rounded(fe.fake_features(scans(spark, d), as_of()), "epc_length")


@query("H2_dup_features", """
SELECT file_id, epc_code, count(*)::DOUBLE AS event_count, count(DISTINCT scan_location)::DOUBLE AS unique_locations,
  count(DISTINCT event_type)::DOUBLE AS unique_event_types, round(least((epoch_us(max(event_time))-epoch_us(min(event_time)))/3.6e9/168, 1), 4) AS time_span,
  round(least(coalesce(avg(gap0)/3600, 0)/24, 1), 4) AS avg_gap, round(least(coalesce(max(gap0)/3600, 0)/48, 1), 4) AS max_gap,
  round(1 - count(DISTINCT scan_location)/count(*), 4) AS location_repetition, round(1 - count(DISTINCT event_type)/count(*), 4) AS event_type_repetition
FROM gaps GROUP BY ALL""", "gaps")
def _(spark, d):
    return rounded_all(fe.dup_features(scans(spark, d), hot=hot(spark, d)), fe.DUP[3:])


STAGE = """CASE WHEN event_type_raw = 'Aggregation' THEN 1 WHEN event_type_raw LIKE 'WMS_%' OR event_type_raw LIKE 'HUB_%' OR event_type_raw LIKE 'W_Stock%' THEN 2
  WHEN event_type_raw LIKE 'R_Stock%' OR event_type_raw = 'POS_Sell' THEN 3 END"""
SHARED["kinds"] = f"""
kinds0 AS (SELECT *, {direction_sql('event_type_raw')} || '/' || {place_step_sql('event_type_raw')} AS kind, {STAGE} AS stage FROM scans),
kinds AS (SELECT *, {', '.join(f'lag(kind, {n}) OVER w AS x{n}' for n in range(1, 8))}, lag(stage) OVER w AS p_stage,
  (epoch_us(event_time) - epoch_us(lag(event_time) OVER w))/3.6e9 AS gap_h, row_number() OVER w - 1 AS pos FROM kinds0
  WINDOW w AS (PARTITION BY file_id, epc_code ORDER BY event_time, event_id))"""


def _rep(k):
    xs = ["kind"] + [f"x{n}" for n in range(1, 8)]
    return "coalesce(" + " AND ".join(f"{xs[t]} = {xs[t + k]}" for t in range(k)) + ", false)"


@query("H3_order_features", f"""
, bits AS (SELECT file_id, epc_code, -sum(n/total*log2(n/total)) + 0 AS bits FROM (SELECT file_id, epc_code, count(*)::DOUBLE AS n,
  sum(count(*)) OVER (PARTITION BY file_id, epc_code) AS total FROM kinds GROUP BY file_id, epc_code, kind) GROUP BY ALL),
a AS (SELECT file_id, epc_code, count(*) AS n, count(DISTINCT event_type_raw) AS types, count(DISTINCT x1 || '>' || kind) AS pairs,
  count(*) FILTER (stage < p_stage) AS backward, count(*) FILTER (gap_h < 0) AS disorder, max(abs(gap_h)) AS gap,
  count(*) FILTER (stage = 1) AS s1, count(*) FILTER (stage = 2) AS s2, count(*) FILTER (stage = 3) AS s3,
  {', '.join(f'count(*) FILTER ({_rep(k)}) AS r{k}' for k in range(1, 5))} FROM kinds GROUP BY ALL)
SELECT file_id, epc_code, n::DOUBLE AS sequence_length, types::DOUBLE AS unique_event_types, pairs::DOUBLE AS transition_count,
  backward::DOUBLE AS backward_transitions, disorder::DOUBLE AS temporal_disorder, round(least(coalesce(gap, 0)/168, 1), 4) AS max_gap,
  round(s1/n, 4) AS production_ratio, round(s2/n, 4) AS logistics_ratio, round(s3/n, 4) AS retail_ratio, round(bits, 4) + 0 AS event_entropy,
  round(CASE WHEN n < 2 THEN 1 ELSE coalesce(greatest({', '.join(f'CASE WHEN n // 2 >= {k} THEN r{k}/(n-{k}) END' for k in range(1, 5))}), 0) END, 4) AS regularity,
  round((backward + disorder)/n, 4) AS violation_density FROM a JOIN bits USING (file_id, epc_code)""", "kinds")
def _(spark, d):
    return rounded_all(fe.order_features(scans(spark, d), type_column="event_type_raw", hot=hot(spark, d)), fe.ORDER[5:])


@query("H4_location_features", f"""
, b AS (SELECT *, CASE WHEN level = 99 THEN -1 ELSE level END AS lv, CASE WHEN p_level = 99 THEN -1 ELSE p_level END AS pl, CASE WHEN level <> 99 THEN level END AS k FROM steps),
c AS (SELECT *, CASE WHEN lv >= 0 AND pl >= 0 THEN lv - pl END AS st, k - last_value(k IGNORE NULLS) OVER
  (PARTITION BY file_id, epc_code ORDER BY event_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mv FROM b),
bits AS (SELECT file_id, epc_code, CASE WHEN count(*) > 1 THEN -sum(n/total*log2(n/total))/log2(count(*)) ELSE -sum(n/total*log2(n/total)) END + 0 AS bits
  FROM (SELECT file_id, epc_code, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY file_id, epc_code) AS total FROM norm GROUP BY file_id, epc_code, scan_location) GROUP BY ALL),
a AS (SELECT file_id, epc_code, count(*) AS n, count(k) AS known, count(DISTINCT scan_location) AS places, count(*) FILTER (lv < 0) AS unknown,
  count(*) FILTER (st < -1 OR st > 2) AS viol, count(*) FILTER (st < -1) AS rev, coalesce(max(abs(st)), 0) AS jump,
  count(*) FILTER (lv=0) AS l0, count(*) FILTER (lv=1) AS l1, count(*) FILTER (lv=2) AS l2, count(*) FILTER (lv=3) AS l3,
  count(*) FILTER (abs(mv) <= 1) AS smooth, var_pop(mv) AS spread FROM c GROUP BY ALL)
SELECT file_id, epc_code, n::DOUBLE AS sequence_length, places::DOUBLE AS unique_locations, viol::DOUBLE AS hierarchy_violations, unknown::DOUBLE AS unknown_locations,
  rev::DOUBLE AS reverse_transitions, round(least(jump/3.0, 1), 4)::DOUBLE AS max_hierarchy_jump,
  {', '.join(f'round(CASE WHEN known > 0 THEN l{i}/known ELSE 0 END, 4) AS level{i}_ratio' for i in range(4))}, round(bits::DOUBLE, 4) AS location_entropy,
  round(CASE WHEN n < 2 THEN 1 WHEN known < 2 THEN 0 ELSE smooth/(known-1) END, 4) AS hierarchy_consistency, round(least(places/n, 1), 4) AS geographic_scatter,
  round(CASE WHEN n < 3 THEN 1 WHEN known < 3 THEN 0 ELSE 1/(1+spread) END, 4) AS transition_regularity, round((viol + unknown)/n, 4) AS anomaly_density
FROM a JOIN bits USING (file_id, epc_code)""", "dated norm")
def _(spark, d):
    return rounded_all(fe.location_features(norm(spark, d), hot=hot(spark, d)), fe.LOCATION[5:])


@query("H5_jump_features", """
, g AS (SELECT *, gap0/3600 AS g FROM gaps),
q AS (SELECT file_id, epc_code, quantile_cont(g, 0.25) AS a, quantile_cont(g, 0.75) AS b FROM g WHERE g IS NOT NULL GROUP BY ALL),
k AS (SELECT file_id, epc_code, count(*) AS kept, avg(g) AS m, stddev_pop(g) AS s FROM g JOIN q USING (file_id, epc_code)
  WHERE g BETWEEN a - (b-a)*1.5 AND b + (b-a)*1.5 GROUP BY ALL),
t AS (SELECT file_id, epc_code, count(*) AS n, (epoch_us(max(event_time))-epoch_us(min(event_time)))/3.6e9 AS span, avg(g) AS mean, max(g) AS top, min(g) AS low,
  var_samp(g) AS v, count(*) FILTER (g > 168) AS far, count(*) FILTER (g < 0) AS neg, count(*) FILTER (g = 0) AS zero FROM g GROUP BY ALL)
SELECT file_id, epc_code, n::DOUBLE AS sequence_length, round(least(span/168, 1), 4) AS time_span, round(least(coalesce(mean, 0)/24, 1), 4) AS avg_gap,
  round(least(coalesce(top, 0)/168, 1), 4) AS max_gap, round(greatest(coalesce(low, 0), 0), 4) AS min_gap, round(least(coalesce(v, 0)/576, 1), 9) AS gap_variance,
  far::DOUBLE AS impossible_jumps, neg::DOUBLE AS negative_gaps, zero::DOUBLE AS zero_gaps,
  round(CASE WHEN n < 3 THEN 1 WHEN coalesce(kept, 0) < 2 THEN 0 WHEN m = 0 THEN 0 ELSE 1/(1+s/m) END, 4) AS time_regularity
FROM t LEFT JOIN k USING (file_id, epc_code)""", "gaps")
def _(spark, d):
    df = rounded(fe.jump_features(scans(spark, d), hot=hot(spark, d)), "gap_variance", digits=9)
    return rounded_all(df, [n for n in fe.JUMP if n not in ("sequence_length", "gap_variance")])


@query("H6_location_features_per_event", f"""
, b AS (SELECT *, CASE WHEN {level_sql('scan_location')} = 99 THEN -1 ELSE {level_sql('scan_location')} END AS l FROM norm),
c AS (SELECT *, lag(l) OVER w AS p, lead(l) OVER w AS nx, count(*) OVER (PARTITION BY file_id, epc_code) AS n FROM b
  WINDOW w AS (PARTITION BY file_id, epc_code ORDER BY event_time, event_id)),
e AS (SELECT *, CASE WHEN l <> -1 AND p <> -1 THEN l - p ELSE 0 END AS bk, CASE WHEN l <> -1 AND nx <> -1 THEN nx - l ELSE 0 END AS ah FROM c)
SELECT file_id, epc_code, event_id, l::DOUBLE AS current_level, coalesce(p, -2)::DOUBLE AS prev_level, coalesce(nx, -2)::DOUBLE AS next_level, bk::DOUBLE AS change_from_prev,
  ah::DOUBLE AS change_to_next, (bk < -1)::INT::DOUBLE AS is_reverse, (abs(bk) > 2)::INT::DOUBLE AS is_big_jump, (p IS NULL)::INT::DOUBLE AS is_first,
  (nx IS NULL)::INT::DOUBLE AS is_last, n::DOUBLE AS sequence_length FROM e""", "dated norm")
def _(spark, d):
    return fe.location_features_per_event(norm(spark, d), hot=hot(spark, d))


@query("H7_jump_features_per_event", f"""
, c AS (SELECT *, (epoch_us(event_time) - epoch_us(lag(event_time) OVER w))/3.6e9 AS p, (epoch_us(lead(event_time) OVER w) - epoch_us(event_time))/3.6e9 AS nx,
  row_number() OVER w AS pos, count(*) OVER k AS n, (epoch_us(max(event_time) OVER k) - epoch_us(min(event_time) OVER k))/3.6e9 AS span FROM scans
  WINDOW w AS (PARTITION BY file_id, epc_code ORDER BY event_time, event_id), k AS (PARTITION BY file_id, epc_code)),
e AS (SELECT *, avg(p) OVER (PARTITION BY file_id, epc_code) AS m FROM c)
SELECT file_id, epc_code, event_id, round(coalesce(p, 0), 4) AS time_from_prev, round(coalesce(nx, 0), 4) AS time_to_next,
  round(CASE WHEN n = 1 THEN 0.5 ELSE (pos-1)/(n-1) END, 4) AS relative_position, n::DOUBLE AS sequence_length, round(span, 4) AS time_span,
  round(coalesce(m, 0), 4) AS avg_gap, (pos = 1)::INT::DOUBLE AS is_first, (pos = n)::INT::DOUBLE AS is_last FROM e""")
def _(spark, d):
    return rounded_all(fe.jump_features_per_event(scans(spark, d), hot=hot(spark, d)), ("time_from_prev", "time_to_next", "relative_position", "time_span", "avg_gap"))


NAMED = "CASE {} WHEN 1 THEN 'production' WHEN 2 THEN 'logistics' WHEN 3 THEN 'retail' END"


@query("H8_order_violations", f"""
SELECT file_id, epc_code, event_id, pos AS position, {NAMED.format('p_stage')} AS from_stage, {NAMED.format('stage')} AS to_stage,
  event_type_raw AS event_type, scan_location FROM kinds WHERE stage < p_stage""", "kinds")
def _(spark, d):
    return fe.order_violations(scans(spark, d), type_column="event_type_raw", hot=hot(spark, d))


@query("S6_most_common_violation", f"""
, m AS (SELECT file_id, epc_code, {NAMED.format('p_stage')} || '->' || {NAMED.format('stage')} AS mv, count(*) AS n FROM kinds WHERE stage < p_stage GROUP BY ALL)
SELECT file_id, epc_code, first(mv ORDER BY n DESC, mv) AS most_common_violation, CAST(sum(n) AS BIGINT) AS violation_count FROM m GROUP BY ALL""", "kinds")
def _(spark, d):
    return fe.most_common_violation(fe.order_violations(scans(spark, d), type_column="event_type_raw", hot=hot(spark, d)))


@query("H9_location_violations", """
, b AS (SELECT *, pos - 1 AS position, level - p_level AS j FROM steps WHERE level <> 99 AND p_level <> 99)
SELECT file_id, epc_code, event_id, position, p_place AS from_location, scan_location AS to_location, p_level AS from_level, level AS to_level,
  j AS level_jump, CASE WHEN abs(j) > 2 THEN 'big_jump' ELSE 'reverse_jump' END AS violation_type FROM b WHERE abs(j) > 2 OR j < -1""", "dated norm")
def _(spark, d):
    return fe.location_violations(norm(spark, d), hot=hot(spark, d))


@query("H10_gap_anomalies", """
SELECT file_id, epc_code, event_id, pos AS position, gap_h AS gap_hours, CASE WHEN gap_h > 168 THEN 'long' WHEN gap_h < 0 THEN 'negative' ELSE 'zero' END AS kind
FROM kinds WHERE gap_h > 168 OR gap_h <= 0""", "kinds")
def _(spark, d):
    return fe.gap_anomalies(scans(spark, d), hot=hot(spark, d))


CELLS = ["location_id", "device_id", "operator_id"]
FLAGS = ["is_outbound"]


def flagged(spark, d):
    return scans(spark, d).withColumn("is_outbound", F.coalesce(F.col("event_type") == "Outbound", F.lit(False)))


def _listed(df, more=()):
    text = F.array_join(F.transform("sequence", lambda r: F.array_join(F.transform(r, lambda x: x.cast("long").cast("string")), ",")), ";")
    return df.select("event_id", text.alias("sequence"), F.array_join("label", ",").alias("label"), F.col("sequence_length").cast("int").alias("sequence_length"),
                     when("sequence_start").alias("sequence_start"), *more)


def windows_sql(length, least):
    return f"""
, t AS (SELECT *, count(*) OVER k AS n, epoch_us(max(event_time) OVER k) - epoch_us(min(event_time) OVER k) AS us, row_number() OVER w AS pos
  FROM scans WINDOW w AS (PARTITION BY file_id, epc_code ORDER BY event_time, event_id), k AS (PARTITION BY file_id, epc_code)),
l AS (SELECT *, CAST({length} AS INTEGER) AS len,
  list(location_id || ',' || device_id || ',' || operator_id) OVER w AS cells, list(event_time) OVER w AS times FROM t
  WINDOW w AS (PARTITION BY file_id, epc_code ORDER BY event_time, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW))
SELECT event_id, array_to_string(cells[-len:], ';') AS sequence, CASE WHEN event_type = 'Outbound' THEN '1' ELSE '0' END AS label, len AS sequence_length,
  strftime(times[-len], '%Y-%m-%d %H:%M:%S') AS sequence_start FROM l WHERE n >= {least} AND pos >= len"""


@query("H11_sequences", windows_sql("CASE WHEN n/greatest(floor(us/8.64e10), 1) > 5 THEN least(6, n) ELSE least(4, n) END", 2))
def _(spark, d):
    return _listed(fe.sequences(flagged(spark, d), CELLS, FLAGS, base=4, longest=6, hot=hot(spark, d)))


@query("H12_sequences_adaptive", windows_sql(
    "CASE WHEN n/greatest(us/3.6e9, 1) > 5 THEN least(6, n) WHEN n/greatest(us/3.6e9, 1) < 1 THEN greatest(3, least(4, n)) ELSE least(4, n) END", 3))
def _(spark, d):
    return _listed(fe.sequences_adaptive(flagged(spark, d), CELLS, FLAGS, base=4, least=3, longest=6, hot=hot(spark, d)))


@query("H13_sequences_fixed", windows_sql("5", 5))
def _(spark, d):
    return _listed(fe.sequences_fixed(flagged(spark, d), CELLS, FLAGS, length=5, hot=hot(spark, d)))


@query("H14_recent_padded", """
, l AS (SELECT file_id, epc_code, list(location_id || ',' || device_id ORDER BY event_time, event_id) AS c FROM scans GROUP BY ALL)
SELECT file_id, epc_code, array_to_string(list_transform(range(greatest(5 - len(c), 0)), lambda x: '0,0') || c[-5:], ';') AS sequence FROM l""")
def _(spark, d):
    df = fe.recent_padded(scans(spark, d), CELLS[:2], 5, hot=hot(spark, d))
    text = F.array_join(F.transform("sequence", lambda r: F.array_join(F.transform(r, lambda x: x.cast("long").cast("string")), ",")), ";")
    return df.select("file_id", "epc_code", text.alias("sequence"))


@query("S5_latest_sequence", """
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY file_id, epc_code ORDER BY event_time DESC, event_id DESC) AS r FROM scans) WHERE r <= 3""")
def _(spark, d):
    return fe.latest_events(scans(spark, d), 3, hot=hot(spark, d)).select("event_id")


@query("H15_feature_matrix", """
SELECT event_id, location_id::DOUBLE AS location_id, device_id::DOUBLE AS device_id, coalesce(length(scan_location), 0)::DOUBLE AS name_length FROM scans""")
def _(spark, d):
    df = scans(spark, d).select("event_id", "location_id", "device_id", F.length("scan_location").alias("name_length"), F.lit(7).alias("constant"))
    return fe.feature_matrix(df, ["location_id", "device_id", "name_length", "constant"])[0]


@query("H16_epc_embedding")
def _(spark, d):
    df = fe.epc_embedding(scans(spark, d), hot=hot(spark, d))
    return df.select("file_id", "epc_code", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"))


@query("H17_run_features", f"""
, w1 AS (SELECT *, avg(gap) OVER k AS m, stddev_samp(gap) OVER k AS s, count(*) OVER k AS n, row_number() OVER w AS pos,
   lag(location_id) OVER w AS p, lag(hub_type) OVER w AS ph FROM gaps
   WINDOW w AS (PARTITION BY file_id, epc_code ORDER BY event_time, event_id), k AS (PARTITION BY file_id, epc_code))
SELECT event_id, gap AS time_gap_seconds, round(CASE WHEN s > 0 THEN (gap-m)/s ELSE 0 END, 4) AS time_gap_zscore, pos AS scan_position, n AS total_scans,
  CAST(p IS DISTINCT FROM location_id AS INTEGER) AS location_changed, CAST(ph IS DISTINCT FROM hub_type AS INTEGER) AS hub_type_changed,
  CAST(hour(event_time) AS INTEGER) AS hour, round(ln(1+gap), 4) AS time_gap_log, round(e::DOUBLE, 4) AS location_entropy
FROM w1 JOIN (SELECT file_id AS f2, epc_code AS e2, CASE WHEN any_value(total) < 3 THEN 0 ELSE -sum(t) END AS e FROM (SELECT *, {ENTROPY_SQL['smoothed'][0]} AS t FROM (
  SELECT *, c/total AS p FROM (SELECT file_id, epc_code, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY file_id, epc_code) AS total,
    count(*) OVER (PARTITION BY file_id, epc_code) AS k FROM scans GROUP BY file_id, epc_code, location_id))) GROUP BY ALL) ON f2 = file_id AND e2 = epc_code""", "gaps")
def _(spark, d):
    df = fe.run_features(scans(spark, d), hot=hot(spark, d))
    return rounded(df, "time_gap_zscore", "time_gap_log", "location_entropy").select(
        "event_id", "time_gap_seconds", "time_gap_zscore", "scan_position", "total_scans", "location_changed", "hub_type_changed", "hour",
        "time_gap_log", "location_entropy")


@query("U4_order_violations_sql", f"""
SELECT file_id, epc_code, event_id, pos AS position, {NAMED.format('p_stage')} AS from_stage, {NAMED.format('stage')} AS to_stage,
  event_type_raw AS event_type, scan_location FROM kinds WHERE stage < p_stage""", "kinds")
def _(spark, d):
    table_functions.register_table_functions(spark)
    rows = moves.with_event_kind(scans(spark, d), "event_type_raw")
    rows = rows.withColumn("stage", moves.stage_of_kind(F.col("_kind"))).withColumn("stage_rank", moves.stage_rank(F.col("stage")))
    rows.select("file_id", "epc_code", "event_id", "event_time", "stage", "stage_rank", F.col("event_type_raw").alias("event_type"), "scan_location").createOrReplaceTempView("staged_scans")
    return spark.sql("SELECT * FROM order_violations(TABLE(staged_scans))")


@query("U4_location_violations_sql", """
, b AS (SELECT *, pos - 1 AS position, level - p_level AS j FROM steps WHERE level <> 99 AND p_level <> 99)
SELECT file_id, epc_code, event_id, position, p_place AS from_location, scan_location AS to_location, p_level AS from_level, level AS to_level,
  j AS level_jump, CASE WHEN abs(j) > 2 THEN 'big_jump' ELSE 'reverse_jump' END AS violation_type FROM b WHERE abs(j) > 2 OR j < -1""", "dated norm")
def _(spark, d):
    table_functions.register_table_functions(spark)
    fe._levels(norm(spark, d)).select("file_id", "epc_code", "event_id", "event_time", "scan_location", F.col("_level").alias("level")).createOrReplaceTempView("levelled_scans")
    return spark.sql("SELECT * FROM location_violations(TABLE(levelled_scans))")

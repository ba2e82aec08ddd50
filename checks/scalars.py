"""Column expressions."""

from pyspark.sql import functions as F

from checks.base import AS_OF_SQL, FAKE_SQL, PARTS, W, direction_sql, hot, level_sql, place_step_sql, query, scans, when
from scanwarden import constants as C
from scanwarden.functions import clock, epc, moves, sequences, verdicts
from scanwarden.operators import windows as win
from scanwarden.sources.table_scans import as_of


def items(spark, d):
    return scans(spark, d).select("file_id", "epc_code").distinct()


ITEM = "SELECT DISTINCT file_id, epc_code FROM scans"


@query("B1_epc_parts", f"""
SELECT epc_code, len(p) = 6 AS structure, len(p) = 6 AND p[1] = '001' AS header,
  len(p) = 6 AND p[2] IN ('8804823','8805843','8809437') AS company, len(p) = 6 AND regexp_full_match(p[3], '[0-9]{{7}}') AS product,
  len(p) = 6 AND regexp_full_match(p[4], '[0-9]{{6}}') AS lot, len(p) = 6 AND regexp_full_match(p[6], '[0-9]{{9}}') AS serial
FROM (SELECT epc_code, {PARTS} AS p FROM ({ITEM}))""".replace("AND p[1]", "AND p[1]"))
def _(spark, d):
    return items(spark, d).select("epc_code", epc.epc_parts(F.col("epc_code")).alias("p")).select("epc_code", "p.*")


@query("B2_mfg_date_status", "SELECT DISTINCT epc_code, dstat AS status FROM dated", "dated")
def _(spark, d):
    return items(spark, d).select("epc_code", epc.epc_date_status(F.col("epc_code"), as_of()).alias("status"))


@query("B3_epc_fake_score", "SELECT DISTINCT epc_code, fake AS score FROM scored", "dated")
def _(spark, d):
    return items(spark, d).select("epc_code", epc.epc_fake_score(F.col("epc_code"), as_of()).alias("score"))


KM_SQL = """2*6371*asin(sqrt(pow(sin((radians(latitude)-radians(la))/2),2)
  + cos(radians(la))*cos(radians(latitude))*pow(sin((radians(longitude)-radians(lo))/2),2)))"""


@query("B4_haversine_km", f"""
SELECT event_id, round({KM_SQL}, 4) AS km FROM (SELECT *, lag(latitude) OVER {W} AS la, lag(longitude) OVER {W} AS lo FROM scans)
WHERE la IS NOT NULL""")
def _(spark, d):
    df = win.over_sequence(scans(spark, d), lambda x, s: x.withColumns({"la": s.back("latitude"), "lo": s.back("longitude")}), hot=hot(spark, d))
    km = moves.haversine_km(F.col("la"), F.col("lo"), F.col("latitude"), F.col("longitude"))
    return df.where(F.col("la").isNotNull()).select("event_id", F.round(km, 4).alias("km"))


@query("B5_jump_score", f"""
, g AS (SELECT event_id, (epoch_us(event_time) - epoch_us(lag(event_time) OVER {W}))/3.6e9 AS gap, location_id AS l FROM scans)
SELECT event_id, CAST(CASE WHEN gap < 0 OR (l*3.0)/100 > gap THEN 95 WHEN abs(gap-5)/2.0 <= 2 THEN 0 WHEN abs(gap-5)/2.0 <= 3 THEN 60
  WHEN abs(gap-5)/2.0 <= 4 THEN 80 ELSE 95 END AS INTEGER) AS score FROM g WHERE gap IS NOT NULL""")
def _(spark, d):
    df = win.over_sequence(scans(spark, d), lambda x, s: x.withColumn(
        "gap", clock.hours_between(F.col("event_time"), s.back("event_time"))), hot=hot(spark, d))
    score = moves.jump_score(F.col("gap"), F.lit(5.0), F.lit(2.0), F.col("location_id") * 3.0)
    return df.where(F.col("gap").isNotNull()).select("event_id", score.alias("score"))


@query("B6_classify_event", f"""
SELECT event_id, {direction_sql('event_type_raw')} AS direction, {place_step_sql('event_type_raw')} AS step FROM scans""")
def _(spark, d):
    return scans(spark, d).select("event_id", moves.classify_event(F.col("event_type_raw")).alias("k")).select("event_id", "k.*")


@query("B7_location_level", f"SELECT event_id, {level_sql('scan_location')} AS level FROM scans")
def _(spark, d):
    return scans(spark, d).select("event_id", moves.location_level(F.col("scan_location")).alias("level"))


@query("B8_severity", """
SELECT DISTINCT epc_code, CASE WHEN fake >= 70 THEN 'HIGH' WHEN fake >= 40 THEN 'MEDIUM' WHEN fake >= 20 THEN 'LOW' ELSE 'NORMAL' END AS severity
FROM scored""", "dated")
def _(spark, d):
    scored = epc.with_fake_score(items(spark, d), as_of(), "fake")
    return scored.select("epc_code", verdicts.severity(F.col("fake")).alias("severity"))


@query("B10_location_name", "SELECT event_id, coalesce(scan_location, CAST(location_id AS VARCHAR)) AS place FROM scans")
def _(spark, d):
    return scans(spark, d).select("event_id", moves.location_name(F.col("scan_location"), F.col("location_id")).alias("place"))


@query("B11_strict_epc_format", f"""
SELECT epc_code, regexp_full_match(epc_code, '[0-9]{{3}}\\.[0-9]{{7}}\\.[0-9]{{7}}\\.[0-9]{{6}}\\.[0-9]{{8}}\\.[0-9]{{9}}') AS strict FROM ({ITEM})""")
def _(spark, d):
    return items(spark, d).select("epc_code", epc.strict_epc_format(F.col("epc_code")).alias("strict"))


@query("B12_repair_epc", f"""
, broken AS (SELECT epc_code, CASE WHEN file_id = 0 THEN replace(epc_code, '.', '') WHEN file_id = 1 THEN replace(epc_code, '.', '-')
  WHEN file_id = 2 THEN lower(epc_code) ELSE replace(epc_code, '.', ',') END AS b FROM ({ITEM})),
u AS (SELECT *, upper(trim(b)) AS t FROM broken)
SELECT epc_code, b AS broken, CASE WHEN NOT contains(t, '.') AND length(t) >= 40 THEN
    concat_ws('.', substr(t,1,3), substr(t,4,7), substr(t,11,7), substr(t,18,6), substr(t,24,8), substr(t,32))
  WHEN contains(t, '-') THEN replace(t, '-', '.') WHEN contains(t, '_') THEN replace(t, '_', '.')
  WHEN contains(t, ' ') THEN replace(t, ' ', '.') WHEN contains(t, ',') THEN replace(t, ',', '.') ELSE b END AS fixed FROM u""")
def _(spark, d):
    file, code = F.col("file_id"), F.col("epc_code")
    broken = (F.when(file == 0, F.translate(code, ".", "")).when(file == 1, F.translate(code, ".", "-"))
              .when(file == 2, F.lower(code)).otherwise(F.translate(code, ".", ",")))
    return items(spark, d).select("epc_code", broken.alias("broken")).withColumn("fixed", epc.repair_epc(F.col("broken")))


@query("B13_business_step_ordinal", """
SELECT event_id, CASE business_step WHEN 'Factory' THEN 1 WHEN 'WMS' THEN 2 ELSE 99 END AS basic,
  CASE business_step WHEN 'Factory' THEN 1 WHEN 'WMS' THEN 2 ELSE 0 END AS retail,
  CASE business_step WHEN 'Factory' THEN 1 WHEN 'WMS' THEN 2 END AS customer FROM scans""")
def _(spark, d):
    step = F.col("business_step")
    return scans(spark, d).select("event_id", *[moves.business_step_ordinal(step, v).alias(v) for v in ("basic", "retail", "customer")])


@query("B14_calendar_features", """
, h AS (SELECT event_id, CAST(hour(event_time) AS INTEGER) AS hour, CAST(isodow(event_time) - 1 AS INTEGER) AS day_of_week,
  CAST(day(event_time) AS INTEGER) AS day_of_month, CAST(month(event_time) AS INTEGER) AS month FROM scans)
SELECT *, CAST(day_of_week >= 5 AS INTEGER) AS is_weekend, CAST(hour BETWEEN 9 AND 17 AS INTEGER) AS is_business_hour,
  CAST(hour BETWEEN 8 AND 18 AS INTEGER) AS business_eight, CAST(hour <= 5 OR hour >= 22 AS INTEGER) AS is_night FROM h""")
def _(spark, d):
    t = F.col("event_time")
    eight = clock.calendar(t, "eight_to_six")["is_business_hour"].alias("business_eight")
    return scans(spark, d).select("event_id", *[c.alias(n) for n, c in clock.calendar(t).items()], eight)


@query("B15_cyclic_time", """
SELECT event_id, round(sin(2*pi()*hour(event_time)/24), 6) AS hour_sin, round(cos(2*pi()*hour(event_time)/24), 6) AS hour_cos,
  round(sin(2*pi()*(isodow(event_time)-1)/7), 6) AS dow_sin, round(cos(2*pi()*(isodow(event_time)-1)/7), 6) AS dow_cos FROM scans""")
def _(spark, d):
    return scans(spark, d).select("event_id", *[F.round(c, 6).alias(n) for n, c in clock.cyclic(F.col("event_time")).items()])


@query("B16_time_cluster", """
SELECT event_id, CASE WHEN h = 0 THEN NULL WHEN h <= 6 THEN 'Night' WHEN h <= 12 THEN 'Morning' WHEN h <= 18 THEN 'Afternoon' ELSE 'Evening' END AS cluster
FROM (SELECT event_id, hour(event_time) AS h FROM scans)""")
def _(spark, d):
    return scans(spark, d).select("event_id", clock.time_cluster(F.hour("event_time")).alias("cluster"))


@query("B17_days_since_manufacture", """
SELECT event_id, CAST(floor((epoch(event_time) - epoch(manufacture_date))/86400) AS BIGINT) AS days,
  CAST(event_time < manufacture_date AS INTEGER) AS early FROM scans""")
def _(spark, d):
    t, m = F.col("event_time"), F.col("manufacture_date")
    return scans(spark, d).select("event_id", clock.days_since_manufacture(t, m).alias("days"), clock.scan_before_manufacture(t, m).alias("early"))


@query("B18_log_gap", "SELECT event_id, round(ln(1 + gap), 6) AS time_gap_log FROM gaps", "gaps")
def _(spark, d):
    df = win.time_gap(scans(spark, d), hot=hot(spark, d))
    return df.select("event_id", F.round(clock.log_gap(F.col("time_gap_seconds")), 6).alias("time_gap_log"))


PROBS = {t: f"CAST((event_id // {p}) % 100 AS DOUBLE)/100" for t, p in zip(C.STATS_TYPES, (1, 7, 49, 343, 2401))}



def _any(level):
    return " OR ".join(f"{PROBS[t]} >= {cut}" for t, cut in C.ALERT_CUTS[level].items())


@query("B20_alert_level", f"""
SELECT event_id, CASE WHEN {_any('HIGH')} THEN 'HIGH' WHEN {_any('MEDIUM')} THEN 'MEDIUM' WHEN {_any('LOW')} THEN 'LOW' END AS alert FROM scans""")
def _(spark, d):
    probs = {t: F.expr(f"CAST((event_id div {p}) % 100 AS DOUBLE)/100") for t, p in zip(C.STATS_TYPES, (1, 7, 49, 343, 2401))}
    return scans(spark, d).select("event_id", verdicts.alert_level(probs).alias("alert"))


@query("B21_risk_level", """
SELECT event_id, CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.6 THEN 'medium' ELSE 'low' END AS three,
  CASE WHEN p >= 0.8 THEN 'HIGH' WHEN p >= 0.5 THEN 'MEDIUM' WHEN p >= 0.2 THEN 'LOW' ELSE 'NORMAL' END AS four
FROM (SELECT event_id, (event_id % 100)/100.0::DOUBLE AS p FROM scans)""")
def _(spark, d):
    p = F.col("event_id") % 100 / 100.0
    return scans(spark, d).select("event_id", verdicts.risk_level(p).alias("three"), verdicts.risk_level(p, "four").alias("four"))


@query("B22_drop_future", f"SELECT event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time FROM scans WHERE event_time <= {AS_OF_SQL}")
def _(spark, d):
    return verdicts.drop_future(scans(spark, d), as_of()).select("event_id", when().alias("event_time"))


@query("B22_future_flag", f"SELECT event_id, CAST(event_time > {AS_OF_SQL} AS INTEGER) AS is_future FROM scans")
def _(spark, d):
    return scans(spark, d).select("event_id", verdicts.future_flag(F.col("event_time"), as_of()).alias("is_future"))


@query("B23_finding_description", """
, t AS (SELECT event_id, scan_location, business_step, CASE event_id % 5 WHEN 0 THEN 'epcFake' WHEN 1 THEN 'epcDup' WHEN 2 THEN 'jump'
  WHEN 3 THEN 'evtOrderErr' ELSE 'locErr' END AS p FROM scans)
SELECT event_id, CASE p WHEN 'epcFake' THEN 'EPC 형식 위반' WHEN 'epcDup' THEN '불가능한 중복 스캔' WHEN 'jump' THEN '비논리적인 시공간 이동'
  WHEN 'evtOrderErr' THEN '이벤트 순서 오류' ELSE '위치 계층 위반' END AS name,
  CASE p WHEN 'epcFake' THEN 'EPC 코드 형식 위반 감지' WHEN 'epcDup' THEN '동일 시간 다른 위치 중복 스캔 감지'
  WHEN 'jump' THEN coalesce(scan_location, '') || '에서 비논리적 시간점프 이동 발생' WHEN 'evtOrderErr' THEN business_step || ' 이벤트 순서 오류'
  ELSE '위치 계층 순서 위반' END AS sentence FROM t""")
def _(spark, d):
    n = F.col("event_id") % 5
    kind = F.when(n == 0, "epcFake").when(n == 1, "epcDup").when(n == 2, "jump").when(n == 3, "evtOrderErr").otherwise("locErr")
    return scans(spark, d).withColumn("p", kind).select(
        "event_id", verdicts.type_name(F.col("p")).alias("name"),
        verdicts.finding_description(F.col("p"), F.col("scan_location"), F.col("business_step")).alias("sentence"))


@query("B24_recommendations", """
, t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'epcFake' WHEN 1 THEN 'epcDup' WHEN 2 THEN 'jump' WHEN 3 THEN 'evtOrderErr' ELSE 'locErr' END AS p,
  CASE WHEN location_id % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS r,
  CASE location_id % 4 WHEN 0 THEN 'Time gap' WHEN 1 THEN 'Location change' WHEN 2 THEN 'Business hours' ELSE 'Scan frequency' END AS f FROM scans)
SELECT event_id, concat_ws('; ', CASE WHEN r = 'HIGH' THEN 'Investigate ' || CASE p WHEN 'epcFake' THEN 'counterfeit product detection'
    WHEN 'epcDup' THEN 'impossible duplicate scanning' WHEN 'locErr' THEN 'supply chain flow violations'
    WHEN 'evtOrderErr' THEN 'event sequence anomalies' ELSE 'impossible travel time detection' END END,
  CASE f WHEN 'Time gap' THEN 'Review scanning timing patterns and procedures' WHEN 'Location change' THEN 'Verify supply chain route and location compliance'
    WHEN 'Business hours' THEN 'Check for unauthorized after-hours activities' ELSE 'Analyze scanning frequency for operational issues' END,
  CASE p WHEN 'epcFake' THEN 'Verify product authenticity and EPC format compliance' WHEN 'epcDup' THEN 'Check for duplicate scanning equipment or procedures'
    WHEN 'jump' THEN 'Investigate impossible travel times between locations' WHEN 'locErr' THEN 'Review supply chain flow and location hierarchy'
    ELSE 'Examine event sequencing and timing issues' END) AS advice FROM t""")
def _(spark, d):
    n = F.col("event_id") % 5
    kind = F.when(n == 0, "epcFake").when(n == 1, "epcDup").when(n == 2, "jump").when(n == 3, "evtOrderErr").otherwise("locErr")
    m = F.col("location_id") % 4
    factor = F.when(m == 0, "Time gap").when(m == 1, "Location change").when(m == 2, "Business hours").otherwise("Scan frequency")
    risk = F.when(F.col("location_id") % 3 == 0, "HIGH").otherwise("LOW")
    advice = verdicts.recommendations(kind, risk, F.array(factor, factor))
    return scans(spark, d).select("event_id", F.array_join(advice, "; ").alias("advice"))


@query("B19_fit_sequence_length", f"""
, s AS (SELECT event_id, list(CAST(location_id AS DOUBLE)) OVER (PARTITION BY file_id, epc_code ORDER BY event_time, event_id
  ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS a FROM scans),
f AS (SELECT *, len(a) AS n FROM s)
SELECT event_id, array_to_string(CASE WHEN n <= 4 THEN list_transform(a || list_transform(range(4 - n), lambda x: list_aggregate(a, 'median')), lambda x: printf('%.3f', x))
  ELSE list_transform(range(4), lambda i: printf('%.3f', CASE WHEN i = 3 THEN a[n] ELSE
    a[CAST(floor(i*(n-1)/3.0) AS BIGINT)+1] * (1 - (i*(n-1)/3.0 - floor(i*(n-1)/3.0)))
    + a[least(CAST(floor(i*(n-1)/3.0) AS BIGINT)+2, n)] * (i*(n-1)/3.0 - floor(i*(n-1)/3.0)) END)) END, ',') AS fitted FROM f""")
def _(spark, d):
    rows = win.over_sequence(scans(spark, d), lambda x, s: x.withColumn(
        "a", F.collect_list(F.col("location_id").cast("double")).over(s.recent(8))), before=8, hot=hot(spark, d))
    fitted = sequences.fit_sequence_length(F.col("a"), 4, "median")
    return rows.select("event_id", F.array_join(F.transform(fitted, lambda x: F.format_string("%.3f", x)), ",").alias("fitted"))

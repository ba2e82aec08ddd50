"""What is written and read back, and streams over the scans that are drained once: equal to the tables they come from."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import SQL, query, scans, when
from checks.detection import findings
from checks.drifts import FEATURES, sides
from checks.journey import rounded
from checks.models import CHANCE, scored
from checks.thresholds import training
from scanwarden import constants as C
from scanwarden import schemas
from scanwarden.operators import detect_epc
from scanwarden.operators import drift as dr
from scanwarden.operators import features as fe
from scanwarden.session import shared_folder
from scanwarden.sources import findings_log, scan_files, training_sets
from scanwarden.sources.table_scans import as_of
from scanwarden.streaming import findings as accounted
from scanwarden.streaming import jobs, sketches, vectors
from scanwarden.streaming.in_order import prepare

TIMES = "yyyy-MM-dd HH:mm:ss"
TIME_SQL = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


# ---- files ----------------------------------------------------------------------------------------

def scan_table(spark: SparkSession, d: str) -> DataFrame:
    """The scans with the columns of a scan file."""
    df = scans(spark, d, product=True)
    part = F.split("epc_code", "[.]")
    names = ("epc_header", "epc_company", "epc_product", "epc_lot", "epc_manufacture", "epc_serial")
    df = df.withColumns({n: F.get(part, F.lit(i)) for i, n in enumerate(names)} | {"expiry_date": F.lit(None).cast("string")})
    return df.select(*schemas.SCAN.names, "source_file")


def scan_folder(spark: SparkSession, d: str) -> str:
    path = shared_folder(spark)
    table = scan_table(spark, d).drop("source_file")
    table.write.csv(path, sep="\t", header=True, timestampFormat=TIMES)
    return path


SCAN_FILE_SQL = ("SELECT epc_code, location_id, scan_location, business_step, event_type, operator_id, device_id, hub_type, "
                 f"{TIME_SQL.format('event_time')}, {TIME_SQL.format('manufacture_date')}")


def picked(df: DataFrame, *more) -> DataFrame:
    return df.select("epc_code", "location_id", "scan_location", "business_step", "event_type", "operator_id", "device_id", "hub_type",
                     when().alias("event_time"), when("manufacture_date").alias("manufacture_date"), *more)


@query("A1_read_scans", SCAN_FILE_SQL + " FROM scans")
def _(spark, d):
    return picked(scan_files.read_scans(spark, scan_folder(spark, d)))


@query("A2_read_scans_tagged", SCAN_FILE_SQL + ", true AS tagged FROM scans")
def _(spark, d):
    tagged = scan_files.read_scans_tagged(spark, scan_folder(spark, d))
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return picked(tagged, (F.concat("source_file", F.lit(".csv")) == name).alias("tagged"))


@query("A3_read_validated", SCAN_FILE_SQL + """ FROM scans WHERE regexp_full_match(epc_code, '[0-9]{3}([.][0-9]+){5}')""")
def _(spark, d):
    """The scans in two folders with different headers, and a third without a required column."""
    path, table = shared_folder(spark), scan_table(spark, d).drop("source_file")
    odd = F.col("location_id") % 2 == 1
    parts = {"a": table.where(odd), "b": table.where(~odd).select(*reversed(table.columns)), "c": table.drop("event_type")}
    for name, part in parts.items():
        part.write.csv(f"{path}/{name}", sep="\t", header=True, timestampFormat=TIMES, compression="gzip")
    return picked(scan_files.read_validated(spark, [f"{path}/{name}" for name in parts]))


@query("A7_load_dimensions", """
SELECT DISTINCT location_id, scan_location, latitude AS "Latitude", longitude AS "Longitude", 0 AS missing FROM scans""")
def _(spark, d):
    path = shared_folder(spark)
    geo = scans(spark, d).select("location_id", "scan_location", F.col("latitude").alias("Latitude"), F.col("longitude").alias("Longitude"))
    geo.distinct().write.csv(f"{path}/geo.csv", header=True)
    found = scan_files.load_dimensions(spark, path)
    absent = found["transitions"].agg(F.count("*").cast("int").alias("missing"))
    return found["geo"].crossJoin(F.broadcast(absent))


@query("A9_latest_findings", """SELECT event_id, f_fake AS "epcFake", f_dup AS "epcDup", 'second' AS run_id FROM findings""", "dated prev found")
def _(spark, d):
    path, events = shared_folder(spark), scans(spark, d)
    found = findings(spark, d)
    findings_log.write_findings_log(found.where(F.col("file_id") == 0), events, path, "first", as_of())
    findings_log.write_findings_log(found, events, path, "second", as_of() + F.expr("INTERVAL 1 DAY"))
    newest = findings_log.latest_findings(spark, path)
    return newest.select("event_id", *[F.coalesce(F.col(t), F.lit(False)).alias(t) for t in ("epcFake", "epcDup")], "run_id")


@query("A8_run_written_again", """SELECT 'run' AS run_id, count(*) AS findings, count(DISTINCT event_id) AS events FROM findings""", "dated prev found")
def _(spark, d):
    """A run that is written in part, then whole: the second attempt is the run."""
    path, events, found = shared_folder(spark), scans(spark, d), findings(spark, d)
    findings_log.write_findings_log(found.where(F.col("file_id") == 0), events, path, "run", as_of())
    findings_log.write_findings_log(found, events, path, "run", as_of())
    return findings_log.logged_findings(spark, path).groupBy("run_id").agg(F.count("*").alias("findings"), F.count_distinct("event_id").alias("events"))


def stored(spark: SparkSession, d: str) -> str:
    path = shared_folder(spark)
    training_sets.write_training_set(training(spark, d), path, "epcFake", fe.FAKE, as_of())
    return path


@query("A11_A12_training_set", """
SELECT DISTINCT file_id, epc_code, CAST(fake >= 50 AS INTEGER) AS label, fake::DOUBLE AS score, 10 AS dimensions FROM scored""", "dated")
def _(spark, d):
    path = stored(spark, d)
    parts = [training_sets.read_training_set(spark, path, "epcFake", split) for split in ("train", "test")]
    return parts[0].unionByName(parts[1]).select("file_id", "epc_code", "label", "score", F.size("features").alias("dimensions"))


@query("A13_training_set_catalog", """
, i AS (SELECT DISTINCT file_id, epc_code, fake FROM scored)
SELECT 1::BIGINT AS sets, count(*) AS samples, round(avg((fake >= 50)::INT), 6)::DOUBLE AS mean_positive_ratio, 10 AS min_dimensions, 10 AS max_dimensions FROM i""", "dated")
def _(spark, d):
    return rounded(training_sets.training_set_catalog(spark, stored(spark, d)), "mean_positive_ratio", digits=6)


@query("A14_check_training_set", "SELECT count(*) > 0 AS rows_ok, true AS dimensions_ok, true AS labels_ok FROM scans")
def _(spark, d):
    return training_sets.check_training_set(spark, stored(spark, d), "epcFake")


@query("B9_normalize_scans", f"""
SELECT event_id, upper(trim(epc_code)) AS epc_code, coalesce(event_type, 'UNKNOWN') AS event_type, coalesce(scan_location, 'UNKNOWN_LOCATION') AS scan_location,
  strftime(date_trunc('second', event_time), '%Y-%m-%d %H:%M:%S') AS event_time_rounded FROM scans""")
def _(spark, d):
    out = detect_epc.normalize_scans(scans(spark, d))
    return out.select("event_id", "epc_code", "event_type", "scan_location", when("event_time_rounded").alias("event_time_rounded"))


# ---- streams --------------------------------------------------------------------------------------

END = "2100-01-01 00:00:00"
DELAY = "8000 days"  # longer than the scans last, shorter than from their end to END: nothing is late, all of it is emitted


def stream(spark: SparkSession, d: str, df: DataFrame | None = None) -> DataFrame:
    """The scans as a stream of files in order of time; a last row moves the watermark past them."""
    path, df = shared_folder(spark), scans(spark, d) if df is None else df
    df.repartitionByRange("event_time").write.parquet(path)
    last = df.limit(1).withColumns({"event_time": F.lit(END).cast("timestamp"), "epc_code": F.lit("END"), "event_id": F.lit(-1).cast("long")})
    last.write.mode("append").parquet(path)
    return jobs.stream_events(spark, path, df.schema, delay=DELAY)


def drained(frame: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream until its files are read; each micro-batch goes to a folder of its own."""
    spark, out = frame.sparkSession, shared_folder(frame.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    job = frame.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out).drop("batch")


@query("O1_stream_events", f"SELECT event_id, epc_code, location_id, {TIME_SQL.format('event_time')} FROM scans")
def _(spark, d):
    out = drained(stream(spark, d).select("event_id", "epc_code", "location_id", "event_time"))
    return out.where(F.col("epc_code") != "END").withColumn("event_time", when())


_LEVEL = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'{CHANCE[t]} >= {cut}' for t, cut in cuts.items())} THEN '{level}'" for level, cuts in C.ALERT_CUTS.items()) + " END"


def alerts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.stream_alerts(stream(spark, d, scored(spark, d)))


@query("O2_stream_alerts", f", a AS (SELECT event_id, {_LEVEL} AS alert_level FROM scans) SELECT * FROM a WHERE alert_level IS NOT NULL")
def _(spark, d):
    return drained(alerts(spark, d).where(F.col("epc_code") != "END").select("event_id", "alert_level"))


@query("O3_stream_detect", """SELECT event_id, ord AS "evtOrderErr", dup AS "epcDup", loc AS "locErr" FROM found WHERE ord OR dup OR loc""", "dated prev found")
def _(spark, d):
    return drained(jobs.stream_detect(stream(spark, d))).select("event_id", "evtOrderErr", "epcDup", "locErr")


LATE = "event_id % 97 = 0"


def late_sql(sql: str) -> str:
    """``sql`` over the scans that were in time: a part of them comes in a file of its own after all others, 7 days behind the last."""
    edge = f"(SELECT max(event_time) FROM all_scans WHERE NOT {LATE}) - INTERVAL 7 DAYS"
    return sql.replace("scans AS (", "all_scans AS (", 1).replace("\ndated AS (", f"""
late AS (SELECT * FROM all_scans WHERE {LATE} AND event_time < {edge}), scans AS (SELECT * FROM all_scans WHERE event_id NOT IN (SELECT event_id FROM late)),
dated AS (""", 1)


@query("O3_stream_findings", """
SELECT event_id, 'finding' AS kind, ord AS "evtOrderErr", dup AS "epcDup", loc AS "locErr" FROM found WHERE ord OR dup OR loc
UNION ALL SELECT event_id, 'late', NULL, NULL, NULL FROM late""", "dated prev found")
def _(spark, d):
    """Three rounds of the same stream: the scans, those that come late, and a row that moves the watermark past all."""
    prepare(spark)
    path, out, checkpoint, df = shared_folder(spark), shared_folder(spark), shared_folder(spark), scans(spark, d)
    last = df.limit(1).withColumns({"event_time": F.lit(END).cast("timestamp"), "epc_code": F.lit("END"), "event_id": F.lit(-1).cast("long")})
    for part in (df.where(f"NOT {LATE}"), df.where(LATE), last):
        part.write.mode("append").parquet(path)
        found = accounted.stream_findings(jobs.stream_events(spark, path, df.schema, files_per_batch=1_000_000))
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select("event_id", "kind", "evtOrderErr", "epcDup", "locErr")


SQL["O3_stream_findings"] = late_sql(SQL["O3_stream_findings"])


@query("O4_stream_epc_profile", f"""
SELECT epc_code, count(*) AS scans, strftime(min(event_time), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS last_time,
  round(avg((hour(event_time) BETWEEN 8 AND 18)::INT), 6)::DOUBLE AS business_rate FROM scans GROUP BY 1""")
def _(spark, d):
    out = drained(jobs.stream_epc_profile(stream(spark, d), 10**10), "update").where(F.col("epc_code") != "END")
    newest = out.groupBy("epc_code").agg(F.max(F.struct("scans", "first_time", "last_time", "business_rate")).alias("r")).select("epc_code", "r.*")
    return newest.withColumns({"first_time": when("first_time"), "last_time": when("last_time"), "business_rate": F.round("business_rate", 6)})


@query("O4_stream_vectors", """
, e AS (SELECT file_id, epc_code, location_id + device_id + hour(event_time) AS x, (event_id % 10) / 10.0 AS c,
  row_number() OVER (PARTITION BY file_id, epc_code ORDER BY event_time, event_id) AS i, count(*) OVER (PARTITION BY file_id, epc_code) AS m FROM scans),
w AS (SELECT *, CASE WHEN file_id <> 0 AND i = 1 THEN pow(0.9, m - 1) ELSE 0.1 * pow(0.9, m - i) END AS w FROM e)
SELECT file_id, epc_code, round(sum(w * x) + CASE WHEN file_id = 0 THEN 6 * pow(0.9, m) ELSE 0 END + 1e-8, 6) AS total,
  round((sum(c)::DOUBLE + CASE WHEN file_id = 0 THEN 1 ELSE 0 END) / (m + CASE WHEN file_id = 0 THEN 2 ELSE 0 END), 6) AS confidence,
  (m + CASE WHEN file_id = 0 THEN 2 ELSE 0 END)::BIGINT AS updates FROM w GROUP BY file_id, epc_code, m""")
def _(spark, d):
    """Vectors of place, device and hour; items of the first file are known before the stream. Sums are short decimals: 1e-8 parts ties."""
    prepare(spark)
    cells = [F.col(c).cast("double") for c in ("location_id", "device_id")]
    events = stream(spark, d).withColumns({"embedding": F.array(*cells, F.hour("event_time").cast("double")), "confidence": F.col("event_id") % 10 / 10.0})
    known = scans(spark, d).where("file_id = 0").select("file_id", "epc_code").distinct().withColumns(
        {"embedding": F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), "confidence": F.lit(0.5), "updates": F.lit(2)})
    out = drained(vectors.stream_vectors(events, known)).where("NOT late AND epc_code <> 'END'")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    last = out.groupBy("file_id", "epc_code").agg(F.max(F.struct("updates", (total + 1e-8).alias("total"), "confidence")).alias("r"))
    return rounded(last.select("file_id", "epc_code", "r.*"), "total", "confidence", digits=6).select("file_id", "epc_code", "total", "confidence", "updates")


def bucket_sql(seconds: int, shift: int = 0) -> str:
    return f"strftime(make_timestamp(((epoch(event_time)::BIGINT // {seconds}) * {seconds} - {shift}) * 1000000), '%Y-%m-%d %H:%M:%S')"


def spans(df: DataFrame) -> DataFrame:
    """Windows over the scans, without that of the last row."""
    return df.where(F.col("start") < F.lit("2050-01-01").cast("timestamp")).withColumns({"start": when("start"), "end": when("end")}).drop("end")


@query("O5_stream_counts", f"""
, a AS (SELECT {bucket_sql(3600)} AS start, {_LEVEL} AS alert_level FROM scans)
SELECT start, alert_level, count(*) AS alerts FROM a WHERE alert_level IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return spans(drained(jobs.stream_counts(alerts(spark, d))))


@query("O6_stream_drift", "SELECT feature, round(emd, 6) AS emd, emd > 0.5 AS drifted FROM dist", "dist")
def _(spark, d):
    old, new = sides(spark, d)
    path, out = shared_folder(spark), shared_folder(spark)
    new.write.parquet(path)
    events = jobs.stream_events(spark, path, new.schema, files_per_batch=1_000_000)
    jobs.stream_drift(events, old, FEATURES, 0.5, out, shared_folder(spark)).awaitTermination()
    return rounded(spark.read.parquet(out).select("feature", "emd", "drifted"), "emd", digits=6)


@query("O7_stream_dedup", "SELECT DISTINCT epc_code, event_time::VARCHAR AS event_time, location_id FROM scans")
def _(spark, d):
    twice = scans(spark, d)
    out = drained(jobs.stream_dedup(stream(spark, d, twice.unionByName(twice))).select("epc_code", "event_time", "location_id"))
    return out.where(F.col("epc_code") != "END").withColumn("event_time", when())


@query("O8_tumbling", f"SELECT {bucket_sql(30 * 86400)} AS start, business_step, count(*) AS events FROM scans GROUP BY ALL")
def _(spark, d):
    return spans(drained(jobs.tumbling(stream(spark, d), "30 days", ["business_step"])))


@query("O8_sliding", f"""
SELECT start, count(*) AS events FROM (SELECT {bucket_sql(86400)} AS start FROM scans UNION ALL SELECT {bucket_sql(86400, 86400)} FROM scans) GROUP BY 1""")
def _(spark, d):
    return spans(drained(jobs.sliding(stream(spark, d), "2 days", "1 day")))


@query("O8_sessions", """
, g AS (SELECT epc_code, event_time, coalesce(event_time - lag(event_time) OVER w > INTERVAL 168 HOUR, true) AS fresh FROM scans WINDOW w AS (PARTITION BY epc_code ORDER BY event_time)),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY epc_code ORDER BY event_time) AS n FROM g)
SELECT epc_code, strftime(min(event_time), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM s GROUP BY epc_code, n""")
def _(spark, d):
    return spans(drained(jobs.sessions(stream(spark, d))))


SPAN = 30 * 86400


@query("O6_sliding_drift", f"""
, v AS (SELECT epoch(event_time)::BIGINT // {SPAN} AS b, count(*) AS n FROM scans GROUP BY 1),
w AS (SELECT e.b, sum(v.n) FILTER (v.b <= e.b - 2) AS r, sum(v.n) FILTER (v.b > e.b - 2) AS t FROM v e JOIN v ON v.b BETWEEN e.b - 7 AND e.b GROUP BY 1)
SELECT feature, strftime(make_timestamp(b * {SPAN} * 1000000), '%Y-%m-%d %H:%M:%S') AS start, r::BIGINT AS n_reference, t::BIGINT AS n_test, TRUE AS within
FROM w, (VALUES ('location_id'), ('device_id'), ('hour')) f(feature) WHERE r IS NOT NULL""")
def _(spark, d):
    """Two spans of 30 days against the six before, by sketches of a stream; ``within``: no further from the exact distance than the bound says."""
    hours = F.hour("event_time")
    buckets = drained(sketches.bucket_sketches(stream(spark, d).withColumn("hour", hours), FEATURES, "30 days"))
    found = sketches.sliding_drift(buckets, SPAN, reference=6, test=2)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in FEATURES])
    counts = scans(spark, d).withColumn("hour", hours).select(F.expr(f"unix_seconds(event_time) div {SPAN}").alias("bucket"), F.inline(cells))
    counts = counts.groupBy("bucket", "feature", "value").agg(F.count("*").alias("n"))
    spread = counts.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("side", F.when(F.col("back") < 2, 1).otherwise(0))
    spread = spread.withColumn("start", F.timestamp_seconds((F.col("bucket") + F.col("back")) * SPAN))
    spread = spread.join(found.select("feature", "start"), ["feature", "start"], "left_semi")
    exact = dr.distances(spread, ["feature", "start"], F.col("n")).select("feature", "start", F.col("emd").alias("exact"))
    return found.join(exact, ["feature", "start"]).select(
        "feature", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_reference", "n_test", (F.abs(F.col("emd") - F.col("exact")) <= F.col("bound")).alias("within"))

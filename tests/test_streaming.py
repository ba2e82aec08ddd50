import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanwarden import constants as C
from scanwarden.operators import detect_events
from scanwarden.sources.table_scans import as_of, scans
from scanwarden.streaming import jobs

COLUMNS = ["file_id", "epc_code", "event_id", "event_time", "event_type", "business_step", "scan_location", "location_id"]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """Scans in four files in time order, and one late event that moves the watermark past them all."""
    path = str(tmp_path_factory.mktemp("stream") / "in")
    df = scans(spark, sf).select(*COLUMNS)
    df.repartitionByRange(4, "event_time").write.parquet(path)
    last = df.limit(1).withColumns({"event_time": F.lit("2030-01-01 00:00:00").cast("timestamp"), "epc_code": F.lit("END"), "event_id": F.lit(-1).cast("long")})
    last.coalesce(1).write.mode("append").parquet(path)
    return path, df


def drain(spark, frame, mode, name, tmp_path):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option(
        "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def source(spark, folder, delay="100 days"):
    path, df = folder
    return jobs.stream_events(spark, path, df.schema, delay=delay)


def test_stream_equals_batch(spark, folder, tmp_path):
    got = drain(spark, jobs.stream_detect(source(spark, folder, "8000 days")), "append", "found", tmp_path)
    path, df = folder
    with_last = spark.read.parquet(path)
    edge = with_last.agg(F.max("event_time")).first()[0]
    batch = detect_events.detect_events(df, as_of(), hot=None)
    batch = batch.where(F.coalesce(F.col("evtOrderErr"), F.col("epcDup"), F.col("locErr")))
    batch = batch.where(F.col("event_time") < F.lit(edge) - F.expr("INTERVAL 8000 DAYS"))
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("evtOrderErr", "epcDup", "locErr")]
    left = sorted(map(str, got.select("event_id", *flags).collect()))
    right = sorted(map(str, batch.select("event_id", *flags).collect()))
    assert len(right) > 100 and left == right


def test_alerts_and_counts(spark, folder, tmp_path):
    scored = source(spark, folder).withColumns({f"{t}_probability": F.col("event_id") % 100 / 100.0 for t in C.STATS_TYPES})
    alerts = jobs.stream_alerts(scored)
    assert drain(spark, alerts.select("event_id", "alert_level"), "append", "alerts", tmp_path).where("alert_level = 'HIGH'").count() > 0
    counts = drain(spark, jobs.stream_counts(alerts), "append", "counts", tmp_path)
    assert counts.agg(F.sum("alerts")).first()[0] > 1000


def test_profiles_dedup_and_windows(spark, folder, tmp_path):
    path, df = folder
    profiles = drain(spark, jobs.stream_epc_profile(source(spark, folder), 10**8), "update", "profiles", tmp_path)
    latest = profiles.groupBy("epc_code").agg(F.max("scans").alias("n"))
    want = spark.read.parquet(path).groupBy("epc_code").agg(F.count("*").alias("n"))
    assert latest.exceptAll(want).isEmpty() and want.count() == latest.count()
    unique = drain(spark, jobs.stream_dedup(source(spark, folder)).select("epc_code"), "append", "unique_events", tmp_path)
    assert unique.count() == spark.read.parquet(path).select("epc_code", "event_time", "location_id").distinct().count()
    days = drain(spark, jobs.tumbling(source(spark, folder), "30 days"), "append", "days", tmp_path)
    assert days.agg(F.sum("events")).first()[0] == df.count()
    batch = jobs.sessions(df)
    assert batch.agg(F.sum("events")).first()[0] == df.count()
    assert jobs.sliding(df, "2 days", "1 day").agg(F.sum("events")).first()[0] == 2 * df.count()


def test_stream_drift(spark, folder, tmp_path):
    path, df = folder
    out = str(tmp_path / "drift")
    query = jobs.stream_drift(source(spark, folder), df.limit(500), ["location_id"], 0.5, out, str(tmp_path / "c"))
    query.awaitTermination()
    assert {"emd", "drifted"} <= set(spark.read.parquet(f"{out}/*").columns)
    assert isinstance(spark.read.parquet(out).schema["batch"].dataType, T.IntegerType)

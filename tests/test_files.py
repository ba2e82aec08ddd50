import json

import pytest
from pyspark.sql import functions as F

from scanwarden import constants as C
from scanwarden import schemas
from scanwarden.operators import detect_events
from scanwarden.plans import pipelines, registry
from scanwarden.sources import findings_log, scan_files, training_sets
from scanwarden.sources.table_scans import as_of, scans
from tests.rows import as_of as today
from tests.rows import request_rows

LINE = ["서울 공장", "1", "HWS_Factory", "Factory", "Aggregation", "1", "1", "001.8804823.0000001.000001.20240701.000000001", "001", "8804823",
        "0000001", "000001", "20240701", "000000001", "Product 1", "2024-07-02 09:00:00", "2024-07-01 10:00:00", "20251231"]


@pytest.fixture
def tsv(tmp_path):
    path = tmp_path / "hws.csv"
    other = LINE.copy()
    other[7], other[15] = "short", "2024-07-02 10:00:00"
    lines = ["\t".join(schemas.SCAN.names), "\t".join(LINE), "\t".join(other)]
    path.write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_scan_files(spark, tsv, tmp_path):
    rows = scan_files.read_scans_tagged(spark, tsv)
    assert rows.count() == 2
    row = rows.orderBy("event_time").first()
    assert (row["scan_location"], row["location_id"], row["source_file"], row["event_time"].hour) == ("서울 공장", 1, "hws", 9)
    assert scan_files.clean_scans(rows).count() == 1
    bad = tmp_path / "bad.csv"
    bad.write_text("a\tb\n1\t2\n")
    assert scan_files.read_validated(spark, [tsv, str(bad)]).count() == 1
    events = scan_files.events_from_scans(rows)
    assert events.select("event_id").distinct().count() == 2
    assert [r["event_id"] for r in scan_files.events_from_scans(rows, numbered=True).orderBy("event_id").collect()] == [1, 2]


def test_event_ids_are_unique(spark):
    rows = [("a", None, "x", "f"), ("a", "x", None, "f"), ("a", "x", None, "f"), ("a", "x", None, None)]
    df = spark.createDataFrame(rows, "epc_code string, business_step string, event_type string, source_file string").selectExpr(
        "*", "timestamp'2024-01-01' AS event_time", "1 AS location_id", "'p' AS scan_location")
    events = scan_files.events_from_scans(df)
    assert events.select("source_file", "event_id").distinct().count() == 4
    assert scan_files.events_from_scans(df, numbered=False).select("event_id").distinct().count() == 3


def test_log_that_is_not_there(spark, tmp_path):
    empty = findings_log.latest_findings(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and {"event_id", "run_id", "run_ts"} <= set(empty.columns)


def test_envelopes_to_documents(spark, tmp_path):
    rows = [r.asDict() for r in request_rows(spark).drop("scan_location").withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")).collect()]
    for r in rows[:4]:
        r["eventId"] = r.pop("event_id")
    path = tmp_path / "request.json"
    path.write_text(json.dumps({"data": rows}, ensure_ascii=False))
    assert scan_files.read_event_envelopes(spark, str(path)).count() == 8
    docs = pipelines.answer_envelopes(spark, str(path), today()).collect()
    assert len(docs) == 1
    doc = json.loads(docs[0]["document"])
    assert doc["fileId"] == 3 and len(doc["EventHistory"]) == 6 and doc["fileAnomalyStats"]["totalEvents"] == 7
    assert next(e for e in doc["EventHistory"] if e["eventId"] == 304) == {"eventId": 304, "epcFake": True, "epcFakeScore": 100.0}
    pages = pipelines.answer_envelopes(spark, str(path), today(), page_rows=2).collect()
    assert len(pages) > 1 and sum(len(json.loads(p["document"]).get("EventHistory", [])) for p in pages) == 6
    empty = tmp_path / "empty.json"
    empty.write_text('{"data": []}')
    assert pipelines.answer_envelopes(spark, str(empty), today()).isEmpty()


def test_dimensions(spark, tmp_path):
    (tmp_path / "transitions.csv").write_text(",".join(schemas.TRANSITIONS.names) + "\na,b,5.0,1.0,1.0,9.0,12\na,b,6.0,1.0,1.0,9.0,12\n")
    tables = scan_files.load_dimensions(spark, str(tmp_path))
    assert tables["transitions"].count() == 1 and tables["geo"].isEmpty() and tables["locations"].isEmpty()


def test_findings_log(spark, tmp_path):
    events = request_rows(spark)
    found = detect_events.detect_events(events, today())
    path = str(tmp_path / "log")
    findings_log.write_findings_log(found.where("event_id < 305"), events, path, "first", today("2025-01-01 00:00:00"))
    findings_log.write_findings_log(found, events, path, "second", today("2025-01-02 00:00:00"))
    assert findings_log.latest_findings(spark, path).count() == 6
    bad, good = findings_log.split_anomalous_normal(events, found)
    assert bad.count() == 6 and good.count() == 2


def test_training_sets(spark, tmp_path):
    df = spark.range(200).select(
        F.lit(0).alias("file_id"), F.col("id").cast("string").alias("epc_code"), (F.col("id") % 4 == 0).cast("int").alias("label"),
        F.col("id").alias("score"), (F.col("id") / 7).alias("a"), F.lit(1.0).alias("b"))
    path = str(tmp_path / "sets")
    for kind in ("jump", "epcDup"):
        training_sets.write_training_set(df, path, kind, ["a", "b"], today())
    assert training_sets.read_training_set(spark, path, "jump", "test").count() == 40
    one = training_sets.training_set_catalog(spark, path).first()
    assert (one["sets"], one["samples"], one["mean_positive_ratio"], one["min_dimensions"]) == (2, 400, 0.25, 2)
    assert all(training_sets.check_training_set(spark, path, "jump").first())
    with pytest.raises(FileNotFoundError):
        training_sets.read_training_set(spark, path, "locErr")


def test_sql_surface(spark, sf):
    registry.register_sql_functions(spark)
    registry.register_views(scans(spark, sf), as_of(), hot=None)
    assert spark.sql("SELECT location_level('서울 공장'), severity(75D), jump_score(1D, 5D, 1D, 150D)").first()[:] == (0, "HIGH", 95)
    assert spark.sql("SELECT sum(totalEvents) FROM epc_findings").first()[0] == spark.sql("SELECT sum(totalEvents) FROM file_findings").first()[0]


def test_train_from_scans(spark, sf):
    models, split = pipelines.train_from_scans(scans(spark, sf), as_of(), ["epcFake", "jump"], steps=2, hot=None)
    assert {r["anomaly_type"] for r in models.collect()} == {"epcFake", "jump"}
    assert split.where("split = 'eval'").count() == 1


def test_a_run_written_again_replaces_itself(spark, tmp_path):
    """A retried run, and one that broke off before it was listed."""
    path = str(tmp_path / "log")
    day = lambda n: F.lit(f"2025-01-0{n} 00:00:00").cast("timestamp")
    flags = ", ".join(f"{t} boolean, {t}Score int" for t in C.STATS_TYPES)
    rows = [(i, 1, f"e{i}", *[x for t in C.STATS_TYPES for x in (True, 80)]) for i in range(6)]
    found = spark.createDataFrame(rows, f"event_id long, file_id int, epc_code string, {flags}")
    events = found.select("event_id", "file_id", "epc_code")
    findings_log.write_findings_log(found, events, path, "first", day(1))
    findings_log.write_findings_log(found.where("event_id < 4"), events, path, "second", day(2))
    findings_log.write_findings_log(found.where("event_id < 5"), events, path, "second", day(2))
    # a third run whose job was lost after its findings: the summary is never written
    lost = found.withColumns({"run_id": F.lit("third"), "run_ts": day(3), "attempt": F.lit("x"), "run_date": day(3).cast("date")})
    lost.write.mode("append").partitionBy("run_date").parquet(f"{path}/findings")
    assert sorted(r.event_id for r in findings_log.latest_findings(spark, path).collect()) == [0, 1, 2, 3, 4]
    assert {(r.run_id, r.findings) for r in findings_log.logged_runs(spark, path).collect()} == {("first", 6), ("second", 5)}
    assert findings_log.logged_findings(spark, path).groupBy("run_id").count().where("count <> CASE run_id WHEN 'first' THEN 6 ELSE 5 END").count() == 0
    # written once more, the lost run is there whole
    findings_log.write_findings_log(found, events, path, "third", day(3))
    assert findings_log.latest_findings(spark, path).count() == 6


def test_validated_files_are_written_compressed(spark, sf):
    import __spark_entry__

    files = __spark_entry__.queries()["A3_read_validated"](spark, sf).inputFiles()
    assert files and all(f.endswith(".csv.gz") for f in files)

import pytest
from pyspark.sql import functions as F

from scanwarden.functions import epc, moves, sequences, verdicts
from scanwarden.operators import detect_epc as items
from scanwarden.operators import detect_events as events
from tests.rows import PREFIX, as_of, request_rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_event_findings_of_the_request(spark):
    found = {r["event_id"]: r for r in events.detect_events(request_rows(spark), as_of()).collect()}
    assert set(found) == {302, 303, 304, 306, 307, 308}
    assert found[302]["epcDupScore"] == 90 and found[302]["locErr"] is None
    assert found[303]["epcDupScore"] == 90 and found[303]["locErrScore"] == 30
    assert found[304]["epcFakeScore"] == 100
    assert found[306]["locErrScore"] == 30
    assert found[307]["epcDup"] and found[308]["epcDup"]
    assert all(r["jump"] is None for r in found.values())


def test_rollups_of_the_request(spark):
    found = events.detect_events(request_rows(spark), as_of())
    per = {r["epc_code"][-1]: r for r in events.epc_stats(found).collect()}
    assert (per["1"]["epcDupCount"], per["1"]["locErrCount"], per["1"]["totalEvents"]) == (2, 1, 3)
    assert (per["T"]["epcFakeCount"], per["T"]["totalEvents"]) == (1, 1)
    file = events.file_stats(found).first()
    assert (file["epcFakeCount"], file["epcDupCount"], file["locErrCount"], file["totalEvents"]) == (1, 4, 2, 7)


def test_item_findings_of_the_request(spark):
    df = items.normalize_scans(request_rows(spark))
    found = items.detect_epc(df, as_of())
    rows = {r["epc_code"][-1]: r for r in found.collect()}
    assert rows["1"]["anomalyScores"] == {"epcDup": 90, "locErr": 80}
    assert (rows["1"]["primaryAnomaly"], rows["1"]["problemStep"], rows["1"]["sequencePosition"]) == ("epcDup", "Duplicate_Scan_Error", 2)
    assert rows["T"]["anomalyScores"] == {"epcFake": 100} and rows["T"]["sequencePosition"] == 1
    assert rows["2"]["anomalyScores"] == {"locErr": 40} and rows["2"]["problemStep"] == "General_Analysis"
    summary = items.summary_stats(found).first()
    assert (summary["epcFakeCount"], summary["epcDupCount"], summary["locErrCount"], summary["multiAnomalyCount"],
            summary["totalAnomalyCount"]) == (1, 1, 3, 1, 4)


def test_two_cities_at_once(spark):
    code = "001.8804823.0000001.000001.20240701.000000001"
    rows = [(1, 1, code, "2024-07-02 09:00:00", "서울 공장", "Aggregation"), (1, 2, code, "2024-07-02 09:00:00", "부산 공장", "WMS_Inbound"),
            (1, 3, "invalid.format.epc", "2024-07-02 10:00:00", "서울 공장", "Aggregation")]
    df = spark.createDataFrame(rows, "file_id int, event_id long, epc_code string, event_time string, scan_location string, event_type string")
    stats = spark.createDataFrame([("서울 공장", "부산 공장", 5.0, 1.0)], "from_scan_location string, to_scan_location string, "
                                  "time_taken_hours_mean double, time_taken_hours_std double")
    found = {r["epc_code"]: r for r in items.detect_epc(items.normalize_scans(df), as_of(), stats).collect()}
    assert found[code]["anomalyScores"] == {"epcDup": 90, "jump": 95}
    assert (found[code]["primaryAnomaly"], found[code]["problemStep"], found[code]["sequencePosition"]) == ("jump", "Step_1_issue", 2)
    assert found["INVALID.FORMAT.EPC"]["anomalyScores"] == {"epcFake": 100}


@pytest.mark.parametrize("code, score", [
    (None, 100), ("", 100), ("a.b", 100),
    ("999.8804823.0000003.000001.20241201.000000001", 20),
    ("001.1234567.0000003.000001.20241201.000000001", 25),
    ("999.1234567.0000003.000001.20241399.000000001", 100),
    ("001.8804823.0000003.000001.20991201.000000001", 20),
    ("001.8804823.0000003.000001.20151201.000000001", 15),
    ("001.8804823.0000003.000001.20241201.000001", 10),
    (PREFIX + "000000001", 0),
])
def test_code_score(spark, code, score):
    assert one(spark, epc.epc_fake_score(F.lit(code).cast("string"), as_of())) == score


@pytest.mark.parametrize("gap, mean, std, km, score", [
    (-1.0, 5.0, 1.0, None, 95), (1.0, 5.0, 1.0, 150.0, 95), (7.0, 5.0, 1.0, None, 0), (7.5, 5.0, 1.0, None, 60),
    (8.5, 5.0, 1.0, None, 80), (9.5, 5.0, 1.0, None, 95), (7.0, 0.0, 1.0, None, 0), (7.0, 5.0, 0.0, None, 0)])
def test_jump_score(spark, gap, mean, std, km, score):
    args = [F.lit(v).cast("double") for v in (gap, mean, std, km)]
    assert one(spark, moves.jump_score(*args)) == score


@pytest.mark.parametrize("name, level", [("수도권_도매상1_권역_소매상1", 2), ("인천공장창고", 0), ("Store 5", 3), ("x", 99), (None, 99)])
def test_location_level(spark, name, level):
    assert one(spark, moves.location_level(F.lit(name).cast("string"))) == level


@pytest.mark.parametrize("score, level", [(70, "HIGH"), (69, "MEDIUM"), (40, "MEDIUM"), (20, "LOW"), (19, "NORMAL")])
def test_severity(spark, score, level):
    assert one(spark, verdicts.severity(F.lit(score))) == level


@pytest.mark.parametrize("times, score", [(1, 0), (2, 25), (3, 65), (4, 100), (9, 100)])
def test_repeated_inbound(spark, times, score):
    rows = [(0, "e", i, i, "WMS_Inbound") for i in range(times)]
    df = spark.createDataFrame(rows, "file_id int, epc_code string, event_id int, event_time int, event_type string")
    assert items.epc_event_order(df, hot=None).first()["evtOrderErr"] == score


@pytest.mark.parametrize("places, score", [(1, 0), (2, 90), (3, 100), (4, 100)])
def test_places_within_a_second(spark, places, score):
    rows = [(0, "e", 5, f"p{i}") for i in range(places)]
    df = spark.createDataFrame(rows, "file_id int, epc_code string, event_time_rounded int, scan_location string")
    assert items.epc_duplicate(df).first()["epcDup"] == score


@pytest.mark.parametrize("names, score", [(["factory", "store", "factory"], 30), (["store", "x"], 20)])
def test_location_error(spark, names, score):
    rows = [(0, "e", i, i, n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "file_id int, epc_code string, event_id int, event_time int, scan_location string")
    assert items.epc_location_error(df, hot=None).first()["locErr"] == score


def test_repair(spark):
    whole = PREFIX + "000000001"
    assert one(spark, epc.repair_epc(F.lit(whole.replace(".", "")))) == whole
    assert one(spark, epc.repair_epc(F.lit("001-5"))) == "001.5"
    assert one(spark, epc.repair_epc(F.lit("abc"))) == "abc"


def test_fit_sequence_length(spark):
    def fit(values, n, kind="median"):
        return one(spark, sequences.fit_sequence_length(F.array(*[F.lit(float(v)) for v in values]), n, kind))

    assert fit([1, 2], 2) == [1, 2]
    assert fit([1, 3], 4, "mean") == [1, 3, 2, 2]
    assert fit([1, 3], 3, "last") == [1, 3, 3]
    assert fit([1, 1, 0], 4, "majority") == [1, 1, 0, 1]
    assert fit([0, 1, 2, 3, 4], 3) == [0, 2, 4]
    assert fit(range(100), 98)[:3] == [0, 1, 2]

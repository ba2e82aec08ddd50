"""Events written out by hand."""

from pyspark.sql import functions as F

PREFIX = "001.8804823.0000003.000001.20241201."
SCHEMA = "file_id int, event_id long, epc_code string, location_id int, business_step string, event_type string, event_time string"


def request_rows(spark):
    rows = [
        (3, 301, PREFIX + "000000001", 1, "Factory", "Outbound", "2024-12-01 08:00:00"),
        (3, 302, PREFIX + "000000001", 2, "WMS", "Inbound", "2024-12-01 10:00:00"),
        (3, 303, PREFIX + "000000001", 4, "Retailer", "Inbound", "2024-12-01 10:00:00"),
        (3, 304, "BROKEN.EPC.FORMAT", 3, "Wholesaler", "Inbound", "2024-12-01 11:00:00"),
        (3, 305, PREFIX + "000000002", 2, "WMS", "Outbound", "2024-12-01 12:00:00"),
        (3, 306, PREFIX + "000000002", 1, "Factory", "Inbound", "2024-12-01 13:00:00"),
        (3, 307, PREFIX + "000000003", 3, "Wholesaler", "Inbound", "2024-12-01 14:00:00"),
        (3, 308, PREFIX + "000000003", 3, "Wholesaler", "Outbound", "2024-12-01 14:00:00"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({
        "event_time": F.col("event_time").cast("timestamp"), "scan_location": F.col("location_id").cast("string")})


def as_of(text="2025-07-22 00:00:00"):
    return F.lit(text).cast("timestamp")


def labels(spark, n, keys=None):
    rows = [(i if keys is None else keys[i], t, int((i * 7 + k) % 5 == 0), i % 40 / 40.0) for i in range(n) for k, t in enumerate(("epcFake", "jump"))]
    return spark.createDataFrame(rows, "event_id long, anomaly_type string, truth int, probability double")

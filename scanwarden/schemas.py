"""Schemas of files and reference tables."""

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
    "timestamp": T.TimestampType()}


def _struct(text: str) -> T.StructType:
    """Schema from ``name type, ...``, without a running session."""
    pairs = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


SCAN = _struct(
    "scan_location string, location_id int, hub_type string, business_step string, event_type string, "
    "operator_id int, device_id int, epc_code string, epc_header string, epc_company string, epc_product string, "
    "epc_lot string, epc_manufacture string, epc_serial string, product_name string, event_time timestamp, "
    "manufacture_date timestamp, expiry_date string"
)
EVENT = _struct(
    "event_id long, eventId long, epc_code string, location_id int, business_step string, event_type string, "
    "event_time string, file_id int"
)
ENVELOPE = T.StructType([T.StructField("data", T.ArrayType(EVENT))])
TRANSITIONS = _struct(
    "from_scan_location string, to_scan_location string, time_taken_hours_mean double, time_taken_hours_std double, "
    "time_taken_hours_min double, time_taken_hours_max double, time_taken_hours_count long"
)
GEO = _struct("location_id int, scan_location string, Latitude double, Longitude double")
LOCATIONS = _struct("location_id int, scan_location string")
SCAN_REQUIRED = ("scan_location", "location_id", "business_step", "event_type", "epc_code", "event_time")

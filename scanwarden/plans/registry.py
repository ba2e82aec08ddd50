"""Names for feature builders and scorers, and the rules as SQL functions and views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanwarden import constants as C
from scanwarden.operators import detect_epc, features
from scanwarden.operators.detect_events import detect_events, epc_stats, file_stats

EXTRACTORS: dict[str, Callable[..., DataFrame]] = {
    "epcFake": features.fake_features, "epcDup": features.dup_features, "evtOrderErr": features.order_features,
    "locErr": features.location_features, "jump": features.jump_features}
EVENT_EXTRACTORS: dict[str, Callable[..., DataFrame]] = {
    "locErr": features.location_features_per_event, "jump": features.jump_features_per_event}
FEATURE_NAMES = {
    "epcFake": features.FAKE, "epcDup": features.DUP, "evtOrderErr": features.ORDER, "locErr": features.LOCATION, "jump": features.JUMP}
SCORERS: dict[str, Callable[..., DataFrame]] = {
    "epcDup": detect_epc.epc_duplicate, "evtOrderErr": detect_epc.epc_event_order, "locErr": detect_epc.epc_location_error,
    "jump": detect_epc.epc_jump}


def register_extractor(name: str, build: Callable[..., DataFrame], names: tuple[str, ...]) -> None:
    """Adds or replaces the feature builder of a type."""
    EXTRACTORS[name], FEATURE_NAMES[name] = build, names


def register_scorer(name: str, build: Callable[..., DataFrame]) -> None:
    SCORERS[name] = build


def _case(arms: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in arms) + f" ELSE {default} END"


def register_sql_functions(spark: SparkSession) -> None:
    """Temporary SQL functions for the rules; they expand into plain expressions."""
    level = _case([(f"contains(lower(trim(name)), '{w}')", str(n)) for w, n in C.LOCATION_KEYWORDS], str(C.UNKNOWN_LEVEL))
    direction = _case([("event_type IS NULL OR event_type = ''", "'missing'")]
                      + [(f"contains(lower(event_type), '{w}')", f"'{d}'") for w, d, _ in C.EVENT_KEYWORDS], "'other'")
    severity = _case([(f"score >= {cut}", f"'{n}'") for n, cut in C.SEVERITY_CUTS], "'NORMAL'")
    step = _case([(f"step = '{n}'", str(v)) for n, v in C.STEP_LEVEL.items()], str(C.UNKNOWN_LEVEL))
    km = (f"{2 * C.EARTH_RADIUS_KM} * asin(sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * "
          "cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)))")
    bands = _case([("mean_h = 0 OR std_h = 0 OR mean_h IS NULL OR std_h IS NULL", "0")]
                  + [(f"abs(gap_h - mean_h) / std_h <= {upper}", str(score)) for upper, score in C.JUMP_BANDS], str(C.JUMP_IMPOSSIBLE))
    jump = _case([("gap_h < 0", str(C.JUMP_IMPOSSIBLE)), (f"km / {C.MAX_SPEED_KMH} > gap_h", str(C.JUMP_IMPOSSIBLE))], bands)
    companies = ", ".join(f"'{c}'" for c in C.VALID_COMPANIES)
    date_status = (
        "CASE WHEN NOT text RLIKE '^[0-9]{8}$' OR try_to_date(text, 'yyyyMMdd') IS NULL OR text IS NULL THEN 'invalid_format' "
        "WHEN CAST(try_to_date(text, 'yyyyMMdd') AS TIMESTAMP) > as_of THEN 'future_date' "
        f"WHEN datediff(CAST(as_of AS DATE), try_to_date(text, 'yyyyMMdd')) > {C.MAX_AGE_DAYS} THEN 'too_old' ELSE 'valid' END")
    parts = "split(trim(code), '[.]', -1)"
    fake = (
        f"CASE WHEN code IS NULL OR size({parts}) <> {C.EPC_PARTS} THEN {C.SCORE_MAX} "
        f"WHEN get({parts}, 0) <> '{C.VALID_HEADER}' AND get({parts}, 1) NOT IN ({companies}) AND mfg_date_status(get({parts}, 4), as_of) <> 'valid' THEN {C.SCORE_MAX} "
        f"ELSE least({C.SCORE_MAX}, if(get({parts}, 0) = '{C.VALID_HEADER}', 0, {C.SCORE_HEADER}) + if(get({parts}, 1) IN ({companies}), 0, {C.SCORE_COMPANY}) "
        f"+ if(get({parts}, 2) RLIKE '^[0-9]{{{C.PRODUCT_DIGITS}}}$', 0, {C.SCORE_PRODUCT}) + if(get({parts}, 3) RLIKE '^[0-9]{{{C.LOT_DIGITS}}}$', 0, {C.SCORE_LOT}) "
        f"+ if(get({parts}, 5) RLIKE '^[0-9]{{{C.SERIAL_DIGITS}}}$', 0, {C.SCORE_SERIAL}) + CASE mfg_date_status(get({parts}, 4), as_of) WHEN 'valid' THEN 0 "
        f"WHEN 'too_old' THEN {C.SCORE_DATE_OLD} ELSE {C.SCORE_DATE} END) END")
    functions = {
        "location_level(name STRING) RETURNS INT": level,
        "event_direction(event_type STRING) RETURNS STRING": direction,
        "severity(score DOUBLE) RETURNS STRING": severity,
        "step_level(step STRING) RETURNS INT": step,
        "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": km,
        "jump_score(gap_h DOUBLE, mean_h DOUBLE, std_h DOUBLE, km DOUBLE) RETURNS INT": jump,
        "mfg_date_status(text STRING, as_of TIMESTAMP) RETURNS STRING": date_status,
        "epc_fake_score(code STRING, as_of TIMESTAMP) RETURNS INT": fake,
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register_views(events: DataFrame, as_of: Column, **options) -> None:
    """Views ``scan_events``, ``event_findings``, ``epc_findings`` and ``file_findings``."""
    found = detect_events(events, as_of, **options)
    events.createOrReplaceTempView("scan_events")
    found.createOrReplaceTempView("event_findings")
    epc_stats(found).createOrReplaceTempView("epc_findings")
    file_stats(found).createOrReplaceTempView("file_findings")


def score_items(name: str, df: DataFrame, **options) -> DataFrame:
    """Item scores of a registered type."""
    return SCORERS[name](df, **options)


def item_features(name: str, df: DataFrame, as_of: Column | None = None, **options) -> DataFrame:
    """Feature rows of a registered type."""
    if name == "epcFake":
        return EXTRACTORS[name](df, as_of if as_of is not None else F.current_timestamp())
    return EXTRACTORS[name](df, **options)

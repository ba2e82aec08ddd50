"""Scan files, event envelopes and reference tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanwarden import schemas
from scanwarden.functions.epc import LOOSE_PATTERN
from scanwarden.skew import running_totals


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_scans(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Tab-separated scan files with a header line (a byte order mark in it does no harm)."""
    return spark.read.csv(
        _paths(paths), sep="\t", header=True, schema=schemas.SCAN, mode="PERMISSIVE", enforceSchema=True,
        timestampFormat="yyyy-MM-dd HH:mm:ss")


def read_scans_tagged(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Scan files with ``source_file``, the file name without its ending."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return read_scans(spark, paths).withColumn("source_file", stem)


def read_validated(spark: SparkSession, paths: Sequence[str], required: Sequence[str] = schemas.SCAN_REQUIRED) -> DataFrame:
    """Files that lack a required column are left out, rows with malformed codes or times dropped.

    Only header lines are looked at to check columns; columns are matched by name. Files with equal headers are read
    together, so the plan has one branch per header, not per file.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        header = tuple(spark.read.csv(path, sep="\t", header=True).columns)
        if set(required) <= {c.lstrip("\ufeff") for c in header}:
            by_header.setdefault(header, []).append(path)
    if not by_header:
        return spark.createDataFrame([], schemas.SCAN)
    rows = None
    for header, alike in by_header.items():
        text = T.StructType([T.StructField(c, T.StringType()) for c in header])
        part = spark.read.csv(alike, sep="\t", header=True, schema=text).toDF(*[c.lstrip("\ufeff") for c in header])
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    known = {f.name: f.dataType for f in schemas.SCAN}
    for c in rows.columns:
        if c in ("event_time", "manufacture_date"):
            rows = rows.withColumn(c, F.try_to_timestamp(F.col(c)))
        elif c in known and not isinstance(known[c], T.StringType):
            rows = rows.withColumn(c, F.col(c).try_cast(known[c]))
    return rows.where(F.col("epc_code").rlike(LOOSE_PATTERN) & F.col("event_time").isNotNull())


def clean_scans(df: DataFrame) -> DataFrame:
    """Rows with all required values and a code of more than ten characters."""
    return df.dropna(subset=list(schemas.SCAN_REQUIRED)).where(F.length("epc_code") > 10)


def read_event_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents ``{"data": [event, ...]}`` as one row per event; accepts event_id and eventId."""
    docs = spark.read.schema(schemas.ENVELOPE).json(path, multiLine=True)
    rows = docs.select(F.explode("data").alias("e")).select("e.*")
    rows = rows.withColumn("event_id", F.coalesce("event_id", "eventId")).drop("eventId")
    return rows.withColumn("event_time", F.try_to_timestamp(F.col("event_time")))


def events_from_scans(df: DataFrame, numbered: bool = True) -> DataFrame:
    """Scans in the shape of events, numbered per file in the order of their values, repeats included.

    With ``numbered=False`` the id is a 64-bit hash of all values, nulls told apart: cheaper, but equal rows share it and
    different rows may.
    """
    columns = ("epc_code", "event_time", "location_id", "business_step", "event_type")
    if numbered:
        rows = running_totals(df, ["source_file"], list(columns), {"event_id": F.lit(1).cast("long")})
    else:
        values = F.to_json(F.struct(*columns, "source_file"), {"ignoreNullFields": "false"})
        rows = df.withColumn("event_id", F.xxhash64(values))
    return rows.select(
        "event_id", "epc_code", "location_id", "business_step", "event_type",
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "source_file", "scan_location")


def load_dimensions(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Transition statistics, coordinates and place names; an empty table where a file is missing."""
    out = {}
    for name, schema in (("transitions", schemas.TRANSITIONS), ("geo", schemas.GEO), ("locations", schemas.LOCATIONS)):
        try:
            table = spark.read.csv(f"{folder}/{name}.csv", header=True, schema=schema)
            table.schema  # noqa: B018 - resolves the path
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            table = spark.createDataFrame([], schema)
        out[name] = table
    keys = ["from_scan_location", "to_scan_location"]
    # one row per pair; the smallest row on repeated pairs
    rest = [c for c in schemas.TRANSITIONS.names if c not in keys]
    out["transitions"] = out["transitions"].groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*")
    return out


def file_inventory(df: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows, items and columns per source file."""
    per_item = df.groupBy(source, "epc_code").agg(F.count("*").alias("_n"))
    out = per_item.groupBy(source).agg(F.sum("_n").alias("rows"), F.count("epc_code").alias("items"))
    return out.withColumn("columns", F.lit(len([c for c in df.columns if c != source])))

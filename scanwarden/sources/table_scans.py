"""Scan events derived from the order tables.

One order is one item with a product code, one order line is one scan of it. The formula
also produces malformed codes, repeated times, reversed steps and missing places, so every
rule has something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2000-07-01 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_id() -> Column:
    """Integer id from the order, the line and a mix of the other fields; unique within an order."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    mixed = F.col("l_partkey") * 31 + F.col("l_suppkey") * 7919 + cents * 104729 + F.col("l_quantity").cast("long") * 611953
    return (F.col("l_orderkey") % 68719476736) * 134217728 + F.col("l_linenumber") * F.lit(16777216).cast("long") + mixed % 16777216


def _items(orders: DataFrame) -> DataFrame:
    """What all scans of an item share, built once per order before the join."""
    key = F.col("o_orderkey")
    company = (
        F.when(key % 20 == 0, "1234567")
        .when(key % 3 == 0, "8804823").when(key % 3 == 1, "8805843").otherwise("8809437")
    )
    code = F.concat_ws(
        ".",
        F.when(key % 37 == 0, "999").otherwise("001"),
        company,
        F.lpad(F.col("o_custkey").cast("string"), 7, "0"),
        F.lpad((key % 1000000).cast("string"), 6, "0"),
        F.date_format("o_orderdate", "yyyyMMdd"),
        F.lpad(key.cast("string"), 9, "0"),
    )
    late = F.when(key % 29 == 0, F.expr("INTERVAL 2 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    ordered = F.col("o_orderdate").cast("timestamp")
    return orders.select(
        "o_orderkey",
        (F.col("o_custkey") % 4).cast("int").alias("file_id"),
        F.when(key % 41 == 0, F.concat(F.lit("INVALID_FORMAT_"), key.cast("string"))).otherwise(code).alias("epc_code"),
        ordered.alias("ordered"),
        (ordered + late).alias("manufacture_date"),
    )


def scans(spark: SparkSession, sf_dir: str, product: bool = False) -> DataFrame:
    """All order lines as scan events. ``product`` adds the product name."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    orders = _items(table(spark, sf_dir, "orders"))
    df = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.col("l_linenumber")
    step = (
        F.when(F.col("l_suppkey") % 11 == 0, "Factory")
        .when(line == 1, "Factory").when(line <= 3, "WMS").when(line <= 5, "Wholesaler").otherwise("Retailer")
    )
    known = F.col("l_partkey") % 97 != 0
    shift = (5 * line + F.col("l_partkey") % 7) * 3_600_000_000
    df = df.withColumns({
        "event_id": _event_id(),
        "event_time": F.timestamp_micros(F.unix_micros("ordered") + shift),
        "business_step": step,
        "way": F.when(F.col("l_returnflag") == "R", "Outbound").otherwise("Inbound"),
        "location_id": (F.col("l_suppkey") % 58 + 1).cast("int"),
    })
    even = F.col("location_id") % 2 == 0

    def word(korean: str, english: str) -> Column:
        return F.when(even, korean).otherwise(english)

    keyword = (
        F.when(F.col("location_id") % 29 == 0, "site")
        .when(F.col("business_step") == "Factory", word("공장", "factory"))
        .when(F.col("business_step") == "WMS", word("창고", "logistics"))
        .when(F.col("business_step") == "Wholesaler", word("도매상", "wholesale"))
        .otherwise(word("소매상", "store"))
    )
    raw = (
        F.when(F.col("business_step") == "Factory", "Aggregation")
        .when(line == 3, F.concat(F.lit("HUB_"), "way"))
        .when(F.col("business_step") == "WMS", F.concat(F.lit("WMS_"), "way"))
        .when(F.col("business_step") == "Wholesaler", F.concat(F.lit("W_Stock_"), "way"))
        .when(F.col("l_partkey") % 5 == 0, "POS_Sell")
        .otherwise(F.concat(F.lit("R_Stock_"), "way"))
    )
    out = df.select(
        "event_id", "file_id", "epc_code", "event_time", "business_step",
        F.when(known, F.col("way")).alias("event_type"),
        F.when(known, raw).alias("event_type_raw"),
        "location_id",
        F.when(known, F.concat_ws("_", keyword, F.col("location_id").cast("string"))).alias("scan_location"),
        (33 + (F.col("location_id") * 37 % 500) / 100.0).alias("latitude"),
        (126 + (F.col("location_id") * 53 % 350) / 100.0).alias("longitude"),
        F.col("l_suppkey").cast("int").alias("operator_id"),
        (F.col("l_partkey") % 50).cast("int").alias("device_id"),
        F.concat_ws("_", "business_step", F.col("location_id").cast("string")).alias("hub_type"),
        "manufacture_date",
        F.concat(F.lit("file_"), F.col("file_id").cast("string")).alias("source_file"),
        *(["l_partkey"] if product else []),
    )
    if product:
        parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("product_name"))
        out = out.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").drop("l_partkey", "p_partkey")
    return out


SCANS_SQL = """
lines AS (
  SELECT l.*, o.o_custkey, o.o_orderdate,
    CASE WHEN l_suppkey % 11 = 0 OR l_linenumber = 1 THEN 'Factory' WHEN l_linenumber <= 3 THEN 'WMS'
         WHEN l_linenumber <= 5 THEN 'Wholesaler' ELSE 'Retailer' END AS step,
    CASE WHEN l_returnflag = 'R' THEN 'Outbound' ELSE 'Inbound' END AS way,
    CAST(l_suppkey % 58 + 1 AS INTEGER) AS place
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey),
scans AS (
  SELECT
    (l_orderkey % 68719476736)*134217728 + l_linenumber*CAST(16777216 AS BIGINT) + (l_partkey*31 + l_suppkey*7919
      + CAST(round(l_extendedprice*100) AS BIGINT)*104729 + CAST(l_quantity AS BIGINT)*611953) % 16777216 AS event_id,
    CAST(o_custkey % 4 AS INTEGER) AS file_id,
    CASE WHEN l_orderkey % 41 = 0 THEN 'INVALID_FORMAT_' || l_orderkey ELSE
      concat_ws('.', CASE WHEN l_orderkey % 37 = 0 THEN '999' ELSE '001' END,
        CASE WHEN l_orderkey % 20 = 0 THEN '1234567' WHEN l_orderkey % 3 = 0 THEN '8804823'
             WHEN l_orderkey % 3 = 1 THEN '8805843' ELSE '8809437' END,
        lpad(CAST(o_custkey AS VARCHAR), 7, '0'), lpad(CAST(l_orderkey % 1000000 AS VARCHAR), 6, '0'),
        strftime(o_orderdate, '%Y%m%d'), lpad(CAST(l_orderkey AS VARCHAR), 9, '0')) END AS epc_code,
    o_orderdate + to_hours(CAST(5*l_linenumber + l_partkey % 7 AS INTEGER)) AS event_time,
    step AS business_step,
    CASE WHEN l_partkey % 97 <> 0 THEN way END AS event_type,
    CASE WHEN l_partkey % 97 <> 0 THEN CASE
      WHEN step = 'Factory' THEN 'Aggregation' WHEN l_linenumber = 3 THEN 'HUB_' || way
      WHEN step = 'WMS' THEN 'WMS_' || way WHEN step = 'Wholesaler' THEN 'W_Stock_' || way
      WHEN l_partkey % 5 = 0 THEN 'POS_Sell' ELSE 'R_Stock_' || way END END AS event_type_raw,
    place AS location_id,
    CASE WHEN l_partkey % 97 <> 0 THEN concat_ws('_', CASE
      WHEN place % 29 = 0 THEN 'site'
      WHEN step = 'Factory' THEN CASE WHEN place % 2 = 0 THEN '공장' ELSE 'factory' END
      WHEN step = 'WMS' THEN CASE WHEN place % 2 = 0 THEN '창고' ELSE 'logistics' END
      WHEN step = 'Wholesaler' THEN CASE WHEN place % 2 = 0 THEN '도매상' ELSE 'wholesale' END
      ELSE CASE WHEN place % 2 = 0 THEN '소매상' ELSE 'store' END END, place) END AS scan_location,
    CAST(33 + (place*37 % 500)/100.0 AS DOUBLE) AS latitude,
    CAST(126 + (place*53 % 350)/100.0 AS DOUBLE) AS longitude,
    CAST(l_suppkey AS INTEGER) AS operator_id, CAST(l_partkey % 50 AS INTEGER) AS device_id,
    step || '_' || place AS hub_type,
    CASE WHEN l_orderkey % 29 = 0 THEN o_orderdate + INTERVAL 2 DAY ELSE o_orderdate END AS manufacture_date,
    'file_' || (o_custkey % 4) AS source_file, l_partkey
  FROM lines)"""

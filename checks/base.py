"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanwarden.skew import EPC_KEYS, hot_keys
from scanwarden.sources import table_scans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_HOT: dict[tuple[str, str], object] = {}

AS_OF_SQL = f"TIMESTAMP '{table_scans.AS_OF}'"


def query(name: str, sql: str | None = None, needs: str = ""):
    """Register ``fn(spark, sf_dir)``; ``sql`` may use the tables ``scans`` and those in ``needs``."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            parts = [table_scans.SCANS_SQL] + [SHARED[n] for n in needs.split()]
            SQL[name] = "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + sql.strip()
        return fn

    return keep


def plain(name: str, sql: str | None = None):
    """Register a query over other tables than the scans."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return keep


def scans(spark: SparkSession, sf_dir: str, product: bool = False) -> DataFrame:
    return table_scans.scans(spark, sf_dir, product)


def hot(spark: SparkSession, sf_dir: str):
    """Items with very many scans, measured once per table and session."""
    slot = (spark.sparkContext.applicationId, sf_dir)
    if slot not in _HOT:
        _HOT[slot] = hot_keys(scans(spark, sf_dir), EPC_KEYS)
    return _HOT[slot]


def when(column: str = "event_time"):
    """Time as text, so that both engines compare equal."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# ---- table expressions shared by several checks ------------------------------------------
PARTS = "string_split(epc_code, '.')"
FAKE_SQL = f"""
CASE WHEN epc_code IS NULL OR len({PARTS}) <> 6 THEN 100 ELSE
 CASE WHEN {PARTS}[1] <> '001' AND {PARTS}[2] NOT IN ('8804823','8805843','8809437') AND dstat <> 'valid' THEN 100
 ELSE least(100, CASE WHEN {PARTS}[1] = '001' THEN 0 ELSE 20 END
  + CASE WHEN {PARTS}[2] IN ('8804823','8805843','8809437') THEN 0 ELSE 25 END
  + CASE WHEN regexp_full_match({PARTS}[3], '[0-9]{{7}}') THEN 0 ELSE 15 END
  + CASE WHEN regexp_full_match({PARTS}[4], '[0-9]{{6}}') THEN 0 ELSE 15 END
  + CASE WHEN regexp_full_match({PARTS}[6], '[0-9]{{9}}') THEN 0 ELSE 10 END
  + CASE dstat WHEN 'valid' THEN 0 WHEN 'too_old' THEN 15 ELSE 20 END) END END"""

_LEVEL_WORDS = [
    ("공장", 0), ("factory", 0), ("제조", 0), ("manufacturing", 0), ("물류센터", 1), ("물류", 1), ("logistics", 1),
    ("hub", 1), ("센터", 1), ("center", 1), ("도매상", 2), ("도매", 2), ("wholesale", 2), ("w_stock", 2), ("창고", 2),
    ("warehouse", 2), ("소매상", 3), ("소매", 3), ("retail", 3), ("r_stock", 3), ("pos", 3), ("매장", 3), ("store", 3),
]


def level_sql(column: str) -> str:
    arms = " ".join(f"WHEN contains(lower({column}), '{w}') THEN {n}" for w, n in _LEVEL_WORDS)
    return f"CASE WHEN {column} IS NULL THEN 99 {arms} ELSE 99 END"


def step_sql(column: str) -> str:
    return f"CASE {column} WHEN 'Factory' THEN 1 WHEN 'WMS' THEN 2 WHEN 'Wholesaler' THEN 3 WHEN 'Retailer' THEN 4 ELSE 99 END"


def direction_sql(column: str) -> str:
    return (f"CASE WHEN {column} IS NULL THEN 'missing' WHEN {column} = 'POS_Sell' THEN 'other' "
            f"WHEN {column} = 'Aggregation' OR {column} LIKE '%_Inbound' THEN 'inbound' "
            f"WHEN {column} LIKE '%_Outbound' THEN 'outbound' ELSE 'other' END")


def place_step_sql(column: str) -> str:
    return (f"CASE WHEN {column} IS NULL THEN 'unknown' WHEN {column} = 'POS_Sell' THEN 'pos' "
            f"WHEN {column} = 'Aggregation' THEN 'aggregation' WHEN {column} LIKE 'WMS_%' THEN 'wms' "
            f"WHEN {column} LIKE 'HUB_%' THEN 'hub' WHEN {column} LIKE 'W_Stock%' THEN 'w_stock' "
            f"WHEN {column} LIKE 'R_Stock%' THEN 'r_stock' ELSE 'unknown' END")


W = "(PARTITION BY file_id, epc_code ORDER BY event_time, event_id)"

SHARED = {
    "dated": f"""
dated AS (
  SELECT *, CASE WHEN len({PARTS}) <> 6 OR try_strptime({PARTS}[5], '%Y%m%d') IS NULL THEN 'invalid_format'
    WHEN try_strptime({PARTS}[5], '%Y%m%d') > {AS_OF_SQL} THEN 'future_date'
    WHEN date_diff('day', CAST(try_strptime({PARTS}[5], '%Y%m%d') AS DATE), CAST({AS_OF_SQL} AS DATE)) > 1825
    THEN 'too_old' ELSE 'valid' END AS dstat FROM scans),
scored AS (SELECT *, CAST({FAKE_SQL} AS INTEGER) AS fake FROM dated)""",
    "prev": f"""
prev AS (
  SELECT *, lag(event_time) OVER w AS p_time, lag(event_type) OVER w AS p_type, lag(business_step) OVER w AS p_step,
    {step_sql('business_step')} AS lv, lag({step_sql('business_step')}) OVER w AS p_lv
  FROM scored WINDOW w AS (PARTITION BY file_id, epc_code ORDER BY event_time, event_id))""",
    "found": """
ties AS (
  SELECT file_id, epc_code, event_time, count(*) AS n, bool_or(business_step = 'Factory') AS f,
    bool_or(business_step = 'WMS') AS w, bool_or(contains(coalesce(scan_location,''), '공장')) AS lf,
    bool_or(contains(coalesce(scan_location,''), '창고')) AS lw
  FROM scans GROUP BY ALL),
found AS (
  SELECT p.*, coalesce(event_time < p_time, false)
      OR coalesce(event_type = 'Inbound' AND p_type = 'Inbound' AND business_step = p_step, false) AS ord,
    coalesce(lv < p_lv AND lv <> 99 AND p_lv <> 99, false) OR coalesce((p_lv=2 AND lv=4) OR (p_lv=1 AND lv IN (3,4)), false)
      OR coalesce(p_lv=1 AND lv=2 AND event_time = p_time, false) AS loc,
    t.n > 1 AND NOT (t.n = 2 AND t.f AND t.w AND t.lf AND t.lw) AS dup
  FROM prev p JOIN ties t USING (file_id, epc_code, event_time)),
findings AS (
  SELECT file_id, epc_code, event_id, event_time, fake > 0 AS f_fake, dup AS f_dup, loc AS f_loc, ord AS f_ord, fake
  FROM found WHERE fake > 0 OR dup OR loc OR ord)""",
}

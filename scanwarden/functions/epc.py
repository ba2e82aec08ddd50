"""Checks and repairs of item codes (EPC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanwarden import constants as C

STRICT_PATTERN = r"^\d{3}\.\d{7}\.\d{7}\.\d{6}\.\d{8}\.\d{9}$"
LOOSE_PATTERN = r"^\d{3}(\.\d+){5}$"


def _parts(epc: Column) -> Column:
    return F.split(F.trim(epc), r"\.", -1)


def _digits(text: Column, n: int) -> Column:
    return text.rlike(f"^[0-9]{{{n}}}$")


def _flags(parts: Column) -> dict[str, Column]:
    whole = F.coalesce(F.size(parts) == C.EPC_PARTS, F.lit(False))

    def flag(test: Column) -> Column:
        return whole & F.coalesce(test, F.lit(False))

    def at(n: int) -> Column:
        return F.get(parts, F.lit(n))

    return {
        "structure": whole,
        "header": flag(at(0) == C.VALID_HEADER),
        "company": flag(at(1).isin(*C.VALID_COMPANIES)),
        "product": flag(_digits(at(2), C.PRODUCT_DIGITS)),
        "lot": flag(_digits(at(3), C.LOT_DIGITS)),
        "serial": flag(_digits(at(5), C.SERIAL_DIGITS)),
    }


def epc_parts(epc: Column) -> Column:
    """Which parts of the code are well formed; all false unless there are six parts."""
    return F.struct(*[test.alias(name) for name, test in _flags(_parts(epc)).items()])


def _date(text: Column) -> Column:
    return F.try_to_date(F.when(_digits(text, 8), text), "yyyyMMdd")


def mfg_date(epc: Column) -> Column:
    """Manufacture date inside the code, null when it is not exactly eight digits of a real date."""
    return _date(F.get(_parts(epc), F.lit(4)))


def _date_status(day: Column, as_of: Column) -> Column:
    return (
        F.when(day.isNull(), "invalid_format")
        .when(day.cast("timestamp") > as_of, "future_date")
        .when(F.datediff(as_of.cast("date"), day) > C.MAX_AGE_DAYS, "too_old")
        .otherwise("valid")
    )


def mfg_date_status(text: Column, as_of: Column) -> Column:
    """valid / future_date / too_old / invalid_format."""
    return _date_status(_date(text), as_of)


def epc_date_status(epc: Column, as_of: Column) -> Column:
    return _date_status(mfg_date(epc), as_of)


def _score(flags: dict[str, Column], status: Column) -> Column:
    weights = (
        ("header", C.SCORE_HEADER), ("company", C.SCORE_COMPANY), ("product", C.SCORE_PRODUCT),
        ("lot", C.SCORE_LOT), ("serial", C.SCORE_SERIAL),
    )
    total = F.when(status == "valid", 0).when(status == "too_old", C.SCORE_DATE_OLD).otherwise(C.SCORE_DATE)
    for name, weight in weights:
        total = total + F.when(flags[name], 0).otherwise(weight)
    hopeless = ~flags["header"] & ~flags["company"] & (status != "valid")
    worst = ~flags["structure"] | hopeless
    return F.when(worst, C.SCORE_MAX).otherwise(F.least(F.lit(C.SCORE_MAX), total)).cast("int")


def epc_fake_score(epc: Column, as_of: Column) -> Column:
    """0 (sound) to 100 (certainly not a real code), as one expression."""
    return _score(_flags(_parts(epc)), epc_date_status(epc, as_of))


def with_fake_score(df: DataFrame, as_of: Column, name: str = "epcFakeScore", epc: str = "epc_code") -> DataFrame:
    """Adds the score in three projections, so that the code is split and its date parsed once per row."""
    df = df.withColumn("_parts", _parts(F.col(epc)))
    df = df.withColumn("_day", _date(F.get("_parts", F.lit(4))))
    df = df.withColumn("_status", _date_status(F.col("_day"), as_of))
    df = df.withColumn(name, _score(_flags(F.col("_parts")), F.col("_status")))
    return df.drop("_parts", "_day", "_status")


def with_epc_checks(df: DataFrame, as_of: Column, epc: str = "epc_code") -> DataFrame:
    """Adds ``_parts`` (array), ``_ok`` (flags) and ``_status`` (date), each from the one before."""
    df = df.withColumn("_parts", _parts(F.col(epc)))
    df = df.withColumn("_day", _date(F.get("_parts", F.lit(4))))
    flags = F.struct(*[test.alias(name) for name, test in _flags(F.col("_parts")).items()])
    return df.withColumns({"_ok": flags, "_status": _date_status(F.col("_day"), as_of)}).drop("_day")


def strict_epc_format(epc: Column) -> Column:
    return F.coalesce(epc.rlike(STRICT_PATTERN), F.lit(False))


def repair_epc(epc: Column) -> Column:
    """Put back missing dots (long codes without any) or replace the first wrong separator found.

    Codes that need neither are returned untouched.
    """
    text = F.upper(F.trim(epc))
    cuts = ((1, 3), (4, 7), (11, 7), (18, 6), (24, 8))
    pieces = [F.substring(text, start, size) for start, size in cuts]
    rest = F.substring(text, F.lit(32), F.length(text))
    fixed = F.when(~text.contains(".") & (F.length(text) >= 40), F.concat_ws(".", *pieces, rest))
    for mark in ("-", "_", " ", ","):
        fixed = fixed.when(text.contains(mark), F.translate(text, mark, "."))
    return fixed.otherwise(epc)

"""Table functions for SQL: lists of an item's violations, one event after the other."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

_KEYS = ("file_id", "epc_code")


def _ordered(table: AnalyzeArgument, needs: tuple[str, ...], out: list[tuple[str, type]]) -> AnalyzeResult:
    """Rows of one item in order of time, whatever the caller says about partitions; the keys keep their types."""
    if not table.isTable:
        raise ValueError("the argument must be a table")
    missing = [c for c in (*_KEYS, "event_id", "event_time", *needs) if c not in table.dataType.names]
    if missing:
        raise ValueError(f"the table has no {', '.join(missing)}")
    schema = StructType([table.dataType[c] for c in (*_KEYS, "event_id")])
    for name, kind in out:
        schema = schema.add(name, kind())
    return AnalyzeResult(schema, partitionBy=[PartitioningColumn(c) for c in _KEYS], orderBy=[OrderingColumn("event_time"), OrderingColumn("event_id")])


class LocationMoves:
    """Moves over more than two levels (big_jump) or back over more than one (reverse_jump). Holds the event before, nothing else."""

    def __init__(self):
        self.position, self.level, self.place = -1, None, None

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _ordered(table, ("scan_location", "level"), [
            ("position", LongType), ("from_location", StringType), ("to_location", StringType), ("from_level", IntegerType),
            ("to_level", IntegerType), ("level_jump", IntegerType), ("violation_type", StringType)])

    def eval(self, row):
        self.position += 1
        before, place, level = self.level, self.place, row["level"]
        self.level, self.place = level, row["scan_location"]
        if self.position and before is not None and level is not None and before >= 0 and level >= 0:
            jump = level - before
            if abs(jump) > 2 or jump < -1:
                yield (row["file_id"], row["epc_code"], row["event_id"], self.position, place, row["scan_location"], before, level, jump,
                       "big_jump" if abs(jump) > 2 else "reverse_jump")


class StageMoves:
    """Events whose stage lies before that of the event before; ``stage_rank`` orders the stages."""

    def __init__(self):
        self.position, self.stage, self.rank = -1, None, None

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _ordered(table, ("stage", "stage_rank", "event_type", "scan_location"), [
            ("position", LongType), ("from_stage", StringType), ("to_stage", StringType), ("event_type", StringType), ("scan_location", StringType)])

    def eval(self, row):
        self.position += 1
        stage, rank = self.stage, self.rank
        self.stage, self.rank = row["stage"], row["stage_rank"]
        if self.position and rank is not None and self.rank is not None and self.rank < rank:
            yield (row["file_id"], row["epc_code"], row["event_id"], self.position, stage, self.stage, row["event_type"], row["scan_location"])


def register_table_functions(spark: SparkSession) -> None:
    """``location_violations(TABLE(t))`` and ``order_violations(TABLE(t))``: the rows of the operators of these names, for SQL.

    Tables have file_id, epc_code, event_id, event_time and scan_location, and ``level``, or ``stage``, ``stage_rank`` and ``event_type``.
    """
    spark.udtf.register("location_violations", udtf(LocationMoves))
    spark.udtf.register("order_violations", udtf(StageMoves))

"""How filters act in each order: a filter interaction audit (operator 11)."""

from __future__ import annotations

import string
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_SPACE = r"[\x20\x09-\x0D]+"


def failed_filters(docs: DataFrame, ident: str = "doc_id", text: str = "text", part: str = "lang", least_words: int = 200,
                   least_distinct: int = 50, most_capitals: int = 3, symbols: str = r"[#$%\&*|]") -> DataFrame:
    """``part``, ``doc_id``, ``mask`` and ``n``: rows of ``docs`` by the filters that they fail (bit k for the k-th of ``FILTERS``).

    A: under ``least_words`` words; B: fewer than ``least_distinct`` in 100 words distinct; C: more than ``most_capitals`` in 100
    code points in A-Z; D: holds one of ``symbols``; E: the text is that of a row with a smaller id. A null text counts as
    empty, a null part as an empty string; a null id is neither smaller nor larger than another; rows alike in all columns
    are counted in ``n``; an empty table gives no rows; other columns are ignored.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(ident).alias("doc_id"), body.alias("body"))
    rows = rows.withColumn("words", F.array_remove(F.split("body", _SPACE), ""))
    words, capitals = F.size("words"), F.length("body") - F.length(F.translate("body", string.ascii_uppercase, ""))
    fails = [words < least_words, 100 * F.size(F.array_distinct("words")) < least_distinct * words,
             100 * capitals > most_capitals * F.length("body"), F.col("body").rlike(symbols)]
    rows = rows.select("part", "doc_id", F.unhex(F.sha2("body", 256)).alias("digest"), _mask(fails).alias("mask"))
    rows = rows.groupBy("part", "doc_id", "digest", "mask").agg(F.count("*").alias("n"))
    # the first owner of a text is joined on both columns, so a text with many copies is no hot key
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["digest", "doc_id"], "left")
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.select("part", "doc_id", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"), "n")


def _mask(fails: Sequence[Column]) -> Column:
    total = F.lit(0)
    for k, x in enumerate(fails):
        total = total + F.when(x, 1 << k).otherwise(0)
    return total


def mask_cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask``, ``good``, ``toxic`` and ``n`` documents; an id that is labelled more than once has a label if one row says so."""
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = failed.join(said, "doc_id", "left")
    no = F.lit(False)
    return rows.groupBy("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n"))


def _counted(cell: Column, orders: Column) -> Column:
    """The counts of one cell at all steps of all orders: each order is folded from its first filter to its last."""
    none = F.lit(0).cast("long")

    def when(condition: Column) -> Column:
        return F.when(condition, cell["n"]).otherwise(none)

    def step(state: Column, bit: Column) -> Column:
        fails, gone = cell["mask"].bitwiseAND(bit) > 0, state["gone"]
        removed = fails & ~gone
        counts = F.struct(bit.alias("bit"), when(~gone & ~fails).alias("kept"), when(removed).alias("removed"), when(fails & gone).alias("redundant"),
                          when(cell["mask"] == bit).alias("unique_fails"), when(removed & cell["good"]).alias("good_lost"),
                          when(removed & cell["toxic"]).alias("toxic_lost"))
        return F.struct((gone | fails).alias("gone"), F.array_append(state["steps"], counts).alias("steps"))

    start = F.struct(F.lit(False).alias("gone"), F.array().cast(_STEPS).alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["steps"])))


_STEPS = "array<struct<bit:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the cells of ``mask_cells``.

    A part has at most 4 * 2 ** len(filters) cells, whatever its number of documents. Each cell is folded over the array of all
    orders, a constant of the plan; the arrays of a part's cells are added element by element. ``shapley`` is the
    sum of what the step's filter removes, over all orders.
    """
    names = ["".join(p) for p in permutations(filters)]
    orders = F.expr("array(" + ", ".join(f"array({', '.join(str(1 << filters.index(c)) for c in name)})" for name in names) + ")")
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))

    def add(a: Column, b: Column) -> Column:
        return F.struct(a["bit"].alias("bit"), *[(a[c] + b[c]).alias(c) for c in COUNTS])

    rest = F.slice("cells", 2, F.size("cells"))
    total = F.aggregate(rest, _counted(F.element_at("cells", 1), orders), lambda sums, cell: F.zip_with(sums, _counted(cell, orders), add))

    def with_shares(steps: Column) -> Column:
        def over_orders(bit: int) -> Column:
            return F.aggregate(F.filter(steps, lambda s: s["bit"] == bit), F.lit(0).cast("long"), lambda a, s: a + s["removed"])

        shares = F.map_from_arrays(F.array(*map(F.lit, bits)), F.array(*map(over_orders, bits)))
        return F.transform(F.array(shares), lambda x: F.transform(steps, lambda s: s.withField("shapley", x[s["bit"]])))[0]

    bits = [1 << k for k in range(len(filters))]
    # the outer form, as the plain one works the array out twice: a part has cells, so it is never empty
    steps = F.transform(F.array(total.cast(_STEPS)), with_shares)[0]
    rows = held.select("part", F.posexplode_outer(steps).alias("pos", "s"))
    width = len(filters)
    return rows.select(
        "part", F.element_at(F.expr(f"array({str(names)[1:-1]})"), (F.col("pos") / width).cast("int") + 1).alias("filter_order"),
        (F.col("pos") % width + 1).cast("int").alias("step"), *[F.col("s")[c].alias(c) for c in (*COUNTS, "shapley")])


def filter_audit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``interactions`` of the five filters over whole texts; see ``failed_filters`` and ``mask_cells`` for nulls, ties and repeated rows."""
    return interactions(mask_cells(failed_filters(docs, ident, text, part), labels))

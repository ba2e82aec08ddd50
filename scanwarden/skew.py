"""Ordered work per key that holds when one key owns a large share of all rows.

A window over ``(file_id, epc_code)`` puts all events of one item into one task. That is
right for ordinary items (a handful of events) and wrong for an item code that is shared
by billions of rows. ``over_sequence`` therefore runs the same window code twice:

* ordinary keys: the plain window, one exchange on the key;
* hot keys (more rows than a limit): rows are range-partitioned by key *and order*, so a
  key is spread over many bounded pieces; each piece gets the few rows before and after it
  that the window code looks at, and those helper rows are dropped afterwards.

``running_totals`` does the same for prefix sums in a global or per-group order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from scanwarden.session import ensure_checkpoint_dir

EPC_KEYS = ("file_id", "epc_code")
EVENT_ORDER = ("event_time", "event_id")
HOT_ROWS = 1_000_000
BROADCAST_ROWS = 100_000
#: Hashes of keys by which ``hot_keys`` counts rows first.
KEY_SLOTS = 1 << 16
#: Equal ranges of a value in which ``quantile_grid`` counts rows first.
GRID_RANGES = 1 << 16

_PIECE, _HELPER, _OFFSET, _ROW = "_sq_piece", "_sq_helper", "_sq_offset", "_sq_row"


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join that keeps the key columns of the left side only."""
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_k_{k}" for k in keys])


def side_by_side(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Columns of tables that have one row per key, null keys too, on one row per key: one aggregation instead of a join per table.
    No table may have a column of another; a key that a table lacks has nulls there."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rows.columns if c not in keys])


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a derived dimension after counting it; leave the join to the planner beyond that."""
    rows = df.take(max_rows + 1)
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


@dataclass(frozen=True)
class HotKeys:
    """Keys with more rows than the limit, and how many rows they have together."""

    table: DataFrame
    rows: int
    limit: int


def hot_keys(df: DataFrame, keys: Sequence[str] = EPC_KEYS, limit: int = HOT_ROWS) -> HotKeys | None:
    """Find hot keys with map-side combined counts; ``None`` when there are none.

    Rows are counted by a short hash of the key first, so that keys themselves move only where their hash has more rows than the limit.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(KEY_SLOTS))
    full = df.groupBy(slot.alias("_slot")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit).collect()  # at most KEY_SLOTS rows
    if not full:
        return None
    near = F.broadcast(df.sparkSession.createDataFrame([(r["_slot"],) for r in full], "_slot long"))
    df = df.select(*keys, slot.alias("_slot")).join(near, "_slot", "left_semi")
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit)
    found = counts.take(BROADCAST_ROWS + 1)
    if not found:
        return None
    if len(found) <= BROADCAST_ROWS:
        local = df.sparkSession.createDataFrame(found, counts.schema)
        return HotKeys(F.broadcast(local.drop("_rows")), sum(r["_rows"] for r in found), limit)
    total = counts.agg(F.sum("_rows")).first()[0]
    return HotKeys(counts.drop("_rows"), total, limit)


MEASURE = "measure"  # default of ``hot`` arguments: look for hot keys first


@dataclass(frozen=True)
class Steps:
    """What window code may ask about neighbours, in either of the two runs."""

    window: WindowSpec
    split: bool = False
    turned: WindowSpec | None = None

    def back(self, column, n: int = 1) -> Column:
        return F.lag(column, n).over(self.window)

    def ahead(self, column, n: int = 1) -> Column:
        return F.lead(column, n).over(self.window)

    def position(self) -> Column:
        """1-based position of the event in the whole sequence of its key."""
        number = F.row_number().over(self.window).cast("long")
        return number + F.col(_OFFSET) if self.split else number

    def recent(self, rows_back: int, rows_ahead: int = 0) -> WindowSpec:
        return self.window.rowsBetween(-rows_back, rows_ahead)

    def last_known(self, column: str, include_current: bool = False) -> Column:
        """Last non-null value before (or up to) the row; list the column in ``carry``."""
        frame = self.window.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
        value = F.last(column, ignorenulls=True).over(frame)
        return F.coalesce(value, F.col(f"_prior_{column}")) if self.split else value

    def next_known(self, column: str, include_current: bool = False) -> Column:
        """First non-null value after (or from) the row; list the column in ``carry``. Looked up in the opposite order: a frame that ends with the key is
        read anew for each row, so that its cost grows with the square of the key's rows."""
        frame = self.turned.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
        value = F.last(column, ignorenulls=True).over(frame)
        return F.coalesce(value, F.col(f"_later_{column}")) if self.split else value


def over_sequence(
    df: DataFrame,
    build: Callable[[DataFrame, Steps], DataFrame],
    *,
    keys: Sequence[str] = EPC_KEYS,
    order: Sequence[str] = EVENT_ORDER,
    before: int = 1,
    after: int = 0,
    carry: Sequence[str] = (),
    hot: HotKeys | str | None = MEASURE,
) -> DataFrame:
    """Add columns computed from neighbouring events of the same key.

    ``build`` only adds columns and looks at most ``before`` rows back and ``after`` rows
    ahead; unbounded looks for the last or next non-null value go through ``carry``.
    """
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    def steps(rows: DataFrame, names: Sequence[str], split: bool = False) -> tuple[DataFrame, Steps]:
        whole = Window.partitionBy(*names)
        if not carry:
            return rows, Steps(whole.orderBy(*order), split)
        # rows are numbered, so that both directions agree where the order has ties
        rows = rows.withColumn(_ROW, F.row_number().over(whole.orderBy(*order)))
        return rows, Steps(whole.orderBy(_ROW), split, whole.orderBy(F.desc(_ROW)))

    if hot is None:
        return build(*steps(df, keys)).drop(_ROW)
    ordinary = join_on(df, hot.table, keys, "left_anti")
    heavy = _pieces(join_on(df, hot.table, keys, "left_semi"), keys, order, hot)
    heavy = _with_helpers(heavy, keys, order, before, after, carry)
    done = build(*steps(heavy, [*keys, _PIECE], True)).where(~F.col(_HELPER))
    done = done.drop(_PIECE, _HELPER, _OFFSET, _ROW, *[f"_prior_{c}" for c in carry], *[f"_later_{c}" for c in carry])
    return build(*steps(ordinary, keys)).drop(_ROW).unionByName(done)


def _pieces(df: DataFrame, keys, order, hot: HotKeys) -> DataFrame:
    """Spread rows over range partitions of about ``limit`` rows and fix the piece number.

    The checkpoint freezes the piece numbers: range bounds come from a sample, so a second
    evaluation could cut elsewhere.
    """
    ensure_checkpoint_dir(df.sparkSession)
    parts = max(2, math.ceil(hot.rows / max(1, hot.limit)))
    ranged = df.repartitionByRange(parts, *keys, *order)
    return ranged.withColumn(_PIECE, F.spark_partition_id()).checkpoint()


def _piece_table(df: DataFrame, keys, order, carry: Sequence[str] = ()) -> DataFrame:
    """One row per (key, piece): size, rows before it, carried values. As many rows as pieces."""
    stamp = F.struct(*order)
    aggs = [F.count("*").alias("_sq_size")]
    for c in carry:
        known = F.col(c).isNotNull()
        aggs.append(F.max_by(F.col(c), F.when(known, stamp)).alias(f"_last_{c}"))
        aggs.append(F.min_by(F.col(c), F.when(known, stamp)).alias(f"_first_{c}"))
    table = df.groupBy(*keys, _PIECE).agg(*aggs)
    w = Window.partitionBy(*keys).orderBy(_PIECE)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc(_PIECE)).rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("_sq_number", F.row_number().over(w))
    table = table.withColumn("_sq_rows_before", F.coalesce(F.sum("_sq_size").over(earlier), F.lit(0)))
    for c in carry:
        table = table.withColumn(f"_prior_{c}", F.last(f"_last_{c}", True).over(earlier))
        table = table.withColumn(f"_later_{c}", F.last(f"_first_{c}", True).over(later))
    return table


def _edge_copies(df, pieces, keys, order, count: int, ahead: bool) -> DataFrame:
    """Copies of up to ``count`` rows next to each piece, labelled with that piece."""
    direction = [F.col(o).asc() if ahead else F.col(o).desc() for o in order]
    near = Window.partitionBy(*keys, _PIECE).orderBy(*direction)
    edge = df.withColumn("_sq_rank", F.row_number().over(near)).where(F.col("_sq_rank") <= count).drop("_sq_rank")
    numbers = pieces.select(*keys, _PIECE, "_sq_number")
    edge = join_on(edge, numbers, [*keys, _PIECE], "inner")
    sign = -1 if ahead else 1
    target = edge.withColumn("_sq_step", F.explode(F.sequence(F.lit(1), F.lit(count))))
    target = target.withColumn("_sq_number", F.col("_sq_number") + F.lit(sign) * F.col("_sq_step"))
    target = target.drop("_sq_step", _PIECE)
    target = join_on(target, numbers, [*keys, "_sq_number"], "inner")
    best = Window.partitionBy(*keys, _PIECE).orderBy(*direction)
    return target.withColumn("_sq_rank", F.row_number().over(best)).where(F.col("_sq_rank") <= count).drop("_sq_rank", "_sq_number")


def _with_helpers(df, keys, order, before, after, carry) -> DataFrame:
    pieces = _piece_table(df, keys, order, carry)
    rows = df.withColumn(_HELPER, F.lit(False)).withColumn("_sq_lead_in", F.lit(0).cast("long"))
    if before:
        copies = _edge_copies(df, pieces, keys, order, before, ahead=False)
        rows = rows.unionByName(copies.withColumn(_HELPER, F.lit(True)).withColumn("_sq_lead_in", F.lit(1).cast("long")))
    if after:
        copies = _edge_copies(df, pieces, keys, order, after, ahead=True)
        rows = rows.unionByName(copies.withColumn(_HELPER, F.lit(True)).withColumn("_sq_lead_in", F.lit(0).cast("long")))
    info = pieces.select(*keys, _PIECE, "_sq_rows_before", *[f"_prior_{c}" for c in carry], *[f"_later_{c}" for c in carry])
    rows = join_on(rows, broadcast_if_small(info), [*keys, _PIECE], "inner")
    lead_in = F.sum("_sq_lead_in").over(Window.partitionBy(*keys, _PIECE))
    return rows.withColumn(_OFFSET, F.col("_sq_rows_before") - lead_in).drop("_sq_lead_in", "_sq_rows_before")


def colocated(df: DataFrame, keys: Sequence[str], hot: HotKeys | None) -> DataFrame:
    """Exchange on the keys now, so that costly columns are computed on the balanced side of it.

    Windows and aggregates on the same keys reuse this partitioning, so the plan keeps one
    exchange. With hot keys nothing is moved here; ``over_sequence`` spreads those rows.
    """
    return df.repartition(*keys) if hot is None else df


def with_key_stats(
    df: DataFrame,
    stats: dict[str, Column],
    *,
    keys: Sequence[str] = EPC_KEYS,
    hot: HotKeys | str | None = MEASURE,
) -> DataFrame:
    """Put aggregates of the whole key on each of its rows.

    Without hot keys the window reuses the exchange of the sequence windows. With hot keys
    the aggregate is combined map-side and joined back (the planner splits skewed joins).
    """
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    if hot is None:
        whole = Window.partitionBy(*keys)
        return df.withColumns({name: agg.over(whole) for name, agg in stats.items()})
    table = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in stats.items()])
    return join_on(df, table, keys)


def with_group_count(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Size of any group on each of its rows, counted map-side before the join."""
    return join_on(df, df.groupBy(*keys).agg(F.count("*").alias(name)), keys)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    *,
    bounded: bool = False,
    limit: int = HOT_ROWS,
    descending: bool = False,
) -> DataFrame:
    """Inclusive prefix sums in the order of distinct ``order`` values inside each group.

    Callers pre-aggregate equal values first. ``bounded`` says the number of distinct values
    is fixed by the domain (scores 0-100, hours), so one plain window is enough.
    """
    base = df.withColumns({f"_v_{name}": expr for name, expr in sums.items()})
    sort = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    if not bounded:
        sizes = base.groupBy(*keys).agg(F.count("*").alias("_rows")).agg(
            F.max("_rows").alias("top"), F.sum("_rows").alias("all")).first()
        bounded = (sizes["top"] or 0) <= limit
    if bounded:
        frame = Window.partitionBy(*keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
        return base.withColumns({n: F.sum(f"_v_{n}").over(frame) for n in sums}).drop(*[f"_v_{n}" for n in sums])
    ensure_checkpoint_dir(df.sparkSession)
    parts = max(2, math.ceil(sizes["all"] / max(1, limit)))
    spread = base.repartitionByRange(parts, *keys, *sort)
    spread = spread.withColumn(_PIECE, F.spark_partition_id()).checkpoint()
    per_piece = spread.groupBy(*keys, _PIECE).agg(*[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    per_piece = per_piece.select(
        *keys, _PIECE, *[F.coalesce(F.sum(f"_p_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    joined = join_on(spread, broadcast_if_small(per_piece), [*keys, _PIECE], "inner")
    frame = Window.partitionBy(*keys, _PIECE).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({n: F.sum(f"_v_{n}").over(frame) + F.col(f"_b_{n}") for n in sums})
    return out.drop(_PIECE, *[f"_v_{n}" for n in sums], *[f"_b_{n}" for n in sums])


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    *,
    bounded: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per probability; ``weight`` names how many values a row stands for.

    Equal values are counted first, then ranked by prefix sums; no task holds the values of
    a whole group, unlike the built-in exact ``percentile``.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        (F.count("*") if weight is None else F.sum(weight)).alias("_n"))
    ranked = running_totals(counted, keys, [value], {"_upto": F.col("_n")}, bounded=bounded)
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = join_on(ranked, totals, keys) if keys else ranked.crossJoin(F.broadcast(totals))
    aggs = []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("_total") - 1)
        for tag, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
            aggs.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{tag}_{name}"))
    picked = ranked.groupBy(*keys).agg(F.first("_total").alias("_total"), *aggs)
    out = []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("_total") - 1)
        share = place - F.floor(place)
        out.append((F.col(f"_lo_{name}") + share * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return picked.select(*keys, *out)


def quantile_grid(df: DataFrame, value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles of one column as one array, for many probabilities at once.

    Rows are counted in equal ranges of the value; only those of ranges that hold a wanted rank are ordered, range by range.
    Three passes over ``df``.
    """
    v = F.col(value).cast("double")
    known = df.where(F.col(value).isNotNull()).select(v.alias("_v"))
    finite = ~F.isnan("_v") & (F.abs("_v") != float("inf"))
    edge = known.agg(F.min(F.when(finite, F.col("_v"))).alias("low"), F.max(F.when(finite, F.col("_v"))).alias("high")).first()
    low, width = edge["low"] or 0.0, (edge["high"] or 0.0) - (edge["low"] or 0.0)
    if 0 < width < float("inf"):
        place = F.least(F.floor((F.col("_v") - low) / width * GRID_RANGES), F.lit(GRID_RANGES - 1)).cast("int")
    else:
        place = F.lit(0)
    place = F.when(F.isnan("_v") | (F.col("_v") == float("inf")), GRID_RANGES).when(F.col("_v") == float("-inf"), -1).otherwise(place)
    known = known.withColumn("_range", place)
    counts = known.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()  # at most GRID_RANGES + 2 rows
    total = sum(r["n"] for r in counts)
    places = [float(p) * (total - 1) for p in probabilities]
    ranks, wanted, before = sorted({r for x in places for r in (math.floor(x), math.ceil(x))}), [], 0
    for r in counts:
        inside = [k for k in ranks if before <= k < before + r["n"]]
        if inside:
            wanted.append((r["_range"], before, inside))
        before += r["n"]
    near = df.sparkSession.createDataFrame(wanted, "_range int, _before long, _ranks array<long>")
    few = known.join(F.broadcast(near.select("_range")), "_range").groupBy("_range", "_v").agg(F.count("*").alias("_n"))
    ranked = running_totals(few, ["_range"], ["_v"], {"_upto": F.col("_n")}).join(F.broadcast(near), "_range")
    upto = F.col("_before") + F.col("_upto")
    hits = ranked.select(F.explode(F.filter("_ranks", lambda r: (r >= upto - F.col("_n")) & (r < upto))).alias("_rank"), "_v")
    # at most two entries per probability
    table = hits.agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def between(x: float) -> Column:
        low = F.col("_at")[F.lit(math.floor(x)).cast("long")]
        return low + F.lit(x - math.floor(x)) * (F.col("_at")[F.lit(math.ceil(x)).cast("long")] - low)

    return table.select(F.array(*[between(x) for x in places]).alias("quantiles"))


def paged(df: DataFrame, keys: Sequence[str], row_key: Sequence[str], page_rows: int) -> DataFrame:
    """Cut each group into pages of about ``page_rows`` rows by a hash of the row key."""
    sized = with_group_count(df, keys, "_rows")
    pages = F.ceil(F.col("_rows") / F.lit(page_rows)).cast("long")
    page = F.pmod(F.xxhash64(*row_key), F.greatest(pages, F.lit(1)))
    return sized.withColumn("page", (page + 1).cast("int")).withColumn("pages", pages.cast("int")).drop("_rows")

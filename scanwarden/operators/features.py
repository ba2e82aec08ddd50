"""Feature rows per item and per event. Column names are the contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanwarden import constants as C
from scanwarden.functions import clock, epc, moves
from scanwarden.functions.sequences import left_padded, normalized
from scanwarden.operators.profile import entropy, epc_profile, long_form, with_entropies
from scanwarden.operators.windows import gap_zscore, hub_type_changed, location_moves, rolling_gap, scan_position, step_moves, time_gap
from scanwarden.skew import (
    EPC_KEYS, EVENT_ORDER, MEASURE, HotKeys, Steps, colocated, hot_keys, join_on, over_sequence, quantiles, with_key_stats)

Hot = HotKeys | str | None

FAKE = ("structure_valid", "header_valid", "company_valid", "product_valid", "lot_valid", "serial_valid",
        "date_valid", "date_future", "date_old", "epc_length")
DUP = ("event_count", "unique_locations", "unique_event_types", "time_span", "avg_gap", "max_gap",
       "location_repetition", "event_type_repetition")
ORDER = ("sequence_length", "unique_event_types", "transition_count", "backward_transitions", "temporal_disorder",
         "max_gap", "production_ratio", "logistics_ratio", "retail_ratio", "event_entropy", "regularity",
         "violation_density")
LOCATION = ("sequence_length", "unique_locations", "hierarchy_violations", "unknown_locations", "reverse_transitions",
            "max_hierarchy_jump", "level0_ratio", "level1_ratio", "level2_ratio", "level3_ratio", "location_entropy",
            "hierarchy_consistency", "geographic_scatter", "transition_regularity", "anomaly_density")
JUMP = ("sequence_length", "time_span", "avg_gap", "max_gap", "min_gap", "gap_variance", "impossible_jumps",
        "negative_gaps", "zero_gaps", "time_regularity")
LOCATION_EVENT = ("current_level", "prev_level", "next_level", "change_from_prev", "change_to_next", "is_reverse",
                  "is_big_jump", "is_first", "is_last", "sequence_length")
JUMP_EVENT = ("time_from_prev", "time_to_next", "relative_position", "sequence_length", "time_span", "avg_gap",
              "is_first", "is_last")


def _num(c: Column) -> Column:
    return c.cast("double")


def _kinds(df: DataFrame, columns: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """Distinct non-null values per item for several columns, through counted pairs."""
    rows = long_form(df, list(columns), list(keys), cast="string").where(F.col("value").isNotNull())
    pairs = rows.groupBy(*keys, "column", "value").agg(F.lit(1).alias("one"))
    return pairs.groupBy(*keys).agg(*[F.count_if(F.col("column") == c).alias(n) for c, n in columns.items()])


def fake_features(df: DataFrame, as_of: Column, keys: Sequence[str] = EPC_KEYS) -> DataFrame:
    """Ten numbers about the code itself."""
    items = epc.with_epc_checks(df.select(*keys).distinct(), as_of)
    dated = F.size("_parts") >= 5
    parts = ("structure", "header", "company", "product", "lot", "serial")
    values = [_num(F.col("_ok")[p]) for p in parts]
    values += [_num(dated & (F.col("_status") == s)) for s in ("valid", "future_date", "too_old")]
    values.append(F.least(F.length("epc_code") / 100.0, F.lit(1.0)))
    return items.select(*keys, *[v.alias(n) for n, v in zip(FAKE, values)])


def dup_features(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                 hot: Hot = MEASURE) -> DataFrame:
    """Eight numbers about repetition."""
    rows = time_gap(df, keys=keys, order=order, hot=hot, first=None)
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), clock.hours_between(F.max("event_time"), F.min("event_time")).alias("span"),
        (F.avg("time_gap_seconds") / 3600).alias("mean"), (F.max("time_gap_seconds") / 3600).alias("top"))
    base = join_on(base, _kinds(df, {"scan_location": "places", "event_type": "types"}, keys), keys).fillna(0)
    n, places, types = (_num(F.col(c)) for c in ("n", "places", "types"))

    def cap(c: str, unit: float) -> Column:
        return F.least(F.coalesce(F.col(c), F.lit(0.0)) / unit, F.lit(1.0))

    values = [n, places, types, cap("span", 168.0), cap("mean", 24.0), cap("top", 48.0), 1 - places / n, 1 - types / n]
    return base.select(*keys, *[v.alias(name) for name, v in zip(DUP, values)])


def _backtracked(s: Steps, column: str, rows: int) -> dict[str, Column]:
    return {f"_x{n}": s.back(column, n) for n in range(1, rows + 1)}


def _repeats(length: int) -> Column:
    """True where the last ``length`` values equal the ``length`` values before them."""
    same = F.lit(True)
    for t in range(length):
        a = F.col("_kind") if t == 0 else F.col(f"_x{t}")
        same = same & F.coalesce(a == F.col(f"_x{t + length}"), F.lit(False))
    return same


def order_features(df: DataFrame, *, type_column: str = "event_type", strict: bool = False,
                   keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER, hot: Hot = MEASURE) -> DataFrame:
    """Twelve numbers about the order of events.

    ``strict`` leaves the stage features at 0, as an implementation does that compares
    (direction, step) pairs with stage names.
    """
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = moves.with_event_kind(colocated(df, keys, hot), type_column)
    rows = rows.withColumn("_stage", F.lit(None).cast("string") if strict else moves.stage_of_kind(F.col("_kind")))
    rows = rows.withColumn("_rank", moves.stage_rank(F.col("_stage")))

    def look(d: DataFrame, s: Steps) -> DataFrame:
        return d.withColumns({
            **_backtracked(s, "_kind", 7), "_p_rank": s.back("_rank"),
            "_gap": clock.hours_between(F.col("event_time"), s.back("event_time"))})

    rows = over_sequence(rows, look, keys=keys, order=order, before=7, hot=hot)
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("_rank") < F.col("_p_rank")).alias("backward"),
        F.count_if(F.col("_gap") < 0).alias("disorder"), F.max(F.abs("_gap")).alias("gap"),
        *[F.count_if(F.col("_stage") == s).alias(s) for s in C.STAGE_RANK],
        *[F.count_if(_repeats(k)).alias(f"_r{k}") for k in range(1, 5)])
    pairs = rows.where(F.col("_x1").isNotNull()).withColumn("_pair", F.concat_ws(">", "_x1", "_kind"))
    base = join_on(base, _kinds(rows.withColumnRenamed(type_column, "_type"), {"_type": "types"}, keys), keys)
    base = join_on(base, _kinds(pairs, {"_pair": "pairs"}, keys), keys)
    base = join_on(base, entropy(rows, "_kind", "plain", keys=keys, name="bits", hot=hot), keys).fillna(0)
    n = _num(F.col("n"))
    scores = [F.when(F.floor(n / 2) >= k, F.col(f"_r{k}") / (n - k)) for k in range(1, 5)]
    regular = F.when(n < 2, 1.0).otherwise(F.coalesce(F.greatest(*scores), F.lit(0.0)))
    values = [
        n, _num(F.col("types")), _num(F.col("pairs")), _num(F.col("backward")), _num(F.col("disorder")),
        F.least(F.col("gap") / C.MAX_REASONABLE_GAP_HOURS, F.lit(1.0)), *[F.col(s) / n for s in C.STAGE_RANK],
        F.col("bits"), regular, (F.col("backward") + F.col("disorder")) / n]
    return base.select(*keys, *[v.alias(name) for name, v in zip(ORDER, values)])


def _levels(df: DataFrame) -> DataFrame:
    """Hierarchy level of the place, -1 when unknown."""
    return moves.with_location_level(df).withColumn(
        "_level", F.when(F.col("_level") == C.UNKNOWN_LEVEL, -1).otherwise(F.col("_level")))


def location_features(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                      hot: Hot = MEASURE) -> DataFrame:
    """Fifteen numbers about places and their hierarchy."""
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = _levels(colocated(df, keys, hot)).withColumn("_known", F.when(F.col("_level") >= 0, F.col("_level")))
    rows = over_sequence(rows, lambda d, s: d.withColumns({
        "_prev": s.back("_level"), "_prev_known": s.last_known("_known")}),
        keys=keys, order=order, carry=["_known"], hot=hot)
    step = F.when((F.col("_level") >= 0) & (F.col("_prev") >= 0), F.col("_level") - F.col("_prev"))
    move = F.col("_known") - F.col("_prev_known")
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("_known").alias("known"), F.count_if(F.col("_level") < 0).alias("unknown"),
        F.count_if((step < -1) | (step > 2)).alias("violations"), F.count_if(step < -1).alias("reverse"),
        F.coalesce(F.max(F.abs(step)), F.lit(0)).alias("jump"),
        *[F.count_if(F.col("_level") == i).alias(f"l{i}") for i in range(4)],
        F.count_if(F.abs(move) <= 1).alias("smooth"), F.var_pop(move).alias("spread"))
    base = join_on(base, _kinds(df, {"scan_location": "places"}, keys), keys)
    base = join_on(base, entropy(df, "scan_location", "normalized", keys=keys, name="bits", hot=hot), keys).fillna(0)
    n, known, places = (_num(F.col(c)) for c in ("n", "known", "places"))
    ratios = [F.when(known > 0, F.col(f"l{i}") / known).otherwise(0.0) for i in range(4)]
    smooth = F.when(n < 2, 1.0).when(known < 2, 0.0).otherwise(F.col("smooth") / (known - 1))
    regular = F.when(n < 3, 1.0).when(known < 3, 0.0).otherwise(1 / (1 + F.col("spread")))
    values = [
        n, places, _num(F.col("violations")), _num(F.col("unknown")), _num(F.col("reverse")),
        F.least(F.col("jump") / 3.0, F.lit(1.0)), *ratios, F.col("bits"), smooth, F.least(places / n, F.lit(1.0)), regular,
        (F.col("violations") + F.col("unknown")) / n]
    return base.select(*keys, *[v.alias(name) for name, v in zip(LOCATION, values)])


def jump_features(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                  hot: Hot = MEASURE) -> DataFrame:
    """Ten numbers about time gaps; a single event gives length 1, regularity 1 and zeros."""
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = time_gap(df, keys=keys, order=order, hot=hot, first=None)
    rows = rows.withColumn("_gap", F.col("time_gap_seconds") / 3600)
    g = F.col("_gap")
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), clock.hours_between(F.max("event_time"), F.min("event_time")).alias("span"),
        F.avg(g).alias("mean"), F.max(g).alias("top"), F.min(g).alias("low"),
        F.when(F.count(g) > 1, F.variance(g)).alias("var"),
        F.count_if(g > C.MAX_REASONABLE_GAP_HOURS).alias("far"), F.count_if(g < 0).alias("neg"), F.count_if(g == 0).alias("zero"))
    bounds = quantiles(rows, keys, "_gap", {"_q1": 0.25, "_q3": 0.75}, bounded=hot is None)
    gaps = join_on(rows.where(g.isNotNull()).select(*keys, "_gap"), bounds, keys)
    reach = (F.col("_q3") - F.col("_q1")) * 1.5
    inside = gaps.where(g.between(F.col("_q1") - reach, F.col("_q3") + reach))
    kept = inside.groupBy(*keys).agg(
        F.count("*").alias("kept"), F.avg(g).alias("kept_mean"), F.stddev_pop(g).alias("kept_std"))
    base = join_on(base, kept, keys)
    n = _num(F.col("n"))
    variation = F.col("kept_std") / F.col("kept_mean")
    regular = (
        F.when(n < 3, 1.0).when(F.coalesce(F.col("kept"), F.lit(0)) < 2, 0.0)
        .when(F.col("kept_mean") == 0, 0.0).otherwise(1 / (1 + variation)))

    def cap(c: str, unit: float) -> Column:
        return F.least(F.coalesce(F.col(c), F.lit(0.0)) / unit, F.lit(1.0))

    values = [
        n, cap("span", 168.0), cap("mean", 24.0), cap("top", C.MAX_REASONABLE_GAP_HOURS),
        F.greatest(F.coalesce(F.col("low"), F.lit(0.0)), F.lit(0.0)), cap("var", 576.0), _num(F.col("far")),
        _num(F.col("neg")), _num(F.col("zero")), regular]
    return base.select(*keys, *[v.alias(name) for name, v in zip(JUMP, values)])


def location_features_per_event(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS,
                                order: Sequence[str] = EVENT_ORDER, hot: Hot = MEASURE) -> DataFrame:
    """Ten numbers per event; -2 stands for no neighbour, -1 for an unknown place."""
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = over_sequence(_levels(df), lambda d, s: d.withColumns({
        "_prev": s.back("_level"), "_next": s.ahead("_level")}), keys=keys, order=order, after=1, hot=hot)
    rows = with_key_stats(rows, {"_total": F.count(F.lit(1))}, keys=keys, hot=hot)
    here, prev, nxt = F.col("_level"), F.col("_prev"), F.col("_next")
    back = F.when((here != -1) & (prev != -1), here - prev).otherwise(0)
    ahead = F.when((here != -1) & (nxt != -1), nxt - here).otherwise(0)
    values = [
        here, F.coalesce(prev, F.lit(-2)), F.coalesce(nxt, F.lit(-2)), back, ahead, back < -1, F.abs(back) > 2,
        prev.isNull(), nxt.isNull(), F.col("_total")]
    return rows.select(*keys, "event_id", *[_num(v).alias(n) for n, v in zip(LOCATION_EVENT, values)])


def jump_features_per_event(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                            hot: Hot = MEASURE) -> DataFrame:
    """Eight numbers per event about the gaps around it."""
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    t = F.col("event_time")
    rows = over_sequence(df, lambda d, s: d.withColumns({
        "_prev": clock.hours_between(t, s.back("event_time")), "_next": clock.hours_between(s.ahead("event_time"), t),
        "_pos": s.position()}), keys=keys, order=order, after=1, hot=hot)
    rows = with_key_stats(rows, {
        "_total": F.count(F.lit(1)), "_first": F.min("event_time"), "_last": F.max("event_time"), "_mean": F.avg("_prev"),
    }, keys=keys, hot=hot)
    alone = F.col("_total") == 1
    values = [
        F.coalesce("_prev", F.lit(0.0)), F.coalesce("_next", F.lit(0.0)),
        F.when(alone, 0.5).otherwise((F.col("_pos") - 1) / (F.col("_total") - 1)), F.col("_total"),
        clock.hours_between(F.col("_last"), F.col("_first")), F.coalesce("_mean", F.lit(0.0)),
        F.col("_pos") == 1, F.col("_pos") == F.col("_total")]
    return rows.select(*keys, "event_id", *[_num(v).alias(n) for n, v in zip(JUMP_EVENT, values)])


def order_violations(df: DataFrame, *, type_column: str = "event_type", keys: Sequence[str] = EPC_KEYS,
                     order: Sequence[str] = EVENT_ORDER, hot: Hot = MEASURE) -> DataFrame:
    """One row per event whose stage lies before that of its predecessor."""
    rows = moves.with_event_kind(df, type_column)
    rows = rows.withColumn("_stage", moves.stage_of_kind(F.col("_kind")))
    rows = over_sequence(rows, lambda d, s: d.withColumns({
        "_from": s.back("_stage"), "_pos": s.position()}), keys=keys, order=order, hot=hot)
    bad = moves.stage_rank(F.col("_stage")) < moves.stage_rank(F.col("_from"))
    return rows.where(bad).select(
        *keys, "event_id", (F.col("_pos") - 1).alias("position"), F.col("_from").alias("from_stage"),
        F.col("_stage").alias("to_stage"), F.col(type_column).alias("event_type"), "scan_location")


def most_common_violation(violations: DataFrame, keys: Sequence[str] = EPC_KEYS) -> DataFrame:
    """Most frequent "from->to" of each item, alphabetically first on ties."""
    move = F.concat_ws("->", "from_stage", "to_stage").alias("move")
    counted = violations.groupBy(*keys, move).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(
        F.min_by("move", F.struct(-F.col("n"), F.col("move"))).alias("most_common_violation"),
        F.sum("n").alias("violation_count"))


def location_violations(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                        hot: Hot = MEASURE) -> DataFrame:
    """One row per move over more than two levels (big_jump) or back over more than one (reverse_jump)."""
    rows = over_sequence(_levels(df), lambda d, s: d.withColumns({
        "_prev": s.back("_level"), "_from": s.back("scan_location"), "_pos": s.position()}), keys=keys, order=order, hot=hot)
    change = F.when((F.col("_level") >= 0) & (F.col("_prev") >= 0), F.col("_level") - F.col("_prev"))
    kind = F.when(F.abs(change) > 2, "big_jump").when(change < -1, "reverse_jump")
    rows = rows.withColumns({"level_jump": change, "violation_type": kind}).where(F.col("violation_type").isNotNull())
    return rows.select(
        *keys, "event_id", (F.col("_pos") - 1).alias("position"), F.col("_from").alias("from_location"),
        F.col("scan_location").alias("to_location"), F.col("_prev").alias("from_level"), F.col("_level").alias("to_level"),
        "level_jump", "violation_type")


def gap_anomalies(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                  hot: Hot = MEASURE) -> DataFrame:
    """One row per gap that is longer than a week, negative or zero."""
    rows = over_sequence(df, lambda d, s: d.withColumns({
        "gap_hours": clock.hours_between(F.col("event_time"), s.back("event_time")), "_pos": s.position()}),
        keys=keys, order=order, hot=hot)
    gap = F.col("gap_hours")
    kind = F.when(gap > C.MAX_REASONABLE_GAP_HOURS, "long").when(gap < 0, "negative").when(gap == 0, "zero")
    return rows.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        *keys, "event_id", (F.col("_pos") - 1).alias("position"), "gap_hours", "kind")


# ---- sequences -----------------------------------------------------------------------------

def _windows(df: DataFrame, features: Sequence[str], labels: Sequence[str], length: Column, least: int, longest: int,
             keys: Sequence[str], order: Sequence[str], hot: Hot, extra: dict[str, Column]) -> DataFrame:
    """Overlapping windows of ``length`` events that end at each event (stride 1)."""
    cells = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    rows = df.withColumn("_cells", cells).withColumn("_length", length)

    def collect(d: DataFrame, s: Steps) -> DataFrame:
        near = s.recent(longest - 1)
        return d.withColumns({
            "_recent": F.collect_list("_cells").over(near), "_times": F.collect_list("event_time").over(near),
            "_pos": s.position()})

    rows = over_sequence(rows, collect, keys=keys, order=order, before=longest - 1, hot=hot)
    rows = rows.where((F.col("_total") >= least) & (F.col("_pos") >= F.col("_length")))
    # each step of the slice starts from a bounded array of at most ``longest`` events
    return rows.select(
        *keys, "event_id",
        F.slice("_recent", -F.col("_length"), F.col("_length")).alias("sequence"),
        F.array(*[F.col(x).cast("int") for x in labels]).alias("label"),
        F.element_at(F.slice("_times", -F.col("_length"), F.col("_length")), 1).alias("sequence_start"),
        F.col("event_time").alias("sequence_end"), F.col("_length").alias("sequence_length"),
        *[c.alias(n) for n, c in extra.items()])


def _with_span(df: DataFrame, keys: Sequence[str], hot: Hot) -> DataFrame:
    return with_key_stats(df, {
        "_total": F.count(F.lit(1)), "_first": F.min("event_time"), "_last": F.max("event_time")}, keys=keys, hot=hot)


def sequences(df: DataFrame, features: Sequence[str], labels: Sequence[str] = C.STATS_TYPES, base: int = 15,
              longest: int = 25, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
              hot: Hot = MEASURE) -> DataFrame:
    """Windows whose length follows the events per day of the item."""
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = _with_span(df, keys, hot)
    days = F.floor((F.unix_micros("_last") - F.unix_micros("_first")) / 8.64e10)
    rate = F.col("_total") / F.greatest(days, F.lit(1))
    length = F.least(F.when(rate > 5, longest).otherwise(base), F.col("_total")).cast("int")
    return _windows(rows, features, labels, length, 2, longest, keys, order, hot, {"scan_frequency": rate})


def sequences_adaptive(df: DataFrame, features: Sequence[str], labels: Sequence[str] = C.STATS_TYPES, base: int = 15,
                       least: int = 5, longest: int = 25, *, keep: Sequence[str] = (), keys: Sequence[str] = EPC_KEYS,
                       order: Sequence[str] = EVENT_ORDER, hot: Hot = MEASURE) -> DataFrame:
    """Windows whose length follows the events per hour; items with few events are left out.

    ``keep`` names columns to carry over from the last event of a window.
    """
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = _with_span(df, keys, hot)
    rate = F.col("_total") / F.greatest(clock.hours_between(F.col("_last"), F.col("_first")), F.lit(1.0))
    usual = F.least(F.lit(base), F.col("_total"))
    length = (
        F.when(rate > 5, F.least(F.lit(longest), F.col("_total")))
        .when(rate < 1, F.greatest(F.lit(least), usual)).otherwise(usual).cast("int"))
    extra = {"scan_frequency": rate} | {c: F.col(c) for c in keep}
    return _windows(rows, features, labels, length, least, longest, keys, order, hot, extra)


def sequences_fixed(df: DataFrame, features: Sequence[str], labels: Sequence[str] = C.STATS_TYPES, length: int = 15,
                    *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER, hot: Hot = MEASURE) -> DataFrame:
    """Windows of one fixed length."""
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = _with_span(df, keys, hot)
    return _windows(rows, features, labels, F.lit(length), 5, length, keys, order, hot, {})


def latest_events(df: DataFrame, n: int, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                  hot: Hot = MEASURE) -> DataFrame:
    """Last events of each item, at most ``n`` per item; positions make this exact for any item size."""
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = over_sequence(df, lambda d, s: d.withColumn("_pos", s.position()), keys=keys, order=order, before=0, hot=hot)
    rows = with_key_stats(rows, {"_total": F.count(F.lit(1))}, keys=keys, hot=hot)
    return rows.where(F.col("_pos") > F.col("_total") - n)


def recent_padded(df: DataFrame, features: Sequence[str], n: int = 25, *, keys: Sequence[str] = EPC_KEYS,
                  order: Sequence[str] = EVENT_ORDER, hot: Hot = MEASURE) -> DataFrame:
    """The last ``n`` events of each item as one array, zeros in front when there are fewer."""
    cells = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    rows = latest_events(df, n, keys=keys, order=order, hot=hot).withColumn("_cells", cells)
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_cells"))).alias("_rows"))
    zeros = F.array(*[F.lit(0.0) for _ in features])
    arrays = F.transform("_rows", lambda r: r["_cells"])
    return listed.select(*keys, left_padded(arrays, n, zeros).alias("sequence"))


# ---- vectors -----------------------------------------------------------------------------------

EMBEDDING = ("total_scans", "scan_duration_hours", "avg_time_gap_log", "time_entropy", "unique_locations",
             "location_entropy", "business_step_count", "location_backtrack_rate", "operator_entropy",
             "scan_frequency", "business_hour_rate", "weekend_scan_rate")


def epc_embedding(df: DataFrame, dimensions: int = 16, *, keys: Sequence[str] = EPC_KEYS,
                  order: Sequence[str] = EVENT_ORDER, hot: Hot = MEASURE) -> DataFrame:
    """Unit vector of twelve profile numbers per item, zero padded."""
    if dimensions < len(EMBEDDING):
        raise ValueError(f"at least {len(EMBEDDING)} dimensions")
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = location_moves(time_gap(df, keys=keys, order=order, hot=hot), keys=keys, order=order, hot=hot)
    rows = with_entropies(rows, {"operator_id": "operator_entropy"}, "similarity", keys=keys, hot=hot)
    more = rows.groupBy(*keys).agg(
        F.avg(F.log1p("time_gap_seconds")).alias("avg_time_gap_log"),
        F.avg(_num(F.col("location_backtrack"))).alias("location_backtrack_rate"), F.max("operator_entropy").alias("operator_entropy"))
    out = join_on(epc_profile(df, keys=keys, hot=hot), more, keys).fillna(0)
    cells = [_num(F.col(c)) for c in EMBEDDING] + [F.lit(0.0)] * (dimensions - len(EMBEDDING))
    return out.withColumn("_v", F.array(*cells)).select(*keys, normalized(F.col("_v")).alias("embedding"))


def run_features(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                 hot: Hot = MEASURE) -> DataFrame:
    """Temporal, spatial and behavioural columns of each event; all windows share one partitioning."""
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    options = {"keys": keys, "order": order, "hot": hot}
    rows = gap_zscore(df, **options)
    rows = rolling_gap(rows, **options)
    rows = scan_position(rows, **options)
    rows = location_moves(rows, **options)
    rows = step_moves(rows, **options)
    rows = hub_type_changed(rows, **options)
    rows = rows.withColumns(clock.calendar(F.col("event_time"))).withColumns(clock.cyclic(F.col("event_time")))
    rows = rows.withColumn("time_gap_log", F.log1p("time_gap_seconds"))
    rows = rows.withColumn("_hour", F.hour("event_time"))
    names = {"location_id": "location_entropy", "_hour": "time_entropy", "operator_id": "operator_entropy"}
    return with_entropies(rows, names, "smoothed", keys=keys, hot=hot).drop("_hour")


def feature_matrix(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Numeric columns with nulls as 0, without those that never vary; also returns the names kept.

    Whether a column varies comes from one min/max aggregation.
    """
    numeric = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    filled = df.select(*[c for c in df.columns if c not in columns], *numeric)
    bounds = filled.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
    kept = [c for c in columns if bounds[f"lo_{c}"] != bounds[f"hi_{c}"]]
    return filled.drop(*[c for c in columns if c not in kept]), kept

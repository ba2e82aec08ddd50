"""Profiles of scan tables: counts, quality, moments, distributions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanwarden.functions import clock, epc
from scanwarden.operators.windows import time_gap
from scanwarden.session import written
from scanwarden.skew import EPC_KEYS, EVENT_ORDER, MEASURE, HotKeys, colocated, hot_keys, join_on, quantiles, side_by_side, with_key_stats

Hot = HotKeys | str | None
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
VALID_STEPS = ("Factory", "WMS", "Logistics_HUB", "Distribution", "Retail", "Customer")


def long_form(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (), name: str = "column",
              value: str = "value", cast: str | None = None) -> DataFrame:
    """One row per (row, column)."""
    picked = df.select(*ids, *[F.col(c).cast(cast) if cast else F.col(c) for c in columns])
    return picked.unpivot(list(ids), list(columns), name, value)


def score_stats(scores: DataFrame, by: Sequence[str] = ("dataset", "anomaly_type"), value: str = "score") -> DataFrame:
    """Count, mean, population deviation, range, percentiles and non-zero share per group.

    Scores are whole numbers 0-100, so equal scores are counted first and the groups stay tiny.
    """
    counted = written(scores.groupBy(*by, value).agg(F.count("*").alias("_n")))  # the only pass over the scores
    v, n = F.col(value), F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0)
    whole = Window.partitionBy(*by)  # one row per distinct score
    counted = counted.withColumn("_samples", F.sum(n).over(whole))
    samples = F.when(F.col("_samples") > 0, F.col("_samples"))
    counted = counted.withColumn("_mean", F.sum(v.cast("double") * n).over(whole) / samples)
    base = counted.groupBy(*by).agg(
        F.max("_samples").alias("samples"), F.max("_mean").alias("mean"),
        F.sqrt(F.sum(n * (v - F.col("_mean")) * (v - F.col("_mean")) / samples)).alias("std"),
        F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"),
        F.sum(F.when(v > 0, F.col("_n")).otherwise(0)).alias("non_zero_count"))
    table = join_on(base, quantiles(counted, by, value, PERCENTILES, bounded=True, weight="_n"), by)
    return table.withColumn("non_zero_rate", F.col("non_zero_count") / F.col("samples"))


def label_distribution(labelled: DataFrame, by: Sequence[str] = ("anomaly_type",), label: str = "label",
                       score: str = "score") -> DataFrame:
    """Positives, negatives, imbalance and score statistics of both classes."""
    pos, s = F.col(label) == 1, F.col(score)
    out = labelled.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(pos).alias("positives"), F.count_if(~pos).alias("negatives"),
        F.avg(F.when(pos, s)).alias("positive_score_mean"), F.avg(F.when(~pos, s)).alias("negative_score_mean"),
        F.min(F.when(pos, s)).cast("double").alias("positive_score_min"),
        F.max(F.when(~pos, s)).cast("double").alias("negative_score_max"))
    return out.withColumns({
        "positive_ratio": F.col("positives") / F.col("total"),
        "imbalance_ratio": F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives"))})


def threshold_sweep(scores: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ("anomaly_type",),
                    value: str = "score") -> DataFrame:
    """Positives and their share at each threshold.

    Scores are counted once per distinct value; thresholds meet those counts, not the rows.
    """
    counted = scores.groupBy(*by, value).agg(F.count("*").alias("_n"))
    steps = counted.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hit = F.when(F.col(value) >= F.col("threshold"), F.col("_n")).otherwise(0)
    out = steps.groupBy(*by, "threshold").agg(F.sum(hit).alias("positives"), F.sum("_n").alias("_total"))
    return out.withColumn("positive_ratio", F.col("positives") / F.col("_total")).drop("_total")


def epc_corpus_stats(df: DataFrame, keys: Sequence[str] = ("epc_code",)) -> DataFrame:
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("epcs"), F.sum("n").alias("events"), F.avg("n").alias("avg_events"),
        F.max("n").alias("max_events"), F.count_if(F.col("n") == 1).alias("single_event_epcs"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Non-null, null, null share, distinct count and type per column.

    The exact distinct counts go through (column, value) pairs, combined map-side; ``approx``
    uses sketches and needs no shuffle of values.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    rows = long_form(df, columns, cast="string")
    if approx:
        table = rows.groupBy("column").agg(
            F.count("value").alias("non_null"), F.count_if(F.col("value").isNull()).alias("nulls"),
            F.approx_count_distinct("value").alias("distinct_values"))
    else:
        pairs = rows.groupBy("column", "value").agg(F.count("*").alias("n"))
        table = pairs.groupBy("column").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count("value").alias("distinct_values"))
    kind = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])
    return table.withColumns({
        "null_percent": 100.0 * F.col("nulls") / (F.col("nulls") + F.col("non_null")), "type": kind[F.col("column")]})


def missing_by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    nulls = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    out = nulls.unpivot(["_rows"], list(columns), "column", "missing")
    return out.select("column", "missing", (100.0 * F.col("missing") / F.col("_rows")).alias("missing_percent"))


def missing_by_source(df: DataFrame, columns: Sequence[str], source: str = "source_file") -> DataFrame:
    nulls = df.groupBy(source).agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    out = nulls.unpivot([source, "_rows"], list(columns), "column", "missing")
    return out.select(source, "column", "missing", (100.0 * F.col("missing") / F.col("_rows")).alias("missing_percent"))


def missing_patterns(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """Most frequent combinations of missing columns, as a bit string in column order."""
    bits = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return df.groupBy(bits.alias("pattern")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "pattern").limit(top)


def missing_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of the missing flags of two columns; null where one never varies."""
    flags = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in columns])
    return correlation_pairs(flags, columns)


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair, all from one aggregation."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def high_corr_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> DataFrame:
    return correlation_pairs(df, columns).where(F.abs("correlation") > threshold)


def _gap_check(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: Hot) -> DataFrame:
    rows = time_gap(df, keys=keys, order=order, hot=hot, first=None)
    return rows.agg(F.count_if(F.col("time_gap_seconds") > 86400 * 365).alias("long_gaps"))


def quality_scores(df: DataFrame, as_of: Column, columns: Sequence[str], *, keys: Sequence[str] = EPC_KEYS,
                   order: Sequence[str] = EVENT_ORDER, hot: Hot = MEASURE) -> DataFrame:
    """Completeness, consistency, validity, uniqueness (0-100) and their mean; checks of absent columns are left out."""
    has = set(df.columns)
    checks, valid = [], []
    if "epc_code" in has:
        checks.append(~epc.strict_epc_format(F.col("epc_code")))
    if "event_time" in has:
        checks.append(F.col("event_time").isNull())
    if "location_id" in has:
        checks.append(F.col("location_id").isNull() | (F.col("location_id") < 0))
    if "business_step" in has:
        checks.append(~F.coalesce(F.col("business_step").isin(*VALID_STEPS), F.lit(False)))
    base = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(c).alias(f"_bad{i}") for i, c in enumerate(checks)],
        F.sum(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))).alias("_missing"),
        F.count_if(F.col("event_time") > as_of).alias("_future") if "event_time" in has else F.lit(0).alias("_future"),
        F.count_if(F.col("product_name").isNull()).alias("_no_product") if "product_name" in has else F.lit(0).alias("_no_product"),
    )
    copies = duplicate_rows(df.select(*columns))
    out = base.crossJoin(F.broadcast(copies))
    if "event_time" in has:
        out = out.crossJoin(F.broadcast(_gap_check(df, keys, order, hot)))
        valid += [F.col("_future") > F.col("rows") * 0.8, F.col("long_gaps") > 0]
    if "product_name" in has:
        valid.append(F.col("_no_product") > F.col("rows") * 0.1)

    def share(broken: list[Column]) -> Column:
        issues = sum((b.cast("int") for b in broken), F.lit(0))
        return 100.0 * (len(broken) - issues) / max(len(broken), 1)

    out = out.select(
        "rows",
        (100.0 * (1 - F.col("_missing") / (F.col("rows") * len(columns)))).alias("completeness"),
        share([F.col(f"_bad{i}") > 0 for i in range(len(checks))]).alias("consistency"),
        share(valid).alias("validity"),
        (100.0 * (1 - F.col("duplicate_rows") / F.col("rows"))).alias("uniqueness"))
    parts = ("completeness", "consistency", "validity", "uniqueness")
    return out.withColumn("overall", sum((F.col(p) for p in parts), F.lit(0.0)) / len(parts))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of identical rows; copies are counted map-side."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def quality_issues(df: DataFrame, as_of: Column, columns: Sequence[str]) -> DataFrame:
    """One row per kind of problem that occurs."""
    one = df.agg(
        F.count_if(~epc.strict_epc_format(F.col("epc_code"))).alias("invalid_epc"),
        F.count_if(F.col("event_time") > as_of).alias("future_event"),
        F.count_if(F.col("location_id") < 0).alias("negative_location"))
    one = one.crossJoin(F.broadcast(duplicate_rows(df.select(*columns)).withColumnRenamed("duplicate_rows", "duplicate_row")))
    names = ["invalid_epc", "future_event", "negative_location", "duplicate_row"]
    return one.unpivot([], names, "issue", "rows").where(F.col("rows") > 0)


def moments(df: DataFrame, columns: Sequence[str], unbiased: bool = False, alpha_chi2: float = 5.991) -> DataFrame:
    """Mean, median, deviation, skewness, excess kurtosis, distinct values and a normality flag per column.

    Normality is the Jarque-Bera test at 5 % (critical value of chi-square with two degrees of
    freedom). ``unbiased`` applies the sample corrections to skewness and kurtosis.
    """
    rows = long_form(df, columns, cast="double").where(F.col("value").isNotNull())
    v = F.col("value")
    base = rows.groupBy("column").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev(v).alias("std"), F.skewness(v).alias("skewness"),
        F.kurtosis(v).alias("kurtosis"))
    distinct = rows.groupBy("column", "value").agg(F.lit(1).alias("one")).groupBy("column").agg(
        F.count("*").alias("distinct_values"))
    mid = quantiles(rows, ["column"], "value", {"median": 0.5})
    out = base.join(distinct, "column").join(mid, "column")
    bera = F.col("n") / 6 * (F.pow("skewness", F.lit(2.0)) + F.pow("kurtosis", F.lit(2.0)) / 4)
    out = out.withColumn("is_normal", F.coalesce(bera < alpha_chi2, F.lit(False)))
    if unbiased:
        n = F.col("n").cast("double")
        out = out.withColumns({
            "skewness": F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("skewness")),
            "kurtosis": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("kurtosis") + 6))})
    return out


def distribution_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles and the number of values outside 1.5 quartile distances."""
    rows = long_form(df, columns, cast="double").where(F.col("value").isNotNull())
    bounds = quantiles(rows, ["column"], "value", {"q25": 0.25, "q75": 0.75})
    reach = (F.col("q75") - F.col("q25")) * 1.5
    joined = rows.join(F.broadcast(bounds), "column")
    far = (F.col("value") < F.col("q25") - reach) | (F.col("value") > F.col("q75") + reach)
    return joined.groupBy("column", "q25", "q75").agg(
        F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.count_if(far).alias("outliers"))


def temporal_counts(df: DataFrame, source: str = "source_file") -> DataFrame:
    """Events by hour, weekday, date and month within each source, in one aggregation."""
    t = F.col("event_time")
    parts = df.select(
        source, F.hour(t).cast("string").alias("hour"), F.weekday(t).cast("string").alias("weekday"),
        F.date_format(t, "yyyy-MM-dd").alias("date"), F.date_format(t, "yyyy-MM").alias("month"))
    names = ["hour", "weekday", "date", "month"]
    grouped = parts.groupingSets([[F.col(source), F.col(n)] for n in names], source, *names).agg(
        F.count("*").alias("events"), F.grouping_id(source, *names).alias("_g"))
    period, value = None, None
    for i, n in enumerate(names):
        mask = 0b01111 & ~(1 << (len(names) - 1 - i))
        period = F.when(F.col("_g") == mask, n) if period is None else period.when(F.col("_g") == mask, n)
        value = F.when(F.col("_g") == mask, F.col(n)) if value is None else value.when(F.col("_g") == mask, F.col(n))
    return grouped.select(source, period.alias("period"), value.alias("value"), "events")


def temporal_summary(df: DataFrame, as_of: Column) -> DataFrame:
    """Evenness over hours (deviation by mean of the hourly counts), span in days, future share."""
    hours = df.groupBy(F.hour("event_time").alias("h")).agg(
        F.count("*").alias("n"), F.min("event_time").alias("lo"), F.max("event_time").alias("hi"),
        F.count_if(F.col("event_time") > as_of).alias("late"))
    return hours.agg(
        (F.stddev("n") / F.avg("n")).alias("hourly_variation"),
        F.floor((F.unix_micros(F.max("hi")) - F.unix_micros(F.min("lo"))) / 8.64e10).alias("span_days"),
        (100.0 * F.sum("late") / F.sum("n")).alias("future_percent"))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "value").limit(n)


def nunique_by_source(df: DataFrame, columns: Sequence[str], source: str = "source_file") -> DataFrame:
    rows = long_form(df, columns, [source], cast="string")
    pairs = rows.groupBy(source, "column", "value").agg(F.lit(1).alias("one"))
    return pairs.groupBy(source, "column").agg(F.count("value").alias("distinct_values"))


def modes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value of each column (smallest on ties)."""
    rows = long_form(df, columns, list(by), cast="string").where(F.col("value").isNotNull())
    counted = rows.groupBy(*by, "column", "value").agg(F.count("*").alias("n"))
    return counted.groupBy(*by, "column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


ENTROPY_VARIANTS = ("plain", "normalized", "guarded", "smoothed", "jeffreys", "similarity")


def entropy(df: DataFrame, column: str, variant: str = "plain", *, keys: Sequence[str] = EPC_KEYS,
            name: str | None = None, hot: Hot = MEASURE) -> DataFrame:
    """Entropy (bits) of a column's values per item.

    plain; normalized by the largest possible; guarded (+1e-10 in the logarithm, 0 for one
    row); smoothed (+0.01, 0 below three rows); jeffreys (+0.5, over 1.5 k, 0 below three
    rows); similarity (+1e-8, 0 for one value).
    """
    counted = df.groupBy(*keys, column).agg(F.count("*").alias("_n"))
    known = F.col(column).isNotNull()
    rows = with_key_stats(counted, {
        "_rows": F.sum("_n"), "_total": F.sum(F.when(known, F.col("_n"))), "_kinds": F.count(column)}, keys=keys, hot=hot)
    out = rows.where(known).groupBy(*keys).agg(
        (-F.sum(_entropy_term(variant))).alias("_e"), F.max("_rows").alias("_rows"), F.max("_kinds").alias("_kinds"))
    return out.select(*keys, _entropy_value(variant).alias(name or f"{column}_entropy"))


def _entropy_term(variant: str) -> Column:
    """What a value adds (``_n`` of ``_total`` known rows, ``_kinds`` values)."""
    p, k = F.col("_n") / F.col("_total"), F.col("_kinds")
    if variant in ("plain", "normalized"):
        return p * F.log2(p)
    if variant == "guarded":
        return p * F.log2(p + 1e-10)
    if variant == "similarity":
        return p * F.log2(p + 1e-8)
    if variant == "smoothed":
        q = (p + 0.01) / (1 + 0.01 * k)
        return q * F.log2(q)
    if variant == "jeffreys":
        q = (p + 0.5) / (k + 0.5 * k)
        return q * F.log2(q)
    raise ValueError(f"unknown variant {variant}")


def _entropy_value(variant: str) -> Column:
    """Entropy from the sum of its terms ``_e``, by the item's ``_rows`` and ``_kinds``."""
    value = F.col("_e")
    if variant == "normalized":
        value = F.when(F.col("_kinds") > 1, value / F.log2(F.col("_kinds").cast("double"))).otherwise(value)
    elif variant == "guarded":
        value = F.when(F.col("_rows") <= 1, 0.0).otherwise(value)
    elif variant in ("smoothed", "jeffreys"):
        value = F.when(F.col("_rows") < 3, 0.0).otherwise(value)
    elif variant == "similarity":
        value = F.when(F.col("_kinds") <= 1, 0.0).otherwise(value)
    return value + F.lit(0.0)


def with_entropies(df: DataFrame, columns: dict[str, str], variant: str = "plain", *, keys: Sequence[str] = EPC_KEYS,
                   hot: Hot = MEASURE) -> DataFrame:
    """Puts the entropy of each column's values (column: name) on all rows of the item; null where no value is known.

    Without hot keys windows find it in the partitioning of the item's other windows, so rows move once for all of them.
    """
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    if hot is not None:
        tables = [entropy(df, c, variant, keys=keys, name=n, hot=hot) for c, n in columns.items()]
        return join_on(df, side_by_side(tables, keys), keys)
    whole = Window.partitionBy(*keys)
    for column, name in columns.items():
        alike, known = Window.partitionBy(*keys, column), F.col(column).isNotNull()
        df = df.withColumns({"_n": F.count(F.lit(1)).over(alike), "_one": known & (F.row_number().over(alike.orderBy(column)) == 1)})
        df = df.withColumns({"_rows": F.count(F.lit(1)).over(whole), "_total": F.count(column).over(whole), "_kinds": F.count_if("_one").over(whole)})
        df = df.withColumn("_e", -F.sum(F.when(F.col("_one"), _entropy_term(variant))).over(whole))
        df = df.withColumn(name, F.when(F.col("_kinds") > 0, _entropy_value(variant))).drop("_n", "_one", "_rows", "_total", "_kinds", "_e")
    return df


def kinds(column: str) -> Column:
    """Number of known values of an ordinary item as an aggregate; it keeps the set, so it is not for hot keys."""
    return F.size(F.collect_set(F.col(column).cast("string"))).cast("long")


def epc_behaviour(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                  hot: Hot = MEASURE) -> DataFrame:
    """Diversity and gap statistics of each item, with ratios and the coefficient of variation."""
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    rows = time_gap(df, keys=keys, order=order, hot=hot)
    gap = F.col("time_gap_seconds")
    names = {"location_id": "locations", "business_step": "steps", "operator_id": "operators", "device_id": "devices"}
    aggs = [
        F.count("*").alias("scans"), F.avg(gap).alias("gap_mean"), F.coalesce(F.stddev(gap), F.lit(0.0)).alias("gap_std"),
        F.min(gap).alias("gap_min"), F.max(gap).alias("gap_max"),
        F.avg("location_id").alias("location_mean"), F.coalesce(F.stddev("location_id"), F.lit(0.0)).alias("location_std")]
    if hot is None:
        # all in the partitioning of the gaps' window
        out = rows.groupBy(*keys).agg(*aggs, *[kinds(c).alias(n) for c, n in names.items()])
    else:
        pairs = long_form(df, list(names), list(keys), cast="string").groupBy(*keys, "column", "value").agg(F.lit(1).alias("one"))
        counts = pairs.groupBy(*keys).agg(*[
            F.count_if((F.col("column") == c) & F.col("value").isNotNull()).alias(n) for c, n in names.items()])
        out = join_on(rows.groupBy(*keys).agg(*aggs), counts, keys)
    return out.withColumns({
        "location_ratio": F.col("locations") / F.col("scans"),
        "operator_ratio": F.col("operators") / F.col("scans"),
        "gap_cv": F.when(F.col("gap_mean") > 0, F.col("gap_std") / F.col("gap_mean")).otherwise(0.0)})


def epc_profile(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, hot: Hot = MEASURE) -> DataFrame:
    """What an item looks like when compared with others: size, duration, diversity, habits."""
    if hot == MEASURE:
        hot = hot_keys(df, keys)
    hour, weekday = F.hour("event_time"), F.weekday("event_time")
    aggs = [
        F.count("*").alias("total_scans"),
        F.greatest(clock.hours_between(F.max("event_time"), F.min("event_time")), F.lit(0.1)).alias("scan_duration_hours"),
        F.avg(hour.between(8, 18).cast("double")).alias("business_hour_rate"),
        F.avg((weekday >= 5).cast("double")).alias("weekend_scan_rate")]
    entropies = {"location_id": "location_entropy", "_hour": "time_entropy"}
    counted = {"location_id": "unique_locations", "business_step": "business_step_count"}
    with_hour = df.withColumn("_hour", hour)
    if hot is None:
        # one exchange: windows and the aggregate share the partitioning by item
        rows = with_entropies(colocated(with_hour, keys, hot), entropies, "similarity", keys=keys, hot=hot)
        out = rows.groupBy(*keys).agg(*aggs, *[F.max(n).alias(n) for n in entropies.values()], *[kinds(c).alias(n) for c, n in counted.items()])
    else:
        tables = [df.groupBy(*keys).agg(*aggs)]
        for column, name in entropies.items():
            tables.append(entropy(with_hour, column, "similarity", keys=keys, name=name, hot=hot))
        for column, name in counted.items():
            found = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.lit(1).alias("one"))
            tables.append(found.groupBy(*keys).agg(F.count("*").alias(name)))
        out = side_by_side(tables, keys)
    out = out.withColumn("scan_frequency", F.col("total_scans") / F.col("scan_duration_hours"))
    first = ["total_scans", "scan_duration_hours", "business_hour_rate", "weekend_scan_rate", "scan_frequency"]
    return out.select(*keys, *first, *entropies.values(), *counted.values()).fillna(0)


def outlier_ratio_and_nu(findings: DataFrame, events: DataFrame, types: Sequence[str]) -> DataFrame:
    """Share of events with a finding per type and the outlier share to train a one-class model with."""
    from scanwarden.functions.verdicts import nu_for_ratio

    hits = findings.agg(*[F.count_if(F.coalesce(F.col(t), F.lit(False))).alias(t) for t in types])
    rows = hits.unpivot([], list(types), "anomaly_type", "events_found")
    rows = rows.crossJoin(F.broadcast(events.agg(F.count("*").alias("total_events"))))
    ratio = F.when(F.col("total_events") > 0, F.col("events_found") / F.col("total_events")).otherwise(0.0)
    return rows.withColumn("ratio", ratio).withColumn("nu", nu_for_ratio(F.col("ratio")))


def sequence_length_stats(df: DataFrame, keys: Sequence[str] = EPC_KEYS) -> DataFrame:
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    base = per.agg(
        F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"),
        F.count("*").alias("sequences"))
    marks = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95}
    return base.crossJoin(F.broadcast(quantiles(per, [], "n", marks)))


def duplicate_timestamps(df: DataFrame, keys: Sequence[str] = EPC_KEYS) -> DataFrame:
    """Items and times with more than one event."""
    return df.groupBy(*keys, "event_time").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def gap_summary(df: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                hot: Hot = MEASURE) -> DataFrame:
    rows = time_gap(df, keys=keys, order=order, hot=hot, first=None)
    gap = F.col("time_gap_seconds") / 3600
    return rows.agg(
        F.avg(gap).alias("mean_hours"), F.min(gap).alias("min_hours"), F.max(gap).alias("max_hours"),
        F.count_if(gap < 0.1).alias("short_gaps"))


def epc_component_profile(df: DataFrame) -> DataFrame:
    """Valid structures and distinct parts among distinct codes."""
    codes = df.where(F.col("epc_code").isNotNull()).select("epc_code").distinct()
    parts = codes.select(F.split("epc_code", r"\.").alias("p")).withColumn("ok", F.size("p") == 6)
    base = parts.agg(F.count("*").alias("codes"), F.count_if("ok").alias("valid_structures"))
    names = ("header", "company", "date")
    picked = parts.where("ok").select(*[F.get("p", F.lit(i)).alias(n) for i, n in zip((0, 1, 4), names)])
    kinds = long_form(picked, names).groupBy("column", "value").agg(F.lit(1).alias("one"))
    counts = kinds.agg(*[F.count_if(F.col("column") == n).alias(f"distinct_{n}s") for n in names])
    return base.crossJoin(F.broadcast(counts))


def location_profile(df: DataFrame, violations: DataFrame) -> DataFrame:
    """Distinct places and steps, and how many items break the hierarchy (``locErr`` per item)."""
    kinds = long_form(df, ["scan_location", "business_step"]).groupBy("column", "value").agg(F.lit(1).alias("one"))
    base = kinds.where(F.col("value").isNotNull()).agg(
        F.count_if(F.col("column") == "scan_location").alias("locations"),
        F.count_if(F.col("column") == "business_step").alias("steps"))
    bad = violations.agg(F.count_if(F.col("locErr") > 0).alias("epcs_with_violations"))
    return base.crossJoin(F.broadcast(bad))


def location_conflicts(df: DataFrame) -> DataFrame:
    """Place numbers that carry several names or are negative."""
    pairs = df.groupBy("location_id", "scan_location").agg(F.count("*").alias("n"))
    out = pairs.groupBy("location_id").agg(
        F.count("scan_location").alias("names"), F.min("scan_location").alias("first_name"),
        F.max("scan_location").alias("last_name"), F.sum("n").alias("events"))
    return out.where((F.col("names") > 1) | (F.col("location_id") < 0))


def training_summary(df: DataFrame, features: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """Size, balance, grade and feature statistics of a training table; one row."""
    out = df.agg(
        F.count("*").alias("samples"), F.count_if(F.col(label) == 1).alias("positives"),
        F.min(score).cast("double").alias("score_min"), F.max(score).cast("double").alias("score_max"),
        *[F.var_pop(f).alias(f"_v_{f}") for f in features])
    ratio = F.col("positives") / F.col("samples")
    zero = sum((F.when(F.col(f"_v_{f}") == 0, 1).otherwise(0) for f in features), F.lit(0))
    grade = (
        F.when((ratio < 0.01) | (ratio > 0.99), "poor_balance").when(F.col("samples") < 100, "low_samples")
        .when((ratio < 0.05) | (ratio > 0.95), "imbalanced").otherwise("good")
    )
    return out.select(
        "samples", "positives", (F.col("samples") - F.col("positives")).alias("negatives"), ratio.alias("positive_ratio"),
        F.lit(len(features)).alias("dimensions"), "score_min", "score_max", zero.alias("zero_variance_features"),
        grade.alias("quality"))


def feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population variance per feature."""
    rows = long_form(df, features, cast="double", name="feature")
    return rows.groupBy("feature").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))


def class_weights(df: DataFrame, by: Sequence[str] = ("anomaly_type",), label: str = "label") -> DataFrame:
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"))
    neg = F.col("n") - F.col("pos")
    return out.select(
        *by, F.when(F.col("pos") > 0, F.col("n") / (2 * F.col("pos"))).alias("positive_weight"),
        F.when(neg > 0, F.col("n") / (2 * neg)).alias("negative_weight"))


def prediction_summary(scored: DataFrame, types: Sequence[str]) -> DataFrame:
    """Detected count, share and mean score per type, with an alert text for the overall rate.

    Expects ``<type>_detected`` and ``<type>_score`` columns.
    """
    any_hit = F.lit(False)
    for t in types:
        any_hit = any_hit | F.col(f"{t}_detected")
    one = scored.agg(
        F.count("*").alias("items"), F.count_if(any_hit).alias("hits"),
        *[F.count_if(F.col(f"{t}_detected")).alias(f"n_{t}") for t in types],
        *[F.avg(f"{t}_score").alias(f"s_{t}") for t in types])
    rate = 100.0 * F.col("hits") / F.col("items")
    alert = F.when(rate > 10, "HIGH").when(rate > 5, "MEDIUM").when(rate > 1, "LOW").otherwise("EXCELLENT")
    rows = F.array(*[
        F.struct(F.lit(t).alias("anomaly_type"), F.col(f"n_{t}").alias("detected"),
                 (100.0 * F.col(f"n_{t}") / F.col("items")).alias("percent"), F.col(f"s_{t}").alias("mean_score"))
        for t in types])
    return one.select(rate.alias("anomaly_rate"), alert.alias("alert"), F.inline(rows))

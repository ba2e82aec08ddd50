"""Imputation, correction, scaling, encoding and feature selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanwarden.functions import epc, moves
from scanwarden.operators import profile, windows
from scanwarden.session import shared_folder
from scanwarden.skew import EPC_KEYS, EVENT_ORDER, MEASURE, HotKeys, Steps, broadcast_if_small, join_on, over_sequence, quantiles, running_totals

Hot = HotKeys | str | None


# ---- imputation ---------------------------------------------------------------------------

def impute_mode(df: DataFrame, columns: Sequence[str], unknown: str = "Unknown") -> DataFrame:
    """Missing texts become the most frequent value, ``Unknown`` when the column is empty."""
    table = profile.modes(df, columns)
    wide = table.agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(f"_m_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(wide))
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(unknown)) for c in columns})
    return out.drop(*[f"_m_{c}" for c in columns])


def impute_knn(df: DataFrame, target: str, by: str, k: int = 5) -> DataFrame:
    """Missing ``target`` numbers become the mean of the k rows nearest in ``by``.

    Equal values of ``by`` count as one group with its mean. Only the k groups on either side
    of a value can matter, so bounded windows over the distinct values are exact.
    """
    groups = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(target).alias("n"), F.avg(target).alias("mean")).withColumn("_all", F.lit(1))
    own = F.when(F.col("n") > 0, F.struct(F.col(by).cast("double").alias("at"), "n", "mean"))
    order = {"keys": ["_all"], "order": [by], "hot": MEASURE}

    def sides(d: DataFrame, s: Steps) -> DataFrame:
        return d.withColumns({
            "_before": F.collect_list(own).over(s.recent(k - 1)), "_after": F.collect_list(own).over(s.recent(0, k - 1))})

    donors = over_sequence(groups.where("n > 0"), sides, before=k - 1, after=k - 1, **order)
    rows = join_on(groups, donors.select(by, "_before", "_after"), [by])
    rows = over_sequence(rows, lambda d, s: d.withColumns({
        "_low": s.last_known("_before", include_current=True), "_high": s.next_known("_after")}),
        before=0, carry=["_before", "_after"], **order)
    empty = F.array().cast("array<struct<at:double,n:bigint,mean:double>>")
    near = F.array_distinct(F.concat(F.coalesce("_low", empty), F.coalesce("_high", empty)))
    ranked = F.array_sort(F.transform(near, lambda g: F.struct(
        F.abs(g["at"] - F.col(by)).alias("away"), g["at"].alias("at"), g["n"].alias("n"), g["mean"].alias("mean"))))

    def add(acc: Column, g: Column) -> Column:
        take = F.least(g["n"], F.lit(k) - acc["taken"])
        return F.struct((acc["taken"] + take).alias("taken"), (acc["total"] + take * g["mean"]).alias("total"))

    start = F.struct(F.lit(0).cast("bigint").alias("taken"), F.lit(0.0).alias("total"))
    value = F.aggregate(ranked, start, add, lambda acc: F.when(acc["taken"] > 0, acc["total"] / acc["taken"]))
    table = rows.select(by, value.alias("_imputed"))
    return join_on(df, table, [by]).withColumn(target, F.coalesce(F.col(target).cast("double"), F.col("_imputed"))).drop("_imputed")


def impute_business(df: DataFrame) -> DataFrame:
    """Place from its number, step from the hub name, manufacture date from the median of the product."""
    names = df.where(F.col("scan_location").isNotNull()).groupBy("location_id").agg(F.min("scan_location").alias("_place"))
    out = join_on(df, names, ["location_id"])
    hub = F.col("hub_type")
    step = None
    for word in ("Factory", "WMS", "Wholesaler", "Retailer"):
        step = F.when(hub.startswith(word), word) if step is None else step.when(hub.startswith(word), word)
    out = out.withColumns({
        "scan_location": F.coalesce("scan_location", "_place"), "business_step": F.coalesce(F.col("business_step"), step)})
    if "product_name" in df.columns and "manufacture_date" in df.columns:
        made = df.select("product_name", F.unix_micros("manufacture_date").alias("_us"))
        middle = quantiles(made, ["product_name"], "_us", {"_made": 0.5})
        out = join_on(out, middle, ["product_name"])
        out = out.withColumn("manufacture_date", F.coalesce("manufacture_date", F.timestamp_micros(F.round("_made").cast("long")))).drop("_made")
    return out.drop("_place")


def correct(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired codes, parsed times and positive place numbers; second table: what was changed."""
    fixed = df.withColumns({
        "_epc": epc.repair_epc(F.col("epc_code")), "_time": F.try_to_timestamp(F.col("event_time").cast("string")),
        "_place": F.abs("location_id")})
    kinds = {
        "epc_format": (F.col("_epc") != F.col("epc_code"), F.col("epc_code"), F.col("_epc")),
        "event_time": (F.col("_time").isNull() & F.col("event_time").isNotNull(), F.col("event_time").cast("string"), F.lit(None).cast("string")),
        "location_id": (F.col("location_id") < 0, F.col("location_id").cast("string"), F.col("_place").cast("string"))}
    entries = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(kind).alias("kind"), old.alias("before"), new.alias("after"))) for kind, (test, old, new) in kinds.items()]))
    issues = fixed.select("event_id", F.inline(entries))
    out = fixed.withColumns({"epc_code": F.col("_epc"), "event_time": F.col("_time"), "location_id": F.col("_place")})
    return out.drop("_epc", "_time", "_place"), issues


def correction_report(df: DataFrame, issues: DataFrame, *, keys: Sequence[str] = EPC_KEYS, order: Sequence[str] = EVENT_ORDER,
                      hot: Hot = MEASURE) -> DataFrame:
    """Number of corrections per kind, with steps that go back and scans before manufacture."""
    rows = issues.groupBy("kind").agg(F.count("*").alias("events"))
    back = windows.backward_steps(df, keys=keys, order=order, hot=hot).agg(F.lit("backward_step").alias("kind"), F.count("*").alias("events"))
    early = windows.before_manufacture(df).agg(F.lit("before_manufacture").alias("kind"), F.count("*").alias("events"))
    return rows.unionByName(back).unionByName(early)


# ---- scaling ----------------------------------------------------------------------------------

def scale(df: DataFrame, columns: Sequence[str], methods: dict[str, str] | None = None) -> DataFrame:
    """Adds ``<column>_scaled``: standard, robust (median and quartiles) or min-max.

    Without ``methods``: min-max for values inside [0, 1] or columns named like a ratio,
    standard for normal ones, robust for the rest.
    """
    stats = profile.moments(df, columns).drop("median")
    rows = profile.long_form(df, columns, cast="double")
    stats = join_on(stats, rows.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high")), ["column"])
    stats = join_on(stats, quantiles(rows, ["column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), ["column"])
    named = F.col("column").rlike("ratio|rate|percent|probability|progress")
    method = F.when(((F.col("low") >= 0) & (F.col("high") <= 1)) | named, "minmax").when(F.col("is_normal"), "standard").otherwise("robust")
    for c, m in (methods or {}).items():
        method = F.when(F.col("column") == c, m).otherwise(method)
    center = F.when(method == "minmax", F.col("low")).when(method == "standard", F.col("mean")).otherwise(F.col("q50"))
    spread = F.when(method == "minmax", F.col("high") - F.col("low")).when(method == "standard", F.col("std")).otherwise(
        F.col("q75") - F.col("q25"))
    plan = stats.select("column", center.alias("c"), F.when(spread > 0, spread).otherwise(1.0).alias("s"))
    wide = plan.agg(
        *[F.max(F.when(F.col("column") == c, F.col("c"))).alias(f"_c_{c}") for c in columns],
        *[F.max(F.when(F.col("column") == c, F.col("s"))).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(wide))
    out = out.withColumns({f"{c}_scaled": (F.col(c) - F.col(f"_c_{c}")) / F.col(f"_s_{c}") for c in columns})
    return out.drop(*[f"_{x}_{c}" for c in columns for x in "cs"])


def normalize_features(train: DataFrame, df: DataFrame, columns: Sequence[str], method: str = "robust") -> DataFrame:
    """Scales ``df`` with centers and spreads measured on ``train`` only."""
    if method == "robust":
        marks = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
        table = quantiles(profile.long_form(train, columns, cast="double"), ["column"], "value", marks)
        table = table.select("column", F.col("q50").alias("c"), (F.col("q75") - F.col("q25")).alias("s"))
    else:
        rows = profile.long_form(train, columns, cast="double")
        table = rows.groupBy("column").agg(F.avg("value").alias("c"), F.stddev_pop("value").alias("s"))
    wide = table.agg(
        *[F.max(F.when(F.col("column") == c, F.col("c"))).alias(f"_c_{c}") for c in columns],
        *[F.max(F.when(F.col("column") == c, F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(wide))
    out = out.withColumns({c: (F.col(c) - F.col(f"_c_{c}")) / F.col(f"_s_{c}") for c in columns})
    return out.drop(*[f"_{x}_{c}" for c in columns for x in "cs"])


# ---- encoding -----------------------------------------------------------------------------------

LABELLED = ("scan_location", "product_name")


def encode_categoricals(df: DataFrame, columns: Sequence[str], one_hot_up_to: int = 10) -> DataFrame:
    """Two values: 0/1. Up to ten: one column per value and for null. Places and products: label
    number. Others: share of rows. Values of all columns are counted in one pass, whose rows (one per value) are kept
    in the shared folder; they are broadcast unless there are very many."""
    counted = df.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id().alias("_of"), F.count("*").alias("_n"))
    path = shared_folder(df.sparkSession)
    counted.write.parquet(path)
    counted = df.sparkSession.read.schema(counted.schema).parquet(path)
    last = len(columns) - 1
    values_of = {c: counted.where(F.col("_of") == 2 ** (last + 1) - 1 - 2 ** (last - i)).select(c, "_n") for i, c in enumerate(columns)}
    out = df
    for c in columns:
        known = values_of[c].where(F.col(c).isNotNull()).select(c)
        kind = known.count()
        if kind <= one_hot_up_to and c not in LABELLED or kind <= 2:
            # at most ``one_hot_up_to`` values reach the driver
            values = [r[0] for r in known.orderBy(c).collect()]
            if kind <= 2:
                out = out.withColumn(f"{c}_encoded", (F.col(c).eqNullSafe(values[-1]) if values else F.lit(False)).cast("int"))
            else:
                out = out.withColumns({f"{c}_{v}": F.col(c).eqNullSafe(v).cast("int") for v in values})
                out = out.withColumn(f"{c}_nan", F.col(c).isNull().cast("int"))
        elif c in LABELLED:
            codes = running_totals(known, [], [c], {f"{c}_encoded": F.lit(1)}).withColumn(f"{c}_encoded", (F.col(f"{c}_encoded") - 1).cast("int"))
            out = join_on(out, broadcast_if_small(codes), [c]).withColumn(f"{c}_encoded", F.coalesce(f"{c}_encoded", F.lit(-1)))
        else:
            total = values_of[c].agg(F.sum("_n").alias("_rows"))
            out = join_on(out, broadcast_if_small(values_of[c]), [c]).crossJoin(F.broadcast(total))
            out = out.withColumn(f"{c}_frequency", F.col("_n") / F.col("_rows")).drop("_n", "_rows")
    if "business_step" in df.columns:
        out = out.withColumn("business_step_ordinal", moves.business_step_ordinal(F.col("business_step"), "customer"))
    return out


# ---- selection ------------------------------------------------------------------------------------

def variance_filter(df: DataFrame, columns: Sequence[str], threshold: float = 0.01) -> tuple[DataFrame, list[str]]:
    """Drops columns whose population variance does not exceed the threshold; also returns those kept."""
    row = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in columns]).first()
    kept = [c for c in columns if row[c] is not None and row[c] > threshold]
    return df.drop(*[c for c in columns if c not in kept]), kept


def correlations(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Correlation matrix from one aggregation; only the p x p numbers reach the driver."""
    index = {c: i for i, c in enumerate(columns)}
    matrix = np.eye(len(columns))
    for r in profile.correlation_pairs(df, columns).collect():
        value = 0.0 if r["correlation"] is None else r["correlation"]
        i, j = index[r["first"]], index[r["second"]]
        matrix[i, j] = matrix[j, i] = value
    return matrix


def vif(df: DataFrame, columns: Sequence[str], high: float = 10.0) -> DataFrame:
    """Variance inflation of each column: diagonal of the inverse correlation matrix."""
    matrix = correlations(df, columns)
    values = np.diag(np.linalg.pinv(matrix)) if np.linalg.matrix_rank(matrix) < len(columns) else np.diag(np.linalg.inv(matrix))
    rows = [(c, float(v), bool(v > high)) for c, v in zip(columns, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, high boolean")


def vif_convergence(df: DataFrame, columns: Sequence[str], key: Sequence[str], shares: Sequence[float], seed: int = 42) -> DataFrame:
    """Mean VIF on growing samples and whether the last three differ by less than 5 %."""
    from scanwarden.operators.sampling import draw

    drawn = df.withColumn("_u", draw(key, seed) / float(2**48))
    means = []
    for share in shares:
        matrix = correlations(drawn.where(F.col("_u") < share), columns)
        means.append(float(np.mean(np.diag(np.linalg.pinv(matrix)))))
    rows = []
    for i, share in enumerate(shares):
        tail = np.array(means[max(0, i - 2): i + 1])
        rows.append((float(share), means[i], bool(len(tail) == 3 and tail.std() / tail.mean() < 0.05)))
    return df.sparkSession.createDataFrame(rows, "share double, mean_vif double, converged boolean")


def correlation_prune(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Columns left after dropping the second of each pair that correlates above the threshold."""
    matrix, kept = correlations(df, columns), []
    for i, c in enumerate(columns):
        if not any(abs(matrix[columns.index(k), i]) > threshold for k in kept):
            kept.append(c)
    return kept


def redundancy_report(df: DataFrame, columns: Sequence[str], corr_cut: float = 0.85, vif_cut: float = 10.0) -> DataFrame:
    """Whether to reduce: more than three inflated columns of more than fifteen, or more than five close pairs."""
    matrix = correlations(df, columns)
    inflated = int((np.diag(np.linalg.pinv(matrix)) > vif_cut).sum())
    pairs = int((np.abs(np.triu(matrix, 1)) > corr_cut).sum())
    reduce_ = (inflated > 3 and len(columns) > 15) or pairs > 5
    return df.sparkSession.createDataFrame(
        [(len(columns), inflated, pairs, reduce_)], "features int, high_vif int, high_pairs int, should_reduce boolean")


def _standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    scaled = normalize_features(filled, filled, columns, "standard")
    return VectorAssembler(inputCols=list(columns), outputCol="_vector").transform(scaled)


def pca(df: DataFrame, columns: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """Component scores per row, and per component its explained variance and the loading of each column."""
    rows = _standardized(df, columns)
    model = PCA(k=k, inputCol="_vector", outputCol="_pc").fit(rows)
    share = model.explainedVariance.toArray()
    total = np.cumsum(share)
    table = [(i + 1, float(share[i]), float(total[i]), c, float(abs(model.pc.toArray()[j, i])))
             for i in range(k) for j, c in enumerate(columns)]
    loadings = df.sparkSession.createDataFrame(
        table, "component int, explained double, cumulative double, feature string, loading double")
    return model.transform(rows).withColumn("components", vector_to_array("_pc")).drop("_pc", "_vector"), loadings


def components_for(loadings: DataFrame, shares: Sequence[float] = (0.80, 0.85, 0.95)) -> DataFrame:
    """Components needed for each share of variance."""
    steps = loadings.select("component", "cumulative").distinct().withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    return steps.groupBy("share").agg(F.min(F.when(F.col("cumulative") >= F.col("share"), F.col("component"))).alias("components"))


def cluster(df: DataFrame, columns: Sequence[str], k: int = 4, components: int = 3, seed: int = 42) -> DataFrame:
    """k-means on the first principal components."""
    rows, _ = pca(df, columns, components)
    parts = [f"_pc{i}" for i in range(components)]
    rows = rows.withColumns({p: F.get("components", F.lit(i)) for i, p in enumerate(parts)})
    rows = VectorAssembler(inputCols=parts, outputCol="_point").transform(rows)
    # k-means keeps the points themselves, without the other columns of their rows
    model = KMeans(k=k, seed=seed, featuresCol="_point", predictionCol="cluster").fit(rows.select("_point"))
    return model.transform(rows).drop("_point", *parts)


def feature_importance(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Absolute correlation of each column with the label, 0 for constant ones; one aggregation."""
    y = F.col(label).cast("double")
    wide = df.agg(*[F.coalesce(F.abs(F.corr(F.col(c).cast("double"), y)), F.lit(0.0)).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "feature", "importance")

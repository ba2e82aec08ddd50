"""Label noise. Draws are hashes of the row key, so a noisy table can be rebuilt anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanwarden.operators.sampling import draw, hash_rank
from scanwarden.skew import join_on

TYPE = "anomaly_type"
DRAW_RANGE = float(2**48)
#: Draws are counted by their leading bits before a range of them is ordered.
RANGE_BITS = 16


def _flipped(hit: Column) -> Column:
    return F.when(hit, 1 - F.col("truth")).otherwise(F.col("truth")).cast("int")


def inject_noise(df: DataFrame, rate: float, key: Sequence[str], variant: str = "bernoulli", seed: int = 42) -> DataFrame:
    """``bernoulli`` flips each label with the rate; ``exact`` flips that share of all cells;
    ``drop_positives`` turns that share of each type's positives to 0."""
    full = [*key, TYPE]
    if variant == "bernoulli":
        return df.withColumn("truth", _flipped(draw(full, seed) / DRAW_RANGE < rate))
    if variant == "exact":
        ranked = hash_rank(df, [], full, seed, "_rank")
        total = df.agg(F.floor(F.count("*") * F.lit(rate)).alias("_flips"))
        out = ranked.crossJoin(F.broadcast(total))
        return out.withColumn("truth", _flipped(F.col("_rank") <= F.col("_flips"))).drop("_rank", "_flips")
    if variant == "drop_positives":
        return _flip_share(df, {1: rate}, key, seed)
    raise ValueError(f"unknown variant {variant}")


def _flip_share(df: DataFrame, rates: dict[int, float | Column], key: Sequence[str], seed: int) -> DataFrame:
    """Flips a share of each type's labels of a class, lowest draws first.

    The table is not moved: draws are counted in equal ranges, the range with the last draw to flip is ordered, and each row compares
    its own draw. Only rows that share this last draw are ranked, where not all of them are to be flipped.
    """
    df = df.where(F.col(TYPE).isNotNull() & F.col("truth").isNotNull())
    share = F.lit(0.0)
    for label, rate in rates.items():
        share = F.when(F.col("truth") == label, rate if isinstance(rate, Column) else F.lit(float(rate))).otherwise(share)
    strata, drawn = [TYPE, "truth"], draw([*key], seed)
    rows = df.where(share > 0).select(*strata, *[c for c in key if c not in strata], share.alias("_share"), drawn.alias("_draw"))
    counts = rows.groupBy(*strata, "_share", F.shiftright("_draw", 48 - RANGE_BITS).alias("_range")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*strata)  # one row per range
    upto = F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumns({"_upto": upto, "_size": F.sum("_n").over(whole)})
    wanted = F.least(F.floor(F.col("_size") * F.col("_share")), F.col("_size"))
    last = counts.withColumn("_wanted", wanted).where((F.col("_upto") - F.col("_n") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_upto")))
    # one row per type and class: the range of the last draw to flip and how many of its rows are flipped
    last = last.select(*strata, "_range", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_few")).collect()
    if not last:
        return df.withColumn("truth", F.col("truth").cast("int"))
    near = F.broadcast(df.sparkSession.createDataFrame(last, rows.select(*strata).schema.add("_range", "long").add("_few", "long")))
    inside = join_on(rows.withColumn("_range", F.shiftright("_draw", 48 - RANGE_BITS)), near, [*strata, "_range"], "inner")
    inside = inside.groupBy(*strata, "_few", "_draw").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*strata).orderBy("_draw").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("_upto", upto).where((F.col("_upto") - F.col("_n") < F.col("_few")) & (F.col("_few") <= F.col("_upto")))
    cuts = inside.select(*strata, F.col("_draw").alias("_cut"), (F.col("_few") - F.col("_upto") + F.col("_n")).alias("_ties"), "_n").collect()
    schema = rows.select(*strata).schema.add("_cut", "long").add("_ties", "long").add("_n", "long")
    out = join_on(df, F.broadcast(df.sparkSession.createDataFrame(cuts, schema)), strata)
    part = F.col("_cut").isNotNull() & (F.col("_ties") < F.col("_n"))  # some rows of the last draw stay
    helpers = ["_cut", "_ties", "_n"]
    if all(r["_ties"] == r["_n"] for r in cuts):
        return out.withColumn("truth", _flipped(F.col("_cut").isNotNull() & (drawn <= F.col("_cut")))).drop(*helpers)
    tied = F.coalesce(part & (drawn == F.col("_cut")), F.lit(False))
    plain = out.where(~tied).withColumn("truth", _flipped(F.col("_cut").isNotNull() & (drawn <= F.col("_cut"))))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(*key))
    ranked = out.where(tied).withColumn("_rank", rank).withColumn("truth", _flipped(F.col("_rank") <= F.col("_ties"))).drop("_rank")
    return plain.unionByName(ranked).drop(*helpers)


def inject_bias(df: DataFrame, patterns: dict[str, float], key: Sequence[str], seed: int = 42) -> DataFrame:
    """A positive share turns that many 0 labels of the type to 1, a negative one 1 labels to 0."""
    up, down = F.lit(0.0), F.lit(0.0)
    for kind, share in patterns.items():
        if share > 0:
            up = F.when(F.col(TYPE) == kind, F.lit(float(share))).otherwise(up)
        else:
            down = F.when(F.col(TYPE) == kind, F.lit(float(-share))).otherwise(down)
    return _flip_share(df, {0: up, 1: down}, key, seed)


def inject_low_confidence_noise(df: DataFrame, rate: float, key: Sequence[str], width: float = 0.2, seed: int = 42) -> DataFrame:
    """Flips labels with the rate, only where the probability is close to one half."""
    unsure = F.abs(F.col("probability") - 0.5) < width
    return df.withColumn("truth", _flipped(unsure & (draw([*key, TYPE], seed) / DRAW_RANGE < rate)))

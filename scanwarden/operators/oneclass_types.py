"""One-class models of several types fitted together: a step is one pass for all of them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanwarden.operators.oneclass import MIN_ROWS, MODEL, _batch, _fourier, _row_vector
from scanwarden.skew import quantile_grid

_BUCKETS = 64


def stacked(tables: dict[str, tuple[DataFrame, Sequence[str]]], label: str = "label") -> DataFrame:
    """Feature rows of all types under one another: ``kind``, ``x`` (numbers, null as 0) and ``y``."""
    out = None
    for kind, (df, features) in tables.items():
        rows = df.select(F.lit(kind).alias("kind"), _row_vector(features).alias("x"), F.col(label).cast("int").alias("y"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _by_kind(batch: pd.DataFrame):
    for kind, rows in batch.groupby("kind", sort=False):
        yield kind, rows.index, _batch(rows.iloc[:, 1])


def _sums(rows: DataFrame, at: dict[str, tuple[np.ndarray, float]]) -> dict[str, tuple[np.ndarray, int]]:
    """Per type the sum of the features below the margin and their number: a row per task and type, added in two levels."""
    def sums(batches):
        totals = {}
        for batch in batches:
            for kind, _, phi in _by_kind(batch):
                weights, rho = at[kind]
                low = phi[phi @ weights < rho]
                part = np.append(low.sum(axis=0), len(low))
                totals[kind] = totals[kind] + part if kind in totals else part
        if totals:
            yield pd.DataFrame({"kind": list(totals), "v": list(totals.values())})

    parts = rows.mapInPandas(sums, "kind string, v array<double>")
    parts = parts.select("kind", array_to_vector("v").alias("v"), (F.spark_partition_id() % _BUCKETS).alias("b"))
    level = parts.groupBy("kind", "b").agg(Summarizer.sum(F.col("v")).alias("v"))
    totals = level.groupBy("kind").agg(Summarizer.sum(F.col("v")).alias("v")).collect()  # one row per type
    found = {r["kind"]: r["v"].toArray() for r in totals}
    return {k: (found[k][:-1], int(found[k][-1])) if k in found else (np.zeros_like(w), 0) for k, (w, _) in at.items()}


def fit_types(tables: dict[str, tuple[DataFrame, Sequence[str]]], label: str = "label", nu: float = 0.1, dimensions: int = 32,
              steps: int = 15, rate: float = 0.5, seed: int = 42) -> DataFrame:
    """The models that ``fit_one_class`` finds for each type's table and features, from ``steps`` passes in all.

    Types with fewer than ten rows of label 0 get no row. Rows whose numbers are all 0 or null are not learnt from, as there; repeated
    rows count each time. Rows without a label are not learnt from; the accuracy counts them as label 0.
    """
    names = {kind: list(features) for kind, (_, features) in tables.items()}
    cells = stacked(tables, label).persist()
    phi = None
    try:
        spark = cells.sparkSession
        usable = cells.where((F.col("y") == 0) & F.exists("x", lambda v: v != 0))
        summary = Summarizer.metrics("count", "mean", "std").summary(array_to_vector("x")).alias("s")
        stats = {r["kind"]: r["s"] for r in usable.groupBy("kind").agg(summary).collect()}  # one row per type
        learnt = [k for k in names if k in stats and stats[k]["count"] >= MIN_ROWS]
        if not learnt:
            return spark.createDataFrame([], MODEL)
        maps, n = {}, {}
        for k in learnt:
            n[k] = int(stats[k]["count"])
            spread = stats[k]["std"].toArray() * math.sqrt((n[k] - 1) / n[k])
            rng = np.random.default_rng(seed)
            directions = rng.normal(0.0, math.sqrt(2.0 / len(names[k])), (dimensions, len(names[k])))
            maps[k] = (stats[k]["mean"].toArray(), np.where(spread > 0, spread, 1.0), directions, rng.uniform(0.0, 2 * math.pi, dimensions))

        def mapped(batches):
            for batch in batches:
                for kind, _, x in _by_kind(batch):
                    yield pd.DataFrame({"kind": kind, "phi": list(_fourier(x, *maps[kind]))})

        kept = usable.where(F.col("kind").isin(learnt)).select("kind", "x")
        phi = kept.mapInPandas(mapped, "kind string, phi array<double>").persist()
        at = {}
        for r in phi.groupBy("kind").agg(Summarizer.mean(array_to_vector("phi")).alias("m")).collect():
            start = r["m"].toArray()
            at[r["kind"]] = (start, float(start @ start) * 0.9)
        for step in range(steps):
            pace = rate / (1 + step)
            for k, (total, count) in _sums(phi, at).items():
                weights, rho = at[k]
                at[k] = (weights - pace * (weights - total / n[k] / nu), rho - pace * (count / n[k] / nu - 1) * abs(rho))

        def decided(batches):
            for batch in batches:
                for kind, _, x in _by_kind(batch):
                    yield pd.DataFrame({"kind": kind, "value": x @ at[kind][0]})

        values = phi.mapInPandas(decided, "kind string, value double")
        model, shares = [], [i / 100 for i in range(101)] + [nu]
        for k in learnt:
            found = quantile_grid(values.where(F.col("kind") == k), "value", shares).first()["quantiles"]
            center, spread, directions, phases = maps[k]
            offset = float(found[-1])
            model.append((k, names[k], center.tolist(), spread.tolist(), directions.tolist(), phases.tolist(), at[k][0].tolist(), offset,
                          [float(q) - offset for q in found[:-1]], n[k], None))
        limits = {m[0]: m[7] for m in model}

        def judged(batches):
            for batch in batches:
                for kind, index, x in _by_kind(batch[["kind", "x"]]):
                    out = _fourier(x, *maps[kind]) @ at[kind][0] < limits[kind]
                    yield pd.DataFrame({"kind": kind, "right": (out == (batch.loc[index, "y"] == 1).to_numpy()).astype(float)})

        right = cells.where(F.col("kind").isin(learnt)).mapInPandas(judged, "kind string, right double")
        rates = {r["kind"]: r["a"] for r in right.groupBy("kind").agg(F.avg("right").alias("a")).collect()}
        return spark.createDataFrame([(*m[:-1], float(rates[m[0]])) for m in model], MODEL)
    finally:
        cells.unpersist()
        if phi is not None:
            phi.unpersist()

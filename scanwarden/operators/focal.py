"""Several labels learnt at once with the focal loss: every pass over the rows serves all labels and several step lengths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanwarden import constants as C
from scanwarden.operators.multilabel import with_risk

MODEL = (
    "anomaly_type string, center array<double>, spread array<double>, weights array<double>, intercept double, rows bigint, positives bigint, "
    "rounds int, kept_round int, losses array<double>, validation_losses array<double>")
#: Step lengths that one pass tries; each label takes the one that suits it.
LADDER = (2.0, 1.0, 0.4, 0.05)
_BUCKETS = 64


def focal_loss(probability: Column, label: Column, alpha: float = 0.7, gamma: float = 2.0, positive_weight: float | Column = 1.0) -> Column:
    """Loss of one probability: cross entropy, less for rows that are already right, positives weighted."""
    p = F.least(F.greatest(probability, F.lit(1e-15)), F.lit(1 - 1e-15))
    hit = label.cast("double") == 1
    weight = F.lit(positive_weight) if isinstance(positive_weight, (int, float)) else positive_weight
    return F.when(hit, -alpha * weight * F.pow(1 - p, F.lit(gamma)) * F.ln(p)).otherwise(-(1 - alpha) * F.pow(p, F.lit(gamma)) * F.ln(1 - p))


def _losses(z: np.ndarray, y: np.ndarray, scale: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its slope by ``z``; cells without a label give 0."""
    sign = np.where(y > 0.5, 1.0, -1.0)
    u = sign * z
    log_hit, miss = -np.logaddexp(0.0, -u), np.exp(-np.logaddexp(0.0, u))  # log p and 1 - p of the right class
    factor = np.where(np.isnan(y), 0.0, scale) * miss**gamma
    return -factor * log_hit, factor * sign * (gamma * (1 - miss) * log_hit - miss)


def cells_of(rows: DataFrame, features: str, label: str, n: int, validation: str | None) -> DataFrame:
    """Vector, labels and whether the row is held back, of rows that have both."""
    held = F.coalesce(F.col(validation).cast("boolean"), F.lit(False)) if validation else F.lit(False)
    kept = rows.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    y = F.array(*[F.get(label, F.lit(i)).cast("double") for i in range(n)])
    return kept.select(vector_to_array(features).alias("x"), y.alias("y"), held.alias("held"))


def pass_sums(cells: DataFrame, trials: np.ndarray, center: np.ndarray, spread: np.ndarray, positive_weights: np.ndarray,
              alpha: float, gamma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all rows for each trial and label: training loss, its gradient, validation loss.

    ``trials`` is trials x labels x (features + 1). A task gives one row; rows are added in two levels.
    """
    shape = trials.shape
    flat = trials.reshape(-1, shape[2])
    width = len(flat)
    weight_of = np.tile(positive_weights, shape[0])

    def sums(batches):
        loss, slope, held_loss = np.zeros(width), np.zeros_like(flat), np.zeros(width)
        for batch in batches:
            if not len(batch):
                continue
            x = np.nan_to_num((np.stack(batch["x"].to_numpy()) - center) / spread, posinf=0.0, neginf=0.0)
            x = np.hstack([x, np.ones((len(x), 1))])
            y = np.tile(np.array([[np.nan if v is None else v for v in row] for row in batch["y"]], dtype=float), (1, shape[0]))
            scale = np.where(y > 0.5, alpha * weight_of, 1 - alpha)
            part, by_z = _losses(x @ flat.T, y, scale, gamma)
            held = batch["held"].to_numpy(dtype=bool)
            loss += part[~held].sum(axis=0)
            held_loss += part[held].sum(axis=0)
            slope += by_z[~held].T @ x[~held]
        yield pd.DataFrame({"v": [np.concatenate([loss, slope.ravel(), held_loss])]})

    parts = cells.mapInPandas(sums, "v array<double>").select(array_to_vector("v").alias("v"), (F.spark_partition_id() % _BUCKETS).alias("b"))
    level = parts.groupBy("b").agg(Summarizer.sum(F.col("v")).alias("v"))
    total = level.agg(Summarizer.sum(F.col("v")).alias("v")).first()["v"].toArray()
    loss, slope, held = np.split(total, [width, width + flat.size])
    return loss.reshape(shape[:2]), slope.reshape(shape), held.reshape(shape[:2])


class _Curvature:
    """Last moves of one label and how its gradient changed, for directions of the L-BFGS kind."""

    def __init__(self, keep: int = 6):
        self.keep, self.moves = keep, []

    def direction(self, gradient: np.ndarray) -> np.ndarray:
        q, used = gradient.copy(), []
        for s, y in reversed(self.moves):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append((a, s, y))
        if self.moves:
            s, y = self.moves[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(q)))
        for a, s, y in reversed(used):
            q += s * (a - (y @ q) / (s @ y))
        return -q

    def add(self, s: np.ndarray, y: np.ndarray) -> None:
        if s @ y > 1e-12 * float(np.linalg.norm(s) * np.linalg.norm(y)) and np.any(s):
            self.moves = [*self.moves, (s, y)][-self.keep:]


def fit_focal(rows: DataFrame, labels: Sequence[str] = C.STATS_TYPES, features: str = "features", label: str = "label",
              validation: str | None = None, alpha: float = 0.7, gamma: float = 2.0, penalty: float = 1e-4, rounds: int = 40,
              patience: int = 5, positive_weights: Sequence[float] | None = None) -> DataFrame:
    """One linear model per label, all of them from the same passes; a row per label.

    ``features`` is a vector, ``label`` an array of 0/1 (null: the row says nothing on that label). Positives weigh as much more as they
    are rarer, unless weights are given. A round is one pass: it tries ``LADDER`` along each label's direction and brings the next
    gradients too. With ``validation`` (a boolean column) those rows are not learnt from; rounds end once their mean loss has not
    fallen for ``patience`` rounds, and the round where it was least is kept. Labels that do not vary get no row. Rows without features
    or labels are left out; numbers that are not finite count as the mean. Repeated rows count each time.
    """
    names = list(labels)
    cells = cells_of(rows, features, label, len(names), validation).persist()
    try:
        return _fit(cells, names, alpha, gamma, penalty, rounds, patience, positive_weights, bool(validation))
    finally:
        cells.unpersist()


def _fit(cells, names, alpha, gamma, penalty, rounds, patience, positive_weights, validated) -> DataFrame:
    spark, learn = cells.sparkSession, ~F.col("held")
    known = [F.get("y", F.lit(i)) for i in range(len(names))]
    finite = F.transform("x", lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v))
    row = cells.agg(
        *[F.count_if(learn & k.isNotNull()).alias(f"n{i}") for i, k in enumerate(known)],
        *[F.count_if(learn & (k > 0.5)).alias(f"p{i}") for i, k in enumerate(known)],
        *[F.count_if(~learn & k.isNotNull()).alias(f"h{i}") for i, k in enumerate(known)]).first()
    n, pos, held = (np.array([row[f"{c}{i}"] for i in range(len(names))], dtype=float) for c in "nph")
    live = np.flatnonzero((pos > 0) & (pos < n))
    if not len(live):
        return spark.createDataFrame([], MODEL)
    stats = cells.where(learn).select(Summarizer.metrics("mean", "std").summary(array_to_vector(finite)).alias("s")).first()["s"]
    center, spread = stats["mean"].toArray(), stats["std"].toArray()
    spread = np.where(spread > 0, spread, 1.0)
    weights_of = np.asarray(positive_weights, dtype=float) if positive_weights is not None else (n - pos) / np.maximum(pos, 1)
    picked = cells.withColumn("y", F.array(*[known[i] for i in live]))
    n_live, held_live = n[live], np.maximum(held[live], 1)

    def measured(trials):
        loss, slope, held_loss = pass_sums(picked, trials, center, spread, weights_of[live], alpha, gamma)
        flat = trials.copy()
        flat[:, :, -1] = 0.0  # the intercept is not penalised
        return loss / n_live + penalty / 2 * (flat**2).sum(axis=2), slope / n_live[:, None] + penalty * flat, held_loss / held_live

    at = np.zeros((len(live), len(center) + 1))
    (loss,), (slope,), (held_loss,) = measured(at[None])
    memory, reach = [_Curvature() for _ in live], np.ones(len(live))
    losses, held_losses = [loss], [held_loss]
    best, kept, kept_at = float(held_loss.mean()), 0, at.copy()
    for step in range(1, rounds + 1):
        way = np.stack([m.direction(g) for m, g in zip(memory, slope)])
        trials = np.stack([at + length * reach[:, None] * way for length in LADDER])
        trial_loss, trial_slope, trial_held = measured(trials)
        trial_loss = np.where(np.isfinite(trial_loss), trial_loss, np.inf)
        pick, each = trial_loss.argmin(axis=0), np.arange(len(live))
        better = trial_loss[pick, each] < loss
        for i in each:
            if better[i]:
                memory[i].add(trials[pick[i], i] - at[i], trial_slope[pick[i], i] - slope[i])
                reach[i] = 1.0
            else:  # no length helps: forget the curvature and go on with shorter steps
                memory[i], reach[i] = _Curvature(), reach[i] / 40
        at = np.where(better[:, None], trials[pick, each], at)
        slope = np.where(better[:, None], trial_slope[pick, each], slope)
        held_loss, before = np.where(better, trial_held[pick, each], held_loss), loss
        loss = np.where(better, trial_loss[pick, each], loss)
        losses.append(loss)
        held_losses.append(held_loss)
        now = float(held_loss.mean())
        if not validated or now < best - 1e-9:
            best, kept, kept_at = now, step, at.copy()
        if validated and step - kept >= patience:
            break
        if np.all((before - loss <= 1e-7 * before) & (better | (reach < 1e-3))):
            break
    table = [
        (names[i], center.tolist(), spread.tolist(), kept_at[j, :-1].tolist(), float(kept_at[j, -1]), int(n[i]), int(pos[i]), len(losses) - 1,
         kept, [float(v[j]) for v in losses], [float(v[j]) for v in held_losses] if validated else None)
        for j, i in enumerate(live)]
    return spark.createDataFrame(table, MODEL)


def score_focal(rows: DataFrame, models: DataFrame, labels: Sequence[str] = C.STATS_TYPES, cuts: dict[str, float] | None = None,
                features: str = "features") -> DataFrame:
    """Adds per label probability and flag, the overall risk and its level; labels without a model get probability 0.

    Numbers that are not finite count as the mean; without features the probability is that of the mean row.
    """
    fitted = {m["anomaly_type"]: m for m in models.collect()}  # one row per label
    x, out = F.when(F.col(features).isNotNull(), vector_to_array(features)), rows
    for name in labels:
        p = F.lit(0.0)
        if name in fitted:
            m = fitted[name]
            parts = F.arrays_zip(x.alias("x"), F.lit(m["weights"]).alias("w"), F.lit(m["center"]).alias("c"), F.lit(m["spread"]).alias("s"))
            z = F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + F.when(
                F.isnan(v["x"]) | (F.abs(v["x"]) == float("inf")), F.lit(0.0)).otherwise(v["w"] * (v["x"] - v["c"]) / v["s"]))
            p = 1 / (1 + F.exp(-(F.coalesce(z, F.lit(0.0)) + m["intercept"])))
        out = out.withColumns({f"{name}_probability": p})
        out = out.withColumn(f"{name}_detected", F.col(f"{name}_probability") > (cuts or {}).get(name, 0.5))
    return with_risk(out, labels).withColumn("method", F.lit("model"))

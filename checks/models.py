"""One-class and multi-label models, similarity, explanations."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from checks.base import FAKE_SQL, hot, plain, query, scans
from checks.detection import findings
from checks.journey import rounded
from checks.thresholds import training
from scanwarden import constants as C
from scanwarden.operators import detect_events as det
from scanwarden.operators import features as fe
from scanwarden.operators import focal as fo
from scanwarden.operators import labels as lab
from scanwarden.operators import multilabel as ml
from scanwarden.operators import oneclass as oc
from scanwarden.operators import profile as pro
from scanwarden.operators import similarity as sm
from scanwarden.plans import registry
from scanwarden.sources.table_scans import as_of, table

FAKE = list(fe.FAKE)


@query("M1_fit_one_class")
def _(spark, d):
    model = oc.fit_one_class(training(spark, d), FAKE, "epcFake")
    return model.select("anomaly_type", "rows", F.round("accuracy", 4).alias("accuracy"), F.round("offset", 6).alias("offset"))


@query("M2_score_one_class")
def _(spark, d):
    rows = training(spark, d)
    model = oc.fit_one_class(rows, FAKE, "epcFake").first()
    scored = oc.score_one_class(rows, model)
    return scored.select("file_id", "epc_code", "outlier", "score", F.round("decision", 5).alias("decision"))


@query("M3_detect_one_class")
def _(spark, d):
    events = scans(spark, d)
    items = training(spark, d)
    jumps = fe.jump_features_per_event(events, hot=hot(spark, d)).withColumn("label", F.lit(0))
    tables = {"epcFake": items} | {
        kind: registry.item_features(kind, events, hot=hot(spark, d)).withColumn("label", F.lit(0)) for kind in C.STATS_TYPES if kind not in ("epcFake", "jump")}
    models = oc.fit_one_class(jumps, fe.JUMP_EVENT, "jump")
    for kind, rows in tables.items():
        models = models.unionByName(oc.fit_one_class(rows, list(registry.FEATURE_NAMES[kind]), kind))
    found = oc.detect_one_class(models, tables, {"jump": jumps}, events)
    return det.file_stats(found)


def labelled_sequences(spark, d):
    df = scans(spark, d)
    found = findings(spark, d).select("event_id", *[F.coalesce(F.col(t), F.lit(False)).alias(t) for t in C.STATS_TYPES])
    df = df.join(found, "event_id", "left").fillna(False, list(C.STATS_TYPES))
    return fe.sequences_fixed(df, ["location_id", "device_id"], length=5, hot=hot(spark, d))


@query("M6_M7_score_multilabel")
def _(spark, d):
    rows = ml.flatten(labelled_sequences(spark, d))
    models = ml.fit_multilabel(rows)
    scored = ml.score_multilabel(rows, models)
    return scored.select("event_id", *[F.round(f"{t}_probability", 4).alias(t) for t in C.STATS_TYPES], "risk_level", "alert_level")


PROBS = {t: p for t, p in zip(C.STATS_TYPES, (1, 7, 49, 343, 2401))}


def scored(spark, d):
    return scans(spark, d).withColumns({f"{t}_probability": F.expr(f"CAST((event_id div {p}) % 100 AS DOUBLE)/100") for t, p in PROBS.items()})


CHANCE = {t: f"CAST((event_id // {p}) % 100 AS DOUBLE)/100" for t, p in PROBS.items()}


@query("M7_item_risk", f"""
, m AS (SELECT file_id, epc_code, {', '.join(f'max({c}) AS "{t}_probability"' for t, c in CHANCE.items())} FROM scans GROUP BY ALL),
r AS (SELECT *, greatest({', '.join(f'"{t}_probability"' for t in CHANCE)}) AS overall_risk FROM m)
SELECT *, CASE WHEN overall_risk >= 0.8 THEN 'high' WHEN overall_risk >= 0.6 THEN 'medium' ELSE 'low' END AS risk_level FROM r""")
def _(spark, d):
    return ml.item_risk(scored(spark, d)).drop("alert_level")


@query("M8_ensemble", f"""
, p AS (SELECT event_id, {CHANCE['epcFake']} AS a, {CHANCE['epcDup']} AS b, {CHANCE['jump']} AS c FROM scans), m AS (SELECT *, 0.5*a + 0.3*b + 0.2*c AS m FROM p)
SELECT event_id, round(m, 6) AS ensemble_mean, round(0.5*pow(a-m,2) + 0.3*pow(b-m,2) + 0.2*pow(c-m,2), 6) AS ensemble_variance FROM m""")
def _(spark, d):
    df = ml.ensemble(scored(spark, d), ["epcFake_probability", "epcDup_probability", "jump_probability"], [0.5, 0.3, 0.2])
    return rounded(df, "ensemble_mean", "ensemble_variance", digits=6).select("event_id", "ensemble_mean", "ensemble_variance")


SIMILAR = """
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 0), k AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 0),
s AS (SELECT q.vec_id, k.vec_id AS other, list_cosine_similarity(q.v, k.v) AS sim FROM q, k),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS rank FROM s WHERE sim > 0.1)"""


def similar(spark, d):
    df = table(spark, d, "embeddings")
    return ml.similar_top_k(df.where("label = 0"), df.where("label <> 0"), "vec_id", "vec_id", k=3, threshold=0.1)


@plain("C12_similarity_top_k", SIMILAR + "SELECT vec_id, other AS vec_id_similar, round(sim, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 3")
def _(spark, d):
    return rounded(similar(spark, d), "similarity", digits=6)


@plain("C12_similarity_index", SIMILAR + "SELECT count(*) AS answers, TRUE AS recalled, TRUE AS bounded FROM r WHERE rank <= 3")
def _(spark, d):
    """Answers of the index with a recall of 0.95 against the exact ones."""
    df = table(spark, d, "embeddings")
    index = sm.build_index(df.where("label <> 0"), "vec_id", block_rows=256)
    found = sm.search(index, df.where("label = 0"), "vec_id", k=3, threshold=0.1, recall=0.95)
    exact = sm.search(index, df.where("label = 0"), "vec_id", k=3, threshold=0.1).select("q", "n", F.lit(1).alias("known"))
    both = exact.join(found.select("q", "n", F.lit(1).alias("found")), ["q", "n"], "left")
    out = both.agg(F.count("*").alias("answers"), (F.count("found") >= 0.9 * F.count("*")).alias("recalled"))
    beside = found.groupBy("q").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c") <= 3, F.lit(True)).alias("bounded"))
    return out.crossJoin(F.broadcast(beside))


@plain("M9_cold_start", SIMILAR + """
, n AS (SELECT vec_id, max(sim) AS b FROM r WHERE rank <= 3 GROUP BY 1),
i AS (SELECT vec_id, vec_id % 101 AS s FROM embeddings)
SELECT vec_id, round(coalesce(0.05*(1+0.5*b), s/100), 6) AS "epcFake_probability", round(coalesce(0.04*(1+0.5*b), s/100), 6) AS jump_probability,
  CASE WHEN b IS NOT NULL THEN 'similar_items' ELSE 'rules' END AS method FROM i LEFT JOIN n USING (vec_id)""")
def _(spark, d):
    items = table(spark, d, "embeddings").select("vec_id")
    rules = items.select("vec_id", *[(F.col("vec_id") % 101).alias(t) for t in C.STATS_TYPES])
    out = ml.cold_start(items, similar(spark, d), rules, keys=["vec_id"])
    return rounded(out, "epcFake_probability", "jump_probability", digits=6).select("vec_id", "epcFake_probability", "jump_probability", "method")


@plain("M10_update_embedding", """
WITH k AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 3 <> 0), n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 0)
SELECT coalesce(k.vec_id, n.vec_id) AS vec_id, round(coalesce(list_sum(list_transform(k.v, lambda x: x))*0.9 + list_sum(n.v)*0.1*2, list_sum(k.v), list_sum(n.v)*2), 5) AS total,
  round(CASE WHEN n.vec_id IS NULL THEN 0.5 ELSE (CASE WHEN k.vec_id IS NULL THEN 0 ELSE 0.5*label END + 0.9)/(coalesce(label, 0) + 1) END, 6)::DOUBLE AS confidence,
  (CASE WHEN n.vec_id IS NULL THEN label ELSE coalesce(label, 0) + 1 END)::INT AS updates FROM k FULL JOIN n ON k.vec_id = n.vec_id""")
def _(spark, d):
    df = table(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    known = df.where("vec_id % 3 <> 0").select("vec_id", "embedding", F.lit(0.5).alias("confidence"), F.col("label").alias("updates"))
    recent = df.where("vec_id % 2 = 0").select("vec_id", F.transform("embedding", lambda x: x * 2).alias("embedding"), F.lit(0.9).alias("confidence"))
    out = ml.update_embedding(known, recent, keys=["vec_id"])
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    return out.select("vec_id", F.round(total, 5).alias("total"), F.round("confidence", 6).alias("confidence"), F.col("updates").cast("int").alias("updates"))


WEIGHTS = {"location_id": 0.5, "device_id": -0.2, "operator_id": 0.01}
MEANS = {"location_id": 29.5, "device_id": 24.5, "operator_id": 50.0}
PARTS = {f: f"({f} - {MEANS[f]})*{WEIGHTS[f]}" for f in WEIGHTS}


def attributed(spark, d):
    return ml.attribution(scans(spark, d), list(WEIGHTS), WEIGHTS, MEANS)


@query("M11_attribution", "SELECT event_id, " + ", ".join(f"round({p}, 4)::DOUBLE AS {f}" for f, p in PARTS.items()) + " FROM scans")
def _(spark, d):
    df = attributed(spark, d)
    return df.select("event_id", *[F.round(F.get("contributions", F.lit(i))["contribution"], 4).alias(f) for i, f in enumerate(WEIGHTS)])


@query("S8_top_features", " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg(abs({p})), 6)::DOUBLE AS importance FROM scans" for f, p in PARTS.items()) + " ORDER BY 2 DESC LIMIT 2")
def _(spark, d):
    return rounded(ml.top_features(attributed(spark, d), 2), "importance", digits=6)


@query("M12_business_explanation", f"""
, p AS (SELECT event_id, {CHANCE['jump']} AS p, abs(({PARTS['location_id']})::DOUBLE) AS a, abs(({PARTS['device_id']})::DOUBLE) AS b, abs(({PARTS['operator_id']})::DOUBLE) AS c FROM scans),
r AS (SELECT *, CASE WHEN p >= 0.8 THEN 'HIGH' WHEN p >= 0.5 THEN 'MEDIUM' WHEN p >= 0.2 THEN 'LOW' ELSE 'NORMAL' END AS risk,
  CASE WHEN a > b AND a > c THEN 'Location route' WHEN b >= a AND b > c THEN 'Scan frequency' ELSE 'Time gap' END AS top FROM p)
SELECT event_id, risk AS risk_level, 'Analysis of Impossible travel time detection. Risk Level: ' || risk || ' (' || printf('%.1f', p*100) || '% probability). Primary concern: ' || top AS summary FROM r""")
def _(spark, d):
    df = ml.top_contributions(attributed(spark, d), 2)
    p = F.expr(f"CAST((event_id div {PROBS['jump']}) % 100 AS DOUBLE)/100")
    names = {"location_id": "Location route", "device_id": "Scan frequency", "operator_id": "Time gap"}
    return ml.business_explanation(df, F.lit("jump"), p, names).select("event_id", "risk_level", "summary")


@query("P12_smote_or_weight", f"""
, t AS (SELECT epc_code, max({FAKE_SQL}) >= 80 AS bad FROM dated GROUP BY 1)
SELECT label::INT AS label, CASE WHEN p < 50 OR 2 * p >= n THEN CASE label WHEN 1 THEN p ELSE n - p END ELSE n - p END AS "rows"
FROM (SELECT count(*) AS n, count(*) FILTER (bad) AS p FROM t), (VALUES (0), (1)) l(label)""", "dated")
def _(spark, d):
    rows = training(spark, d).withColumn("label", (F.col("score") >= 80).cast("int"))
    return ml.smote_or_weight(rows, FAKE, "epc_code")[0].groupBy("label").agg(F.count("*").alias("rows"))


@query("D33_prediction_summary", f"""
, p AS (SELECT {', '.join(f'{c} AS s{i}' for i, c in enumerate(CHANCE.values()))} FROM scans),
h AS (SELECT 100.0*count(*) FILTER ({' OR '.join(f's{i} > 0.97' for i in range(5))})/count(*) AS rate FROM p)
SELECT round(rate::DOUBLE, 6) AS anomaly_rate, CASE WHEN rate > 10 THEN 'HIGH' WHEN rate > 5 THEN 'MEDIUM' WHEN rate > 1 THEN 'LOW' ELSE 'EXCELLENT' END AS alert, t.* FROM h, (
  {' UNION ALL '.join(f"SELECT '{t}' AS anomaly_type, count(*) FILTER (s{i} > 0.97) AS detected, round((100.0*count(*) FILTER (s{i} > 0.97)/count(*))::DOUBLE, 6) AS percent, round(avg(s{i}), 6) AS mean_score FROM p" for i, t in enumerate(CHANCE))}) t""")
def _(spark, d):
    df = scored(spark, d)
    df = df.withColumns({f"{t}_detected": F.col(f"{t}_probability") > 0.97 for t in C.STATS_TYPES} | {f"{t}_score": F.col(f"{t}_probability") for t in C.STATS_TYPES})
    return rounded(pro.prediction_summary(df, C.STATS_TYPES), "anomaly_rate", "percent", "mean_score", digits=6)


FOCAL_FEATURES = {"location_id": (30.0, 20.0), "device_id": (25.0, 15.0), "operator_id": (50.0, 30.0)}
FOCAL_WEIGHTS = {t: (0.3 * i - 0.5, 0.2, 0.1 * i, -1.0 + 0.2 * i) for i, t in enumerate(C.STATS_TYPES)}


def focal_rows(spark, d):
    """Scans with three numbers and the types that the rules find."""
    found = findings(spark, d).select("event_id", *[F.coalesce(F.col(t), F.lit(False)).alias(t) for t in C.STATS_TYPES])
    df = scans(spark, d).join(found, "event_id", "left").fillna(False, list(C.STATS_TYPES))
    numbers = F.array(*[F.col(c).cast("double") for c in FOCAL_FEATURES])
    return df.select("event_id", array_to_vector(numbers).alias("features"), F.array(*[F.col(t).cast("int") for t in C.STATS_TYPES]).alias("label"),
                     (F.col("event_id") % 5 == 0).alias("held"))


FOUND = {"epcFake": "f_fake", "epcDup": "f_dup", "locErr": "f_loc", "evtOrderErr": "f_ord"}
FOCAL_Z = {t: " + ".join(f"({c} - {m})/{s}*({w})" for (c, (m, s)), w in zip(FOCAL_FEATURES.items(), FOCAL_WEIGHTS[t])) + f" + ({FOCAL_WEIGHTS[t][3]})" for t in FOUND}


@query("M6_focal_loss", "\n, p AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS anomaly_type, coalesce({y}, false) AS y, event_id % 5 = 0 AS held, 1/(1 + exp(-({FOCAL_Z[t]})::DOUBLE)) AS p FROM scans LEFT JOIN (SELECT event_id, {y} FROM findings) f USING (event_id)"
    for t, y in FOUND.items()) + """),
l AS (SELECT *, CASE WHEN y THEN -0.7*3*pow(1 - p, 2)*ln(p) ELSE -0.3*pow(p, 2)*ln(1 - p) END AS loss FROM p)
SELECT anomaly_type, round(sum(loss) FILTER (NOT held) / count(*), 6) AS training, round(sum(loss) FILTER (held) / count(*), 6) AS held FROM l GROUP BY 1""", "dated prev found")
def _(spark, d):
    names = list(C.STATS_TYPES)
    trial = np.array([[FOCAL_WEIGHTS[t] for t in names]])
    center, spread = (np.array(v) for v in zip(*FOCAL_FEATURES.values()))
    cells = fo.cells_of(focal_rows(spark, d), "features", "label", len(names), "held")
    loss, _, held = fo.pass_sums(cells, trial, center, spread, np.full(len(names), 3.0), 0.7, 2.0)
    n = cells.count()
    rows = [(t, float(loss[0, i]) / n, float(held[0, i]) / n) for i, t in enumerate(names) if t in FOUND]
    return rounded(spark.createDataFrame(rows, "anomaly_type string, training double, held double"), "training", "held", digits=6)


@query("M6_focal_fit", "\n, p AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS anomaly_type, coalesce({y}, false) AS y FROM scans LEFT JOIN (SELECT event_id, {y} FROM findings) f USING (event_id) WHERE event_id % 5 <> 0"
    for t, y in FOUND.items()) + """)
SELECT anomaly_type, count(*) AS "rows", count(*) FILTER (y) AS positives, true AS falls, true AS kept_best FROM p GROUP BY 1
HAVING count(*) FILTER (y) BETWEEN 1 AND count(*) - 1""", "dated prev found")
def _(spark, d):
    rows = focal_rows(spark, d)
    models = fo.fit_focal(rows, validation="held")
    best = models.select(F.posexplode("validation_losses").alias("i", "v"), "kept_round").groupBy("i").agg(F.avg("v").alias("v"), F.max("kept_round").alias("k"))
    best = best.agg((F.max(F.when(F.col("i") == F.col("k"), F.col("v"))) <= F.min("v") + 1e-8).alias("kept_best"))
    out = models.crossJoin(F.broadcast(best))  # one row
    falls = (F.element_at("losses", -1) < F.get("losses", F.lit(0))) & ~F.exists(
        F.zip_with(F.slice("losses", 2, 1000), F.slice("losses", 1, F.size("losses") - 1), lambda b, a: b > a), lambda v: v)
    return out.select("anomaly_type", "rows", "positives", falls.alias("falls"), "kept_best")

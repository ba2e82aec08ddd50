"""Evaluation and label noise on predictions derived from the scans."""

import re

from pyspark.sql import functions as F

from checks.base import SHARED, query, scans
from checks.journey import rounded
from checks.samples import draw_sql
from scanwarden import constants as C
from scanwarden.operators import evaluate as ev
from scanwarden.operators import noise as nz

TYPES = C.STATS_TYPES
STEPS = dict(zip(TYPES, (1, 7, 49, 343, 2401)))
SHARED["pred"] = "pred AS (" + " UNION ALL ".join(
    f"""SELECT event_id, '{t}' AS anomaly_type, CAST((location_id + {i}) % 5 = 0 AS INTEGER) AS truth,
  ((event_id // {p}) % 700 + 300*CAST((location_id + {i}) % 5 = 0 AS INTEGER))/1000.0::DOUBLE AS probability FROM scans"""
    for i, (t, p) in enumerate(STEPS.items())) + ")"


def predictions(spark, d):
    """Five labels and probabilities per event, with some relation between them."""
    df = scans(spark, d)
    rows = []
    for i, (t, p) in enumerate(STEPS.items()):
        truth = ((F.col("location_id") + i) % 5 == 0).cast("int")
        chance = (F.expr(f"(event_id div {p}) % 700") + 300 * truth) / 1000.0
        rows.append(F.struct(F.lit(t).alias("anomaly_type"), truth.alias("truth"), chance.alias("probability")))
    return df.select("event_id", F.inline(F.array(*rows)))


CONFUSION = """SELECT anomaly_type, count(*) FILTER (truth=1 AND hit) AS tp, count(*) FILTER (truth=0 AND hit) AS fp,
  count(*) FILTER (truth=1 AND NOT hit) AS fn, count(*) FILTER (truth=0 AND NOT hit) AS tn FROM {} GROUP BY 1"""
RATES = """SELECT *, CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0 END AS prec, CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0 END AS rec FROM {}"""
SHARED["conf"] = f"""
conf0 AS ({CONFUSION.format('(SELECT *, probability >= 0.5 AS hit FROM pred)')}), conf AS ({RATES.format('conf0')})"""


@query("V1_confusion", """
SELECT anomaly_type, tp, fp, fn, tn, round(prec, 6) AS "precision", round(rec, 6) AS recall, round(CASE WHEN prec+rec > 0 THEN 2*prec*rec/(prec+rec) ELSE 0 END, 6) AS f1 FROM conf""", "pred conf")
def _(spark, d):
    return rounded(ev.confusion(predictions(spark, d)), "precision", "recall", "f1", digits=6)


AUC = """
g AS (SELECT anomaly_type, probability, count(*) FILTER (truth=1) AS p, count(*) FILTER (truth=0) AS n FROM {} GROUP BY ALL),
k AS (SELECT *, sum(p) OVER w AS ctp, sum(n) OVER w AS cfp, sum(p) OVER t AS tp_all, sum(n) OVER t AS tn_all FROM g
  WINDOW w AS (PARTITION BY anomaly_type ORDER BY probability DESC), t AS (PARTITION BY anomaly_type)),
aucs AS (SELECT anomaly_type, CAST(any_value(tp_all) AS BIGINT) AS positives, CAST(any_value(tn_all) AS BIGINT) AS negatives,
  any_value(tp_all)/(any_value(tp_all)+any_value(tn_all)) AS prevalence, sum(p*(tn_all - cfp + n/2))/(any_value(tp_all)*any_value(tn_all)) AS auc,
  sum(p*ctp/(ctp+cfp))/any_value(tp_all) AS ap FROM k GROUP BY 1)"""


@query("V2_auc", ", " + AUC.format("pred") + """
SELECT anomaly_type, positives, negatives, round(prevalence, 6) AS prevalence, round(auc, 6) AS auc, round(ap, 6) AS ap FROM aucs""", "pred")
def _(spark, d):
    return rounded(ev.auc(predictions(spark, d)), "prevalence", "auc", "ap", digits=6)


def metrics_sql(source, tag=""):
    """All metrics per type with micro and macro rows, as CTEs ending in ``met{tag}``."""
    pooled = f"(SELECT * FROM {source} UNION ALL SELECT event_id, 'micro', truth, probability FROM {source})"
    body = AUC.format(pooled)
    for name in ("g", "k", "aucs"):
        body = re.sub(rf"\b{name} AS \(", f"{name}{tag} AS (", body)
        body = re.sub(rf"\bFROM {name}\b", f"FROM {name}{tag}", body)
    return f"""{body},
c0{tag} AS ({CONFUSION.format(f'(SELECT *, probability >= 0.5 AS hit FROM {pooled})')}), c1{tag} AS ({RATES.format(f'c0{tag}')}),
m0{tag} AS (SELECT anomaly_type, prec AS "precision", rec AS recall, CASE WHEN prec+rec > 0 THEN 2*prec*rec/(prec+rec) ELSE 0 END AS f1, auc, ap, prevalence
  FROM c1{tag} JOIN aucs{tag} USING (anomaly_type)),
met{tag} AS (SELECT * FROM m0{tag} UNION ALL SELECT 'macro', avg("precision"), avg(recall), avg(f1), avg(auc), avg(ap), avg(prevalence) FROM m0{tag} WHERE anomaly_type <> 'micro')"""


COLUMNS = ("precision", "recall", "f1", "auc", "ap", "prevalence")
ROUNDED = ", ".join(f'round("{c}", 6) AS "{c}"' for c in COLUMNS)


@query("V2_metrics_macro_micro", ", " + metrics_sql("pred") + f"SELECT anomaly_type, {ROUNDED} FROM met", "pred")
def _(spark, d):
    return rounded(ev.metrics(predictions(spark, d)), *COLUMNS, digits=6)


@query("V2_hamming_loss", "SELECT round(avg(((probability >= 0.5) <> (truth = 1))::INT), 6) AS hamming_loss FROM pred", "pred")
def _(spark, d):
    return rounded(ev.hamming_loss(predictions(spark, d)), "hamming_loss", digits=6)


def case(table, i):
    return "CASE anomaly_type " + " ".join(f"WHEN '{t}' THEN {v[i]}::DOUBLE" for t, v in table.items()) + " END"


@query("V3_cost_metrics", f"""
, c AS (SELECT *, {case(C.REVIEW_COSTS, 0)} AS m, {case(C.REVIEW_COSTS, 1)} AS a FROM conf)
SELECT anomaly_type, fn*m AS miss_cost, fp*a AS alert_cost, fn*m + fp*a AS cost, round((fn*m + fp*a)/(tp+fp+fn+tn), 6) AS cost_per_sample,
  round(CASE WHEN 4*prec + rec*m/a > 0 THEN 5*prec*(rec*m/a)/(4*prec + rec*m/a) ELSE 0 END, 6) AS f_beta FROM c""", "pred conf")
def _(spark, d):
    return rounded(ev.cost_metrics(predictions(spark, d)), "cost_per_sample", "f_beta", digits=6)


@query("V4_cost_weighted_accuracy", f"""
, c AS (SELECT anomaly_type, count(*) FILTER (truth=0 AND probability > 0.5) AS fp, count(*) FILTER (truth=1 AND probability <= 0.5) AS fn, count(*) AS n FROM pred GROUP BY 1),
e AS (SELECT sum(fp*{case(C.ACCURACY_COSTS, 0)} + fn*{case(C.ACCURACY_COSTS, 1)}) AS t, sum(n*greatest({case(C.ACCURACY_COSTS, 0)}, {case(C.ACCURACY_COSTS, 1)})) AS m FROM c)
SELECT round(t, 4) AS total_cost, round(m, 4) AS max_cost, round(1 - t/m, 6) AS cost_weighted_accuracy FROM e""", "pred")
def _(spark, d):
    df = rounded(ev.cost_weighted_accuracy(predictions(spark, d)), "total_cost", "max_cost")
    return rounded(df, "cost_weighted_accuracy", digits=6)


SHARED["curve"] = f"""
curve AS (SELECT anomaly_type, i/100 AS threshold, count(*) FILTER (truth=1 AND probability >= i/100)*{case(C.CURVE_COSTS, 2)}
    + count(*) FILTER (truth=0 AND probability < i/100)*{case(C.CURVE_COSTS, 3)} + count(*) FILTER (truth=0 AND probability >= i/100)*{case(C.CURVE_COSTS, 0)}
    + count(*) FILTER (truth=1 AND probability < i/100)*{case(C.CURVE_COSTS, 1)} AS cost,
  count(*) FILTER (truth=0)*{case(C.CURVE_COSTS, 3)} + count(*) FILTER (truth=1)*{case(C.CURVE_COSTS, 1)} AS baseline_cost
  FROM pred, (SELECT unnest(range(101)) AS i) GROUP BY anomaly_type, i)"""


@query("V5_cost_curve", "SELECT anomaly_type, round(threshold, 6) AS threshold, cost, baseline_cost FROM curve", "pred curve")
def _(spark, d):
    return rounded(ev.cost_curve(predictions(spark, d)), "threshold", digits=6)


@query("V5_area_under_cost_curve", """
, l AS (SELECT *, lead(threshold) OVER w AS t, lead(cost) OVER w AS c FROM curve WINDOW w AS (PARTITION BY anomaly_type ORDER BY threshold)),
a AS (SELECT anomaly_type, sum((t-threshold)*(c+cost)/2) AS aucc, min(cost) AS minimum_cost, first(threshold ORDER BY cost, threshold) AS ot, any_value(baseline_cost) AS b FROM l GROUP BY 1)
SELECT anomaly_type, round(aucc, 4) AS aucc, minimum_cost, round(ot, 6) AS optimal_threshold, b AS baseline_cost, b - minimum_cost AS cost_reduction,
  round(CASE WHEN b <> 0 THEN 100*(b - minimum_cost)/abs(b) ELSE 0 END, 6) AS cost_reduction_percent FROM a""", "pred curve")
def _(spark, d):
    df = ev.area_under_cost_curve(ev.cost_curve(predictions(spark, d)))
    return rounded(rounded(df, "aucc"), "optimal_threshold", "cost_reduction_percent", digits=6)


@query("V6_area_over_cost_ratios", f"""
, c AS (SELECT anomaly_type, i, count(*) FILTER (truth=0 AND probability > i/10) AS fp, count(*) FILTER (truth=1 AND probability <= i/10) AS fn, count(*) AS n
  FROM pred, (SELECT unnest(range(1, 10)) AS i) GROUP BY 1, 2),
r AS (SELECT j, 0.01*pow(pow(10000.0, 1/99.0), j) AS ratio FROM (SELECT unnest(range(100)) AS j)),
t AS (SELECT ratio, i, 1 - sum(fp*{case(C.ACCURACY_COSTS, 0)}*ratio + fn*{case(C.ACCURACY_COSTS, 1)})/sum(n*greatest({case(C.ACCURACY_COSTS, 0)}*ratio, {case(C.ACCURACY_COSTS, 1)})) AS acc FROM c, r GROUP BY 1, 2),
b AS (SELECT ratio, max(acc) AS acc, first(i/10 ORDER BY acc DESC, i) AS th FROM t GROUP BY 1),
l AS (SELECT *, lead(ratio) OVER (ORDER BY ratio) AS r2, lead(acc) OVER (ORDER BY ratio) AS a2 FROM b)
SELECT round(sum((r2-ratio)*(a2+acc)/2), 5) AS aucc, round(max(acc), 6) AS best_accuracy, round(first(ratio ORDER BY acc DESC, ratio), 5) AS optimal_cost_ratio,
  first(th ORDER BY acc DESC, ratio) AS optimal_threshold FROM l""", "pred")
def _(spark, d):
    df = ev.area_over_cost_ratios(predictions(spark, d))
    return rounded(rounded(df, "aucc", "optimal_cost_ratio", digits=5), "best_accuracy", digits=6)


@query("V7_C13_compare_rules", """
SELECT anomaly_type, tp, fp, fn, tn, round(prec, 6) AS "precision", round(rec, 6) AS recall, round(CASE WHEN prec+rec > 0 THEN 2*prec*rec/(prec+rec) ELSE 0 END, 6) AS f1,
  tp+fn AS support, tp+fp+fn+tn AS samples, round((tp+tn)/(tp+fp+fn+tn), 6) AS accuracy FROM conf""", "pred conf")
def _(spark, d):
    rows = predictions(spark, d)
    df = ev.compare_rules(rows.drop("probability"), rows.drop("truth"), ["event_id"])
    return rounded(df, "precision", "recall", "f1", "accuracy", digits=6)


def two_models(spark, d):
    rows = predictions(spark, d).withColumn("a", (F.col("probability") >= 0.5).cast("int"))
    return rows.withColumn("b", (F.col("probability") >= 0.45).cast("int")).withColumn("other", F.col("event_id") % 1000 / 1000.0)


@query("V8_mcnemar", """
, m AS (SELECT anomaly_type, (probability >= 0.5)::INT = truth AS a, (probability >= 0.45)::INT = truth AS b FROM pred),
c AS (SELECT anomaly_type, count(*) FILTER (a AND b) AS both_right, count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (NOT a AND b) AS only_second,
  count(*) FILTER (NOT a AND NOT b) AS both_wrong FROM m GROUP BY 1)
SELECT *, round(CASE WHEN only_first + only_second >= 25 THEN pow(abs(only_first-only_second)-1, 2)/(only_first+only_second) END, 6) AS statistic FROM c""", "pred")
def _(spark, d):
    return rounded(ev.mcnemar(two_models(spark, d), "a", "b"), "statistic", digits=6).drop("p_value", "significant")


@query("V8_mcnemar_pvalue", """
, m AS (SELECT anomaly_type, (probability >= 0.5)::INT = truth AS a, (probability >= 0.45)::INT = truth AS b FROM pred),
c AS (SELECT anomaly_type, count(*) FILTER (a AND NOT b) AS x, count(*) FILTER (NOT a AND b) AS y FROM m GROUP BY 1),
z AS (SELECT *, x + y AS n, CASE WHEN x + y >= 25 THEN sqrt(pow(abs(x - y) - 1, 2) / (x + y) / 2) END AS z FROM c),
p AS (SELECT *, CASE WHEN n < 25 THEN least(1, 2 * list_sum(list_transform(range(0, least(x, y) + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))))
  WHEN z = 0 THEN 1 WHEN z > 6 THEN 0
  ELSE 1 - exp(-z * z) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(z) - lgamma(k + 1.5)))) END AS p FROM z)
SELECT anomaly_type, round(p, 6)::DOUBLE AS p_value, p < 0.05 AS significant FROM p""", "pred")
def _(spark, d):
    return rounded(ev.mcnemar(two_models(spark, d), "a", "b"), "p_value", digits=6).select("anomaly_type", "p_value", "significant")


@query("V9_paired_ttest", """
, g AS (SELECT anomaly_type, probability - (event_id % 1000)/1000.0::DOUBLE AS x FROM pred),
s AS (SELECT anomaly_type, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM g GROUP BY 1)
SELECT anomaly_type, n, round(m, 6) AS mean_difference, round(m/(s/sqrt(n)), 4) AS t_statistic, round(m/s, 6) AS cohens_d,
  round(m - 1.959964*s/sqrt(n), 6) AS ci_low, round(m + 1.959964*s/sqrt(n), 6) AS ci_high FROM s""", "pred")
def _(spark, d):
    df = ev.paired_ttest(two_models(spark, d), "probability", "other")
    df = rounded(rounded(df, "mean_difference", "cohens_d", "ci_low", "ci_high", digits=6), "t_statistic")
    return df.drop("p_value", "significant")


DRAW = draw_sql("event_id || '|' || anomaly_type")
BERNOULLI = f"SELECT event_id, anomaly_type, CASE WHEN {DRAW}/281474976710656.0 < 0.05 THEN 1 - truth ELSE truth END AS truth, probability FROM pred"


@query("V10_inject_noise_bernoulli", BERNOULLI.replace(", probability FROM", " FROM"), "pred")
def _(spark, d):
    return nz.inject_noise(predictions(spark, d), 0.05, ["event_id"]).drop("probability")


@query("V10_inject_noise_exact", f"""
SELECT event_id, anomaly_type, CASE WHEN row_number() OVER (ORDER BY {DRAW}, event_id, anomaly_type) <= floor(count(*) OVER () * 0.05) THEN 1 - truth ELSE truth END AS truth FROM pred""", "pred")
def _(spark, d):
    return nz.inject_noise(predictions(spark, d), 0.05, ["event_id"], "exact").drop("probability")


RANKED = f"row_number() OVER (PARTITION BY anomaly_type, truth ORDER BY {draw_sql()}, event_id)"


@query("V10_inject_noise_drop_positives", f"""
SELECT event_id, anomaly_type, CASE WHEN truth = 1 AND {RANKED} <= floor(count(*) OVER (PARTITION BY anomaly_type, truth) * 0.1) THEN 0 ELSE truth END AS truth FROM pred""", "pred")
def _(spark, d):
    return nz.inject_noise(predictions(spark, d), 0.1, ["event_id"], "drop_positives").drop("probability")


@query("V11_inject_bias", f"""
, r AS (SELECT *, {RANKED} AS k, count(*) OVER (PARTITION BY anomaly_type, truth) AS n FROM pred)
SELECT event_id, anomaly_type, CASE WHEN anomaly_type = 'epcFake' AND truth = 0 AND k <= floor(n*0.02) THEN 1 WHEN anomaly_type = 'jump' AND truth = 1 AND k <= floor(n*0.3) THEN 0 ELSE truth END AS truth FROM r""", "pred")
def _(spark, d):
    return nz.inject_bias(predictions(spark, d), {"epcFake": 0.02, "jump": -0.3}, ["event_id"]).drop("probability")


@query("V12_inject_low_confidence_noise", f"""
SELECT event_id, anomaly_type, CASE WHEN abs(probability - 0.5) < 0.2 AND {DRAW}/281474976710656.0 < 0.1 THEN 1 - truth ELSE truth END AS truth FROM pred""", "pred")
def _(spark, d):
    return nz.inject_low_confidence_noise(predictions(spark, d), 0.1, ["event_id"]).drop("probability")


LOSSES = {"auc": 0.4, "f1": 0.3, "ap": 0.3}
SHARED["robust"] = f"""
noisy AS ({BERNOULLI}),
{metrics_sql('pred', '_a')}, {metrics_sql('noisy', '_b')},
rb AS (SELECT a.auc AS clean_auc, a.f1 AS clean_f1, a.ap AS clean_ap, b.auc AS noisy_auc, b.f1 AS noisy_f1, b.ap AS noisy_ap,
  (a.auc-b.auc)/a.auc AS loss_auc, (a.f1-b.f1)/a.f1 AS loss_f1, (a.ap-b.ap)/a.ap AS loss_ap FROM met_a a, met_b b WHERE a.anomaly_type='macro' AND b.anomaly_type='macro'),
robust AS (SELECT *, 0.4*greatest(0, 1-loss_auc) + 0.3*greatest(0, 1-loss_f1) + 0.3*greatest(0, 1-loss_ap) AS robustness_score,
  {' + '.join(f'CASE WHEN loss_{m} > 0.05 THEN loss_{m}*{w} ELSE 0 END' for m, w in LOSSES.items())} AS impact_score FROM rb)"""


@query("V13_robustness", f"""
SELECT {', '.join(f'round({s}_{m}, 6) AS {s}_{m}' for s in ('clean', 'noisy', 'loss') for m in LOSSES)}, round(robustness_score, 6) AS robustness_score,
  round(impact_score, 6) AS impact_score, CASE WHEN impact_score > 0.2 THEN 'high' WHEN impact_score > 0.1 THEN 'medium' ELSE 'low' END AS severity,
  round(impact_score*15, 5) AS cost_increase_percent, round(impact_score*10, 5) AS detection_loss_percent FROM robust""", "pred robust")
def _(spark, d):
    rows = predictions(spark, d)
    df = ev.robustness(rows, nz.inject_noise(rows, 0.05, ["event_id"]))
    names = [f"{s}_{m}" for s in ("clean", "noisy", "loss") for m in LOSSES] + ["robustness_score", "impact_score"]
    return rounded(rounded(df, *names, digits=6), "cost_increase_percent", "detection_loss_percent", digits=5)


@query("V13_robustness_grade", """
SELECT round(robustness_score, 6) AS mean_score, round(robustness_score, 6) AS min_score, 0::DOUBLE AS std_score, CAST(impact_score > 0.2 AS BIGINT) AS critical_failures,
  CASE WHEN robustness_score >= 0.9 THEN 'A' WHEN robustness_score >= 0.8 THEN 'B' WHEN robustness_score >= 0.7 THEN 'C' WHEN robustness_score >= 0.6 THEN 'D' ELSE 'F' END AS grade,
  robustness_score >= 0.8 AND impact_score <= 0.2 AS production_ready FROM robust""", "pred robust")
def _(spark, d):
    rows = predictions(spark, d)
    df = ev.robustness_grade(ev.robustness(rows, nz.inject_noise(rows, 0.05, ["event_id"])))
    return rounded(df, "mean_score", "min_score", digits=6)


@query("V15_discrepancy", f"""
, smp AS (SELECT * FROM pred WHERE {draw_sql()} % 10 = 0), {metrics_sql('pred', '_a')}, {metrics_sql('smp', '_b')},
u AS (SELECT anomaly_type, 'auc' AS metric, auc AS v FROM met_a UNION ALL SELECT anomaly_type, 'f1', f1 FROM met_a),
s AS (SELECT anomaly_type, 'auc' AS metric, auc AS v FROM met_b UNION ALL SELECT anomaly_type, 'f1', f1 FROM met_b)
SELECT anomaly_type, metric, round(s.v, 6) AS sample_value, round(u.v, 6) AS full_value, round(abs(s.v-u.v)/abs(u.v), 6) AS relative_difference, abs(s.v-u.v)/abs(u.v) > 0.05 AS discrepant
FROM u JOIN s USING (anomaly_type, metric)""", "pred")
def _(spark, d):
    from scanwarden.operators.sampling import draw

    rows = predictions(spark, d)
    sample = rows.where(draw(["event_id"], 42) % 10 == 0)
    df = ev.discrepancy(ev.metrics(sample), ev.metrics(rows), ["auc", "f1"])
    return rounded(df, "sample_value", "full_value", "relative_difference", digits=6)

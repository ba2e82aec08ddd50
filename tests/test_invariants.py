import math

import pytest
from pyspark.sql import functions as F

from scanwarden.functions import tests_of_significance as sig
from scanwarden.operators import detect_epc, detect_events, drift, encode, evaluate, features, multilabel, oneclass, sampling
from scanwarden.sources.table_scans import as_of, scans
from tests.rows import as_of as today


def test_rollup_is_sum_and_parts_cover_input(spark, sf):
    df = scans(spark, sf)
    found = detect_events.detect_events(df, as_of(), hot=None).persist()
    per_item = detect_events.epc_stats(found).groupBy("file_id").agg(F.sum("totalEvents").alias("t"))
    assert {r["file_id"]: r["t"] for r in per_item.collect()} == {
        r["file_id"]: r["totalEvents"] for r in detect_events.file_stats(found).collect()}
    rest = df.join(found, ["file_id", "epc_code", "event_id"], "left_anti").count()
    assert rest + found.count() == df.count()


def test_scores_stay_in_range(spark, sf):
    scores = detect_epc.detect_epc(detect_epc.normalize_scans(scans(spark, sf)), as_of(), only_findings=False, hot=None)
    row = scores.agg(*[F.min(t).alias(f"lo_{t}") for t in ("epcFake", "epcDup", "jump", "evtOrderErr", "locErr")],
                     *[F.max(t).alias(f"hi_{t}") for t in ("epcFake", "epcDup", "jump", "evtOrderErr", "locErr")]).first()
    assert all(v >= 0 for k, v in row.asDict().items() if k.startswith("lo"))
    assert all(v <= 100 for k, v in row.asDict().items() if k.startswith("hi"))


def chains(spark, items=40):
    """Clean journeys of five steps."""
    steps = [("Factory", "Aggregation", "factory_1"), ("WMS", "WMS_Inbound", "logistics_5"), ("Wholesaler", "W_Stock_Inbound", "wholesale_23"),
             ("Retailer", "R_Stock_Inbound", "store_53")]
    rows = []
    for i in range(items):
        for j, (step, kind, place) in enumerate(steps):
            rows.append((0, f"001.8804823.0000001.000001.20250101.{i:09d}", i * 10 + j, 1_740_000_000 + i * 3600 + j * 18000, step, kind, place))
    df = spark.createDataFrame(rows, "file_id int, epc_code string, event_id long, s long, business_step string, event_type string, scan_location string")
    return df.withColumn("event_time", F.timestamp_seconds("s")).drop("s")


def test_clean_chains_have_no_findings(spark):
    assert detect_events.detect_events(chains(spark), today(), hot=None).isEmpty()


@pytest.mark.parametrize("kind", ["epcFake", "epcDup", "locErr", "evtOrderErr"])
def test_injected_findings_are_found(spark, kind):
    df = chains(spark)
    hit = F.floor(F.col("event_id") / 10) % 8 == 0
    second, third = F.col("event_id") % 10 == 1, F.col("event_id") % 10 == 2
    if kind == "epcFake":
        df = df.withColumn("epc_code", F.when(hit, F.concat(F.lit("BAD"), "epc_code")).otherwise(F.col("epc_code")))
    elif kind == "epcDup":
        df = df.withColumn("event_time", F.when(hit & third, F.col("event_time") - F.expr("INTERVAL 5 HOURS")).otherwise(F.col("event_time")))
    elif kind == "locErr":
        df = df.withColumn("business_step", F.when(hit & third, "Factory").otherwise(F.col("business_step")))
    else:
        df = df.withColumn("event_type", F.when(hit & (second | third), "Inbound").otherwise(F.col("event_type")))
        df = df.withColumn("business_step", F.when(hit & third, "WMS").otherwise(F.col("business_step")))
    found = detect_events.detect_events(df, today(), hot=None).where(kind).select("epc_code").distinct().count()
    assert found == 5


def test_feature_arity(spark, sf):
    df = scans(spark, sf)
    norm = detect_epc.normalize_scans(df)
    tables = {
        features.FAKE: features.fake_features(df, as_of()), features.DUP: features.dup_features(df, hot=None),
        features.ORDER: features.order_features(df, hot=None), features.LOCATION: features.location_features(norm, hot=None),
        features.JUMP: features.jump_features(df, hot=None)}
    for names, table in tables.items():
        assert set(names) <= set(table.columns)
        assert all(dict(table.dtypes)[n] == "double" for n in names)
        assert table.where(F.greatest(*[F.col(n).isNull().cast("int") for n in names]) == 1).isEmpty()


def test_single_event_features(spark):
    df = chains(spark, 1).limit(1)
    row = features.jump_features(df, hot=None).first()
    assert [row[n] for n in features.JUMP] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    row = features.jump_features_per_event(df, hot=None).first()
    assert [row[n] for n in features.JUMP_EVENT] == [0, 0, 0.5, 1, 0, 0, 1, 1]


def test_p_values():
    assert sig.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert sig.t_two_sided(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)
    assert sig.chi2_one(3.841459) == pytest.approx(0.05, abs=1e-6)
    assert sig.binomial_two_sided(2, 10) == pytest.approx(0.109375)
    assert sig.ks_asymptotic(1.358 / math.sqrt(50), 100, 100) == pytest.approx(0.05, abs=1e-3)


def test_permutation_and_bootstrap_see_a_shift(spark):
    base = spark.range(400).select("id", F.lit("f").alias("feature"), (F.col("id") * 37 % 101 / 10.0).alias("value"), (F.col("id") % 2).cast("int").alias("side"))
    moved = base.withColumn("value", F.col("value") + 3 * F.col("side"))
    for test in (drift.permutation_test, drift.bootstrap_emd_test):
        assert test(moved, ["id"], n=20).first()["p_value"] < 0.06
        assert test(base, ["id"], n=20).first()["p_value"] > 0.05


def test_one_class_learns_the_usual(spark):
    df = spark.range(400).select(
        "id", (F.col("id") * 37 % 101 / 101.0).alias("a"), (F.col("id") * 53 % 97 / 97.0).alias("b"), F.lit(0).alias("label"))
    odd = spark.range(20).select((F.col("id") + 1000).alias("id"), F.lit(9.0).alias("a"), F.lit(-9.0).alias("b"), F.lit(1).alias("label"))
    both = df.unionByName(odd)
    model = oneclass.fit_one_class(both, ["a", "b"], "jump", steps=8)
    again = oneclass.fit_one_class(both, ["a", "b"], "jump", steps=8)
    assert model.first()["weights"] == pytest.approx(again.first()["weights"])
    scored = oneclass.score_one_class(both, model.first()).groupBy("label").agg(
        F.avg(F.col("outlier").cast("double")).alias("share"), F.avg("score").alias("score"))
    rows = {r["label"]: r for r in scored.collect()}
    assert rows[0]["share"] == pytest.approx(0.1, abs=0.02) and rows[1]["share"] == 1.0
    assert rows[1]["score"] > rows[0]["score"]
    assert oneclass.fit_one_class(df.limit(5), ["a", "b"], "jump") is None


def test_models_round_trip(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 7 / 7.0).alias("a"), (F.col("id") % 5 / 5.0).alias("b"), F.lit(0).alias("label"))
    model = oneclass.fit_one_class(df, ["a", "b"], "jump", steps=2)
    oneclass.save_models(model, str(tmp_path / "m"))
    loaded = oneclass.load_models(spark, str(tmp_path / "m")).first()
    assert loaded["weights"] == model.first()["weights"]


def test_similarity_in_blocks_matches_brute_force(spark):
    rows = [(i, [math.sin(i * k + 1) for k in range(1, 6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, embedding array<double>")
    got = multilabel.similar_top_k(df, df.repartition(7), "i", "i", k=4, threshold=0.2, block_rows=16)
    got = {(r["i"], r["i_similar"]) for r in got.collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.dist(a, [0] * 5) / math.dist(b, [0] * 5)

    want = set()
    for i, v in rows:
        near = sorted(((-round(cos(v, w), 12), j) for j, w in rows if cos(v, w) > 0.2))[:4]
        want |= {(i, j) for _, j in near}
    assert len(got ^ want) <= 2 and len(got) == len(want)


def test_knn_matches_brute_force(spark):
    rows = [(i, (i * 7) % 23, float((i * 5) % 11) if i % 4 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, by int, target double")
    got = {r["id"]: r["target"] for r in encode.impute_knn(df, "target", "by", 5).collect()}
    groups = {}
    for _, b, t in rows:
        if t is not None:
            groups.setdefault(b, []).append(t)
    for i, b, t in rows:
        if t is None:
            left, total = 5, 0.0
            for _, at in sorted((abs(g - b), g) for g in groups):
                n = min(left, len(groups[at]))
                total, left = total + n * sum(groups[at]) / len(groups[at]), left - n
            assert got[i] == pytest.approx(total / 5)
        else:
            assert got[i] == t


def test_splits_share_no_item(spark, sf):
    for variant in ("near", "span"):
        split = sampling.epc_temporal_split(scans(spark, sf), variant=variant)
        if variant == "near":
            assert sampling.split_overlap(split).isEmpty()
    train = sampling.file_split(scans(spark, sf)).groupBy("source_file").agg(F.count_distinct("split").alias("n"))
    assert train.agg(F.max("n")).first()[0] == 1


def test_similarity_of_equal_vectors_keeps_k(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, 2.0]) for i in range(90)]
    df = spark.createDataFrame(rows, "i int, embedding array<double>")
    got = multilabel.similar_top_k(df, df, "i", "i", k=2, threshold=0.5, block_rows=20)
    want = {(i, j, r) for i, v in rows for r, j in enumerate([j for j, w in rows if w == v][:2], 1)}
    assert {(r["i"], r["i_similar"], r["rank"]) for r in got.collect()} == want
    far = multilabel.similar_top_k(df, df, "i", "i", k=90, threshold=-1.0, metric="euclidean").where("i = 0")
    assert {r["i_similar"] for r in far.collect()} == set(range(0, 90, 3))
    assert multilabel.similar_top_k(df.where("false"), df, "i", "i").count() == 0


def test_smote_balances(spark):
    df = spark.range(600).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"), (F.col("id") % 17 / 17.0).alias("a"), (F.col("id") % 13 / 13.0).alias("b"))
    out, how = multilabel.smote_or_weight(df, ["a", "b"], "id")
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert how == "smote" and counts == {0: 540, 1: 540}
    weighted, how = multilabel.smote_or_weight(df.limit(100), ["a", "b"], "id")
    assert how == "weights" and weighted.columns == out.columns


def test_noise_lowers_quality(spark):
    from scanwarden.operators import noise

    rows = spark.range(2000).select("id", F.lit("jump").alias("anomaly_type"), (F.col("id") % 5 == 0).cast("int").alias("truth"))
    rows = rows.withColumn("probability", F.when(F.col("truth") == 1, 0.9).otherwise(0.1))
    result = evaluate.robustness(rows, noise.inject_noise(rows, 0.1, ["id"])).first()
    assert result["clean_auc"] == 1.0 and result["noisy_auc"] < 0.95 and result["robustness_score"] < 1
    flips = noise.inject_noise(rows, 0.1, ["id"], "exact").join(rows.select("id", F.col("truth").alias("t")), "id").where("truth <> t").count()
    assert flips == 200


def test_every_query_with_sql_names_unique():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


"""Types fitted together are the models of types fitted alone."""

import numpy as np
import pytest

from scanwarden.operators import oneclass as oc
from scanwarden.operators.oneclass_types import fit_types


def table(spark, n, names, seed):
    rng = np.random.default_rng(seed)
    rows = [(*[float(v) for v in rng.normal(size=len(names))], int(i % 9 == 0)) for i in range(n)]
    rows += [(*[0.0] * len(names), 0), (*[None] * len(names), 0)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", label int")


def test_fitted_together_as_alone(spark):
    tables = {"jump": (table(spark, 300, "abc", 1).repartition(5), "abc"), "locErr": (table(spark, 200, "de", 2), "de"),
              "epcDup": (table(spark, 8, "fg", 3), "fg")}
    got = {m["anomaly_type"]: m for m in fit_types(tables, steps=4).collect()}
    assert set(got) == {"jump", "locErr"}  # the third has too few rows
    for kind, m in got.items():
        alone = oc.fit_one_class(*tables[kind], kind, steps=4).first()
        for field in ("center", "spread", "directions", "phases", "weights", "offset", "grid", "accuracy"):
            assert np.allclose(m[field], alone[field], atol=1e-9), (kind, field)
        assert m["rows"] == alone["rows"] and m["features"] == alone["features"]


def test_no_rows(spark):
    empty = table(spark, 20, "ab", 1).where("label > 5")
    assert fit_types({"jump": (empty, "ab")}).count() == 0


def test_unlabelled_rows_are_not_learnt_from(spark):
    df = table(spark, 40, "ab", 1)
    extra = spark.createDataFrame([(9.0, 9.0, None)], "a double, b double, label int")
    with_, without = (fit_types({"jump": (t, "ab")}, steps=2).first() for t in (df.union(extra), df))
    assert with_["rows"] == without["rows"] and with_["weights"] == pytest.approx(without["weights"])

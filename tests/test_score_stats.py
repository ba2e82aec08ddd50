"""Score statistics read the scores once."""

import numpy as np
import pytest

from scanwarden.operators import profile


def test_score_stats_read_their_rows_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"d{i % 2}", "jump", int(v)) for i, v in enumerate(rng.integers(0, 20, 500))] + [("d0", "jump", None), ("d2", "jump", 7)]
    read = []
    once = profile.written
    monkeypatch.setattr(profile, "written", lambda df: read.append(df.count()) or once(df))
    got = {r["dataset"]: r for r in profile.score_stats(spark.createDataFrame(rows, "dataset string, anomaly_type string, score int")).collect()}
    assert len(read) == 1 and read[0] <= 42
    for name in ("d0", "d1", "d2"):
        v = np.array([s for d, _, s in rows if d == name and s is not None], float)
        r = got[name]
        want = [len(v), v.mean(), v.std(), v.min(), v.max(), (v > 0).sum(), np.quantile(v, 0.5), np.quantile(v, 0.99), (v > 0).mean()]
        names = ("samples", "mean", "std", "min", "max", "non_zero_count", "p50", "p99", "non_zero_rate")
        assert [r[c] for c in names] == pytest.approx(want)

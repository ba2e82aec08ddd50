"""Sliding drift by sketches against exact distances."""

import datetime

import numpy as np
import pytest

from scanwarden.streaming import sketches

DAY = 86_400


def emd(a, b):
    values = np.unique(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(s), values, "right") / len(s) for s in (a, b))
    return float((np.abs(fa - fb)[:-1] * np.diff(values)).sum())


@pytest.fixture(scope="module")
def table(spark):
    """Twelve days of values that move on day 8; no events on day 5; nulls."""
    rng = np.random.default_rng(6)
    days = {d: rng.normal(0 if d < 8 else 1.5, 1, 3000) for d in range(12) if d != 5}
    start = datetime.datetime(2024, 3, 1)
    rows = [(start + datetime.timedelta(days=d, seconds=i * 20), float(v), None if i % 2 else 1.0) for d, x in days.items() for i, v in enumerate(x)]
    return days, spark.createDataFrame(rows, "event_time timestamp, a double, b double")


def test_windows(table):
    days, df = table
    found = sketches.sliding_drift(sketches.bucket_sketches(df, ["a", "b"], "1 day"), DAY, reference=4, test=2, threshold=0.5)
    got = {r.start.day - 1: r for r in found.where("feature = 'a'").collect()}
    assert set(got) == {2, 3, 4, 6, 7, 8, 9, 10, 11}
    for d, r in got.items():
        old = np.concatenate([days[k] for k in range(d - 5, d - 1) if k in days])
        new = np.concatenate([days[k] for k in (d - 1, d) if k in days])
        assert (r.n_reference, r.n_test) == (len(old), len(new)) and abs(r.emd - emd(old, new)) <= r.bound
        assert r.drifted == (d in (8, 9, 10, 11))
    assert all(r.emd == 0 and not r.drifted for r in found.where("feature = 'b'").collect())


def test_sketches_of_parts_merge(table):
    """Spans that come out in several runs give what one run gives, within the bound."""
    _, df = table
    parts = [sketches.bucket_sketches(df.where(f"day(event_time) % 2 = {i}"), ["a"], "1 day") for i in (0, 1)]
    once = {r.start: r for r in sketches.sliding_drift(sketches.bucket_sketches(df, ["a"], "1 day"), DAY, 4, 2).collect()}
    twice = {r.start: r for r in sketches.sliding_drift(parts[0].union(parts[1]), DAY, 4, 2).collect()}
    assert set(once) == set(twice) and all(abs(once[k].emd - twice[k].emd) <= once[k].bound for k in once)


def test_nothing(table):
    _, df = table
    assert sketches.sliding_drift(sketches.bucket_sketches(df.limit(0), ["a"], "1 day"), DAY).count() == 0

"""The model queries call the operators with their default steps, all features and all five types."""

import pytest

from checks import base, models
from scanwarden import constants as C
from scanwarden.operators import features as fe


@pytest.mark.parametrize("name", ["M1_fit_one_class", "M2_score_one_class", "M3_detect_one_class"])
def test_one_class_queries_fit_the_whole_model(spark, sf, monkeypatch, name):
    calls, fit = [], models.oc.fit_one_class

    def kept(df, features, kind, **options):
        calls.append((kind, tuple(features), options))
        return fit(df, features, kind, steps=0)
    monkeypatch.setattr(models.oc, "fit_one_class", kept)
    assert base.QUERIES[name](spark, sf).columns
    assert all(not options for *_, options in calls)
    assert {k for k, *_ in calls} == (set(C.STATS_TYPES) if name.startswith("M3") else {"epcFake"})
    assert [f for k, f, _ in calls if k == "epcFake"] == [tuple(fe.FAKE)]


def test_multilabel_and_smote_queries(spark, sf, monkeypatch):
    calls = []

    def kept(*args, **options):
        calls.append((args, options))
        raise InterruptedError
    monkeypatch.setattr(models.ml, "fit_multilabel", kept)
    monkeypatch.setattr(models.ml, "smote_or_weight", kept)
    for name in ("M6_M7_score_multilabel", "P12_smote_or_weight"):
        with pytest.raises(InterruptedError):
            base.QUERIES[name](spark, sf)
    assert calls[0][1] == {} and tuple(calls[1][0][1]) == tuple(fe.FAKE)

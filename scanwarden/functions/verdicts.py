"""Scores and probabilities turned into levels and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanwarden import constants as C


def severity(score: Column) -> Column:
    out = None
    for name, cut in C.SEVERITY_CUTS:
        out = F.when(score >= cut, name) if out is None else out.when(score >= cut, name)
    return out.otherwise("NORMAL")


def alert_level(probabilities: dict[str, Column]) -> Column:
    """Highest level that any type reaches; null when none does."""
    out = None
    for name, cuts in C.ALERT_CUTS.items():
        hit = reduce(lambda a, b: a | b, (F.coalesce(p, F.lit(0.0)) >= cuts[t] for t, p in probabilities.items()))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def risk_level(confidence: Column, variant: str = "three") -> Column:
    out = None
    for cut, name in C.RISK_CUTS[variant]:
        if cut is None:
            return out.otherwise(name)
        out = F.when(confidence >= cut, name) if out is None else out.when(confidence >= cut, name)
    return out


def drop_future(df, as_of: Column):
    return df.where(F.col("event_time") <= as_of)


def future_flag(event_time: Column, as_of: Column) -> Column:
    return (event_time > as_of).cast("int")


def type_name(primary: Column) -> Column:
    out = None
    for code, name in C.TYPE_NAMES.items():
        out = F.when(primary == code, name) if out is None else out.when(primary == code, name)
    return out


def finding_description(primary: Column, place: Column, step: Column) -> Column:
    """Sentence shown with a finding."""
    out = None
    for code, sentence in C.TYPE_SENTENCES.items():
        for hole, value in (("{place}", place), ("{step}", F.coalesce(step, F.lit("단계")))):
            if hole in sentence:
                text = F.concat(F.coalesce(value, F.lit("")), F.lit(sentence.replace(hole, "")))
                break
        else:
            text = F.lit(sentence)
        out = F.when(primary == code, text) if out is None else out.when(primary == code, text)
    return out


def recommendations(kind: Column, risk: Column, factors: Column) -> Column:
    """Ordered distinct advice. ``factors`` is an array of factor names, most important first."""
    investigate = None
    for code, text in C.TYPE_PHRASES.items():
        phrase = F.lit(f"Investigate {text.lower()}")
        investigate = F.when(kind == code, phrase) if investigate is None else investigate.when(kind == code, phrase)

    def for_factor(n: int) -> Column:
        name = F.lower(F.get(factors, F.lit(n)))
        out = None
        for words, advice in C.FACTOR_ADVICE:
            hit = reduce(lambda a, b: a & b, (name.contains(w) for w in words))
            out = F.when(hit, advice) if out is None else out.when(hit, advice)
        return out

    by_type = None
    for code, advice in C.TYPE_ADVICE.items():
        by_type = F.when(kind == code, advice) if by_type is None else by_type.when(kind == code, advice)
    urgent = F.when(F.upper(risk).isin("HIGH", "MEDIUM"), investigate)
    return F.array_distinct(F.array_compact(F.array(urgent, for_factor(0), for_factor(1), by_type)))


def nu_for_ratio(ratio: Column) -> Column:
    """Outlier share expected by a one-class model."""
    return F.when(ratio > 0, F.least(ratio * 0.8, F.lit(0.1))).otherwise(0.01)

"""p-values for a handful of aggregated rows (never for data rows)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if df <= 0 or math.isnan(t):
        return 1.0
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def chi2_one(x: float) -> float:
    return math.erfc(math.sqrt(x / 2))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided test of one half."""
    if n == 0:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2.0**n
    return min(1.0, 2 * tail)


def ks_asymptotic(d: float, n: float, m: float) -> float:
    """Kolmogorov distribution with the effective sample size."""
    if n <= 0 or m <= 0:
        return 1.0
    x = d * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def _row_by_row(fn):
    def apply(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*columns)], dtype="float64")

    return apply


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _row_by_row(t_two_sided)(t, df)


@F.pandas_udf(T.DoubleType())
def ks_pvalue(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return _row_by_row(ks_asymptotic)(d, n, m)


@F.pandas_udf(T.DoubleType())
def mcnemar_pvalue(b: pd.Series, c: pd.Series) -> pd.Series:
    def one(x, y):
        x, y = int(x), int(y)
        if x + y < 25:
            return binomial_two_sided(min(x, y), x + y)
        return chi2_one((abs(x - y) - 1) ** 2 / (x + y))

    return _row_by_row(one)(b, c)

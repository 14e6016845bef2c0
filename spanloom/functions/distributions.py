"""Tail probabilities of the distributions that tests need, as Arrow-batched functions over result rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d, value = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        value *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    return front * (value - 1)


def t_tail(t: float, df: float) -> float:
    """The two-sided probability of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(x: float, d1: float, d2: float) -> float:
    """The probability that F is above ``x``."""
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def _solve(goal, low: float, high: float) -> float:
    """Where a falling function crosses zero."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if goal(mid) > 0 else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    """The ``t`` beyond which ``2 (1 - p)`` lies on both sides."""
    return _solve(lambda t: t_tail(t, df) - 2 * (1 - p), 0.0, 1e6)


def f_quantile(p: float, d1: float, d2: float) -> float:
    """The ``x`` that F is below with probability ``p``."""
    return _solve(lambda x: f_upper(x, d1, d2) - (1 - p), 0.0, 1e7)


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else f(*map(float, row)) for row in zip(*columns, strict=True)], dtype="float64")


def t_p(t: Column, df: Column) -> Column:
    """Two-sided p-values of t statistics; null for null, and for less than one degree of freedom."""

    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return _each(lambda t, df: t_tail(t, df) if df >= 1 else None, t, df)

    return run(t.cast("double"), df.cast("double"))


def t_interval(p: float, df: Column) -> Column:
    """The t quantile of a two-sided interval of probability ``p``."""

    @F.pandas_udf("double")
    def run(df: pd.Series) -> pd.Series:
        return _each(lambda df: t_quantile((1 + p) / 2, df) if df >= 1 else None, df)

    return run(df.cast("double"))


def f_interval(p: float, d1: Column, d2: Column) -> Column:
    """The F quantile at probability ``p``."""

    @F.pandas_udf("double")
    def run(d1: pd.Series, d2: pd.Series) -> pd.Series:
        return _each(lambda a, b: f_quantile(p, a, b) if a >= 1 and b >= 1 else None, d1, d2)

    return run(d1.cast("double"), d2.cast("double"))


def normal_p(z: Column) -> Column:
    """Two-sided p-values of standard normal statistics."""

    @F.pandas_udf("double")
    def run(z: pd.Series) -> pd.Series:
        return _each(lambda z: math.erfc(abs(z) / math.sqrt(2)), z)

    return run(z.cast("double"))

"""Tail probabilities for already aggregated test statistics (one row per group).

Spark SQL has no incomplete beta or gamma function, so these are Arrow-batched
pandas UDFs over the small statistic table, never over raw rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def _terms(size: float) -> range:
    """Term numbers of a continued fraction, which needs about sqrt(size) of them."""
    return range(1, 1000 + int(100 * math.sqrt(size)))


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), _TINY)
    total = d
    for m in _terms(max(a, b)):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / (1.0 + term * d or _TINY)
            c = 1.0 + term / c or _TINY
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return front * total / a
    raise ArithmeticError(f"incomplete beta did not converge for a={a}, b={b}, x={x}")


def _gamma_tail(s: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(s, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        n = s
        while abs(term) > 1e-16 * abs(total):
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - scale * total
    b = x + 1.0 - s
    c, d = 1.0 / _TINY, 1.0 / b
    value = d
    for i in _terms(s):
        a = -i * (i - s)
        b += 2.0
        d = 1.0 / (a * d + b or _TINY)
        c = b + a / c or _TINY
        value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return scale * value
    raise ArithmeticError(f"incomplete gamma did not converge for s={s}, x={x}")


def _apply(fn, *series: pd.Series) -> pd.Series:
    values = (
        np.nan if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*series, strict=True)
    )
    return pd.Series(list(values), dtype="float64")


@F.pandas_udf(DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(lambda v, k: _beta_tail(k / 2.0, 0.5, k / (k + v * v)), t, df)


@F.pandas_udf(DoubleType())
def _chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(lambda v, k: _gamma_tail(k / 2.0, v / 2.0), x, df)


@F.pandas_udf(DoubleType())
def _normal_upper(z: pd.Series) -> pd.Series:
    return _apply(lambda v: 0.5 * math.erfc(v / math.sqrt(2.0)), z)


def t_two_sided(t: Column, df: Column) -> Column:
    return F.nanvl(_t_two_sided(t, df.cast("double")), F.lit(None).cast("double"))


def chi2_upper(x: Column, df: Column) -> Column:
    return F.nanvl(_chi2_upper(x, df.cast("double")), F.lit(None).cast("double"))


def normal_upper(z: Column) -> Column:
    return F.nanvl(_normal_upper(z), F.lit(None).cast("double"))


def signed_rank_counts(n: Column) -> Column:
    """Coefficients of prod_{r=1..n}(1 + x^r): sign patterns per value of the rank sum.

    Entry w (0-based) is the number of sign patterns with positive-rank sum w.
    """
    start = F.transform(F.sequence(F.lit(0), (n * (n + 1) / 2).cast("int")), lambda w: F.when(w == 0, 1.0).otherwise(0.0))

    def fold(acc: Column, r: Column) -> Column:
        return F.transform(
            acc, lambda value, w: value + F.when(w >= r, F.get(acc, (w - r).cast("int"))).otherwise(0.0)
        )

    return F.aggregate(F.sequence(F.lit(1), n), start, fold)

"""Distribution functions for the A/B operators.

scipy is not available, so the Student-t tail and quantile are computed from
the regularised incomplete beta function (continued fraction) and bisection; the normal quantile comes from ``statistics``.
These run on one row per test (a pandas UDF over a handful of rows), after
Spark has aggregated the moments.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_coefficients(a: float, b: float, x: float):
    """Partial numerators of the continued fraction of the incomplete beta
    function: 1 / (1 + d1 / (1 + d2 / (1 + ...)))."""
    k = 0
    while True:
        yield -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        k += 1
        yield k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))


def _continued_fraction(numerators, terms: int = 800, tol: float = 1e-15) -> float:
    """1 / (1 + n1 / (1 + n2 / ...)) from the ratio of successive convergents
    of numerators P and denominators Q, rescaled as they grow."""
    p0, p1, q0, q1, value = 0.0, 1.0, 1.0, 1.0, 1.0
    for _, n in zip(range(terms), numerators):
        p0, p1 = p1, p1 + n * p0
        q0, q1 = q1, q1 + n * q0
        if q1 != 0.0:
            p0, p1, q0, q1 = p0 / q1, p1 / q1, q0 / q1, 1.0
            if abs(p1 - value) <= tol * abs(p1):
                return p1
            value = p1
    return value


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _continued_fraction(_beta_coefficients(a, b, x)) / a
    return 1.0 - front * _continued_fraction(_beta_coefficients(b, a, 1.0 - x)) / b


def t_two_sided_p(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or math.isnan(t) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * t_two_sided_p(t, df)
    return 1.0 - tail if t >= 0 else tail


def t_ppf(q: float, df: float) -> float:
    """Quantile of Student's t by bisection on the CDF."""
    if df is None or df <= 0 or not (0.0 < q < 1.0):
        return float("nan")
    if q == 0.5:
        return 0.0
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > q:
        lo *= 2.0
    while t_cdf(hi, df) < q:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_cdf(mid, df) < q:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-13 * max(1.0, abs(mid)):
            break
    return 0.5 * (lo + hi)


def norm_ppf(q: float) -> float:
    return NormalDist().inv_cdf(q)


@F.pandas_udf(T.DoubleType())
def t_pvalue_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(float(a), float(b)) if pd.notna(a) and pd.notna(b)
                      else None for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_quantile_udf(q: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_ppf(float(a), float(b)) if pd.notna(a) and pd.notna(b)
                      else None for a, b in zip(q, df)], dtype="float64")

"""Special functions: normal quantile as a Column, tail probabilities on result rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Acklam's rational approximation of the normal quantile.
QUANTILE_A = [
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
]
QUANTILE_B = [
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01,
]
QUANTILE_C = [
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
]
QUANTILE_D = [
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00,
]
QUANTILE_TAIL = 0.02425


def _horner(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution function, relative error about 1e-9."""

    def tail(q: Column) -> Column:
        return _horner(q, QUANTILE_C) / (_horner(q, QUANTILE_D) * q + F.lit(1.0))

    centre = p - F.lit(0.5)
    square = centre * centre
    middle = _horner(square, QUANTILE_A) * centre / (_horner(square, QUANTILE_B) * square + F.lit(1.0))
    return (
        F.when(p < QUANTILE_TAIL, tail(F.sqrt(F.lit(-2.0) * F.log(p))))
        .when(p > 1 - QUANTILE_TAIL, -tail(F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))))
        .otherwise(middle)
    )


def _chi2_tail(x: float, df: float) -> float:
    """Upper incomplete gamma ratio Q(df/2, x/2) by series or continued fraction."""
    a, z = df / 2.0, x / 2.0
    if not (x >= 0 and df > 0):
        return math.nan
    if z == 0:
        return 1.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + even * d) or tiny)
        c = (1 + even / c) or tiny
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + odd * d) or tiny)
        c = (1 + odd / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def _beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def _f_tail(f: float, d1: float, d2: float) -> float:
    if not (f >= 0 and d1 > 0 and d2 > 0):
        return math.nan
    return _beta_ratio(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


_NODES = np.linspace(-8.5, 8.5, 3401)
_DENSITY = np.exp(-0.5 * _NODES**2) / math.sqrt(2 * math.pi)
_erf = np.vectorize(math.erf, otypes=[float])


def _range_tail(q: float, k: float) -> float:
    """P(range of k standard normals > q): k * int pdf(z) [cdf(z) - cdf(z - q)]^(k-1) dz."""
    if not (q >= 0 and k >= 2):
        return math.nan
    above = 0.5 * (1 + _erf(_NODES / math.sqrt(2)))
    below = 0.5 * (1 + _erf((_NODES - q) / math.sqrt(2)))
    inner = k * _DENSITY * (above - below) ** (k - 1)
    return float(min(1.0, max(0.0, 1 - np.trapezoid(inner, _NODES))))


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """Chi-square upper tail; meant for result tables."""
    return pd.Series([_chi2_tail(float(a), float(b)) for a, b in zip(x, df)])


@F.pandas_udf(T.DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """F distribution upper tail; meant for result tables."""
    return pd.Series([_f_tail(float(a), float(b), float(c)) for a, b, c in zip(f, d1, d2)])


@F.pandas_udf(T.DoubleType())
def studentized_range_sf(q: pd.Series, k: pd.Series) -> pd.Series:
    """Studentised range upper tail with infinite degrees of freedom."""
    return pd.Series([_range_tail(float(a), float(b)) for a, b in zip(q, k)])

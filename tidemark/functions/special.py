"""Tail probabilities without SciPy: incomplete beta and gamma functions as vectorised pandas UDFs.

They run on aggregated rows (one for each test), never on the series themselves.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    fix = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    c, d = np.ones_like(x), 1 / fix(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / fix(1 + top * d)
            c = fix(1 + top / c)
            step = c * d
            out = out * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return out


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    log = np.vectorize(lgamma, otypes=[float])
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(log(a + b) - log(a) - log(b) + a * np.log(inside) + b * np.log1p(-inside))
    low = x < (a + 1) / (a + b + 2)
    p, q, z = np.where(low, a, b), np.where(low, b, a), np.where(low, inside, 1 - inside)
    part = front * _fraction(p, q, z) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, part, 1 - part)))


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    a, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, x))
    log = np.vectorize(lgamma, otypes=[float])
    safe = np.maximum(x, 1e-300)
    front = np.exp(-safe + a * np.log(safe) - log(a))
    term = total = 1 / a
    for k in range(1, 500):
        term = term * safe / (a + k)
        total = total + term
    b = safe + 1 - a
    c, d = np.full_like(safe, 1 / _TINY), 1 / np.where(np.abs(b) < _TINY, _TINY, b)
    h = d.copy()
    for k in range(1, 300):
        an = -k * (k - a)
        b = b + 2
        d = 1 / np.where(np.abs(an * d + b) < _TINY, _TINY, an * d + b)
        c = np.where(np.abs(b + an / c) < _TINY, _TINY, b + an / c)
        h = h * c * d
    return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - front * np.where(x < a + 1, total, 0), front * h))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = (t.notna() & df.notna() & (df > 0)).to_numpy()
    out = np.full(len(t), np.nan)
    if ok.any():
        out[ok] = t_two_sided(t.to_numpy(float)[ok], df.to_numpy(float)[ok])
    return pd.Series(out, t.index)


@F.pandas_udf(DoubleType())
def _f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)), f.index)


@F.pandas_udf(DoubleType())
def _chi_p(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(gamma_upper(k.to_numpy(float) / 2, x.to_numpy(float) / 2), x.index)


def p_of_t(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic; null without degrees of freedom."""
    p = _t_p(t.cast("double"), df.cast("double"))
    return F.when(~F.isnan(p), p)


def p_of_f(f: Column, d1: Column, d2: Column) -> Column:
    return _f_p(f.cast("double"), d1.cast("double"), d2.cast("double"))


def p_of_chi2(x: Column, k: Column) -> Column:
    return _chi_p(x.cast("double"), k.cast("double"))


def p_of_r(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs."""
    t = r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))
    return p_of_t(t, F.when(n > 2, n - 2))


def binomial_p(hits: Column, n: Column) -> Column:
    """Exact two-sided test against 1/2: twice the smaller tail, from logarithms, all inside the JVM."""
    k = F.least(hits, n - hits).cast("int")
    one = lambda i: F.exp(_log_choose(n, i) - n * F.lit(0.6931471805599453))
    tail = F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda acc, i: acc + one(i))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def _log_choose(n: Column, k: Column) -> Column:
    """log C(n, k) by Stirling's series from 8 on, and exactly below."""

    def log_factorial(x: Column) -> Column:
        small = F.log(F.factorial(F.least(x, F.lit(20)).cast("int")))
        y = F.greatest(x, F.lit(1)).cast("double")
        series = y * F.log(y) - y + F.log(2 * F.lit(np.pi) * y) / 2 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
        return F.when(x <= 20, small).otherwise(series)

    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)

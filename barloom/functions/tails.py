"""Tail probabilities for finished test tables, as Arrow UDFs on a handful of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _beta_fraction(a, b, x, terms: int = 400):
    """Lentz evaluation of the incomplete-beta continued fraction."""
    c = np.ones_like(x)
    d = 1.0 / _away(1.0 - (a + b) * x / (a + 1.0))
    out = d.copy()
    for m in range(1, terms):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 / _away(1.0 + step * d)
            c = _away(1.0 + step / c)
            out = out * c * d
    return out


def _away(v):
    return np.where(np.abs(v) < _TINY, _TINY, v)


def _lgamma(v):
    from math import lgamma

    return np.array([lgamma(x) for x in np.atleast_1d(v)])


def student_t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """2 * P(T > |t|) for Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    a, b = df / 2.0, np.full_like(df, 0.5)
    x = df / (df + t * t)
    front = np.exp(
        _lgamma(a + b) - _lgamma(a) - _lgamma(b)
        + a * np.log(np.maximum(x, _TINY)) + b * np.log(np.maximum(1.0 - x, _TINY))
    )
    direct = x < (a + 1.0) / (a + b + 2.0)
    left = front * _beta_fraction(a, b, np.where(direct, x, 0.0)) / a
    right = 1.0 - front * _beta_fraction(b, a, np.where(direct, 0.0, 1.0 - x)) / b
    return np.clip(np.where(direct, left, right), 0.0, 1.0)


def chi2_upper(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(X > x) for a chi-square variable."""
    out = []
    for value, k in zip(np.asarray(x, float), np.asarray(df, float)):
        a, h = k / 2.0, value / 2.0
        if h <= 0:
            out.append(1.0)
            continue
        front = np.exp(a * np.log(h) - h - _lgamma(a)[0])
        if h < a + 1.0:
            term = total = 1.0 / a
            for j in range(1, 2000):
                term *= h / (a + j)
                total += term
                if term < total * 1e-17:
                    break
            out.append(1.0 - front * total)
        else:
            b = h + 1.0 - a
            c, d = 1.0 / _TINY, 1.0 / b
            frac = d
            for j in range(1, 2000):
                step = -j * (j - a)
                b += 2.0
                d = 1.0 / (step * d + b)
                c = b + step / c
                frac *= d * c
                if abs(d * c - 1.0) < 1e-16:
                    break
            out.append(front * frac)
    return np.clip(np.array(out), 0.0, 1.0)


def _masked(fn, a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=a.index, dtype=float)
    ok = a.notna() & b.notna()
    if ok.any():
        out[ok] = fn(a[ok].to_numpy(float), b[ok].to_numpy(float))
    return out.astype(object).where(ok, None)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(student_t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(chi2_upper, x, df)

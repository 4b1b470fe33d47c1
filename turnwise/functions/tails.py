"""Tail probabilities of F, chi-square and t for result tables.

Batched over columns of small result tables; the regularised incomplete beta and gamma functions
are evaluated by their continued fraction and series (Abramowitz & Stegun 6.5 and 26.5).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_STEPS = 500
_STIRLING = 1e3
# Degrees of freedom from which F and t are taken for their limits; the two ways then agree to seven
# digits in the middle, and the continued fraction would need more steps with their square root.
_LIMIT = 1e8


def _lgamma(x):
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def _lentz(first, terms):
    """Modified Lentz evaluation of a continued fraction given its (a, b) terms."""
    value = np.where(first == 0, _TINY, first)
    c, d = value.copy(), np.zeros_like(value)
    for a, b in terms:
        d = b + a * d
        d = 1.0 / np.where(d == 0, _TINY, d)
        c = b + a / c
        c = np.where(c == 0, _TINY, c)
        value = value * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return value


def _beta_fraction(a, b, x):
    def terms():
        one = np.ones_like(x)
        for m in range(_STEPS):
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), one
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), one

    return 1.0 / _lentz(np.ones_like(x), terms())


def _lgamma_step(a, b):
    """lgamma(a + b) - lgamma(a), by Stirling's series where a is large, so that two numbers of the
    size of a are never subtracted."""
    far = np.where(a > _STIRLING, a, _STIRLING)
    series = (
        b * np.log(far) + (far + b - 0.5) * np.log1p(b / far) - b
        + (1 / (far + b) - 1 / far) / 12 - (1 / (far + b) ** 3 - 1 / far**3) / 360
    )
    near = np.where(a > _STIRLING, 1.0, a)
    return np.where(a > _STIRLING, series, _lgamma(near + b) - _lgamma(near))


def beta_inc(a, b, x, rest=None):
    """Regularised incomplete beta function I_x(a, b). ``rest`` is 1 - x, where it is known better."""
    rest = 1 - np.asarray(x, float) if rest is None else rest
    a, b, x, rest = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x, rest)))
    inner, outer = np.maximum(x, _TINY), np.maximum(rest, _TINY)
    log_inner = np.where(outer < 0.5, np.log1p(-np.minimum(outer, 0.5)), np.log(inner))
    log_outer = np.where(inner < 0.5, np.log1p(-np.minimum(inner, 0.5)), np.log(outer))
    large, small = np.maximum(a, b), np.minimum(a, b)
    front = np.exp(_lgamma_step(large, small) - _lgamma(small) + a * log_inner + b * log_outer)
    direct = inner < (a + 1) / (a + b + 2)
    low = front * _beta_fraction(np.where(direct, a, b), np.where(direct, b, a),
                                 np.where(direct, inner, outer)) / np.where(direct, a, b)
    result = np.where(direct, low, 1 - low)
    return np.where(x <= 0, 0.0, np.where(rest <= 0, 1.0, result))


def gamma_upper(s, x):
    """Regularised upper incomplete gamma function Q(s, x)."""
    s, x = np.broadcast_arrays(np.asarray(s, float), np.asarray(x, float))
    inner = np.maximum(x, _TINY)
    front = np.exp(s * np.log(inner) - inner - _lgamma(s))
    series, term = np.zeros_like(inner), 1.0 / s
    small = np.where(inner < s + 1, inner, 0.0)
    for n in range(1, _STEPS * 4):
        series = series + term
        term = term * small / (s + n)
        if np.all(term < 1e-17 * series):
            break

    large = np.where(inner < s + 1, s + 2, inner)

    def terms():
        for n in range(1, _STEPS):
            yield -n * (n - s), large + 2 * n + 1 - s

    upper = front / _lentz(large + 1 - s, terms())
    return np.where(x <= 0, 1.0, np.where(inner < s + 1, 1 - front * series, upper))


def f_tail_value(f, df1, df2):
    f, df1, df2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, df1, df2)))
    scaled = df1 * np.minimum(np.maximum(f, 0), 1e300)
    bounded = np.minimum(df2, _LIMIT)
    exact = beta_inc(bounded / 2, df1 / 2, bounded / (bounded + scaled), scaled / (bounded + scaled))
    tail = np.where(df2 > _LIMIT, gamma_upper(df1 / 2, np.minimum(scaled, 1e4) / 2), exact)
    return np.where(np.isposinf(f), 0.0, tail)


def t_tail_value(t, df):
    return f_tail_value(np.asarray(t, float) ** 2, 1.0, df)


def chi2_tail_value(stat, df):
    return gamma_upper(np.asarray(df, float) / 2, np.maximum(np.asarray(stat, float), 0) / 2)


def _on_known(function, *columns: pd.Series) -> pd.Series:
    known = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
    out = np.full(len(known), np.nan)
    if known.any():
        out[known] = function(*[c.to_numpy(float)[known] for c in columns])
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def _f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _on_known(f_tail_value, f, df1, df2)


@F.pandas_udf(T.DoubleType())
def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return _on_known(t_tail_value, t, df)


@F.pandas_udf(T.DoubleType())
def _chi2_tail(stat: pd.Series, df: pd.Series) -> pd.Series:
    return _on_known(chi2_tail_value, stat, df)


def f_tail(f, df1, df2):
    """P(F >= f); null where an argument is null."""
    return F.nanvl(_f_tail(f, df1, df2), F.lit(None).cast("double"))


def t_tail(t, df):
    """Two-sided P(|T| >= |t|)."""
    return F.nanvl(_t_tail(t, df), F.lit(None).cast("double"))


def chi2_tail(stat, df):
    """P(X >= stat)."""
    return F.nanvl(_chi2_tail(stat, df), F.lit(None).cast("double"))

"""Distribution functions for statistics that end in a p-value, on NumPy arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def beta_inc(a, b, x):
    """Regularized incomplete beta function, by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0, 1)
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        tiny = 1e-300
        c = np.ones_like(x)
        d = 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = c * d
                h = h * step
            if np.nanmax(np.abs(step - 1), initial=0) < 1e-15:
                break
        out = np.where(x == 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def gamma_q(a, x):
    """Upper regularized incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(x) - _lgamma(a))
        term, total = 1 / a, 1 / a
        for n in range(1, 500):
            term = term * x / (a + n)
            total = total + term
        low = 1 - front * total
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 500):
            an = -i * (i - a)
            b = b + 2
            d = 1 / (an * d + b)
            c = b + an / c
            h = h * d * c
        high = front * h
    return np.where(x <= 0, 1.0, np.where(x < a + 1, low, high))


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return np.where(f <= 0, 1.0, beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


def chi2_upper(x, df):
    return gamma_q(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def normal_two_sided(z):
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def _guard(fn, *x):
    """fn where no argument is missing."""
    x = [np.asarray(v, float) for v in x]
    bad = np.isnan(np.sum(x, axis=0))
    return np.where(bad, np.nan, fn(*(np.where(bad, 1.0, v) for v in x)))


def _column(fn, *columns: Column) -> Column:
    def one(a: pd.Series) -> pd.Series:
        return pd.Series(_guard(fn, a))

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_guard(fn, a, b))

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(_guard(fn, a, b, c))

    run = (one, two, three)[len(columns) - 1]
    run.__annotations__ = dict.fromkeys([*"abc"[: len(columns)], "return"], pd.Series)
    return F.pandas_udf(run, "double")(*columns)


def t_p(t: Column, df: Column) -> Column:
    return _column(t_two_sided, t, df)


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_upper, f, d1, d2)


def chi2_p(x: Column, df: Column) -> Column:
    return _column(chi2_upper, x, df)


def normal_p(z: Column) -> Column:
    return _column(normal_two_sided, z)


def range_upper(q, k, df):
    """Chance that the studentized range of k normal values, over an independent deviation of df degrees, exceeds q: the chance of the
    range for a known deviation, averaged over the deviation's distribution, both by Gauss-Legendre quadrature."""
    q, k, df = (np.atleast_1d(np.asarray(v, float)) for v in (q, k, df))
    node, weight = np.polynomial.legendre.leggauss(64)
    cdf = lambda x: 0.5 * _erfc(-x / math.sqrt(2))
    z, wz = node * 8, weight * 8
    dens = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    out = np.empty(len(q))
    for i, (a, m, f) in enumerate(zip(q, k, df, strict=True)):
        if not a > 0 or m < 2 or f < 1:
            out[i] = 1.0
            continue
        # The deviation s has f * s^2 ~ chi-square; beyond these bounds it has no weight to speak of.
        low, high = max(0.0, 1 - 8 / math.sqrt(2 * f)), 1 + 12 / math.sqrt(2 * f)
        s, ws = (node + 1) / 2 * (high - low) + low, weight * (high - low) / 2
        log = math.log(2) + (f / 2) * math.log(f / 2) - math.lgamma(f / 2) + (f - 1) * np.log(s) - f * s * s / 2
        inner = m * (wz * dens * (cdf(z[None]) - cdf(z[None] - a * s[:, None])) ** (m - 1)).sum(axis=1)
        out[i] = min(max(1 - float((ws * np.exp(log) * inner).sum()), 0.0), 1.0)
    return out


def range_p(q: Column, k: Column, df: Column) -> Column:
    return _column(range_upper, q, k, df)


def jab_prior(n: float, method: str = "robust", upper: float = 10.0) -> float:
    """Fraction of the data that stands in for a prior: JAB 1/n, min 2/n, robust the larger of 2/n and 1/sqrt(n), balanced
    the integral of exp(-n x^2 / 4) over effects from 0 to `upper`, between 2/n and 0.5."""
    if method == "robust":
        return max(2 / n, 1 / math.sqrt(n))
    if method == "min":
        return 2 / n
    if method == "balanced":
        return max(2 / n, min(0.5, math.sqrt(math.pi / n) * math.erf(upper * math.sqrt(n) / 2)))
    return 1 / n


def alpha_n(n: int, bf: float = 3.0, method: str = "robust", upper: float = 10.0) -> float:
    """Significance level at which a p-value is worth the Bayes factor `bf` for a sample of n: the chance that a
    chi-square variable of one degree exceeds 2 ln(bf / sqrt(b))."""
    return math.erfc(math.sqrt(max(0.0, math.log(bf / math.sqrt(jab_prior(n, method, upper))))))


def two_sided_quantile(p: float, df: float | None = None) -> float:
    """The statistic whose two-sided p-value is p: Student's with df degrees, normal without."""
    if not p < 1:
        return 0.0
    tail = (lambda x: float(t_two_sided(np.array([x]), np.array([float(df)]))[0])) if df is not None else (lambda x: math.erfc(x / math.sqrt(2)))
    high = 1.0
    while tail(high) > p and high < 1e150:
        high *= 2
    low = 0.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > p else (low, mid)
    return (low + high) / 2


def bayes_factor(n: int, p: float, z: bool = False, method: str = "robust", upper: float = 10.0) -> float:
    """Approximate Bayes factor for an effect of a p-value of a sample of n, from Student's t with n - 2 degrees or, with `z`, from
    a normal statistic: exp(statistic^2 / 2) * sqrt(b)."""
    x = two_sided_quantile(p, None if z else n - 2)
    return math.exp(x * x / 2) * math.sqrt(jab_prior(n, method, upper))


def bayes_factors(p: Column, n: int, z: bool = False, method: str = "robust") -> Column:
    """bayes_factor of each p-value of a column."""
    return _column(lambda v: np.array([bayes_factor(n, x, z, method) for x in v]), p)

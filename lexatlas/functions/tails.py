"""Student-t tail probabilities on summary rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x])


#: From here on the tail of the normal law with its terms in 1/df and 1/df^2 is exact to 1e-12.
LARGE_DF = 1e5


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz); each row is followed until it stands still.

    A row that has settled stays as it is: near the end the factors of long fractions go on moving by a few units of the last
    place, and never all at the same time by less than one.
    """
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    m, moving = 1, np.ones(x.shape, dtype=bool)
    # The fraction needs about sqrt(max(a, b)) terms.
    most = 1000 + 20 * int(math.sqrt(float(np.max(np.maximum(a, b)))))
    while moving.any():
        if m > most:
            raise ArithmeticError("the tail of the t distribution has not converged")
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = np.where(moving, h * step, h)
        moving &= ~(np.abs(step - 1.0) < 1e-15)
        m += 1
    return h


def _near_normal(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail for large df: the normal tail plus density times the first two terms of Fisher's series."""
    x = np.minimum(np.abs(t), 40.0)  # the tail beyond is 0 in double precision
    density = np.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi)
    first = (x**3 + x) / 4.0
    second = (3 * x**7 - 5 * x**5 - 7 * x**3 - 3 * x) / 96.0
    upper = np.array([math.erfc(v / math.sqrt(2.0)) for v in x]) / 2.0
    return 2.0 * (upper + density * (first / df + second / df**2))


def two_sided_p(t, df) -> np.ndarray:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom; NaN when df <= 0."""
    t = np.atleast_1d(np.asarray(t, dtype=float))
    df = np.broadcast_to(np.asarray(df, dtype=float), t.shape)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(df) & (df > 0) & ~np.isnan(t)
    out[ok & np.isinf(t)] = 0.0
    ok &= np.isfinite(t)
    large = ok & (df >= LARGE_DF)
    out[large] = np.clip(_near_normal(t[large], df[large]), 0.0, 1.0)
    ok &= df < LARGE_DF
    if not ok.any():
        return out
    a, b = df[ok] / 2.0, np.full(ok.sum(), 0.5)
    square = t[ok] ** 2
    x, rest = df[ok] / (df[ok] + square), square / (df[ok] + square)
    front = np.exp(
        _lgamma(a + b) - _lgamma(a) - _lgamma(b)
        - a * np.log1p(square / df[ok])
        + b * np.log(np.maximum(rest, 1e-300))
    )
    direct = x < (a + 1.0) / (a + b + 2.0)
    res = np.where(
        direct,
        front * _beta_fraction(a, b, np.where(direct, x, 0.0)) / a,
        1.0 - front * _beta_fraction(b, a, np.where(direct, 0.0, rest)) / b,
    )
    out[ok] = np.clip(res, 0.0, 1.0)
    return out


@F.pandas_udf(T.DoubleType())
def _two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    p = two_sided_p(t.to_numpy(dtype=float), df.to_numpy(dtype=float))
    return pd.Series(p).where(~np.isnan(p), None)


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p-value column, null when undefined. Use on summary rows."""
    p = _two_sided(t.cast("double"), df.cast("double"))
    return F.when(F.isnan(p), F.lit(None)).otherwise(p)


def t_quantile(df: float, level: float = 0.975) -> float:
    """The ``level`` quantile of Student's t, by bisection on the tail."""
    if not df > 0:
        return float("nan")
    lo, hi, tail = 0.0, 1e3, 2.0 * (1.0 - level)
    while two_sided_p(hi, df)[0] > tail:
        hi *= 10.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if two_sided_p(mid, df)[0] > tail:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


@F.pandas_udf(T.DoubleType())
def _quantile(df: pd.Series) -> pd.Series:
    return df.map(lambda d: t_quantile(float(d)) if pd.notna(d) and d > 0 else None).astype(float)


def t_critical(df: Column) -> Column:
    """97.5 % point of Student's t per summary row."""
    q = _quantile(df.cast("double"))
    return F.when(F.isnan(q), F.lit(None)).otherwise(q)

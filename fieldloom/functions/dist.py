"""Distributions that Spark SQL lacks, as vectorised functions for Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ERF = np.vectorize(math.erf, otypes=[float])
_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(np.asarray(z, float) / math.sqrt(2)))


def normal_inverse(p: np.ndarray) -> np.ndarray:
    """Bisection on the cumulative distribution, then Newton's steps: near double precision, without tables."""
    p = np.asarray(p, float)
    low, high = np.full(p.shape, -9.0), np.full(p.shape, 9.0)
    for _ in range(40):
        mid = (low + high) / 2
        below = normal_cdf(mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    z = (low + high) / 2
    for _ in range(2):
        z = z - (normal_cdf(z) - p) / np.maximum(np.exp(-z * z / 2) / math.sqrt(2 * math.pi), 1e-300)
    return z


def gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: a power series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    safe = np.maximum(x, 1e-300)
    front = np.exp(-safe + a * np.log(safe) - _LGAMMA(a))
    term = total = 1 / a
    n = a.copy()
    for _ in range(600):
        n = n + 1
        term = term * safe / n
        total = total + term
    tiny = 1e-300
    b = safe + 1 - a
    c, d = np.full(a.shape, 1 / tiny), 1 / np.where(np.abs(b) < tiny, tiny, b)
    h = d
    for i in range(1, 400):
        k = -i * (i - a)
        b = b + 2
        d = k * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + k / np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
    return np.where(x <= 0, 0.0, np.where(x < a + 1, front * total, 1 - front * h))


def t_quantile(p: float, df: float) -> float:
    """Student's t by bisection on its distribution, which a finite sum over the angle gives for whole degrees of freedom."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def _t_cdf(t: float, df: float) -> float:
    theta, n = math.atan(t / math.sqrt(df)), int(df)
    s, c = math.sin(theta), math.cos(theta)
    if n % 2:
        total, term = 0.0, c
        for k in range(1, (n - 1) // 2 + 1):
            total += term
            term *= c * c * (2 * k) / (2 * k + 1)
        return 0.5 + (theta + s * total) / math.pi
    total, term = 0.0, 1.0
    for k in range(1, n // 2 + 1):
        total += term
        term *= c * c * (2 * k - 1) / (2 * k)
    return 0.5 + s * total / 2


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    return pd.Series(2 * (1 - normal_cdf(np.abs(z.to_numpy(float)))))


@F.pandas_udf(T.DoubleType())
def spi_value(total: pd.Series, zero_share: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
    """The normal quantile of a mixed distribution: a share of zeros, and a gamma distribution."""
    x, q, a, b = (s.to_numpy(float) for s in (total, zero_share, alpha, beta))
    ok = np.isfinite(x) & np.isfinite(a) & np.isfinite(b)
    h = np.where(ok, q + (1 - q) * np.where(x > 0, gamma_cdf(np.where(ok, a, 1), np.where(ok, np.maximum(x, 0) / np.where(ok, b, 1), 0)), 0), 0.5)
    return pd.Series(np.where(ok, normal_inverse(np.clip(h, 1e-6, 1 - 1e-6)), np.nan))


@F.pandas_udf(T.DoubleType())
def t_975(df: pd.Series) -> pd.Series:
    known = {n: t_quantile(0.975, n) for n in df.dropna().unique() if n >= 1}
    return df.map(known)

"""Tails of the distributions that the tests need, as survival functions (never 1 - cdf, which loses small tails)."""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = c if abs(c) > _TINY else _TINY
            out *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return out


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    out = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2.0
        d = step * d + b
        c = b + step / c
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = c if abs(c) > _TINY else _TINY
        out *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return front * out


def chi2_sf(x: float, df: float) -> float:
    return gammaincc(df / 2.0, x / 2.0)


def f_sf(x: float, df1: float, df2: float) -> float:
    return 1.0 if x <= 0 else betainc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * x))


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """x with P(T <= x) = p, by bisection on the tail."""
    if p == 0.5:
        return 0.0
    tail, low, high = 2.0 * min(p, 1.0 - p), 0.0, 1.0
    while t_two_sided(high, df) > tail:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        low, high = (middle, high) if t_two_sided(middle, df) > tail else (low, middle)
    return math.copysign((low + high) / 2.0, p - 0.5)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)
_erf = np.vectorize(math.erf)


def _normal_range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals <= w)."""
    z = 8.0 * _NODES
    density = np.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
    upper = 0.5 * (1.0 + _erf(z / math.sqrt(2.0)))
    lower = 0.5 * (1.0 + _erf((z[None, :] - np.asarray(w)[:, None]) / math.sqrt(2.0)))
    return k * 8.0 * ((upper[None, :] - lower) ** (k - 1) * density[None, :]) @ _WEIGHTS


def studentized_range_cdf(q: float, k: int, df: float) -> float:
    """P(Q <= q) for k means and df degrees of freedom of the error (infinite: normal)."""
    if q <= 0:
        return 0.0
    if math.isinf(df) or df > 1e6:
        return float(_normal_range_cdf(np.array([q]), k)[0])
    spread = 8.0 / math.sqrt(2.0 * df)
    low, high = max(1e-9, 1.0 - spread), 1.0 + spread
    s = (high - low) / 2.0 * _NODES + (high + low) / 2.0
    log_density = math.log(2.0) + df / 2.0 * math.log(df / 2.0) - math.lgamma(df / 2.0) + (df - 1.0) * np.log(s) - df * s * s / 2.0
    return float(min(1.0, (high - low) / 2.0 * (np.exp(log_density) * _normal_range_cdf(q * s, k)) @ _WEIGHTS))


def studentized_range_sf(q: float, k: int, df: float) -> float:
    return max(0.0, 1.0 - studentized_range_cdf(q, k, df))


def studentized_range_quantile(p: float, k: int, df: float) -> float:
    low, high = 0.0, 4.0
    while studentized_range_cdf(high, k, df) < p:
        high *= 2.0
    for _ in range(60):
        middle = (low + high) / 2.0
        low, high = (middle, high) if studentized_range_cdf(middle, k, df) < p else (low, middle)
    return (low + high) / 2.0

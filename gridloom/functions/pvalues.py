"""Tail probabilities from the regularised incomplete gamma and beta functions."""

from __future__ import annotations

import math

TINY, EPS = 1e-300, 1e-15


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * EPS:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c, d = x + 1 - a, 1 / TINY, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or TINY)
        c = b + an / c or TINY
        h *= d * c
        if abs(d * c - 1) < EPS:
            break
    return front * h


def beta_i(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or TINY)
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or TINY)
            c = 1 + step / c or TINY
            h *= c * d
        if abs(c * d - 1) < EPS:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / (df + t * t), df / 2, 0.5)


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_i(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile: P(T > t) = 1 - p for p >= 0.5, by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) / 2 > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) / 2 > 1 - p else (low, mid)
    return (low + high) / 2


def pearson_p(r: float, n: int) -> float | None:
    if n < 3 or r is None:
        return None
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

"""Tail areas and quantiles for a handful of coefficients on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def normal_p(z: float) -> float:
    """Two-sided p-value of a z statistic."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def beta_share(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_p(t: float, freedom: float) -> float:
    """Two-sided p-value of a t statistic."""
    if freedom > 1e6:
        return normal_p(t)
    return beta_share(freedom / 2.0, 0.5, freedom / (freedom + t * t))


def t_quantile(level: float, freedom: float) -> float:
    """Upper quantile of Student's t for a two-sided interval of this level."""
    start = NORMAL.inv_cdf(0.5 + level / 2.0)
    if freedom > 1e6:
        return start
    low, high = 0.0, start * 50.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if t_p(middle, freedom) > 1.0 - level:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def chi_square_p(value: float, freedom: int) -> float:
    """Upper tail of the chi-square distribution (regularized upper gamma)."""
    a, x = freedom / 2.0, value / 2.0
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        term = total = 1.0 / a
        for k in range(1, 2000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return 1.0 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1.0 - a, 1e300
    d = 1.0 / b
    h = d
    for k in range(1, 2000):
        step = -k * (k - a)
        b += 2.0
        d = 1.0 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))

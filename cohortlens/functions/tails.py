"""Upper tails of the F, chi-squared and normal distributions, without scipy."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = out = 1 / a
        n = a
        while abs(term) > abs(out) * 1e-16:
            n += 1
            term *= x / n
            out += term
        return max(0.0, 1 - front * out)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 1000):
        top = -i * (i - a)
        b += 2
        d = 1 / (top * d + b or 1e-300)
        c = b + top / c or 1e-300
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def f_tail(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))

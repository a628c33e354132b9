"""Tail probabilities on the driver, from moments and counts that Spark has aggregated."""

from __future__ import annotations

import math


def binomial_two_sided(k: int, n: int) -> float:
    """Two-sided exact p of k successes in n fair trials."""
    if n == 0:
        return 1.0
    most = math.comb(n, k) * (1 + 1e-7)
    return min(1.0, sum(c for c in (math.comb(n, i) for i in range(n + 1)) if c <= most) / 2**n)


def chi2_tail(x: float) -> float:
    """P(chi-square with one degree of freedom > x)."""
    return math.erfc(math.sqrt(max(0.0, x) / 2))


def mcnemar(n10: int, n01: int, exact_below: int = 25) -> dict:
    n = n10 + n01
    if n == 0:
        return {"n10": n10, "n01": n01, "statistic": 0.0, "p_value": 1.0, "method": "exact"}
    if n < exact_below:
        return {"n10": n10, "n01": n01, "statistic": float(min(n10, n01)), "p_value": binomial_two_sided(min(n10, n01), n), "method": "exact"}
    x = (abs(n10 - n01) - 1) ** 2 / n
    return {"n10": n10, "n01": n01, "statistic": x, "p_value": chi2_tail(x), "method": "chi2"}


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float, alternative: str = "two-sided") -> float:
    """p of a t statistic; alternative is two-sided, greater or less."""
    if math.isnan(t) or df <= 0:
        return math.nan
    half = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    upper = half if t > 0 else 1 - half
    return {"two-sided": 2 * min(upper, 1 - upper), "greater": upper, "less": 1 - upper}[alternative]


def welch(n1: int, mean1: float, var1: float, n2: int, mean2: float, var2: float, alternative: str = "two-sided") -> tuple[float, float, float]:
    """(t, degrees of freedom, p) from sample moments."""
    if n1 < 2 or n2 < 2 or var1 + var2 == 0:
        return math.nan, math.nan, math.nan
    a, b = var1 / n1, var2 / n2
    t, df = (mean1 - mean2) / math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return t, df, t_tail(t, df, alternative)


def paired(n: int, mean: float, var: float, alternative: str = "two-sided") -> tuple[float, float, float]:
    """(t, degrees of freedom, p) from the moments of differences."""
    if n < 2 or var == 0:
        return math.nan, math.nan, math.nan
    t = mean / math.sqrt(var / n)
    return t, n - 1, t_tail(t, n - 1, alternative)

"""Numbers that are constants of a plan, computed on the driver."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction from the back."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 0.0
    for m in range(200, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = even / (1 + odd / (1 + value))
    first = -(a + b) * x / (a + 1)
    return front / (1 + first / (1 + value))


def student_t_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def student_t_quantile(p: float, df: float) -> float:
    """By bisection on the distribution function."""
    low, high = -1e6, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if student_t_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2


def grubbs_critical(n: int, alpha: float = 0.05) -> float:
    """Critical value of Grubbs' two-sided test for n values."""
    if n < 3:
        return math.inf
    t = student_t_quantile(1 - alpha / (2 * n), n - 2)
    return (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = math.fsum(weights)
    return [w / total for w in weights]

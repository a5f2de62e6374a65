"""Student's t: quantiles for intervals, probabilities for tests. Nothing else here needs a statistics library."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of freedom whose quantiles are listed; beyond, an expansion in 1 / degrees is as exact.
LISTED = 60


def _tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def two_sided(t: float, degrees: float) -> float:
    """The probability of a |t| as large or larger."""
    return _tail(degrees / (degrees + t * t), degrees / 2, 0.5)


@lru_cache(None)
def quantile(degrees: int, confidence: float = 0.95) -> float:
    """The t that |t| stays below with this probability."""
    low, high = 0.0, 1e4
    while high - low > 1e-12 * max(1.0, high):
        at = (low + high) / 2
        low, high = (at, high) if two_sided(at, degrees) > 1 - confidence else (low, at)
    return (low + high) / 2


@lru_cache(None)
def normal_quantile(confidence: float = 0.95) -> float:
    low, high = 0.0, 40.0
    while high - low > 1e-13:
        at = (low + high) / 2
        low, high = (at, high) if math.erfc(at / math.sqrt(2)) > 1 - confidence else (low, at)
    return (low + high) / 2


def quantile_of(degrees: Column, confidence: float = 0.95) -> Column:
    """The same for a column of degrees of freedom; null below 1."""
    z, v = normal_quantile(confidence), degrees.cast("double")
    far = z + (z**3 + z) / 4 / v + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (v * v) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (v * v * v)
    listed = F.array(*[F.lit(quantile(k, confidence)) for k in range(1, LISTED + 1)])
    return F.when(degrees.between(1, LISTED), F.get(listed, (degrees - 1).cast("int"))).when(degrees > LISTED, far)

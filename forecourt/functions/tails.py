"""Tail probabilities of the test statistics.

The statistics are Spark aggregates; a report holds one per column, and only these few
numbers pass through here.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: series below a + 1, continued fraction above.

    Both need about the square root of ``a`` steps; far up the cube root of the statistic is normal.
    """
    if x <= 0:
        return 1.0
    if a > 1e4:
        return math.erfc(((x / a) ** (1 / 3) - 1 + 1 / (9 * a)) * math.sqrt(9 * a) / math.sqrt(2)) / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        for i in itertools.count(1):
            term *= x / (a + i)
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1.0 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in itertools.count(1):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for i in range(1, 2000):
        for an in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)),
                   -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d = 1.0 / (1 + an * d or 1e-300)
            c = 1 + an / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def _beta_share(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def chi_square_tail(statistic: float, freedom: float) -> float:
    return _gamma_tail(freedom / 2, statistic / 2)


def t_two_sided(statistic: float, freedom: float) -> float:
    return _beta_share(freedom / 2, 0.5, freedom / (freedom + statistic * statistic))


def chi_square_quantile(share: float, freedom: float) -> float:
    """Value with ``share`` of the chi-square distribution below it, by bisection."""
    low, high = 0.0, max(10.0, freedom * 20)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - chi_square_tail(middle, freedom) < share else (low, middle)
    return (low + high) / 2


def _pairwise(fn):
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x, y) if np.isfinite(x) and np.isfinite(y) and y > 0 else None for x, y in zip(a, b)],
                         dtype="float64")

    apply.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return apply


def chi_square_p(statistic: Column, freedom: Column) -> Column:
    return F.pandas_udf(_pairwise(chi_square_tail), "double")(statistic.cast("double"), freedom.cast("double"))


def t_p(statistic: Column, freedom: Column) -> Column:
    return F.pandas_udf(_pairwise(t_two_sided), "double")(statistic.cast("double"), freedom.cast("double"))


def ks_p(statistic: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov probability, as a plain expression."""
    reach = statistic * F.sqrt(n1.cast("double") * n2 / (n1 + n2))
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.when(i % 2 == 1, 2.0).otherwise(-2.0)
                        * F.exp(-2 * i * i * reach * reach))
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.when(reach < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))

"""p-values for small result tables, through the regularized incomplete beta function."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz), x < (a+1)/(a+b+2)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10 + 50 * int(math.sqrt(max(a, b)) + 10)):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return total


def incomplete_beta(a, b, x):
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def fair_coin_p(k, n):
    """Two-sided exact binomial p-value of `k` hits, k <= n/2, in `n` throws with chance 1/2."""
    if n == 0 or 2 * k == n:
        return 1.0
    return min(1.0, 2.0 * incomplete_beta(n - k, k + 1.0, 0.5))


def correlation_p(r, n):
    """Two-sided p-value of a correlation from Student's t with n - 2 degrees of freedom."""
    if n < 3 or r is None or math.isnan(r):
        return None
    if n == 3 and abs(r) >= 1.0:
        return 0.0
    rest = (1.0 - r) * (1.0 + r)
    if rest <= 0.0:
        return 0.0
    df = n - 2.0
    t2 = r * r * df / rest
    return incomplete_beta(df / 2.0, 0.5, df / (df + t2))


@F.pandas_udf(T.DoubleType())
def fair_coin_p_udf(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([fair_coin_p(int(a), int(b)) for a, b in zip(k, n)])


@F.pandas_udf(T.DoubleType())
def correlation_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(None if np.isnan(a) else float(a), int(b))
                      for a, b in zip(r.astype(float), n)], dtype="float64")

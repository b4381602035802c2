"""Closed formulas of tests and intervals; tails that Spark has no function for are vectorised pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z = 1.96


def wilson_ci(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Wilson interval, within [0, 1]; null if n is 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / n
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    inside = lambda x: F.when(n.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return inside((mid - half) / scale), inside((mid + half) / scale)


def log_factorial(n: Column) -> Column:
    return F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1)).cast("bigint")),
        F.lit(0.0),
        lambda t, i: t + F.log(i.cast("double"))
    )


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact p of a fair coin for b against c; 1 without discordant pairs."""
    n, k = (b + c).cast("bigint"), F.least(b, c).cast("bigint")
    # terms C(n, i) / 2^n by their ratios, from i = 0
    start = F.struct((-n * math.log(2)).alias("term"), F.exp(-n * math.log(2)).alias("sum"))
    tail = F.aggregate(
        F.when(
            k >= 1, F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1)))
        ).otherwise(F.array().cast("array<bigint>")),
        start,
        lambda s, i: F.struct(
            (s["term"] + F.log((n - i + 1) / i)).alias("term"),
            (s["sum"] + F.exp(s["term"] + F.log((n - i + 1) / i))).alias("sum")
        ),
        lambda s: s["sum"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar_chi2(b: Column, c: Column) -> Column:
    """Continuity-corrected statistic (not clamped: equal counts give 1/n); null without discordant pairs."""
    return F.try_divide(F.pow(F.abs(b - c) - 1, F.lit(2)), (b + c).cast("double"))


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    log_scale = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:  # series of the lower one
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * math.exp(log_scale))
    tiny = 1e-300  # continued fraction (Lentz)
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(log_scale) * h


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution."""
    return pd.Series(
        [None if v is None or np.isnan(v) else _upper_gamma(d / 2, v / 2) for v, d in zip(x, dof, strict=True)],
        dtype="float64"
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 10000):
        for t in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        ):
            d = 1 / (1 + t * d or tiny)
            c = 1 + t / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def _t_two_sided(t: float, dof: float) -> float:
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    ) if 0 < x < 1 else 0.0
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(
        b, a, 1 - x
    ) / b


@F.pandas_udf(DoubleType())
def correlation_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation by the t distribution with n - 2 degrees of freedom."""
    out = []
    for r, k in zip(rho, n, strict=True):
        if r is None or np.isnan(r) or k < 3:
            out.append(None)
        else:
            out.append(0.0 if abs(r) >= 1 else _t_two_sided(r * math.sqrt((k - 2) / (1 - r * r)), k - 2))
    return pd.Series(out, dtype="float64")

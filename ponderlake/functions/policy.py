"""Formulas of policy optimisation over log-probabilities and advantages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def policy_ratio(new: Column, old: Column) -> Column:
    return F.exp(new - old)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clipped_surrogate(new: Column, old: Column, advantage: Column, eps: float = 0.2) -> Column:
    r = policy_ratio(new, old)
    return -F.avg(F.least(r * advantage, clip(r, 1 - eps, 1 + eps) * advantage))


def approx_kl(new: Column, old: Column) -> Column:
    return F.avg(old - new)


def k3_kl(policy: Column, reference: Column) -> Column:
    d = reference - policy
    return F.avg(F.exp(d) - d - 1)


def clip_fraction(new: Column, old: Column, eps: float = 0.2) -> Column:
    r = policy_ratio(new, old)
    return F.avg((r != clip(r, 1 - eps, 1 + eps)).cast("double"))


def implied_hit(q: Column, k: int) -> Column:
    """Chance of at least one hit in k draws."""
    return 1 - F.pow(1 - q, F.lit(k))


def analytic_advantage(k: Column, m: Column, eps: float = 1e-4) -> dict[str, Column]:
    """Sample deviation of m ones among k, and the advantages of a one and a zero, with and without eps."""
    p = m / k
    std = F.sqrt(m * (k - m) / (k * (k - 1)))
    some = (m > 0) & (m < k)
    zero = F.lit(0.0)
    return {
        "std": std,
        "a_plus": F.when(some, F.try_divide(1 - p, std)).otherwise(zero),
        "a_minus": F.when(some, F.try_divide(-p, std)).otherwise(zero),
        "a_plus_eps": F.when(m > 0, (1 - p) / (std + eps)).otherwise(zero),
        "a_minus_eps": F.when(m < k, -p / (std + eps)).otherwise(zero),
    }

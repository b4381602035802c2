"""Token sequences as arrays: where they end, which tokens count, and sums over those that do.

A sequence is a row with parallel arrays (ids, log-probabilities).  ``n`` below is how many of its first tokens count; all
reductions are over those, inside the row.  An empty or null sequence has no tokens: sums are 0, means null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _size(x: Column) -> Column:
    return F.coalesce(F.size(x), F.lit(0))


def through_end(ids: Column, end: Column) -> Column:
    """Tokens up to the first end token, itself included; all of a sequence that never ends."""
    at = F.array_position(ids, end)
    return F.when(at > 0, at.cast("int")).otherwise(_size(ids))


def before_padding(ids: Column, pad: Column) -> Column:
    """Tokens that aren't padding, one at least (so that no mask is empty) if there is any."""
    return F.least(F.greatest(F.size(F.filter(ids, lambda t: t != pad)), F.lit(1)), _size(ids))


def loss_mask(prompt: Column, n: Column, total: Column) -> Column:
    """For each position but the last, whether the token it predicts is one of the ``n`` after ``prompt`` tokens."""
    places = F.sequence(F.lit(1), F.greatest(total - 1, F.lit(1)))
    mask = F.transform(places, lambda p: ((p >= prompt) & (p < prompt + n)).cast("int"))
    return F.when(total > 1, mask).otherwise(F.array().cast("array<int>"))


def labels(ids: Column, prefix: Column, ignore: int = -100) -> Column:
    """Token ids with those of the common prefix ignored.

    No lambda: Spark writes a column into the lambda that names it, which would find the prefix again at every token.
    """
    n = F.least(F.greatest(F.coalesce(prefix, F.lit(0)), F.lit(0)), _size(ids))
    return F.concat(F.array_repeat(F.lit(ignore), n), F.slice(ids, n + 1, _size(ids) - n))


def common_prefix(a: Column, b: Column, bits: int = 31) -> Column:
    """Length of the longest common prefix of two arrays, by bisection: one comparison of slices a bit of the length."""
    most = F.least(_size(a), _size(b))
    # bits beyond the length can't be set: they are left out
    steps = F.sequence(F.least(F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(bits - 1)), F.lit(0))

    def step(m: Column, k: Column) -> Column:
        n = m + F.call_function("shiftleft", F.lit(1), k)
        return F.when((n <= most) & (F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n)), n).otherwise(m)

    return F.when(most > 0, F.aggregate(steps, F.lit(0), step)).otherwise(F.lit(0))


def total(values: Column, n: Column) -> Column:
    """Sum of the first ``n`` values; nulls count as 0."""
    return F.aggregate(
        F.slice(values, F.lit(1), n), F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0))
    )


def mean(values: Column, n: Column) -> Column:
    return F.when(n > 0, total(values, n) / n)


def ratios(new: Column, old: Column) -> Column:
    """Probability ratio of each token."""
    return F.zip_with(new, old, lambda a, b: F.exp(a - b))


def k3(policy: Column, reference: Column) -> Column:
    """Estimate of the divergence at each token: exp(d) - d - 1, d the reference's less the policy's."""
    return F.zip_with(policy, reference, lambda p, r: F.exp(r - p) - (r - p) - 1)


def surrogate(ratio: Column, advantage: Column, low: float = 0.2, high: float | None = None) -> Column:
    """Clipped loss of each token; ``high`` differs from ``low`` where the upper clip does."""
    upper = 1 + (low if high is None else high)
    return F.transform(
        ratio, lambda r: -F.least(r * advantage, F.least(F.greatest(r, F.lit(1 - low)), F.lit(upper)) * advantage)
    )


def clipped(ratio: Column, low: float = 0.2, high: float | None = None) -> Column:
    """1.0 for each token whose ratio is outside the clip."""
    upper = 1 + (low if high is None else high)
    return F.transform(ratio, lambda r: ((r < 1 - low) | (r > upper)).cast("double"))


def apart(a: Column, b: Column) -> Column:
    """Absolute difference at each token."""
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))

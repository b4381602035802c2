"""Paired tests, rank correlation, independence, and deterministic resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import statistics as S
from .positions import running


def mcnemar(df: DataFrame, a: Column, b: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Discordant counts, statistic, and exact and asymptotic p."""
    g = df.groupBy(*keys).agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    g = g.withColumn("chi2", S.mcnemar_chi2(F.col("b"), F.col("c"))).withColumn(
        "exact_p", S.mcnemar_exact(F.col("b"), F.col("c"))
    )
    return g.withColumn("chi2_p", S.chi2_sf(F.col("chi2"), F.lit(1.0)))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; null if a column is constant.

    Ranks come from counts by value, summed over intervals of values.
    """

    def ranks(c: str) -> DataFrame:
        n = running(df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n")), "v", "n")
        return n.select(F.col("v").alias(c), (F.col("before") + (F.col("n") + 1) / 2).alias(f"rank_{c}"))

    r = df.select(x, y).join(ranks(x), x).join(ranks(y), y)
    a, b = F.col(f"rank_{x}"), F.col(f"rank_{y}")
    s = r.agg(
        F.count("*").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("aa"),
        F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab")
    )
    n = F.col("n").cast("double")
    va, vb = n * F.col("aa") - F.col("sa") * F.col("sa"), n * F.col("bb") - F.col("sb") * F.col("sb")
    return s.select(
        "n",
        F.when(
            (va > 0) & (vb > 0), (n * F.col("ab") - F.col("sa") * F.col("sb")) / F.sqrt(va) / F.sqrt(vb)
        ).alias("rho")
    )


def chi2_independence(df: DataFrame, x: str, y: str) -> DataFrame:
    """statistic and dof of the table x by y, empty cells included."""
    c = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("o"))
    rows, cols, total = c.groupBy("x").agg(
        F.sum("o").alias("r")
    ), c.groupBy("y").agg(F.sum("o").alias("k")), c.agg(F.sum("o").alias("t"))
    # cells without rows add their expectation: their sum is the total less the expectations of the others
    e = F.col("r").cast("double") * F.col("k") / F.col("t")
    full = c.join(rows, "x").join(cols, "y").crossJoin(F.broadcast(total))
    s = full.agg(
        F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("seen"),
        F.sum(e).alias("expected"),
        F.max("t").alias("t"),
        F.count_distinct("x").alias("nx"),
        F.count_distinct("y").alias("ny")
    )
    return s.select(
        (F.col("seen") + F.col("t") - F.col("expected")).alias("statistic"),
        ((F.col("nx") - 1) * (F.col("ny") - 1)).alias("dof")
    )


def interval(reps: DataFrame, value: str = "value") -> DataFrame:
    """Mean and the 2.5 and 97.5 percentiles (linear), and whether they enclose 0 strictly."""
    p = F.expr(f"percentile({value}, array(0.025D, 0.975D))")
    x = reps.agg(F.avg(value).alias("mean"), p.alias("p"), F.count("*").alias("reps"))
    return x.select(
        "reps",
        "mean",
        F.col("p")[0].alias("low"),
        F.col("p")[1].alias("high"),
        ((F.col("p")[0] < 0) & (F.col("p")[1] > 0)).alias("crosses_zero")
    )


def _binomial_quantile(n: int, p: float, u: np.ndarray) -> np.ndarray:
    """Least k whose binomial distribution function reaches u; what lies 12 deviations off is left out."""
    if n == 0 or p <= 0:
        return np.zeros(len(u), np.int64)
    if p >= 1:
        return np.full(len(u), n)
    spread = 12 * math.sqrt(n * p * (1 - p)) + 40
    low, high = max(0, math.floor(n * p - spread)), min(n, math.ceil(n * p + spread))
    k = np.arange(low, high + 1, dtype=float)
    first = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(
        n - low + 1
    ) + low * math.log(p) + (n - low) * math.log1p(-p)
    steps = np.log((n - k[:-1]) / (k[:-1] + 1)) + math.log(p / (1 - p))
    return low + np.searchsorted(np.cumsum(np.exp(first + np.concatenate([[0.0], np.cumsum(steps)]))), u)


def _uniform(seed: int, rep: Column, place: int) -> Column:
    """A number between 0 and 1 from a digest, the same in any engine with md5."""
    return (
        F.conv(
            F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), F.lit(str(place)))), 1, 13),
            16,
            10
        ).cast("double") + 0.5
    ) / float(1 << 52)


def bootstrap_levels(df: DataFrame, level: str, weights: dict[int, float], reps: int, seed: int = 1) -> DataFrame:
    """rep and the mean of each resample of a column of a few integers, each weighing ``weights`` (those left out: 0).

    A resample is how often each level is drawn: a binomial number of the first, then of the next among the rest, and so on,
    by the inverse of their distribution functions.  A rep costs a number for each level, whatever the number of rows.
    """
    v = F.col(level)
    counts = [F.count_if(v == x).alias(f"c{i}") for i, x in enumerate(weights)]
    cells = df.agg(F.count(v).alias("n"), *counts)
    draws = df.sparkSession.range(0, reps, 1, max(1, reps // 2500)).withColumnRenamed("id", "rep")
    draws = draws.select("rep", *[_uniform(seed, F.col("rep"), i + 1).alias(f"u{i}") for i in range(len(weights))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f) or not f["n"].iat[0]:
                continue
            n, before = int(f["n"].iat[0]), 0
            left, total = np.full(len(f), n), np.zeros(len(f))
            for i, weight in enumerate(weights.values()):
                count, u = int(f[f"c{i}"].iat[0]), f[f"u{i}"].to_numpy()
                drawn = np.zeros(len(f), np.int64)
                for k in np.unique(left):
                    drawn[left == k] = _binomial_quantile(int(k), count / max(1, n - before), u[left == k])
                left, total, before = left - drawn, total + weight * drawn, before + count
            yield pd.DataFrame({"rep": f["rep"], "value": total / n})

    return draws.crossJoin(F.broadcast(cells)).mapInPandas(run, "rep bigint, value double")


def bootstrap_signs(df: DataFrame, value: str, reps: int, seed: int = 1) -> DataFrame:
    """The same for a column of -1, 0 and 1 (paired differences of two verdicts)."""
    return bootstrap_levels(df.select(F.signum(value).cast("int").alias("sign")), "sign", {1: 1.0, -1: -1.0}, reps, seed)

"""Mutual information of two columns against shuffles of one of them, at any number of categories.

A shuffle matters by its table of counts alone, and that has the margins of the table as it is: it is a multivariate
hypergeometric draw, which splits along a tree.  The categories of the larger margin are dealt into chunks of ``CHUNK``; for
each repetition, a chunk's counts over the smaller margin are drawn first, and the chunk's own categories within these after,
by another task.  So the table's cells never meet anywhere: what a task holds is the smaller margin and a chunk of the larger.
The observed value is a plain aggregation, and so are the sums that the repetitions come to.

``expected`` is the mean over all shuffles in closed form, from the distribution of a cell's count under given margins; equal
margins are worked out once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import numbered

#: Categories of the larger margin in a chunk; repetitions of a task; sums beyond which numpy draws no hypergeometric numbers.
CHUNK, REPS, LARGE = 4096, 20, 10**9


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Natural logarithm of n!, to double precision: a table below 64, the asymptotic series above."""
    small = np.cumsum(np.log(np.maximum(np.arange(64), 1.0)))
    x = np.maximum(np.asarray(n, float), 1.0) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / 1260 / x**2) / x**2) / x
    return np.where(np.asarray(n) < 64, small[np.minimum(np.asarray(n, np.int64), 63)], series)


def _xlogx(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1))


def draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind are among ``n`` drawn without replacement; beyond ``LARGE`` in all, normal in each split."""
    if left.sum() < LARGE:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for k, good in enumerate(left.tolist()):
        bad, want = rest - good, n - int(out.sum())
        if good + bad < LARGE:
            out[k] = rng.hypergeometric(good, bad, want) if want else 0
        else:
            p = good / rest
            spread = math.sqrt(max(0.0, want * p * (1 - p) * (rest - want) / max(1, rest - 1)))
            out[k] = min(max(round(want * p + spread * rng.standard_normal()), want - bad, 0), good, want)
        rest = bad
    return out


def _margins(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """n of each category of x and of y, the one of fewer categories last."""
    x, y = (cells.groupBy(c).agg(F.sum("n").alias("n")) for c in ("x", "y"))
    a, b = x.count(), y.count()
    return (x.select("n"), y.select("n")) if a >= b else (y.select("n"), x.select("n"))


def cells_of(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y, n of the rows that have both."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))


def observed(cells: DataFrame) -> DataFrame:
    """One row: n, mi (nats; null without rows)."""
    nat = lambda c: F.sum(F.col(c) * F.log(c))
    joint = cells.agg(F.sum("n").alias("n"), nat("n").alias("c"))
    a, b = (cells.groupBy(k).agg(F.sum("n").alias("m")).agg(nat("m").alias(k)) for k in ("x", "y"))
    s = joint.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b))  # one row each
    return s.select("n", ((F.col("c") - F.col("x") - F.col("y")) / F.col("n") + F.log("n")).alias("mi"))


def shuffled(cells: DataFrame, reps: int, seed: int = 1) -> DataFrame:
    """rep (from 1) and mi of each shuffle."""
    spark = cells.sparkSession
    larger, smaller = _margins(cells)
    # equal margins stand together: any order of the categories does
    rows = numbered(larger, "n", "at").withColumn("chunk", F.floor(F.col("at") / CHUNK))
    chunks = rows.groupBy("chunk").agg(F.array_sort(F.collect_list("n")).alias("rows"), F.sum("n").alias("size"))
    columns = np.array(sorted(r.n for r in smaller.collect()), np.int64)
    sizes = sorted((r.chunk, r.size) for r in chunks.select("chunk", "size").collect())  # a number for each CHUNK categories
    n = int(columns.sum())

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for f in frames:
            for rep in f["rep"]:
                rng, left = np.random.default_rng([seed, int(rep)]), columns
                for chunk, size in sizes:
                    got = draw(rng, left, size)
                    left = left - got
                    held.append((rep, chunk, got))
                    if len(held) * len(columns) > 1 << 20:
                        yield pd.DataFrame(held, columns=["rep", "chunk", "left"])
                        held = []
        if held:
            yield pd.DataFrame(held, columns=["rep", "chunk", "left"])

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for rep, chunk, left, own in zip(f["rep"], f["chunk"], f["left"], f["rows"], strict=True):
                rng, total, left = np.random.default_rng([seed, int(rep), int(chunk)]), 0.0, np.asarray(left, np.int64)
                for m in np.asarray(own, np.int64)[:-1]:
                    got = draw(rng, left, int(m))
                    left = left - got
                    total += _xlogx(got).sum()
                out.append((rep, total + _xlogx(left).sum()))
            yield pd.DataFrame(out, columns=["rep", "s"])

    tasks = max(1, -(-reps // REPS))
    parts = spark.range(1, reps + 1, 1, tasks).withColumnRenamed("id", "rep").mapInPandas(split, "rep long, chunk long, left array<long>")
    sums = parts.join(chunks.select("chunk", "rows"), "chunk").mapInPandas(fill, "rep long, s double")
    nat = F.sum(F.col("n") * F.log("n"))
    fixed = sum(m.agg(nat).first()[0] or 0.0 for m in (larger, smaller))
    return sums.groupBy("rep").agg(((F.sum("s") - fixed) / n + math.log(max(n, 1))).alias("mi"))


def expected(cells: DataFrame) -> DataFrame:
    """One row: ``expected``, the mean of mi over all shuffles in closed form."""
    larger, smaller = _margins(cells)
    known = smaller.groupBy("n").agg(F.count("*").alias("k")).collect()  # distinct sizes: fewer than sqrt(2 * rows)
    total = sum(r.n * r.k for r in known)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a, times in zip(f["n"].tolist(), f["k"].tolist(), strict=True):
                s = 0.0
                for r in known:
                    b = r.n
                    low, high = max(0, a + b - total), min(a, b)
                    mean = a * b / total
                    width = 14 * math.sqrt(max(mean * (1 - a / total) * (1 - b / total), 0)) + 60
                    j = np.arange(max(low, math.floor(mean - width)), min(high, math.ceil(mean + width)) + 1)
                    ways = [log_factorial(np.array(v)) for v in (a, b, total - a, total - b, total)]
                    log = ways[0] + ways[1] + ways[2] + ways[3] - ways[4]
                    log = log - log_factorial(j) - log_factorial(a - j) - log_factorial(b - j) - log_factorial(total - a - b + j)
                    s += r.k * float((np.exp(log) * _xlogx(j)).sum())
                yield pd.DataFrame({"s": [s * times]})

    sizes = larger.groupBy("n").agg(F.count("*").alias("k"))
    nat = F.sum(F.col("n") * F.log("n"))
    fixed = sum(m.agg(nat).first()[0] or 0.0 for m in (larger, smaller))
    mean = (F.sum("s") - fixed) / max(total, 1) + math.log(max(total, 1))
    return sizes.mapInPandas(each, "s double").agg(mean.alias("expected"))


def permutation_test(df: DataFrame, x: str, y: str, reps: int, seed: int = 1) -> DataFrame:
    """observed, null_mean, null_std, null_p95, null_max, p: mutual information (nats) of x and y, and with y shuffled.

    Rows without x or y don't count; without any there is no row.  Counts of margins run when called.
    """
    cells = cells_of(df, x, y)
    null = shuffled(cells, reps, seed)
    seen = observed(cells).where("mi IS NOT NULL").select(F.col("mi").alias("observed"))
    g = null.crossJoin(F.broadcast(seen)).groupBy("observed").agg(
        F.avg("mi").alias("null_mean"), F.stddev_pop("mi").alias("null_std"), F.expr("percentile(mi, 0.95D)").alias("null_p95"),
        F.max("mi").alias("null_max"), F.count_if(F.col("mi") >= F.col("observed") - 1e-12).alias("over"), F.count("*").alias("k"),
    )
    return g.select(
        "observed", "null_mean", "null_std", "null_p95", "null_max", ((F.col("over") + 1) / (F.col("k") + 1)).alias("p")
    )

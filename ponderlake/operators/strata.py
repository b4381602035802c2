"""Range bins with merging, quartiles, step buckets, and means within strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import implied_hit
from ..functions.text import bin_label
from .positions import with_quantiles

#: Edges of probability bins (the last ends above 1) and of step buckets.
BINS = ((0.0, 0.05), (0.05, 0.10), (0.10, 0.20), (0.20, 0.40), (0.40, 0.60), (0.60, 0.80), (0.80, 1.01))
STEPS = ((1, 100), (101, 200), (201, 300), (301, 400), (401, 500), (501, 600), (601, 625))
MIN_BIN = 30


def merged_bins(
    df: DataFrame, q: str, bins: Sequence[tuple[float, float]] = BINS, least: int = MIN_BIN
) -> list[tuple[float, float]]:
    """Edges after joining the lowest bins until the first has ``least`` rows; seven counts reach the driver."""
    counts = list(df.agg(*[F.count_if((F.col(q) >= a) & (F.col(q) < b)) for a, b in bins]).first())
    edges = list(bins)
    while len(edges) > 1 and counts[0] < least:
        edges[:2] = [(edges[0][0], edges[1][1])]
        counts[:2] = [counts[0] + counts[1]]
    return edges


def bin_of(q: Column, bins: Sequence[tuple[float, float]] = BINS) -> Column:
    """Label of the half-open bin, null outside; the last label is closed at 1."""
    out = None
    for a, b in bins:
        hit, name = (q >= a) & (q < b), bin_label(F.lit(a), F.lit(b), F.lit(b > 1))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def join_range_bins(df: DataFrame, q: str, bins: DataFrame) -> DataFrame:
    """Rows with the bin (low, high, label) that holds them; bins are a table of known small size."""
    return df.join(F.broadcast(bins), (F.col(q) >= F.col("low")) & (F.col(q) < F.col("high")))


def step_bucket(step: Column, buckets: Sequence[tuple[int, int]] = STEPS) -> Column:
    out = None
    for a, b in buckets:
        out = F.when(step.between(a, b), f"{a}-{b}") if out is None else out.when(step.between(a, b), f"{a}-{b}")
    return out


def bin_table(df: DataFrame, k: int = 8) -> DataFrame:
    """Fourteen statistics by initial bin; columns gold_q0/1, gold_rank0/1, top10/1, gold, control_q."""
    d = F.col("gold_q1") - F.col("gold_q0")
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(bin_of(F.col("gold_q0")).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("gold_q0").alias("initial_q"), F.avg("gold_q1").alias("final_q"), F.avg(d).alias("mean_delta"), F.avg("gold_rank0").alias(
            "initial_rank"
        ), F.avg("gold_rank1").alias("final_rank"),
        share(
            F.col("top11") == F.col("gold")
        ).alias("final_top1"), share(
            F.col("top10") == F.col("gold")
        ).alias("initial_top1"), share(d > 0).alias("increased"), share(d < 0).alias("decreased"),
        F.avg(implied_hit(F.col("gold_q0"), k)).alias("implied_hit_rate"), F.avg(1 - implied_hit(F.col("gold_q0"), k)).alias("implied_miss_rate"), F.avg(
            F.col("control_q") - F.col("gold_q0")
        ).alias("control_delta"),
    )


def hit_miss(df: DataFrame, keys: Sequence[str], hit: Column, delta: Column, least: int = 5) -> DataFrame:
    """HIT against MISS within strata; null difference and ``insufficient`` if either has under ``least`` rows."""
    x = df.groupBy(*keys).agg(
        F.count_if(hit).alias("n_hit"), F.count_if(~hit).alias("n_miss"), F.avg(F.when(hit, delta)).alias("hit_delta"),
        F.avg(F.when(~hit, delta)).alias("miss_delta")
    )
    few = (F.col("n_hit") < least) | (F.col("n_miss") < least)
    return x.withColumn(
        "difference", F.when(~few, F.col("hit_delta") - F.col("miss_delta"))
    ).withColumn("verdict", F.when(few, "insufficient").otherwise("ok"))


def arm_summary(df: DataFrame, keys: Sequence[str], q: str, rank: str, entropy: str, low: Column) -> DataFrame:
    """Distribution of gold probability by arm (and step), over all rows and over the low-support subset."""
    x = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(q).alias("mean"), F.avg((F.col(q) < 0.05).cast("double")).alias("frac_low"), F.avg(
            (F.col(rank) == 1).cast("double")
        ).alias("top1"), F.avg((F.col(rank) <= 3).cast("double")).alias("top3"),
        F.avg(entropy).alias("entropy"), F.count_if(low).alias("n_subset"), F.avg(
            F.when(low, F.col(q))
        ).alias("mean_subset"),
    )
    return with_quantiles(x, df, list(keys), {"p10": (q, 0.1), "median": (q, 0.5)})

"""Probability landscapes: scores of eight candidate labels per question, by model, in long form (id, model, gold, cand, score).

Candidates are few and fixed, so everything about a question is worked out from
one array of eight scores gathered by a single grouping; windows over
(id, model) would shuffle as much and sort besides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import with_quantiles


def softmax(scores: Column) -> Column:
    """Max-shifted softmax of an array."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(e, F.lit(0.0), lambda t, x: t + x)
    return F.transform(e, lambda x: x / total)


def dist_entropy(q: Column) -> Column:
    return -F.aggregate(q, F.lit(0.0), lambda t, x: t + x * F.log(F.greatest(x, F.lit(1e-300))))


def landscape(long: DataFrame, keys: Sequence[str] = ("id", "model"), n: int = 8) -> DataFrame:
    """Per question and model: q (array), gold_q, gold_rank (ties by label order), top1, margins, entropy and its forms."""
    got = long.groupBy(*keys, "gold").agg(F.array_sort(F.collect_list(F.struct("cand", F.col("score").cast("double").alias("score")))).alias("c"))  # n entries a row
    s = got.withColumn("s", F.transform("c", lambda x: x["score"])).withColumn("q", softmax(F.col("s")))
    gold = F.element_at("s", (F.col("gold") + 1).cast("int"))
    order = F.array_sort(F.transform("c", lambda x: F.struct((-x["score"]).alias("a"), x["cand"].alias("b"))))
    ahead = F.filter("c", lambda x: (x["score"] > gold) | ((x["score"] == gold) & (x["cand"] < F.col("gold"))))
    wrong = F.array_max(F.transform(F.filter("c", lambda x: x["cand"] != F.col("gold")), lambda x: x["score"]))
    h = dist_entropy(F.col("q"))
    s = s.withColumn("o", order)
    return s.select(
        *keys, "gold", "q", F.element_at(
            "q", (F.col("gold") + 1).cast("int")
        ).alias("gold_q"), (F.size(ahead) + 1).alias("gold_rank"), F.col("o")[0]["b"].alias("top1"),
        (
            F.col("o")[1]["a"] - F.col("o")[0]["a"]
        ).alias("top1_margin"), (gold - wrong).alias("gold_margin"), h.alias("entropy"), (h / math.log(n)).alias(
            "normalized_entropy"
        ), F.exp(h).alias("effective"),
    )


def aggregate(ls: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    shares = {"p10": 0.1, "p25": 0.25, "median_gold_q": 0.5, "p75": 0.75, "p90": 0.9}
    x = ls.groupBy(*keys).agg(
        F.count("*").alias("n"), share(
            F.col("top1") == F.col("gold")
        ).alias("top1_accuracy"), F.avg("gold_q").alias("mean_gold_q"), share(
            F.col("gold_rank") <= 2
        ).alias("top2"), share(F.col("gold_rank") <= 3).alias("top3"),
        F.avg("gold_margin").alias("mean_gold_margin"), F.avg("top1_margin").alias("mean_top1_margin"), F.avg("normalized_entropy").alias(
            "mean_normalized_entropy"
        ),
    )
    wanted = {n: ("gold_q", p) for n, p in shares.items()} | {"median_gold_margin": ("gold_margin", 0.5)}
    return with_quantiles(x, ls, list(keys), wanted)


def pair(ls: DataFrame, a: str, b: str, columns: Sequence[str]) -> DataFrame:
    """One row for each question with the columns of two models (suffixes 0 and 1); a conditional aggregate, no self-join."""
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    return ls.where(F.col("model").isin(a, b)).groupBy("id", "gold").agg(
        *[pick(m, c).alias(f"{c}{i}") for i, m in enumerate((a, b)) for c in columns]
    )


def mass_by_class(ls: DataFrame) -> DataFrame:
    """Mean q of each candidate, overall (gold null) and by gold class, by model."""
    x = ls.select("model", "gold", F.posexplode("q").alias("cand", "q"))
    return x.groupingSets(
        [["model", "cand"], ["model", "gold", "cand"]], "model", "gold", "cand"
    ).agg(F.avg("q").alias("mean_q"))


def gate(ls: DataFrame) -> DataFrame:
    """One row: all finite, probabilities sum to 1, ranks in bounds."""
    total = F.aggregate("q", F.lit(0.0), lambda t, x: t + x)
    return ls.agg(
        F.bool_and(~F.isnan("entropy") & F.col("gold_q").isNotNull()).alias("finite"),
        F.bool_and(total.between(0.999, 1.001)).alias("sums"),
        F.bool_and(F.col("gold_rank").between(1, F.size("q"))).alias("ranks")
    )

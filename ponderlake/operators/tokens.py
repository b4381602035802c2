"""Token log-probabilities: sequences, losses under both normalisations, audits of two models on the same tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T


def sequence_stats(df: DataFrame, n: Column, new: str, old: str, reference: str, clip: float = 0.2) -> DataFrame:
    """``df`` with sums and means of each sequence over its first ``n`` tokens.

    n_tokens, logp, logp_mean, ratio_mean, ratio_max, clip_fraction, kl (k3, mean).
    """
    x = df.withColumn("n_tokens", n).withColumn("__r", T.ratios(F.col(new), F.col(old)))
    m = F.col("n_tokens")
    return x.withColumns({
        "logp": T.total(F.col(new), m), "logp_mean": T.mean(F.col(new), m), "ratio_mean": T.mean(F.col("__r"), m),
        "ratio_max": F.array_max(F.slice("__r", F.lit(1), m)), "clip_fraction": T.mean(T.clipped(F.col("__r"), clip), m),
        "kl": T.mean(T.k3(F.col(new), F.col(reference)), m),
    }).drop("__r")


def policy_loss(
    df: DataFrame, n: Column, new: str, old: str, reference: str, advantage: str, beta: float = 0.0, clip: float = 0.2,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Loss by token (summed over all tokens, over their number) and by sequence (means of sequences, averaged).

    sequences (empty ones are none), tokens, token_loss, sequence_loss, kl (by token), clip_fraction (by token).
    A mean of what each task sums: no sequence is moved.
    """
    ratio = T.ratios(F.col(new), F.col(old))
    penalty = T.k3(F.col(new), F.col(reference))
    x = df.select(
        *keys, n.alias("n"), T.total(T.surrogate(ratio, F.col(advantage), clip), n).alias("s"), T.total(penalty, n).alias("k"),
        T.total(T.clipped(ratio, clip), n).alias("c"),
    ).where("n > 0")
    loss = F.col("s") + beta * F.col("k")
    per = lambda c: F.try_divide(F.sum(c), F.sum("n"))
    return x.groupBy(*keys).agg(
        F.count("*").alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), per(loss).alias("token_loss"),
        F.avg(loss / F.col("n")).alias("sequence_loss"), per(F.col("k")).alias("kl"), per(F.col("c")).alias("clip_fraction"),
    )


def reference_audit(df: DataFrame, n: Column, policy: str, reference: str, tolerance: float = 1e-6) -> DataFrame:
    """Each sequence's two models on the same tokens: mean and largest difference, divergence, first token that differs.

    first_divergence is the number of tokens before it, null if none differs by more than ``tolerance``.
    """
    d = T.apart(F.col(policy), F.col(reference))
    x = df.withColumn("n_tokens", n).where("n_tokens > 0").withColumn("__d", F.slice(d, F.lit(1), F.col("n_tokens")))
    at = F.array_position(F.transform("__d", lambda v: v > tolerance), True)
    m = F.col("n_tokens")
    return x.withColumns({
        "mean_abs_diff": T.mean(F.col("__d"), m), "max_abs_diff": F.array_max("__d"),
        "initial_kl": T.mean(T.k3(F.col(policy), F.col(reference)), m),
        "first_divergence": F.when(at > 0, at.cast("int") - 1),
    }).drop("__d")


def audit_summary(audited: DataFrame, limit: float = 1e-3) -> DataFrame:
    """One row over all tokens, and whether training may proceed: no difference above ``limit``."""
    m = F.col("n_tokens")
    per = lambda c: F.try_divide(F.sum(F.col(c) * m), F.sum(m))
    most = F.coalesce(F.max("max_abs_diff"), F.lit(0.0))
    return audited.agg(
        F.count("*").alias("sequences"), F.coalesce(per("mean_abs_diff"), F.lit(0.0)).alias("mean_abs_diff"),
        most.alias("max_abs_diff"), F.coalesce(per("initial_kl"), F.lit(0.0)).alias("initial_kl"),
        F.count("first_divergence").alias("diverging"), (most <= limit).alias("ok"),
    )


def first_divergence(
    a: DataFrame, b: DataFrame, keys: Sequence[str], pos: str, token: str, block: int = 1024
) -> DataFrame:
    """keys, common_prefix, a_tokens, b_tokens of pairs of sequences of any length, given as rows of tokens.

    Blocks of positions are compared by digest; only rows of each pair's first differing block meet.  A sequence that is in
    one table alone has no common prefix with the other's nothing.
    """
    g = [*keys, "__b"]
    at = F.floor(F.col(pos) / block).alias("__b")

    def digests(df: DataFrame, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(pos, token)))  # a block at most
        return df.groupBy(*keys, at).agg(F.md5(F.to_json(rows)).alias(name), F.count("*").alias(f"n_{name}"))

    both = digests(a, "x").join(digests(b, "y"), g, "full")
    first = F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("__b"))).alias("first")
    sizes = both.groupBy(*keys).agg(
        first, F.sum(F.coalesce("n_x", F.lit(0))).alias("a_tokens"), F.sum(F.coalesce("n_y", F.lit(0))).alias("b_tokens")
    )
    where = sizes.where("first IS NOT NULL").select(*keys, F.col("first").alias("__b"))
    x, y = (df.select(*keys, at, F.col(pos).alias("__p"), F.col(token).alias(name)).join(where, g) for df, name in ((a, "__x"), (b, "__y")))
    met = x.join(y, [*g, "__p"], "full").where(~F.col("__x").eqNullSafe(F.col("__y")))
    differ = met.groupBy(*keys).agg(F.min("__p").alias("__at"))
    same = F.least("a_tokens", "b_tokens")
    return sizes.join(differ, list(keys), "left").select(
        *keys, F.least(F.coalesce("__at", same), same).alias("common_prefix"), "a_tokens", "b_tokens"
    )

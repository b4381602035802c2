"""Grouped rollouts: group scalars, summaries, advantages, rescue by a finer reward, partition counterfactuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZERO = 1e-12


def rollout_group(
    rollouts: DataFrame, group: str = "id", reward: str = "reward", answer: str | None = "answer"
) -> DataFrame:
    """Scalars of each group; one shuffle, partial aggregation first."""
    r = F.col(reward)
    extra = [
        F.count_distinct(answer).alias("unique_answer_count"), F.count(answer).alias("parse_success_count")
    ] if answer else []
    g = rollouts.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(r).alias("reward_mean"), F.stddev_pop(r).alias("reward_std"),
        F.count_if(r == 1).alias("correct_count"), *extra
    )
    g = g.withColumn("all_wrong", F.col("correct_count") == 0).withColumn(
        "all_correct", F.col("correct_count") == F.col("n")
    )
    g = g.withColumn("zero_variance", F.col("reward_std") * F.col("reward_std") <= ZERO)
    return g.withColumn("mixed_reward", ~F.col("all_wrong") & ~F.col("all_correct"))


def rollout_summary(groups: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pass rate, shares of group states and averages over groups."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return groups.groupBy(*keys).agg(
        F.count("*").alias("groups"), F.avg("reward_mean").alias("mean_reward"), F.avg("reward_std").alias("mean_std"), share("all_wrong").alias("all_wrong_ratio"), share("all_correct").alias(
            "all_correct_ratio"
        ),
        share("mixed_reward").alias("mixed_ratio"), share("zero_variance").alias("zero_variance_ratio"), (
            1 - share("all_wrong")
        ).alias("pass_at_k"), F.avg("correct_count").alias("avg_correct"),
    )


def state(correct: Column, n: Column) -> Column:
    """all-correct, all-wrong or mixed, checked in that order."""
    return F.when(correct == n, "all-correct").when(correct == 0, "all-wrong").otherwise("mixed")


def advantage(
    rollouts: DataFrame, mode: str, group: Sequence[str] = ("id",), reward: str = "reward", eps: float | None = None,
    name: str = "advantage"
) -> DataFrame:
    """Group-normalised advantage by one of four conventions.

    population: (r - mean) / (population deviation + 1e-8); population_masked: 0 where the deviation is below eps;
    sample: (r - mean) / (sample deviation + 1e-4), deviation 0 for one row; noeps: (r - mean) / sample deviation, 0 without any.
    """
    w = Window.partitionBy(*group)
    r, mean = F.col(reward), F.avg(reward).over(w)
    pop, samp = F.stddev_pop(reward).over(w), F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0))
    if mode == "population":
        out = (r - mean) / (pop + F.lit(eps if eps is not None else 1e-8))
    elif mode == "population_masked":
        e = eps if eps is not None else 1e-8
        out = F.when(pop < e, F.lit(0.0)).otherwise((r - mean) / (pop + F.lit(e)))
    elif mode == "sample":
        out = (r - mean) / (samp + F.lit(eps if eps is not None else 1e-4))
    elif mode == "noeps":
        out = _noeps(r, mean, samp)
    else:
        raise ValueError(f"unknown advantage mode {mode!r}")
    return rollouts.withColumn(name, out)


def _noeps(r: Column, mean: Column, samp: Column) -> Column:
    return F.when(samp <= ZERO, F.lit(0.0)).otherwise(F.try_divide(r - mean, samp))


def rescue(
    rollouts: DataFrame, group: str = "id", exact: str = "reward", shaped: str = "shaped", min_advantage: float = 1e-3
) -> DataFrame:
    """Per group: whether all are wrong, and whether the shaped reward then still separates them."""
    s = F.round(F.col(shaped), 6)
    g = rollouts.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(F.col(exact) == 1).alias("correct"), F.count_distinct(s).alias("unique_values"), F.coalesce(
            F.stddev_samp(shaped), F.lit(0.0)
        ).alias("shaped_std"),
        F.avg(shaped).alias("mean"), F.min(shaped).alias("low"), F.max(shaped).alias("high"),
    )
    top = F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low")) / (F.col("shaped_std") + 1e-4)
    g = g.withColumn("max_abs_advantage", top).withColumn("all_wrong", F.col("correct") == 0)
    ok = F.col("all_wrong") & (F.col("unique_values") > 1) & (F.col("shaped_std") > 1e-6) & (
        F.col("max_abs_advantage") > min_advantage
    )
    return g.withColumn("rescued", ok).select(
        group, "n", "correct", "unique_values", "shaped_std", "max_abs_advantage", "all_wrong", "rescued"
    )


def reward_values(rollouts: DataFrame, keys: Sequence[str], reward: str) -> DataFrame:
    r = F.round(F.col(reward), 6)
    return rollouts.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(reward).alias("mean"), F.stddev_samp(reward).alias("std"),
        F.count_distinct(r).alias("distinct_values")
    )


def halves(member: Column, size: Column) -> dict[str, Column]:
    """Three ways to split a group of any size: which half (0 or 1) a member, numbered from 0, is in."""
    inner = (4 * member >= size) & (4 * member < 3 * size)
    return {
        "first_last": (2 * member >= size).cast("int"), "even_odd": (member % 2).cast("int"),
        "outer_inner": inner.cast("int")
    }


def partition_advantages(
    rollouts: DataFrame, group: str = "id", member: str = "k", reward: str = "reward", least: int = 4
) -> DataFrame:
    """Each member under each way to split its group: ``partition``, a16 (whole-group advantage) and a8 (its half's).

    Groups of under ``least`` give no row: a half of one member has no deviation.  Members are numbered from 0.

    Halves are aggregated by condition over the group's own window: rows are put in order once, before they are multiplied.
    """
    w = Window.partitionBy(group)
    whole = rollouts.select(group, member, reward).withColumn("size", F.count("*").over(w))
    whole = advantage(whole.where(F.col("size") >= least), "noeps", (group,), reward, name="a16")
    ways, columns, r = [], {}, F.col(reward)
    for n, half in halves(F.col(member), F.col("size")).items():
        for side in (0, 1):
            own = F.when(half == side, r)
            columns[f"__{n}_{side}"] = F.struct(
                F.avg(own).over(w).alias("mean"), F.coalesce(F.stddev_samp(own).over(w), F.lit(0.0)).alias("dev")
            )
        of = lambda f, n=n, half=half: F.when(half == 0, F.col(f"__{n}_0.{f}")).otherwise(F.col(f"__{n}_1.{f}"))
        ways.append(F.struct(F.lit(n).alias("partition"), half.alias("half"), _noeps(r, of("mean"), of("dev")).alias("a8")))
    x = whole.withColumns(columns).select("*", F.explode(F.array(*ways)).alias("way"))
    return x.select(group, member, reward, "a16", "way.*")


def partition_counterfactual(
    rollouts: DataFrame, group: str = "id", member: str = "k", reward: str = "reward", least: int = 4
) -> DataFrame:
    """Whole-group advantages against those of two halves, for each of the ways to split.

    All members of a group take part.
    """
    x = partition_advantages(rollouts, group, member, reward, least)
    d, a, b = F.col("a16") - F.col("a8"), F.col("a16"), F.col("a8")
    positive = lambda c: F.coalesce(F.sum(F.when(c > ZERO, c)), F.lit(0.0))
    negative = lambda c: F.coalesce(F.sum(F.when(c < -ZERO, -c)), F.lit(0.0))
    norm = F.sqrt(F.sum(a * a) * F.sum(b * b))
    return x.groupBy(group, "partition").agg(
        F.sum(F.col(reward)).cast("long").alias("m_correct"), F.avg(F.abs(d)).alias(
            "mean_abs_delta"
        ), F.max(F.abs(d)).alias("max_abs_delta"), F.sum(F.abs(d)).alias("l1"), F.sqrt(F.sum(d * d)).alias("l2"),
        F.try_divide(
            F.sum(a * b), F.nullif(norm, F.lit(0.0))
        ).alias("cosine"), positive(a).alias(
            "k16_positive"
        ), positive(b).alias("k8_positive"), negative(a).alias("k16_negative"), negative(b).alias("k8_negative"),
        F.count_if(F.abs(a) > ZERO).alias("k16_nonzero"), F.count_if(F.abs(b) > ZERO).alias("k8_nonzero"),
        F.count_if(
            (F.abs(b) <= ZERO) & (a < -ZERO) & (F.col(reward) == 0)
        ).alias("newly_nonzero_wrong"), F.count_if(
            (F.abs(b) <= ZERO) & (a > ZERO) & (F.col(reward) == 1)
        ).alias("newly_nonzero_correct"),
    )


def make_partitions(rollouts: DataFrame, group: str = "id", member: str = "k", n: int = 20, seed: int = 1) -> DataFrame:
    """Each member with ``partition`` and ``half``: the first half against the last, and ``n`` shuffles by digests.

    A group's members are one array, sorted by digest for each shuffle: one shuffle of rows whatever ``n``.
    """
    others = [c for c in rollouts.columns if c not in (group, member)]
    members = F.array_sort(F.collect_list(F.struct(member, *others))).alias("__m")
    g = rollouts.groupBy(group).agg(members)
    digest = lambda begin, x: F.md5(F.concat_ws(":", begin, x[member].cast("string")))
    # sort_array compares as such, array_sort by a lambda; what a shuffle's digests begin with is written once
    ordered = lambda begin: F.sort_array(F.transform("__m", lambda x: F.struct(digest(begin, x).alias("__d"), x.alias("x"))))["x"]
    begin = lambda p: F.concat_ws(":", F.lit(str(seed)), p.cast("string"), F.col(group).cast("string"))
    place = lambda p: F.get(F.transform(F.array(begin(p)), ordered), F.lit(0))
    plain = F.struct(F.lit("first_last").alias("partition"), F.col("__m").alias("m"))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.struct(
        F.format_string("rand%02d", p).alias("partition"), place(p).alias("m")
    ))
    x = g.select(group, F.explode(F.concat(F.array(plain), drawn) if n else F.array(plain)).alias("w"))
    x = x.select(group, "w.partition", F.size("w.m").alias("__n"), F.posexplode("w.m").alias("__at", "x"))
    half = (2 * F.col("__at") >= F.col("__n")).cast("int").alias("half")
    return x.select(group, "x.*", "partition", half)


def step_group_stats(
    rollouts: DataFrame, step: str = "step", group: str = "id", exact: str = "reward", shaped: str = "shaped"
) -> DataFrame:
    """Per step: exact and shaped rewards, and shares of group states, in two levels."""
    g = rollouts.groupBy(step, group).agg(
        F.count("*").alias("n"), F.count_if(F.col(exact) == 1).alias("c"), F.sum(exact).alias("e"),
        F.sum(shaped).alias("s"), F.count_distinct(F.round(shaped, 6)).alias("u")
    )
    wrong = F.col("c") == 0
    return g.groupBy(step).agg(
        F.count("*").alias("groups"), (
            F.sum("e") / F.sum("n")
        ).alias("exact_reward_mean"), (
            F.sum("s") / F.sum("n")
        ).alias("shaped_reward_mean"), F.count_if(wrong).alias("all_wrong_groups"),
        F.count_if(
            F.col("c") == F.col("n")
        ).alias("all_correct_groups"), F.count_if(wrong & (F.col("u") > 1)).alias("rescued_groups"),
    )


def repeat_k(df: DataFrame, k: int) -> DataFrame:
    """Each row k times, numbered."""
    return df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def consecutive_groups(rows: DataFrame, pos: str, size: int, prompt: str) -> DataFrame:
    """Blocks of ``size`` consecutive positions and whether each holds one prompt only."""
    return rows.groupBy(F.floor(F.col(pos) / size).alias("block")).agg(
        F.count("*").alias("n"), F.count_distinct(prompt).alias("prompts")
    ).withColumn("aligned", F.col("prompts") == 1)

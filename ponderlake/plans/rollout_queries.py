"""Queries over grouped rollouts: group scalars, summaries, advantages, rescue, partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy, text
from ..functions.statistics import wilson_ci
from ..operators import audit, groups, positions
from .base import ROLL_SQL, plain_rollouts, rollouts
from .registry import query, read

R6 = lambda c: F.round(c, 6)
WITH = f"WITH {ROLL_SQL}"
GROUP_SQL = f"""{WITH}, g AS (SELECT id, count(*) AS n, avg(reward) AS reward_mean, stddev_pop(reward) AS reward_std, count(*) FILTER (reward = 1) AS correct_count,
 count(DISTINCT answer) AS unique_answer_count, count(answer) AS parse_success_count FROM roll GROUP BY id)"""
GROUP_COLS = "id, n, round(reward_mean, 6) AS reward_mean, round(reward_std, 6) AS reward_std, correct_count, unique_answer_count, parse_success_count, correct_count = 0 AS all_wrong, correct_count = n AS all_correct, reward_std * reward_std <= 1e-12 AS zero_variance, correct_count > 0 AND correct_count < n AS mixed_reward"


@query("agg_rollout_group", f"{GROUP_SQL} SELECT {GROUP_COLS} FROM g")
def agg_rollout_group(spark, d):
    return groups.rollout_group(plain_rollouts(spark, d)).withColumns(
        {"reward_mean": R6(F.col("reward_mean")), "reward_std": R6(F.col("reward_std"))}
    )


@query("agg_rollout_summary", f"""{GROUP_SQL} SELECT count(*) AS groups, round(avg(reward_mean), 6) AS mean_reward, round(avg(reward_std), 6) AS mean_std, round(avg(CAST(correct_count = 0 AS INT)), 6) AS all_wrong_ratio,
 round(avg(CAST(correct_count = n AS INT)), 6) AS all_correct_ratio, round(avg(CAST(correct_count > 0 AND correct_count < n AS INT)), 6) AS mixed_ratio, round(avg(CAST(reward_std * reward_std <= 1e-12 AS INT)), 6) AS zero_variance_ratio,
 round(1 - avg(CAST(correct_count = 0 AS INT)), 6) AS pass_at_k, round(avg(correct_count), 6) AS avg_correct FROM g""")
def agg_rollout_summary(spark, d):
    s = groups.rollout_summary(groups.rollout_group(plain_rollouts(spark, d)))
    return s.select("groups", *[R6(F.col(c)).alias(c) for c in s.columns if c != "groups"])


@query("correct_count_histogram", f"""{GROUP_SQL}, k AS (SELECT unnest(range(17)) AS correct_count), h AS (SELECT correct_count, count(*) AS n FROM g GROUP BY 1)
 SELECT k.correct_count, coalesce(h.n, 0) AS n FROM k LEFT JOIN h USING (correct_count)""")
def correct_count_histogram(spark, d):
    g = groups.rollout_group(plain_rollouts(spark, d)).groupBy("correct_count").agg(F.count("*").alias("n"))
    return spark.range(17).withColumnRenamed("id", "correct_count").join(g, "correct_count", "left").select(
        "correct_count", F.coalesce("n", F.lit(0)).alias("n")
    )


STATE_SQL = f"{GROUP_SQL}, s AS (SELECT id, n, correct_count, CASE WHEN correct_count = n THEN 'all-correct' WHEN correct_count = 0 THEN 'all-wrong' ELSE 'mixed' END AS state FROM g)"


@query(
    "agg_state",
    f"{STATE_SQL} SELECT state, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rollouts FROM s GROUP BY state"
)
def agg_state(spark, d):
    g = groups.rollout_group(plain_rollouts(spark, d)).withColumn(
        "state", groups.state(F.col("correct_count"), F.col("n"))
    )
    return g.groupBy("state").agg(F.count("*").alias("groups"), F.sum("n").alias("rollouts"))


@query("agg_state_transition", f"""{WITH}, t AS (SELECT id, count(*) FILTER (k % 2 = 0) AS n0, count(*) FILTER (k % 2 = 0 AND reward = 1) AS c0, count(*) FILTER (k % 2 = 1) AS n1, count(*) FILTER (k % 2 = 1 AND reward = 1) AS c1 FROM roll GROUP BY id)
 SELECT before, after, count(*) AS n FROM (SELECT CASE WHEN c0 = n0 THEN 'all-correct' WHEN c0 = 0 THEN 'all-wrong' ELSE 'mixed' END AS before, CASE WHEN c1 = n1 THEN 'all-correct' WHEN c1 = 0 THEN 'all-wrong' ELSE 'mixed' END AS after FROM t WHERE n1 > 0) GROUP BY ALL""")
def agg_state_transition(spark, d):
    r, odd = rollouts(spark, d), F.col("k") % 2 == 1
    right = F.col("reward") == 1
    t = r.groupBy("id").agg(
        F.count_if(~odd).alias("n0"), F.count_if(~odd & right).alias("c0"), F.count_if(odd).alias("n1"),
        F.count_if(odd & right).alias("c1")
    ).where("n1 > 0")
    return t.groupBy(
        groups.state(F.col("c0"), F.col("n0")).alias("before"), groups.state(F.col("c1"), F.col("n1")).alias("after")
    ).agg(F.count("*").alias("n"))


@query("agg_behavior", f"""{WITH}, g AS (SELECT l_linestatus AS arm, id, count(*) AS n, count(*) FILTER (reward = 1) AS c FROM roll JOIN (SELECT l_orderkey AS id, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1) USING (id) GROUP BY ALL)
 SELECT arm, count(*) AS groups, round(avg(c / n), 6) AS mean_accuracy, round(avg(CAST(c > 0 AS INT)), 6) AS pass_at_k, round(avg(CAST(c = n AS INT)), 6) AS all_correct FROM g GROUP BY arm""")
def agg_behavior(spark, d):
    arm = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_linestatus").alias("arm"))
    g = groups.rollout_group(plain_rollouts(spark, d)).join(arm, "id")
    share = lambda c: R6(F.avg(c.cast("double")))
    return g.groupBy("arm").agg(
        F.count("*").alias("groups"),
        R6(F.avg(F.col("correct_count") / F.col("n"))).alias("mean_accuracy"),
        share(~F.col("all_wrong")).alias("pass_at_k"),
        share(F.col("all_correct")).alias("all_correct")
    )


@query(
    "agg_class_rollout_accuracy",
    f"{WITH} SELECT gold, CAST(sum(reward) AS BIGINT) AS correct, count(*) AS rollouts, round(sum(reward) / count(*), "
    f"6) AS rollout_accuracy, count(DISTINCT id) AS support_prompts FROM roll GROUP BY gold"
)
def agg_class_rollout_accuracy(spark, d):
    g = plain_rollouts(spark, d).groupBy("gold", "id").agg(F.sum("reward").alias("c"), F.count("*").alias("n"))
    return g.groupBy("gold").agg(
        F.sum("c").cast("long").alias("correct"), F.sum("n").alias("rollouts"),
        R6(F.sum("c") / F.sum("n")).alias("rollout_accuracy"), F.count("*").alias("support_prompts")
    )


@query("agg_composition", f"""{WITH}, g AS (SELECT id, count(*) AS n, CAST(sum(reward) AS BIGINT) AS m FROM roll GROUP BY id)
 SELECT n, m, count(*) AS groups, round(sum(CASE WHEN m > 0 AND m < n THEN m * ((1 - m / n) / sqrt(m * (n - m) / (n * (n - 1)))) ELSE 0 END), 5) AS positive_weight FROM g GROUP BY n, m""")
def agg_composition(spark, d):
    g = plain_rollouts(spark, d).groupBy("id").agg(F.count("*").alias("n"), F.sum("reward").cast("long").alias("m"))
    one = g.groupBy("n", "m").agg(F.count("*").alias("groups"))
    mixed = (F.col("m") > 0) & (F.col("m") < F.col("n"))
    std = F.sqrt(F.col("m") * (F.col("n") - F.col("m")) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0)))
    each = F.when(mixed, F.col("m") * ((1 - F.col("m") / F.col("n")) / std)).otherwise(0.0)
    return one.withColumn("positive_weight", F.round(F.col("groups") * each, 5))


@query("set_distinct_groups", f"{WITH} SELECT id, count(DISTINCT answer) AS distinct_answers FROM roll GROUP BY id")
def set_distinct_groups(spark, d):
    return plain_rollouts(spark, d).groupBy("id").agg(F.count_distinct("answer").alias("distinct_answers"))


@query("repeat_k", "SELECT c_custkey AS id, CAST(k AS INT) AS k FROM customer, (SELECT unnest(range(4)) AS k)")
def repeat_k(spark, d):
    return groups.repeat_k(read(spark, d, "customer").select(F.col("c_custkey").alias("id")), 4)


@query(
    "consecutive_groups",
    "SELECT CAST(floor((o_orderkey - 1) / 8) AS BIGINT) AS block, count(*) AS n, count(DISTINCT o_custkey % 3) AS "
    "prompts, count(DISTINCT o_custkey % 3) = 1 AS aligned FROM orders GROUP BY 1"
)
def consecutive_groups(spark, d):
    o = read(spark, d, "orders").select(
        (F.col("o_orderkey") - 1).alias("pos"), (F.col("o_custkey") % 3).alias("prompt")
    )
    return groups.consecutive_groups(o, "pos", 8, "prompt")


_ADV = {
    "pop": ("population", "(reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-8)"),
    "pop_masked": (
        "population_masked",
        "CASE WHEN stddev_pop(reward) OVER w < 1e-8 THEN 0.0::DOUBLE ELSE (reward - avg(reward) OVER w) / "
        "(stddev_pop(reward) OVER w + 1e-8) END"
    ),
    "sample": ("sample", "(reward - avg(reward) OVER w) / (coalesce(stddev_samp(reward) OVER w, 0) + 1e-4)"),
    "noeps": (
        "noeps",
        "CASE WHEN coalesce(stddev_samp(reward) OVER w, 0) <= 1e-12 THEN 0.0::DOUBLE ELSE (reward - avg(reward) OVER w) "
        "/ stddev_samp(reward) OVER w END"
    ),
}


def _advantage(name: str, mode: str, sql: str) -> None:
    @query(
        f"group_advantage_{name}",
        f"{WITH} SELECT id, k, round({sql}, 5) + 0.0 AS advantage FROM roll WINDOW w AS (PARTITION BY id)"
    )
    def run(spark, d):
        return groups.advantage(rollouts(spark, d), mode).select(
            "id", "k", (F.round("advantage", 5) + 0.0).alias("advantage")
        )


for _n, (_m, _s) in _ADV.items():
    _advantage(_n, _m, _s)

RESCUE_SQL = f"""{WITH}, g AS (SELECT id, count(*) AS n, count(*) FILTER (reward = 1) AS correct, count(DISTINCT round(shaped, 6)) AS unique_values, coalesce(stddev_samp(shaped), 0) AS sd,
 greatest(max(shaped) - avg(shaped), avg(shaped) - min(shaped)) / (coalesce(stddev_samp(shaped), 0) + 1e-4) AS top FROM roll GROUP BY id),
 r AS (SELECT *, correct = 0 AND unique_values > 1 AND sd > 1e-6 AND top > 1e-3 AS rescued FROM g)"""


@query(
    "agg_rescue",
    f"{RESCUE_SQL} SELECT id, n, correct, unique_values, round(sd, 6) AS shaped_std, round(top, 5) AS "
    f"max_abs_advantage, correct = 0 AS all_wrong, rescued FROM r"
)
def agg_rescue(spark, d):
    return groups.rescue(plain_rollouts(spark, d)).withColumns(
        {"shaped_std": R6(F.col("shaped_std")), "max_abs_advantage": F.round("max_abs_advantage", 5)}
    )


@query("gate_decision", f"""{RESCUE_SQL}, t AS (SELECT count(*) FILTER (correct = 0) AS all_wrong, count(*) FILTER (rescued) AS rescued FROM r)
 SELECT all_wrong, rescued, round(rescued / nullif(all_wrong, 0), 6) AS rate, CASE WHEN rescued / nullif(all_wrong, 0) < 0.10 THEN 'H2_INTERVENTION_WEAK_STOP' WHEN rescued / nullif(all_wrong, 0) > 0.25 THEN 'CONTINUE_TO_PHASE_B' ELSE 'BORDERLINE_REVIEW' END AS decision FROM t""")
def gate_decision(spark, d):
    t = groups.rescue(plain_rollouts(spark, d)).agg(
        F.count_if(F.col("all_wrong")).alias("all_wrong"), F.count_if(F.col("rescued")).alias("rescued")
    )
    rate = audit.rescue_rate(F.col("rescued"), F.col("all_wrong"))
    return t.select("all_wrong", "rescued", R6(rate).alias("rate"), audit.decision(rate).alias("decision"))


@query("wilson_ci", f"""{RESCUE_SQL}, t AS (SELECT n, CAST(count(*) FILTER (correct = 0) AS DOUBLE) AS a, count(*) FILTER (rescued) AS h FROM r GROUP BY n), p AS (SELECT n, a, h, h / nullif(a, 0) AS p FROM t)
 SELECT n, CAST(a AS BIGINT) AS all_wrong, h AS rescued, CASE WHEN a > 0 THEN round(greatest(0, (p + 1.96 * 1.96 / (2 * a) - 1.96 * sqrt(p * (1 - p) / a + 1.96 * 1.96 / (4 * a * a))) / (1 + 1.96 * 1.96 / a)), 6) END AS low,
 CASE WHEN a > 0 THEN round(least(1, (p + 1.96 * 1.96 / (2 * a) + 1.96 * sqrt(p * (1 - p) / a + 1.96 * 1.96 / (4 * a * a))) / (1 + 1.96 * 1.96 / a)), 6) END AS high FROM p""")
def wilson(spark, d):
    t = groups.rescue(plain_rollouts(spark, d)).groupBy("n").agg(
        F.count_if(F.col("all_wrong")).alias("all_wrong"), F.count_if(F.col("rescued")).alias("rescued")
    )
    low, high = wilson_ci(F.col("rescued"), F.col("all_wrong"))
    return t.select("n", "all_wrong", "rescued", R6(low).alias("low"), R6(high).alias("high"))


@query(
    "agg_reward_values",
    f"{WITH} SELECT gold, count(*) AS n, round(avg(shaped), 6) AS mean, round(stddev_samp(shaped), 6) AS std, "
    f"count(DISTINCT round(shaped, 6)) AS distinct_values FROM roll GROUP BY gold"
)
def agg_reward_values(spark, d):
    x = groups.reward_values(plain_rollouts(spark, d), ["gold"], "shaped")
    return x.withColumns({"mean": R6(F.col("mean")), "std": R6(F.col("std"))})


@query("agg_step_group_stats", f"""{WITH}, g AS (SELECT step, id, count(*) AS n, count(*) FILTER (reward = 1) AS c, sum(reward) AS e, sum(shaped) AS s, count(DISTINCT round(shaped, 6)) AS u FROM roll GROUP BY step, id)
 SELECT step, count(*) AS groups, round(sum(e) / sum(n), 6) AS exact_reward_mean, round(sum(s) / sum(n), 6) AS shaped_reward_mean, count(*) FILTER (c = 0) AS all_wrong_groups, count(*) FILTER (c = n) AS all_correct_groups, count(*) FILTER (c = 0 AND u > 1) AS rescued_groups FROM g GROUP BY step""")
def agg_step_group_stats(spark, d):
    x = groups.step_group_stats(plain_rollouts(spark, d))
    return x.withColumns({c: R6(F.col(c)) for c in ("exact_reward_mean", "shaped_reward_mean")})


# whole groups of four completions and more, split into two halves in three ways
_HALVES = "(VALUES ('first_last'), ('even_odd'), ('outer_inner')) AS v(partition)"
_HALF = "CASE partition WHEN 'first_last' THEN CAST(2 * k >= size AS INT) WHEN 'even_odd' THEN k % 2 ELSE CAST(4 * k >= size AND 4 * k < 3 * size AS INT) END"
PART_SQL = f"""{WITH}, r8 AS (SELECT * FROM (SELECT id, k, reward, count(*) OVER (PARTITION BY id) AS size FROM roll) WHERE size >= 4),
 w AS (SELECT *, CASE WHEN stddev_samp(reward) OVER g <= 1e-12 THEN 0.0::DOUBLE ELSE (reward - avg(reward) OVER g) / stddev_samp(reward) OVER g END AS a FROM r8 WINDOW g AS (PARTITION BY id)),
 x AS (SELECT id, partition, reward, a, CASE WHEN stddev_samp(reward) OVER h <= 1e-12 THEN 0.0::DOUBLE ELSE (reward - avg(reward) OVER h) / stddev_samp(reward) OVER h END AS b FROM (SELECT *, {_HALF} AS half FROM w CROSS JOIN {_HALVES}) WINDOW h AS (PARTITION BY id, partition, half)),
 pc AS (SELECT id, partition, CAST(sum(reward) AS BIGINT) AS m_correct, avg(abs(a - b)) AS mean_abs_delta, max(abs(a - b)) AS max_abs_delta, sum(abs(a - b)) AS l1, sqrt(sum((a - b) * (a - b))) AS l2, sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0) AS cosine,
 coalesce(sum(a) FILTER (a > 1e-12), 0) AS k16_positive, coalesce(sum(b) FILTER (b > 1e-12), 0) AS k8_positive, coalesce(sum(-a) FILTER (a < -1e-12), 0) AS k16_negative, coalesce(sum(-b) FILTER (b < -1e-12), 0) AS k8_negative,
 count(*) FILTER (abs(a) > 1e-12) AS k16_nonzero, count(*) FILTER (abs(b) > 1e-12) AS k8_nonzero, count(*) FILTER (abs(b) <= 1e-12 AND a < -1e-12 AND reward = 0) AS newly_nonzero_wrong, count(*) FILTER (abs(b) <= 1e-12 AND a > 1e-12 AND reward = 1) AS newly_nonzero_correct FROM x GROUP BY id, partition)"""
_PART_DOUBLES = (
    "mean_abs_delta", "max_abs_delta", "l1", "l2", "cosine", "k16_positive", "k8_positive", "k16_negative",
    "k8_negative"
)
_PART_LONGS = ("m_correct", "k16_nonzero", "k8_nonzero", "newly_nonzero_wrong", "newly_nonzero_correct")


def _partitions(spark, d):
    return groups.partition_counterfactual(rollouts(spark, d))


@query(
    "partition_counterfactual",
    f"{PART_SQL} SELECT id, partition, {', '.join(_PART_LONGS)}, "
    f"{', '.join(f'round({c}, 5) AS {c}' for c in _PART_DOUBLES)} FROM pc"
)
def partition_counterfactual(spark, d):
    return _partitions(spark, d).select(
        "id", "partition", *_PART_LONGS, *[F.round(c, 5).alias(c) for c in _PART_DOUBLES]
    )


@query(
    "newly_nonzero",
    f"{PART_SQL} SELECT partition, CAST(sum(newly_nonzero_wrong) AS BIGINT) AS wrong, CAST(sum(newly_nonzero_correct) "
    f"AS BIGINT) AS correct FROM pc GROUP BY partition"
)
def newly_nonzero(spark, d):
    return _partitions(spark, d).groupBy("partition").agg(
        F.sum("newly_nonzero_wrong").alias("wrong"), F.sum("newly_nonzero_correct").alias("correct")
    )


_BUCKET = "CASE WHEN m_correct IN (0, 1, 2, 3, 8, 16) THEN 'm=' || m_correct WHEN m_correct BETWEEN 4 AND 7 THEN 'm=4-7' WHEN m_correct BETWEEN 9 AND 12 THEN 'm=9-12' WHEN m_correct BETWEEN 13 AND 15 THEN 'm=13-15' END"


@query(
    "agg_partition_summary",
    f"{PART_SQL} SELECT {_BUCKET} AS bucket, count(*) AS n, round(avg(mean_abs_delta), 5) AS mean_abs_delta, "
    f"round(avg(cosine), 5) AS cosine, round(avg(newly_nonzero_wrong), 5) AS wrong, round(avg(newly_nonzero_correct), "
    f"5) AS correct FROM pc GROUP BY 1"
)
def agg_partition_summary(spark, d):
    r5 = lambda c: F.round(F.avg(c), 5)
    return _partitions(spark, d).groupBy(text.m_bucket(F.col("m_correct")).alias("bucket")).agg(
        F.count("*").alias("n"), r5("mean_abs_delta").alias("mean_abs_delta"), r5("cosine").alias("cosine"),
        r5("newly_nonzero_wrong").alias("wrong"), r5("newly_nonzero_correct").alias("correct")
    )


@query(
    "m_bucket",
    f"{GROUP_SQL} SELECT id, correct_count AS m, {_BUCKET.replace('m_correct', 'correct_count')} AS bucket FROM g"
)
def m_bucket(spark, d):
    m = F.col("correct_count")
    return groups.rollout_group(plain_rollouts(spark, d)).select("id", m.alias("m"), text.m_bucket(m).alias("bucket"))


@query(
    "vector_distances",
    f"{PART_SQL} SELECT id, partition, round(l1, 5) AS l1, round(l2, 5) AS l2, round(cosine, 5) AS cosine FROM pc"
)
def vector_distances(spark, d):
    return _partitions(spark, d).select("id", "partition", *[F.round(c, 5).alias(c) for c in ("l1", "l2", "cosine")])


_AT = """km AS (SELECT id, n AS k, correct_count AS m FROM g WHERE n > 1), av AS (SELECT id, k, m, CASE WHEN m > 0 AND m < k THEN sqrt(CAST(m * (k - m) AS DOUBLE) / (k * (k - 1))) ELSE 0.0::DOUBLE END AS std, CAST(m AS DOUBLE) / k AS p FROM km)"""


@query("analytic_advantage", f"""{GROUP_SQL}, {_AT} SELECT id, k, m, round(std, 8) AS std, round(CASE WHEN m > 0 AND m < k THEN (1 - p) / std ELSE 0 END, 8) AS a_plus, round(CASE WHEN m > 0 AND m < k THEN -p / std ELSE 0 END, 8) AS a_minus,
 round(CASE WHEN m > 0 THEN (1 - p) / (std + 1e-4) ELSE 0 END, 8) AS a_plus_eps, round(CASE WHEN m < k THEN -p / (std + 1e-4) ELSE 0 END, 8) + 0.0 AS a_minus_eps FROM av""")
def analytic_advantage(spark, d):
    """Closed forms for each group's number of rollouts and of correct ones."""
    x = groups.rollout_group(plain_rollouts(spark, d)).where("n > 1")
    x = x.select("id", F.col("n").alias("k"), F.col("correct_count").alias("m"))
    return x.select(
        "id",
        "k",
        "m",
        *[(F.round(c, 8) + 0.0).alias(n) for n, c in policy.analytic_advantage(F.col("k"), F.col("m")).items()]
    )


@query(
    "topk_examples",
    f"{RESCUE_SQL}, t AS (SELECT rescued, id, row_number() OVER (PARTITION BY rescued ORDER BY id) AS rank FROM r WHERE "
    f"correct = 0) SELECT rescued, id, CAST(rank AS INT) AS rank FROM t WHERE rank <= 3"
)
def topk_examples(spark, d):
    return positions.topk(
        groups.rescue(plain_rollouts(spark, d)).where("all_wrong").select("rescued", "id"), ["rescued"], ["id"], 3
    )


@query("select_interleave", f"""{WITH}, g AS (SELECT id, CAST(sum(reward) AS BIGINT) AS m FROM roll GROUP BY id), c AS (SELECT id, m, CASE WHEN m BETWEEN 1 AND 3 THEN 0 WHEN m BETWEEN 4 AND 12 THEN 1 WHEN m BETWEEN 13 AND 15 THEN 2 END AS kind FROM g),
 t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS turn FROM c WHERE kind IS NOT NULL), o AS (SELECT id, m, row_number() OVER (ORDER BY CAST(kind <> 0 AS INT), turn, kind) AS rank FROM t) SELECT id, m, CAST(rank AS INT) AS rank FROM o WHERE rank <= 64""")
def select_interleave(spark, d):
    g = plain_rollouts(spark, d).groupBy("id").agg(F.sum("reward").cast("long").alias("m"))
    return positions.select_interleave(g, "m", "id", 64)




@query("policy_math", f"""{WITH}, p AS (SELECT step, -3 + 2.9 * ((k * 131 + id * 17) % 997) / 997.0::DOUBLE AS o, -3 + 2.9 * ((k * 137 + id * 19) % 997) / 997.0::DOUBLE AS n, reward - 0.5 AS a FROM roll)
 SELECT step, round(avg(exp(n - o)), 5) AS ratio, round(-avg(least(exp(n - o) * a, least(greatest(exp(n - o), 0.8), 1.2) * a)), 5) AS surrogate, round(avg(o - n), 5) AS approx_kl, round(avg(exp(o - n) - (o - n) - 1), 5) AS k3_kl,
 round(avg(CAST(exp(n - o) <> least(greatest(exp(n - o), 0.8), 1.2) AS INT)), 5) AS clip_fraction FROM p GROUP BY step""")
def policy_math(spark, d):
    p = rollouts(spark, d).selectExpr(
        "step", "-3 + 2.9D * ((k * 131 + id * 17) % 997) / 997.0D AS o",
        "-3 + 2.9D * ((k * 137 + id * 19) % 997) / 997.0D AS n", "reward - 0.5D AS a"
    )
    o, n, a = F.col("o"), F.col("n"), F.col("a")
    r5 = lambda c: F.round(c, 5)
    return p.groupBy("step").agg(
        r5(F.avg(policy.policy_ratio(n, o))).alias("ratio"), r5(policy.clipped_surrogate(n, o, a)).alias("surrogate"),
        r5(policy.approx_kl(n, o)).alias("approx_kl"), r5(policy.k3_kl(n, o)).alias("k3_kl"),
        r5(policy.clip_fraction(n, o)).alias("clip_fraction")
    )


def _policy(name: str, sql: str, build) -> None:
    @query(
        name,
        f"WITH p AS (SELECT o_orderkey % 50 AS step, -3 + 2.9 * ((o_custkey * 131) % 997) / 997.0::DOUBLE AS o, -3 + "
        f"2.9 * ((o_orderkey * 137) % 997) / 997.0::DOUBLE AS n, CAST(o_custkey % 3 AS DOUBLE) - 1 AS a FROM orders) "
        f"SELECT step, round({sql}, 5) AS value FROM p GROUP BY step"
    )
    def run(spark, d):
        p = read(spark, d, "orders").selectExpr(
            "o_orderkey % 50 AS step", "-3 + 2.9D * ((o_custkey * 131) % 997) / 997.0D AS o",
            "-3 + 2.9D * ((o_orderkey * 137) % 997) / 997.0D AS n", "CAST(o_custkey % 3 AS DOUBLE) - 1 AS a"
        )
        return p.groupBy("step").agg(F.round(build(F.col("n"), F.col("o"), F.col("a")), 5).alias("value"))


_policy("policy_ratio", "avg(exp(n - o))", lambda n, o, a: F.avg(policy.policy_ratio(n, o)))
_policy(
    "clipped_surrogate",
    "-avg(least(exp(n - o) * a, least(greatest(exp(n - o), 0.8), 1.2) * a))",
    policy.clipped_surrogate
)
_policy("approx_kl", "avg(o - n)", lambda n, o, a: policy.approx_kl(n, o))
_policy("k3_kl", "avg(exp(o - n) - (o - n) - 1)", lambda n, o, a: policy.k3_kl(n, o))
_policy(
    "clip_fraction",
    "avg(CAST(exp(n - o) <> least(greatest(exp(n - o), 0.8), 1.2) AS INT))",
    lambda n, o, a: policy.clip_fraction(n, o)
)

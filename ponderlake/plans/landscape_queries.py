"""Queries over candidate scores and metric logs: landscapes, strata, step buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy, text
from ..operators import landscape as L
from ..operators import positions, strata
from .base import LAND_SQL, SCORE_SQL, STEP_SQL, scores, steps
from .registry import query, read

R6 = lambda c: F.round(c, 6)
WITH = f"WITH {SCORE_SQL}, {LAND_SQL}"
PAIR_COLS = ("gold_q", "gold_rank", "top1", "gold_margin", "normalized_entropy")


def _ls(spark, d):
    return L.landscape(scores(spark, d))


def _pair(spark, d):
    return L.pair(_ls(spark, d), "a", "b", PAIR_COLS)


@query("softmax", f"{WITH} SELECT id, model, CAST(cand AS INT) AS cand, round(q, 6) AS q FROM qq")
def softmax(spark, d):
    x = _ls(spark, d).select("id", "model", F.posexplode("q").alias("cand", "q"))
    return x.withColumn("q", R6(F.col("q")))


@query(
    "dist_entropy",
    f"{WITH} SELECT id, model, round(entropy, 6) AS entropy, round(normalized_entropy, 6) AS normalized_entropy, "
    f"round(exp(entropy), 5) AS effective FROM ls"
)
def dist_entropy(spark, d):
    return _ls(spark, d).select(
        "id", "model", R6(F.col("entropy")).alias("entropy"),
        R6(F.col("normalized_entropy")).alias("normalized_entropy"), F.round("effective", 5).alias("effective")
    )


@query(
    "landscape",
    f"{WITH} SELECT id, model, gold, round(gold_q, 6) AS gold_q, gold_rank, top1, round(top1_margin, 6) AS top1_margin, "
    f"round(gold_margin, 6) AS gold_margin FROM ls"
)
def landscape(spark, d):
    return _ls(spark, d).select(
        "id", "model", "gold", R6(F.col("gold_q")).alias("gold_q"), "gold_rank", "top1",
        R6(F.col("top1_margin")).alias("top1_margin"), R6(F.col("gold_margin")).alias("gold_margin")
    )


def _one(name: str, col: str, rounded: bool) -> None:
    @query(name, f"{WITH} SELECT id, model, {f'round({col}, 6)' if rounded else col} AS {col} FROM ls")
    def run(spark, d):
        return _ls(spark, d).select("id", "model", (R6(F.col(col)) if rounded else F.col(col)).alias(col))


_one("rank_stable_desc", "gold_rank", False)
_one("top1_margin", "top1_margin", True)
_one("gold_margin", "gold_margin", True)


@query("agg_landscape", f"""{WITH} SELECT model, count(*) AS n, round(avg(CAST(top1 = gold AS INT)), 6) AS top1_accuracy, round(avg(gold_q), 6) AS mean_gold_q, round(avg(CAST(gold_rank <= 2 AS INT)), 6) AS top2, round(avg(CAST(gold_rank <= 3 AS INT)), 6) AS top3,
 round(avg(gold_margin), 6) AS mean_gold_margin, round(median(gold_margin), 6) AS median_gold_margin, round(avg(top1_margin), 6) AS mean_top1_margin, round(avg(normalized_entropy), 6) AS mean_normalized_entropy,
 round(quantile_cont(gold_q, 0.1), 6) AS p10, round(quantile_cont(gold_q, 0.25), 6) AS p25, round(quantile_cont(gold_q, 0.5), 6) AS median_gold_q, round(quantile_cont(gold_q, 0.75), 6) AS p75, round(quantile_cont(gold_q, 0.9), 6) AS p90 FROM ls GROUP BY model""")
def agg_landscape(spark, d):
    x = L.aggregate(_ls(spark, d))
    return x.select("model", "n", *[R6(F.col(c)).alias(c) for c in x.columns[2:]])


@query(
    "agg_topk_coverage",
    f"{WITH} SELECT model, CAST(k AS INT) AS k, round(avg(CAST(gold_rank <= k AS INT)), 6) AS coverage FROM ls, (SELECT "
    f"unnest([1, 2, 3, 5]) AS k) GROUP BY model, k"
)
def agg_topk_coverage(spark, d):
    x = _ls(spark, d).groupBy("model").agg(
        *[F.avg((F.col("gold_rank") <= k).cast("double")).alias(str(k)) for k in (1, 2, 3, 5)]
    )
    return x.select(
        "model",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("k"), R6(F.col(str(k))).alias("coverage")) for k in (1, 2, 3, 5)])
        ).alias("x")
    ).select("model", "x.k", "x.coverage")


@query(
    "agg_rank_transition",
    f"{WITH} SELECT gold_rank0, gold_rank1, count(*) AS n, count(*) FILTER (gold_rank0 > 3 AND gold_rank1 <= 3) AS "
    f"promoted, count(*) FILTER (gold_rank0 <= 3 AND gold_rank1 > 3) AS demoted FROM pr GROUP BY ALL"
)
def agg_rank_transition(spark, d):
    a, b = F.col("gold_rank0"), F.col("gold_rank1")
    return _pair(spark, d).groupBy("gold_rank0", "gold_rank1").agg(
        F.count("*").alias("n"), F.count_if((a > 3) & (b <= 3)).alias("promoted"),
        F.count_if((a <= 3) & (b > 3)).alias("demoted")
    )


@query(
    "agg_mass_by_class",
    f"{WITH} SELECT model, gold, CAST(cand AS INT) AS cand, round(avg(q), 6) AS mean_q FROM qq GROUP BY GROUPING SETS "
    f"((model, cand), (model, gold, cand))"
)
def agg_mass_by_class(spark, d):
    return L.mass_by_class(_ls(spark, d)).withColumn("mean_q", R6(F.col("mean_q")))


@query(
    "agg_state_conditioned",
    f"{WITH} SELECT top10 = gold AS before, top11 = gold AS after, count(*) AS n, round(avg(gold_q0), 6) AS initial_q, "
    f"round(avg(gold_q1), 6) AS final_q, round(avg(normalized_entropy1), 6) AS entropy FROM pr GROUP BY 1, 2 HAVING "
    f"count(*) >= 5"
)
def agg_state_conditioned(spark, d):
    g = _pair(spark, d).groupBy(
        (F.col("top10") == F.col("gold")).alias("before"), (F.col("top11") == F.col("gold")).alias("after")
    )
    return g.agg(
        F.count("*").alias("n"), R6(F.avg("gold_q0")).alias("initial_q"), R6(F.avg("gold_q1")).alias("final_q"),
        R6(F.avg("normalized_entropy1")).alias("entropy")
    ).where("n >= 5")


@query(
    "finite_gate",
    f"{WITH}, t AS (SELECT id, model, sum(q) AS s FROM qq GROUP BY ALL) SELECT bool_and(NOT isnan(entropy) AND gold_q "
    f"IS NOT NULL) AS finite, bool_and(s BETWEEN 0.999 AND 1.001) AS sums, bool_and(gold_rank BETWEEN 1 AND 8) AS ranks "
    f"FROM ls JOIN t USING (id, model)"
)
def finite_gate(spark, d):
    return L.gate(_ls(spark, d))


@query(
    "implied_hit",
    f"{WITH} SELECT id, model, round(1 - pow(1 - gold_q, 8), 6) AS hit, round(pow(1 - gold_q, 8), 6) AS miss FROM ls"
)
def implied_hit(spark, d):
    h = policy.implied_hit(F.col("gold_q"), 8)
    return _ls(spark, d).select("id", "model", R6(h).alias("hit"), R6(1 - h).alias("miss"))


_BINS = "CASE " + " ".join(
    f"WHEN {{0}} >= {a} AND {{0}} < {b} THEN '[{a:.2f},{min(b, 1.0):.2f}{')' if b <= 1 else ']'}'" for a,
    b in strata.BINS
) + " END"


@query("bin_label", f"{WITH} SELECT id, model, {_BINS.format('gold_q')} AS bin FROM ls")
def bin_label(spark, d):
    return _ls(spark, d).select("id", "model", strata.bin_of(F.col("gold_q")).alias("bin"))


@query(
    "join_range_bins",
    f"{WITH} SELECT {_BINS.format('gold_q')} AS label, count(*) AS n, round(avg(gold_q), 6) AS mean_q FROM ls GROUP BY "
    f"1"
)
def join_range_bins(spark, d):
    bins = spark.createDataFrame(
        [(float(a), float(b), f"[{a:.2f},{min(b, 1.0):.2f}{')' if b <= 1 else ']'}") for a, b in strata.BINS],
        "low double, high double, label string"
    )
    return strata.join_range_bins(_ls(spark, d).select("gold_q"), "gold_q", bins).groupBy("label").agg(
        F.count("*").alias("n"), R6(F.avg("gold_q")).alias("mean_q")
    )


@query("agg_bins", f"""{WITH} SELECT {_BINS.format('gold_q0')} AS bin, count(*) AS n, round(avg(gold_q0), 6) AS initial_q, round(avg(gold_q1), 6) AS final_q, round(avg(gold_q1 - gold_q0), 6) AS mean_delta, round(avg(gold_rank0), 6) AS initial_rank, round(avg(gold_rank1), 6) AS final_rank,
 round(avg(CAST(top11 = gold AS INT)), 6) AS final_top1, round(avg(CAST(top10 = gold AS INT)), 6) AS initial_top1, round(avg(CAST(gold_q1 > gold_q0 AS INT)), 6) AS increased, round(avg(CAST(gold_q1 < gold_q0 AS INT)), 6) AS decreased,
 round(avg(1 - pow(1 - gold_q0, 8)), 6) AS implied_hit_rate, round(avg(pow(1 - gold_q0, 8)), 6) AS implied_miss_rate, round(avg(0.5 * gold_q1 - gold_q0), 6) AS control_delta FROM pr GROUP BY 1""")
def agg_bins(spark, d):
    x = strata.bin_table(_pair(spark, d).withColumn("control_q", 0.5 * F.col("gold_q1")))
    return x.select("bin", "n", *[R6(F.col(c)).alias(c) for c in x.columns[2:]])


_EDGES = "(VALUES " + ", ".join(
    f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(strata.BINS)
) + ") AS e(i, low, high)"


@query("agg_bin_merge", f"""{WITH}, c AS (SELECT i, low, high, count(gold_q0) AS n FROM {_EDGES} LEFT JOIN pr ON gold_q0 >= low AND gold_q0 < high GROUP BY ALL), k AS (SELECT *, sum(n) OVER (ORDER BY i) AS upto FROM c),
 m AS (SELECT coalesce(min(i) FILTER (upto >= {strata.MIN_BIN}), {len(strata.BINS) - 1}) AS last FROM k), g AS (SELECT greatest(i, last) AS i, min(low) AS low, max(high) AS high, CAST(sum(n) AS BIGINT) AS n FROM k, m GROUP BY 1)
 SELECT printf('[%.2f,%.2f%s', low, least(high, 1.0), CASE WHEN high > 1 THEN ']' ELSE ')' END) AS bin, n FROM g WHERE n > 0""")
def agg_bin_merge(spark, d):
    p = _pair(spark, d)
    edges = strata.merged_bins(p, "gold_q0")
    return p.groupBy(strata.bin_of(F.col("gold_q0"), edges).alias("bin")).agg(F.count("*").alias("n"))


@query(
    "agg_outcome_groups",
    f"{WITH} SELECT CASE WHEN top10 = gold THEN 'correct' ELSE 'wrong' END || '_to_' || CASE WHEN top11 = gold THEN "
    f"'correct' ELSE 'wrong' END AS outcome, count(*) AS n, round(avg(gold_q0), 6) AS initial_q, round(avg(gold_rank0), "
    f"6) AS initial_rank, round(avg(gold_margin0), 6) AS initial_margin, round(avg(gold_q1), 6) AS final_q, "
    f"round(avg(gold_q1 - gold_q0), 6) AS mean_delta FROM pr GROUP BY 1"
)
def agg_outcome_groups(spark, d):
    word = lambda c: F.when(F.col(c) == F.col("gold"), "correct").otherwise("wrong")
    m = lambda c, n: R6(F.avg(c)).alias(n)
    g = _pair(spark, d).groupBy(F.concat(word("top10"), F.lit("_to_"), word("top11")).alias("outcome"))
    return g.agg(
        F.count("*").alias("n"), m("gold_q0", "initial_q"), m("gold_rank0", "initial_rank"),
        m("gold_margin0", "initial_margin"), m("gold_q1", "final_q"),
        m(F.col("gold_q1") - F.col("gold_q0"), "mean_delta")
    )


_HM = "count(*) FILTER (id % 3 = 0) AS n_hit, count(*) FILTER (id % 3 <> 0) AS n_miss, avg(gold_q1 - gold_q0) FILTER (id % 3 = 0) AS h, avg(gold_q1 - gold_q0) FILTER (id % 3 <> 0) AS m"


@query("agg_hit_miss", f"{WITH} SELECT {_BINS.format('gold_q0')} AS bin, n_hit, n_miss, round(n_hit / (n_hit + n_miss), 6) AS hit_rate, round(i, 6) AS implied FROM (SELECT {_BINS.format('gold_q0')} AS bin, {_HM}, avg(1 - pow(1 - gold_q0, 8)) AS i FROM pr GROUP BY 1)".replace(f"SELECT {_BINS.format('gold_q0')} AS bin, n_hit", "SELECT bin, n_hit"))
def agg_hit_miss(spark, d):
    hit = F.col("id") % 3 == 0
    g = _pair(spark, d).groupBy(strata.bin_of(F.col("gold_q0")).alias("bin")).agg(
        F.count_if(hit).alias("n_hit"),
        F.count_if(~hit).alias("n_miss"),
        R6(F.avg(policy.implied_hit(F.col("gold_q0"), 8))).alias("implied")
    )
    return g.withColumn("hit_rate", R6(F.col("n_hit") / (F.col("n_hit") + F.col("n_miss"))))


@query(
    "agg_controlled",
    f"{WITH}, g AS (SELECT {_BINS.format('gold_q0')} AS bin, {_HM} FROM pr GROUP BY 1) SELECT bin, n_hit, n_miss, "
    f"round(h, 6) AS hit_delta, round(m, 6) AS miss_delta, CASE WHEN n_hit >= 5 AND n_miss >= 5 THEN round(h - m, 6) "
    f"END AS difference, CASE WHEN n_hit < 5 OR n_miss < 5 THEN 'insufficient' ELSE 'ok' END AS verdict FROM g"
)
def agg_controlled(spark, d):
    p = _pair(spark, d).withColumn("bin", strata.bin_of(F.col("gold_q0")))
    x = strata.hit_miss(p, ["bin"], F.col("id") % 3 == 0, F.col("gold_q1") - F.col("gold_q0"))
    return x.withColumns({c: R6(F.col(c)) for c in ("hit_delta", "miss_delta", "difference")})


@query(
    "quartile_ends",
    f"{WITH}, o AS (SELECT id, gold_q0, row_number() OVER (ORDER BY gold_q0, id) AS r, count(*) OVER () AS n FROM "
    f"(SELECT id, round(gold_q0, 9) AS gold_q0 FROM pr)) SELECT id, CASE WHEN r <= n // 4 THEN 'low' ELSE 'high' END AS "
    f"\"end\" FROM o WHERE r <= n // 4 OR r > n - CAST(ceil(n / 4) AS BIGINT)"
)
def quartile_ends(spark, d):
    p = _pair(spark, d).select("id", F.round("gold_q0", 9).alias("gold_q0"))
    return positions.quartile_ends(p, "id", ["gold_q0", "id"]).select("id", "end")


@query("agg_arm_summary", f"""{WITH} SELECT model, gold, count(*) AS n, round(quantile_cont(gold_q, 0.1), 6) AS p10, round(median(gold_q), 6) AS median, round(avg(gold_q), 6) AS mean, round(avg(CAST(gold_q < 0.05 AS INT)), 6) AS frac_low, round(avg(CAST(gold_rank = 1 AS INT)), 6) AS top1,
 round(avg(CAST(gold_rank <= 3 AS INT)), 6) AS top3, round(avg(normalized_entropy), 6) AS entropy, count(*) FILTER (id % 5 = 0) AS n_subset, round(avg(gold_q) FILTER (id % 5 = 0), 6) AS mean_subset FROM ls GROUP BY model, gold""")
def agg_arm_summary(spark, d):
    x = strata.arm_summary(
        _ls(spark, d), ["model", "gold"], "gold_q", "gold_rank", "normalized_entropy", F.col("id") % 5 == 0
    )
    return x.withColumns(
        {c: R6(F.col(c)) for c in ("p10", "median", "mean", "frac_low", "top1", "top3", "entropy", "mean_subset")}
    )


@query(
    "agg_stratified",
    f"{WITH} SELECT {_BINS.format('gold_q0')} AS bin, count(*) AS n, round(median(gold_q1 - gold_q0), 6) AS "
    f"median_delta, round(avg(CAST(gold_q1 < gold_q0 AS INT)), 6) AS frac_decreased, count(*) FILTER ((top10 = gold) <> "
    f"(top11 = gold)) AS flips FROM pr GROUP BY 1"
)
def agg_stratified(spark, d):
    dq = F.col("gold_q1") - F.col("gold_q0")
    flips = (F.col("top10") == F.col("gold")) != (F.col("top11") == F.col("gold"))
    p = _pair(spark, d).select(strata.bin_of(F.col("gold_q0")).alias("bin"), dq.alias("dq"), flips.alias("flip"))
    g = p.groupBy("bin").agg(
        F.count("*").alias("n"),
        R6(F.avg((F.col("dq") < 0).cast("double"))).alias("frac_decreased"),
        F.count_if("flip").alias("flips")
    )
    return positions.with_quantiles(
        g, p, ["bin"], {"median_delta": ("dq", 0.5)}
    ).withColumn("median_delta", R6(F.col("median_delta")))


# metric logs by step

S = f"WITH {STEP_SQL}"
_BUCKET = "CASE " + " ".join(f"WHEN step BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in strata.STEPS) + " END"


@query(
    "step_bucket",
    f"{S} SELECT {_BUCKET} AS bucket, count(*) AS n, min(step) AS first_step, max(step) AS last_step FROM st GROUP BY 1"
)
def step_bucket(spark, d):
    return steps(spark, d).groupBy(strata.step_bucket(F.col("step")).alias("bucket")).agg(
        F.count("*").alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step")
    )


@query(
    "agg_bucket_means",
    f"{S} SELECT {_BUCKET} AS bucket, arm, round(avg(value), 5) AS mean_value FROM st GROUP BY 1, 2"
)
def agg_bucket_means(spark, d):
    return steps(spark, d).groupBy(
        strata.step_bucket(F.col("step")).alias("bucket"), "arm"
    ).agg(F.round(F.avg("value"), 5).alias("mean_value"))


@query(
    "filter_null_skip", f"{S} SELECT step, count(value) AS n, round(avg(value), 5) AS mean_value FROM st GROUP BY step"
)
def filter_null_skip(spark, d):
    return steps(spark, d).groupBy("step").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 5).alias("mean_value")
    )


@query(
    "agg_pooled_ratio",
    f"{S} SELECT {_BUCKET} AS bucket, count(*) FILTER (user_id % 5 = 0 AND user_id % 3 = 0) AS rescued, count(*) FILTER "
    f"(user_id % 3 = 0) AS all_wrong, round(count(*) FILTER (user_id % 5 = 0 AND user_id % 3 = 0) / nullif(count(*) "
    f"FILTER (user_id % 3 = 0), 0), 6) AS ratio FROM st GROUP BY 1"
)
def agg_pooled_ratio(spark, d):
    w, r = F.col("user_id") % 3 == 0, F.col("user_id") % 5 == 0
    g = steps(spark, d).groupBy(strata.step_bucket(F.col("step")).alias("bucket")).agg(
        F.count_if(w & r).alias("rescued"), F.count_if(w).alias("all_wrong")
    )
    return g.withColumn("ratio", R6(F.try_divide(F.col("rescued"), F.nullif(F.col("all_wrong"), F.lit(0)))))


@query("first_last", f"{S} SELECT arm, arg_min(value, (step, id)) AS first_value, arg_max(value, (step, id)) AS last_value FROM st WHERE value IS NOT NULL GROUP BY arm".replace("(step, id)", "step * 100000000 + id"))
def first_last(spark, d):
    at = F.struct("step", "id")
    return steps(spark, d).where("value IS NOT NULL").groupBy("arm").agg(
        F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value")
    )


@query(
    "agg_best_checkpoint",
    f"{S}, m AS (SELECT arm, step, round(avg(value), 1) AS acc FROM st GROUP BY ALL) SELECT arm, step AS best_step, acc "
    f"AS best FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY acc DESC, step) AS r FROM m) WHERE r = 1"
)
def agg_best_checkpoint(spark, d):
    m = steps(spark, d).groupBy("arm", "step").agg(F.round(F.avg("value"), 1).alias("acc")).where("acc IS NOT NULL")
    return m.groupBy("arm").agg(
        F.max_by("step", F.struct("acc", (-F.col("step")).alias("s"))).alias("best_step"), F.max("acc").alias("best")
    )


@query(
    "early_delta",
    f"{S}, u AS (SELECT user_id, avg(value) FILTER (step <= 50) AS v0, avg(value) FILTER (step BETWEEN 51 AND 150) AS "
    f"v1, avg(value) FILTER (step > 550) AS v2 FROM st GROUP BY 1) SELECT user_id, round(v1 - v0, 5) AS early, round(v2 "
    f"- v0, 5) AS final FROM u WHERE v0 IS NOT NULL"
)
def early_delta(spark, d):
    v = lambda c: F.avg(F.when(c, F.col("value")))
    s = F.col("step")
    u = steps(spark, d).groupBy("user_id").agg(
        v(s <= 50).alias("v0"), v(s.between(51, 150)).alias("v1"), v(s > 550).alias("v2")
    ).where("v0 IS NOT NULL")
    return u.select(
        "user_id", F.round(F.col("v1") - F.col("v0"), 5).alias("early"),
        F.round(F.col("v2") - F.col("v0"), 5).alias("final")
    )


@query(
    "trajectory_pivot",
    f"{S}, "
    + "p AS (SELECT arm, "
    + ", ".join(f"round(avg(value) FILTER (step = {k}), 5) AS s{k}" for k in (100, 200, 300, 400, 500, 600))
    + " FROM st GROUP BY arm) SELECT * FROM p"
)
def trajectory_pivot(spark, d):
    x = steps(spark, d).where(F.col("step") % 100 == 0).groupBy("arm").pivot(
        "step", [100, 200, 300, 400, 500, 600]
    ).agg(F.round(F.avg("value"), 5))
    return x.select("arm", *[F.col(str(k)).alias(f"s{k}") for k in (100, 200, 300, 400, 500, 600)])


@query(
    "agg_trajectory_class",
    f"{S}, c AS (SELECT *, CASE WHEN user_id % 4 = 0 THEN 'stable_correct' WHEN user_id % 4 = 1 THEN 'stable_wrong' "
    f"ELSE 'flip' END AS class FROM st WHERE step % 100 = 0) SELECT class, step, round(avg(value), 5) AS mean, "
    f"round(median(value), 5) AS median FROM c GROUP BY ALL"
)
def agg_trajectory_class(spark, d):
    u = F.col("user_id") % 4
    c = steps(spark, d).where(F.col("step") % 100 == 0).withColumn(
        "class", F.when(u == 0, "stable_correct").when(u == 1, "stable_wrong").otherwise("flip")
    )
    g = c.groupBy("class", "step").agg(F.round(F.avg("value"), 5).alias("mean"))
    return positions.with_quantiles(
        g, c, ["class", "step"], {"median": ("value", 0.5)}
    ).withColumn("median", F.round("median", 5))


@query(
    "join_pair_budget",
    f"{S}, m AS (SELECT arm, step, avg(value) AS v FROM st GROUP BY ALL) SELECT a.step, round(a.v, 5) AS small, "
    f"round(b.v, 5) AS large, round(b.v - a.v, 5) AS delta FROM m a JOIN m b ON b.step = 2 * a.step AND a.arm = 'click' "
    f"AND b.arm = 'view'"
)
def join_pair_budget(spark, d):
    m = steps(spark, d).where(F.col("arm").isin("click", "view")).groupBy("arm", "step").agg(F.avg("value").alias("v"))
    a = m.where("arm = 'click'").select("step", (2 * F.col("step")).alias("at"), F.col("v").alias("x"))
    b = m.where("arm = 'view'").select(F.col("step").alias("at"), F.col("v").alias("y"))
    return a.join(b, "at").select(
        "step", F.round("x", 5).alias("small"), F.round("y", 5).alias("large"),
        F.round(F.col("y") - F.col("x"), 5).alias("delta")
    )


@query("unique_in_order", "SELECT user_id, min(event_id) AS first_pos FROM events GROUP BY 1")
def unique_in_order(spark, d):
    return positions.unique_in_order(read(spark, d, "events"), "user_id", "event_id")


@query(
    "first_mismatch",
    "SELECT count(*) AS compared, min(event_id) FILTER (user_id % 97 IS DISTINCT FROM (user_id + CAST(event_id % 331 = "
    "330 AS INT)) % 97) AS first_mismatch FROM events"
)
def first_mismatch(spark, d):
    e = read(spark, d, "events")
    a = e.select("event_id", (F.col("user_id") % 97).alias("v"))
    b = e.select("event_id", ((F.col("user_id") + (F.col("event_id") % 331 == 330).cast("int")) % 97).alias("v"))
    return positions.first_mismatch(a, b, "event_id", "v")


@query("step_ratio", f"{S} SELECT DISTINCT step, round(step / (1000 / 16.0::DOUBLE), 6) AS epoch FROM st")
def step_ratio(spark, d):
    return steps(spark, d).select("step").distinct().select(
        "step", R6(text.epoch_of_step(F.col("step"), 1000)).alias("epoch")
    )

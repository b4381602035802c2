"""Queries over token sequences and over long vectors: losses, masks, audits of two models, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import geometry, groups, tokens
from .registry import query, read

R6 = lambda c: F.round(c, 6)
END, WORD = 2, r"[^\x20\x09-\x0D]+"
#: A turn is a sequence, its words are tokens (each about 41st an end token); log-probabilities follow from the ids.
_LOGP = {
    "policy": "-(t % 997) / 100.0E0", "old": "-(t % 997) / 100.0E0 + (t % 11 - 5) / 20.0E0",
    "ref": "-(t % 997) / 100.0E0 + CASE WHEN t % 5 = 0 THEN (t % 7 - 3) / 500.0E0 ELSE 0 END",
}
SEQ_SQL = f"""WITH tk AS (SELECT conv_id AS id, turn, role, list_transform(regexp_extract_all(coalesce(text, ''), '{WORD}'), lambda w: CAST('0x' || substr(md5(w), 1, 6) AS BIGINT)) AS raw FROM conversations),
ti AS (SELECT id, turn, role, list_transform(raw, lambda t: CASE WHEN t % 41 = 0 THEN {END} ELSE t END) AS ids FROM tk),
sq AS (SELECT *, CAST(coalesce(nullif(list_position(ids, {END}), 0), len(ids)) AS INT) AS n, {", ".join(f"list_transform(ids, lambda t: {v}) AS {k}" for k, v in _LOGP.items())} FROM ti),
tt AS (SELECT id, turn, role, n, ids[k] AS t, policy[k] AS policy, old[k] AS old, ref[k] AS ref, k FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM sq))"""


def sequences(spark, d):
    """id, turn, role, ids and three models' log-probabilities of each token."""
    word = "conv(substring(md5(w), 1, 6), 16, 10)"
    ids = f"transform(regexp_extract_all(coalesce(text, ''), r'{WORD}', 0), w -> cast({word} as bigint))"
    x = read(spark, d, "conversations").selectExpr("conv_id AS id", "turn", "role", f"{ids} AS raw")
    x = x.selectExpr("id", "turn", "role", f"transform(raw, t -> CASE WHEN t % 41 = 0 THEN {END}L ELSE t END) AS ids")
    return x.selectExpr("*", *[f"transform(ids, t -> {v}) AS {k}" for k, v in _LOGP.items()])


def _n():
    return T.through_end(F.col("ids"), F.lit(END).cast("bigint"))


@query("token_logprobs", f"""{SEQ_SQL}, a AS (SELECT id, turn, sum(policy) AS logp, avg(policy) AS logp_mean, avg(exp(policy - old)) AS ratio_mean, max(exp(policy - old)) AS ratio_max,
 avg(CASE WHEN exp(policy - old) < 0.8 OR exp(policy - old) > 1.2 THEN 1.0 ELSE 0.0 END) AS clip_fraction, avg(exp(ref - policy) - (ref - policy) - 1) AS kl FROM tt GROUP BY ALL)
 SELECT id, turn, n AS n_tokens, round(coalesce(logp, 0), 6) AS logp, round(logp_mean, 6) AS logp_mean, round(ratio_mean, 6) AS ratio_mean, round(ratio_max, 6) AS ratio_max, round(clip_fraction, 6) AS clip_fraction, round(kl, 6) AS kl
 FROM sq LEFT JOIN a USING (id, turn)""")
def token_logprobs(spark, d):
    x = tokens.sequence_stats(sequences(spark, d), _n(), "policy", "old", "ref")
    own = ("logp", "logp_mean", "ratio_mean", "ratio_max", "clip_fraction", "kl")
    return x.select("id", "turn", "n_tokens", *[R6(F.col(c)).alias(c) for c in own])


@query("token_policy_loss", f"""{SEQ_SQL}, l AS (SELECT id, turn, role, n, exp(policy - old) AS r, ((id + turn) % 5 - 2) / 2.0E0 AS adv, exp(ref - policy) - (ref - policy) - 1 AS kl FROM tt),
 s AS (SELECT id, turn, role, any_value(n) AS n, sum(-least(r * adv, least(greatest(r, 0.8), 1.2) * adv) + 0.04 * kl) AS loss, sum(kl) AS kl, sum(CASE WHEN r < 0.8 OR r > 1.2 THEN 1 ELSE 0 END) AS clipped FROM l GROUP BY ALL)
 SELECT role, count(*) AS sequences, CAST(sum(n) AS BIGINT) AS tokens, round(sum(loss) / sum(n), 6) AS token_loss, round(avg(loss / n), 6) AS sequence_loss, round(sum(kl) / sum(n), 6) AS kl, round(sum(clipped) / sum(n), 6) AS clip_fraction FROM s GROUP BY role""")
def token_policy_loss(spark, d):
    x = sequences(spark, d).withColumn("advantage", ((F.col("id") + F.col("turn")) % 5 - 2) / 2.0)
    x = tokens.policy_loss(x, _n(), "policy", "old", "ref", "advantage", beta=0.04, keys=["role"])
    own = ("token_loss", "sequence_loss", "kl", "clip_fraction")
    return x.select("role", "sequences", F.col("tokens").cast("long"), *[R6(F.col(c)).alias(c) for c in own])


@query("loss_masks", f"""{SEQ_SQL}, p AS (SELECT id, turn, n, id % 7 AS prompt, id % 7 + len(ids) AS total FROM sq), m AS (SELECT id, turn, k FROM (SELECT *, unnest(range(1, total)) AS k FROM p) WHERE k >= prompt AND k < prompt + n)
 SELECT p.id, p.turn, greatest(total - 1, 0) AS positions, count(m.k) AS counted, min(m.k) AS first, max(m.k) AS last FROM p LEFT JOIN m ON m.id = p.id AND m.turn = p.turn GROUP BY ALL""")
def loss_masks(spark, d):
    """Positions that predict a token of the completion, after a prompt of a few tokens."""
    prompt = (F.col("id") % 7).cast("int")
    mask = T.loss_mask(prompt, _n(), prompt + F.size("ids"))
    x = sequences(spark, d).select("id", "turn", mask.alias("mask"))
    places = F.filter(F.transform("mask", lambda m, i: F.when(m == 1, i + 1)), lambda i: i.isNotNull())
    return x.select(
        "id", "turn", F.size("mask").cast("long").alias("positions"), F.size(places).cast("long").alias("counted"),
        F.array_min(places).cast("long").alias("first"), F.array_max(places).cast("long").alias("last")
    )


_AUDIT = f"""{SEQ_SQL}, a AS (SELECT id, turn, any_value(n) AS n_tokens, avg(abs(ref - policy)) AS mean_abs_diff, max(abs(ref - policy)) AS max_abs_diff,
 avg(exp(ref - policy) - (ref - policy) - 1) AS initial_kl, min(CASE WHEN abs(ref - policy) > 1e-6 THEN CAST(k - 1 AS INT) END) AS first_divergence FROM tt GROUP BY id, turn)"""


def _audited(spark, d):
    return tokens.reference_audit(sequences(spark, d), _n(), "policy", "ref")


@query(
    "reference_audit",
    f"{_AUDIT} SELECT id, turn, n_tokens, round(mean_abs_diff, 8) AS mean_abs_diff, round(max_abs_diff, 8) AS "
    f"max_abs_diff, round(initial_kl, 8) AS initial_kl, first_divergence FROM a"
)
def reference_audit(spark, d):
    own = [F.round(c, 8).alias(c) for c in ("mean_abs_diff", "max_abs_diff", "initial_kl")]
    return _audited(spark, d).select("id", "turn", "n_tokens", *own, "first_divergence")


@query(
    "reference_audit_summary",
    f"{_AUDIT} SELECT count(*) AS sequences, round(sum(mean_abs_diff * n_tokens) / sum(n_tokens), 8) AS mean_abs_diff, "
    f"round(max(max_abs_diff), 8) AS max_abs_diff, round(sum(initial_kl * n_tokens) / sum(n_tokens), 8) AS initial_kl, "
    f"count(first_divergence) AS diverging, max(max_abs_diff) <= 1e-3 AS ok FROM a"
)
def reference_audit_summary(spark, d):
    x = tokens.audit_summary(_audited(spark, d))
    return x.withColumns({c: F.round(c, 8) for c in ("mean_abs_diff", "max_abs_diff", "initial_kl")})


#: A conversation's whole sequence (a token for each role, then its words), and its prompt: all turns but the last, and the
#: token that asks for an answer.
_ROLE = "CASE role WHEN 'user' THEN 11 WHEN 'assistant' THEN 12 ELSE 13 END"
_BOTH = f"""{SEQ_SQL}, w AS (SELECT id, turn, max(turn) OVER (PARTITION BY id) AS last, list_prepend({_ROLE}, ids) AS own FROM ti),
 r AS (SELECT id, turn, last, k, own[k] AS t FROM (SELECT *, unnest(range(1, len(own) + 1)) AS k FROM w)),
 f AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY turn, k) - 1 AS pos, t FROM r),
 q AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY turn, k) - 1 AS pos, t FROM (SELECT id, turn, k, t FROM r WHERE turn < last UNION ALL SELECT DISTINCT id, last, 1, 12 FROM r)),
 n AS (SELECT id, (SELECT count(*) FROM q WHERE q.id = c.id) AS prompt, (SELECT count(*) FROM f WHERE f.id = c.id) AS whole, (SELECT min(f.pos) FROM f JOIN q USING (id, pos) WHERE f.id = c.id AND f.t <> q.t) AS differ FROM (SELECT DISTINCT id FROM r) c),
 cp AS (SELECT id, prompt, whole, coalesce(differ, least(prompt, whole)) AS common FROM n)"""


def _prompt_and_whole(spark, d):
    role = F.expr(f"cast({_ROLE} as bigint)")
    own = F.concat(F.array(role), F.col("ids"))
    x = sequences(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", own.alias("own")))).alias("t"))
    ids = lambda c: F.flatten(F.transform(c, lambda s: s["own"]))
    before = F.slice("t", F.lit(1), F.size("t") - 1)
    return x.select("id", F.concat(ids(before), F.array(F.lit(12).cast("bigint"))).alias("prompt"), ids("t").alias("whole"))


@query(
    "label_mask",
    f"{_BOTH} SELECT cp.id, prompt AS prompt_tokens, common AS ignored, whole - common AS learnt, "
    f"CAST(coalesce(sum(t) FILTER (pos >= common), 0) AS BIGINT) AS total FROM cp JOIN f ON f.id = cp.id GROUP BY ALL"
)
def label_mask(spark, d):
    """Labels of the whole sequence: what it shares with its prompt is ignored."""
    common = T.common_prefix(F.col("prompt"), F.col("whole"))
    x = _prompt_and_whole(spark, d).select("id", F.size("prompt").cast("long").alias("prompt_tokens"), "whole", common.alias("common"))
    x = x.withColumn("labels", T.labels(F.col("whole"), F.col("common")))
    kept = F.filter("labels", lambda t: t != -100)
    return x.select(
        "id", "prompt_tokens", (F.size("whole") - F.size(kept)).cast("long").alias("ignored"),
        F.size(kept).cast("long").alias("learnt"), F.aggregate(kept, F.lit(0).cast("bigint"), lambda t, v: t + v).alias("total")
    )


@query("sequence_divergence", f"{_BOTH} SELECT id, common AS common_prefix, prompt AS a_tokens, whole AS b_tokens FROM cp")
def sequence_divergence(spark, d):
    """The same prefixes from rows of tokens, for sequences that no row could hold."""
    x = _prompt_and_whole(spark, d)
    rows = lambda c: x.select("id", F.posexplode(c).alias("pos", "token"))
    return tokens.first_divergence(rows("prompt"), rows("whole"), ["id"], "pos", "token", block=64)


#: Sixteen vectors are a group's completions, their labels rewards; gradients are sums under whole-group and half-group advantages.
_GEO = """WITH v AS (SELECT vec_id // 16 AS grp, vec_id % 16 AS k, CAST(label % 3 = 0 AS INT) AS reward, embedding FROM embeddings),
 s AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM v),
 h AS (SELECT s.*, partition, CASE partition WHEN 'first_last' THEN CAST(2 * k >= n AS INT) WHEN 'even_odd' THEN k % 2 ELSE CAST(4 * k >= n AND 4 * k < 3 * n AS INT) END AS half FROM s, (SELECT unnest(['first_last', 'even_odd', 'outer_inner']) AS partition)),
 a AS (SELECT *, avg(reward) OVER g AS m16, stddev_samp(reward) OVER g AS s16, avg(reward) OVER w AS m8, stddev_samp(reward) OVER w AS s8 FROM h WINDOW g AS (PARTITION BY grp, partition), w AS (PARTITION BY grp, partition, half)),
 b AS (SELECT grp, partition, embedding, CASE WHEN s16 > 1e-12 THEN (reward - m16) / s16 ELSE 0 END AS p, CASE WHEN s8 > 1e-12 THEN (reward - m8) / s8 ELSE 0 END AS q FROM a),
 u AS (SELECT grp, partition, i, sum(p * CAST(x AS DOUBLE)) AS x, sum(q * CAST(x AS DOUBLE)) AS y FROM (SELECT grp, partition, p, q, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM b) GROUP BY ALL),
 n AS (SELECT grp, partition, sqrt(sum(x * x)) AS base_norm, sqrt(sum(y * y)) AS norm, sum(x * y) AS xy, sqrt(sum((x - y) * (x - y))) AS apart FROM u GROUP BY ALL)"""


@query("gradient_geometry", f"""{_GEO} SELECT grp, partition, round(norm, 5) AS norm, round(base_norm, 5) AS base_norm, round(CASE WHEN norm > 0 THEN base_norm / norm END, 4) AS norm_ratio,
 round(CASE WHEN norm * base_norm > 0 THEN xy / (norm * base_norm) END, 4) AS cosine, round(CASE WHEN norm > 0 THEN apart / norm END, 4) AS relative_diff FROM n""")
def gradient_geometry(spark, d):
    v = read(spark, d, "embeddings").selectExpr(
        "vec_id div 16 AS grp", "vec_id % 16 AS k", "cast(label % 3 = 0 as int) AS reward", "embedding"
    )
    g = geometry.gram(geometry.blocks(v, ["grp", "k"], "embedding", 24), "grp", "k", "block", "embedding")
    w = groups.partition_advantages(v.select("grp", "k", "reward"), "grp", "k", "reward", least=1)
    x = geometry.compared(g, w, "grp", "partition", "k", "a16", "a8")
    return x.select("grp", "partition", *[F.round(c, 5).alias(c) for c in ("norm", "base_norm")],
                    *[F.round(c, 4).alias(c) for c in ("norm_ratio", "cosine", "relative_diff")])

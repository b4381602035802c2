"""Token sequences, audits and geometry of vectors against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ponderlake.functions import tokens as T
from ponderlake.operators import geometry, tokens

KIND = "id long, ids array<long>, new array<double>, old array<double>, ref array<double>, advantage double"


@pytest.fixture(scope="module")
def seqs(spark):
    rng = random.Random(2)
    rows = [(1, [], [], [], [], 1.0), (2, None, None, None, None, 1.0), (3, [2], [-1.0], [-1.0], [-1.0], -2.0), (4, [5, 6, 7], [-1.0, -2.0, -3.0], [-1.1, -2.0, -2.0], [-1.0, -2.0, -3.0], 0.5)]
    for i in range(5, 40):
        n = rng.randint(1, 30)
        rows.append((i, [rng.randint(2, 12) for _ in range(n)], *[[-4 * rng.random() for _ in range(n)] for _ in range(3)], rng.uniform(-1, 1)))
    return spark.createDataFrame(rows, KIND), rows


def counted(ids, end=2):
    ids = ids or []
    return ids.index(end) + 1 if end in ids else len(ids)


def test_ends_and_masks(spark, seqs):
    df, rows = seqs
    n = T.through_end(F.col("ids"), F.lit(2).cast("long"))
    pad = T.before_padding(F.col("ids"), F.lit(2).cast("long"))
    got = df.select("id", n.alias("n"), pad.alias("p"), T.loss_mask(F.lit(3), n, F.lit(3) + F.coalesce(F.size("ids"), F.lit(0))).alias("m")).collect()
    for r in got:
        ids = next(x[1] for x in rows if x[0] == r.id) or []
        assert r.n == counted(ids) and r.p == min(len(ids), max(1, sum(t != 2 for t in ids)))
        assert list(r.m) == [int(3 <= p < 3 + counted(ids)) for p in range(1, 3 + len(ids))]


def test_losses(spark, seqs):
    df, rows = seqs
    n = T.through_end(F.col("ids"), F.lit(2).cast("long"))
    got = tokens.policy_loss(df, n, "new", "old", "ref", "advantage", beta=0.1).first()
    per, kls, clips = [], [], []
    for _, ids, new, old, ref, a in rows:
        k = counted(ids)
        if not k:
            continue
        r = [math.exp(x - y) for x, y in zip(new[:k], old[:k])]
        kl = [math.exp(z - x) - (z - x) - 1 for x, z in zip(new[:k], ref[:k])]
        per.append([-min(x * a, min(max(x, 0.8), 1.2) * a) + 0.1 * y for x, y in zip(r, kl)])
        kls += kl
        clips += [x < 0.8 or x > 1.2 for x in r]
    flat = [x for p in per for x in p]
    assert (got.sequences, got.tokens) == (len(per), len(flat))
    assert got.token_loss == pytest.approx(sum(flat) / len(flat)) and got.sequence_loss == pytest.approx(sum(sum(p) / len(p) for p in per) / len(per))
    assert got.kl == pytest.approx(sum(kls) / len(kls)) and got.clip_fraction == pytest.approx(sum(clips) / len(clips))
    none = tokens.policy_loss(df.where("id < 3"), n, "new", "old", "ref", "advantage").first()
    assert (none.sequences, none.tokens, none.token_loss, none.sequence_loss) == (0, 0, None, None)
    stats = {r.id: r for r in tokens.sequence_stats(df, n, "new", "old", "ref").collect()}
    assert (stats[1].logp, stats[1].logp_mean, stats[2].n_tokens, stats[2].ratio_max) == (0.0, None, 0, None)
    assert stats[4].logp == pytest.approx(-6) and stats[4].clip_fraction == pytest.approx(1 / 3)


def test_reference_audit(spark, seqs):
    df, _ = seqs
    n = T.through_end(F.col("ids"), F.lit(2).cast("long"))
    same = tokens.audit_summary(tokens.reference_audit(df, n, "new", "new")).first()
    assert same.ok and same.max_abs_diff == 0 and same.diverging == 0
    got = {r.id: r for r in tokens.reference_audit(df, n, "new", "old").collect()}
    assert set(got).isdisjoint({1, 2}) and got[4].first_divergence == 0 and got[4].max_abs_diff == pytest.approx(1) and got[3].first_divergence is None
    assert not tokens.audit_summary(tokens.reference_audit(df, n, "new", "old")).first().ok
    assert tokens.audit_summary(tokens.reference_audit(df.limit(0), n, "new", "old")).first().ok


def test_common_prefixes(spark):
    rng = random.Random(6)
    pairs = [(0, [], []), (1, None, [1]), (2, [1, 2, 3], [1, 2, 3]), (3, [1, 2], [1, 2, 3]), (4, [9], [8])]
    for i in range(5, 60):
        a = [rng.randint(0, 9) for _ in range(rng.randint(1, 300))]
        b = [*a[: rng.randint(0, len(a))], *[rng.randint(0, 9) for _ in range(rng.randint(0, 200))]]
        pairs.append((i, a, b))

    def lcp(a, b):
        k = 0
        while k < min(len(a or []), len(b or [])) and a[k] == b[k]:
            k += 1
        return k

    df = spark.createDataFrame(pairs, "id long, a array<long>, b array<long>")
    assert {r.id: r.n for r in df.select("id", T.common_prefix(F.col("a"), F.col("b")).alias("n")).collect()} == {i: lcp(a, b) for i, a, b in pairs}
    rows = lambda c: df.select("id", F.posexplode(c).alias("pos", "token"))
    for block in (1, 7, 1024):
        got = {r.id: tuple(r)[1:] for r in tokens.first_divergence(rows("a"), rows("b"), ["id"], "pos", "token", block).collect()}
        assert got == {i: (lcp(a, b), len(a or []), len(b or [])) for i, a, b in pairs if a or b}
    masked = df.where("id = 3").select(T.labels(F.col("b"), F.lit(2)).alias("l")).first().l
    assert list(masked) == [-100, -100, 3]


def test_labels_find_their_prefix_once(spark):
    """The prefix is found once a sequence, not at every token; any prefix, null and empty sequences."""
    rows = [(1, [5, 6, 7], 2), (2, [5, 6], 9), (3, [5, 6], -1), (4, [5, 6], None), (5, [], 1), (6, None, 1), (7, [5, None, 7], 1), (8, [5, None, 7], 2)]
    df = spark.createDataFrame(rows, "id long, ids array<long>, n int")
    got = {r.id: r.l for r in df.select("id", T.labels(F.col("ids"), F.col("n")).alias("l")).collect()}
    assert got == {1: [-100, -100, 7], 2: [-100, -100], 3: [5, 6], 4: [5, 6], 5: [], 6: None, 7: [-100, None, 7], 8: [-100, -100, 7]}
    x = df.select("id", "ids", T.common_prefix(F.col("ids"), F.slice("ids", 1, 2)).alias("common"))
    plan = x.select("id", T.labels(F.col("ids"), F.col("common")).alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and plan.count("aggregate(") <= 1


def test_geometry(spark):
    """Vectors in blocks, ragged and with a missing block, against numpy."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((5, 4, 1000))
    x[0, 1, 500:] = 0  # given without its last blocks
    x[4] = 0
    rows = [(g, k, [float(v) for v in (x[g, k] if (g, k) != (0, 1) else x[g, k, :500])]) for g in range(5) for k in range(4)]
    df = spark.createDataFrame(rows, "g long, k int, v array<double>").repartition(3)
    grams = geometry.gram(geometry.blocks(df, ["g", "k"], "v", 96), "g", "k", "block", "v")
    p, q = rng.standard_normal((2, 4, 3, 5))
    w = [(g, f"w{n}", k, float(p[k, n, g]), float(q[k, n, g]) if n else 0.0) for g in range(5) for n in range(3) for k in range(4)]
    weights = spark.createDataFrame(w, "g long, name string, k int, a double, b double")
    got = {(r.g, r.name): r for r in geometry.compared(grams, weights, "g", "name", "k", "a", "b").collect()}
    assert len(got) == 15
    for g in range(5):
        for n in range(3):
            a, b = p[:, n, g] @ x[g], (q[:, n, g] if n else np.zeros(4)) @ x[g]
            r = got[g, f"w{n}"]
            assert r.base_norm == pytest.approx(np.linalg.norm(a)) and r.norm == pytest.approx(np.linalg.norm(b))
            if n and g < 4:
                assert r.norm_ratio == pytest.approx(np.linalg.norm(a) / np.linalg.norm(b)) and r.cosine == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
                assert r.relative_diff == pytest.approx(np.linalg.norm(a - b) / np.linalg.norm(b))
            else:
                assert (r.norm_ratio, r.cosine, r.relative_diff) == (None, None, None)

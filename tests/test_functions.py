"""Formats, parsing, rewards, policy and statistics formulas."""

import json
import math

import pytest
from pyspark.sql import functions as F

from ponderlake.functions import logic, parsing, policy, statistics, text
from ponderlake.operators import generation, groups, positions, puzzles, significance

PEOPLE = ["Alice", "Bob", "Carol"]


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def names():
    return F.array(*[F.lit(p) for p in PEOPLE])


PARSED = [
    ("nothing here", None, "missing <answer> block"),
    ("<answer>\nAlice: knight\nBob: knave\nCarol: knight\n</answer>", "KNK", "ok"),
    ("<answer>Alice: knave\nBob: knave\nCarol: knave</answer> <answer>Alice: knight</answer>", "NNN", "ok"),
    ("<ANSWER>\nALICE: Knight\n\n  bob : KNAVE  \nCarol:knight\n</Answer>", "KNK", "ok"),
    ("<answer>Alice: knight\nBob is a knave\nCarol: knight</answer>", None, "invalid answer line: 'Bob is a knave'"),
    ("<answer>Alice: knight\nDave: knave\nCarol: knight</answer>", None, "unknown person: Dave"),
    ("<answer>Alice: knight\nalice: knave\nCarol: knight</answer>", None, "duplicate person: Alice"),
    ("<answer>Alice: knight\nCarol: knight</answer>", None, "missing people: ['Bob']"),
    ("<answer></answer>", None, "missing people: ['Alice', 'Bob', 'Carol']"),
    ("<answer>Alice: knight\nBob: knave\nCarol: knight</answer> after", "KNK", "ok"),
    (None, None, "missing <answer> block"),
]


def test_parse_answer(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(PARSED)], "i int, t string")
    rows = df.select("i", parsing.parse_answer(F.col("t"), names()).alias("p")).orderBy("i").collect()
    for (_, pattern, reason), r in zip(PARSED, rows, strict=True):
        got = r.p.answer and "".join("K" if r.p.answer[p] == "knight" else "N" for p in PEOPLE)
        assert (got, r.p.reason, r.p.ok) == (pattern, reason, reason == "ok")


@pytest.mark.parametrize(("answer", "exact", "partial"), [("KNK", 1, 1), ("KNN", 0, 2 / 3), ("NNK", 0, 2 / 3), ("NNN", 0, 1 / 3), ("NKN", 0, 0), (None, 0, 0)])
def test_rewards(spark, answer, exact, partial):
    a, g = F.lit(answer).cast("string"), F.lit("KNK")
    r = one(spark, parsing.reward(a, g), parsing.reward(a, g, "partial"))
    assert r.c0 == exact and r.c1 == pytest.approx(partial)


def test_reward_faults(spark):
    with pytest.raises(ValueError, match="unknown reward mode"):
        parsing.reward(F.lit("K"), F.lit("K"), "other")
    with pytest.raises(Exception, match="no people"):
        one(spark, parsing.reward(F.lit(""), F.lit("")))


def test_score_is_answer_and_format(spark):
    assert one(spark, parsing.score_completion(F.lit("KNK"), F.lit("KNK"), F.lit(True))).c0 == pytest.approx(1.1)


def test_policy(spark):
    r = one(spark, policy.policy_ratio(F.lit(-0.8), F.lit(-1.0)), policy.implied_hit(F.lit(0.5), 2))
    assert r.c0 == pytest.approx(math.exp(0.2)) and r.c1 == 0.75
    t = {(x.k, x.m): x for x in spark.sql("SELECT 8 AS k, 1 AS m UNION ALL SELECT 16, 1").select("k", "m", *[c.alias(n) for n, c in policy.analytic_advantage(F.col("k"), F.col("m")).items()]).collect()}
    assert t[8, 1].std == pytest.approx(0.35355339) and t[8, 1].a_plus == pytest.approx(2.47487373) and t[8, 1].a_plus_eps == pytest.approx(2.47417393) and t[8, 1].a_minus_eps == pytest.approx(-0.35345342)
    assert t[16, 1].a_plus_eps == pytest.approx(3.7485006) and t[16, 1].a_minus_eps == pytest.approx(-0.24990004)


@pytest.mark.parametrize(("b", "c", "p", "chi2"), [(133, 154, 0.23772336278505, 1.39372822299652), (159, 128, 0.07640373813290, None), (76, 128, 0.00033290416439, 12.75), (0, 0, 1.0, None), (5, 5, 1.0, 0.1)])
def test_mcnemar(spark, b, c, p, chi2):
    r = one(spark, statistics.mcnemar_exact(F.lit(b), F.lit(c)), statistics.mcnemar_chi2(F.lit(b), F.lit(c)))
    assert r.c0 == pytest.approx(p, abs=1e-12)
    if chi2 is not None:
        assert r.c1 == pytest.approx(chi2)


def test_tails_and_wilson(spark):
    x = spark.createDataFrame([(1.39372822299652, 1.0), (24.85083, 36.0), (36.00363, 37.0), (33.13399, 37.0)], "x double, d double")
    got = [r[0] for r in x.select(statistics.chi2_sf("x", "d")).collect()]
    assert got == pytest.approx([0.23777649970011, 0.91926, 0.51560, 0.65092], abs=1e-5)
    low, high = statistics.wilson_ci(F.lit(10), F.lit(32))
    r = one(spark, low, high, *statistics.wilson_ci(F.lit(0), F.lit(0)))
    assert (r.c0, r.c1) == (pytest.approx(0.180, abs=1e-3), pytest.approx(0.486, abs=1e-3)) and r.c2 is None and r.c3 is None
    p = spark.createDataFrame([(0.5, 10), (1.0, 5)], "r double, n int").select(statistics.correlation_p("r", "n")).collect()
    assert p[0][0] == pytest.approx(0.14111328, abs=1e-6) and p[1][0] == 0


def test_lines_and_labels(spark):
    r = one(spark, text.has_repeated_line(F.lit("a\n a \n\na\nb")), text.has_repeated_line(F.lit("a\na\nb")), text.top_ops_multiset(F.lit("same+and+not")), text.json_len(F.lit("user"), F.lit('é"\n')))
    import json

    assert r.c0 is True and r.c1 is False and r.c2 == "and|not|same"
    assert r.c3 == len(json.dumps([{"role": "user", "content": 'é"\n'}], ensure_ascii=False))


# trees


def tree(op, *xs):
    return {"op": op, **dict(zip({"person_is": ("person", "value"), "not": ("expr",)}.get(op, ("left", "right")), xs, strict=True))}


def brute(t, a):
    if t["op"] == "person_is":
        return a[t["person"]] == t["value"]
    if t["op"] in ("same", "different"):
        return (a[t["left"]] == a[t["right"]]) == (t["op"] == "same")
    if t["op"] == "not":
        return not brute(t["expr"], a)
    return (all if t["op"] == "and" else any)(brute(t[k], a) for k in ("left", "right"))


def assignments():
    import itertools

    return [dict(zip(PEOPLE, x, strict=True)) for x in itertools.product(("knight", "knave"), repeat=3)]


def any_tree(rng, depth):
    kind = rng.choice(("leaf", "not", "and", "or")) if depth else "leaf"
    if kind == "leaf":
        return rng.choice(generation.leaves())
    return {"op": kind, "expr": any_tree(rng, depth - 1)} if kind == "not" else {"op": kind, "left": any_tree(rng, depth - 1), "right": any_tree(rng, depth - 1)}


def test_masks_match_evaluation():
    import random

    rng = random.Random(5)
    for _ in range(300):
        t = any_tree(rng, 4)
        mask, said, nodes, depth, ops = logic.analyse(t, PEOPLE)
        assert mask == sum(brute(t, a) << i for i, a in enumerate(assignments()))
        assert nodes == sum(ops) and 1 <= depth <= 5 and said
    with pytest.raises(ValueError, match="unknown expression operator"):
        logic.analyse({"op": "xor"}, PEOPLE)


def puzzle(spark, *trees):
    import json

    said = [(p, json.dumps(t)) for p, t in zip(PEOPLE, trees, strict=True)]
    return spark.createDataFrame([(1, PEOPLE, said)], "id int, people array<string>, statements array<struct<speaker:string,expr:string>>")


def test_solve(spark):
    p = puzzle(spark, tree("person_is", "Bob", "knight"), tree("different", "Alice", "Carol"), tree("person_is", "Alice", "knight"))
    r = puzzles.compiled(p).select("n_solutions", puzzles.solution(F.col("solutions")).alias("s")).first()
    assert (r.n_solutions, r.s) == (1, "NNN")


def test_key_ignores_spacing_and_key_order(spark):
    a = puzzle(spark, tree("same", "Bob", "Carol"), tree("not", tree("person_is", "Bob", "knave")), tree("same", "Alice", "Bob"))
    import json

    said = [(p, json.dumps(json.loads(s.expr), indent=2)) for p, s in zip(PEOPLE, a.first().statements, strict=True)]
    b = spark.createDataFrame([(2, PEOPLE, said)], a.schema)
    k = [x.select(logic.puzzle_key(F.col("people"), F.col("statements"))).first()[0] for x in (a, b)]
    assert k[0] == k[1]


@pytest.mark.parametrize("kind", ["statement", "label"])
def test_generation_is_unique_and_repeatable(spark, kind):
    g = generation.generate(spark.range(1234, 1240).withColumnRenamed("id", "seed"), kind, at_once=5)
    a, b = (sorted(map(repr, g.collect())) for _ in range(2))
    assert a == b and len(a) == 6
    c = puzzles.compiled(g.select(F.col("seed").alias("id"), "people", F.transform("statements", lambda s: F.struct(s["speaker"].alias("speaker"), s["expr"].alias("expr"))).alias("statements")))
    x = c.join(g.select(F.col("seed").alias("id"), "pattern"), "id").select("n_solutions", puzzles.solution(F.col("solutions")).alias("s"), "pattern").collect()
    assert all(r.n_solutions == 1 and r.s == r.pattern for r in x)


def test_drawn_trees_match_their_compiled_form(spark):
    """Masks, sentences and sizes built as columns against those of the trees' JSON; the grammar's shares."""
    g = generation.grown(spark.range(400).withColumnRenamed("id", "seed"), generation.tags("seed"), 3)
    rows = g.collect()
    for r in rows:
        for i in range(3):
            mask, said, nodes, depth, _ = logic.analyse(json.loads(r[f"expr_{i}_r"]), PEOPLE)
            assert (r[f"mask_{i}_r"], r[f"said_{i}_r"], r[f"nodes_{i}_r"], r[f"depth_{i}_r"]) == (mask, said, nodes, depth)
    assert 0.52 < sum(r[f"nodes_{i}_r"] == 1 for r in rows for i in range(3)) / 1200 < 0.68
    assert len(generation.leaves()) == 18 == len({r.expr_0_r for r in rows if r.nodes_0_r == 1})


def test_label_first_statements_agree_with_the_target(spark):
    g = generation.generate(spark.range(40).withColumnRenamed("id", "seed"), "label")
    target = {(r.seed, r.attempt): r.t for r in spark.range(40).selectExpr("id AS seed", "explode(sequence(1, 64)) AS attempt").selectExpr("*", f"{generation.target_sql(generation.SPARK)} AS t").collect()}
    assert all(r.pattern == text.PATTERNS[target[r.seed, r.attempts]] for r in g.collect())


def test_seeds_without_a_puzzle_are_an_error(spark):
    with pytest.raises(RuntimeError, match="no uniquely solvable puzzle in 1 attempts"):
        generation.generate(spark.range(60).withColumnRenamed("id", "seed"), attempts=1)


@pytest.mark.parametrize("kind", ["statement", "label"])
def test_generation_is_dealt_to_all_tasks(spark, kind):
    """A page of seeds isn't one task's work, and a place that no parent takes isn't drawn."""
    seeds = spark.range(400).withColumnRenamed("id", "seed")
    assert generation.spread(seeds.coalesce(1)).select(F.spark_partition_id()).distinct().count() == 4
    assert generation.generate(seeds, kind).select("seed").distinct().count() == 400
    plan = generation._needed(generation.tags("seed")[:1], 1, ("mask",))
    assert [x.rsplit(" ", 1)[1] for x in plan[0]] == ["op_0_r"]
    assert all("CASE WHEN op_0_r >= " in x for x in plan[1] if "_ra" in x.rsplit(" ", 1)[1] or "_rb" in x.rsplit(" ", 1)[1])



def test_texts(spark):
    p = puzzle(spark, tree("person_is", "Bob", "knight"), tree("different", "Alice", "Carol"), tree("person_is", "Alice", "knight"))
    c = puzzles.compiled(p).first()
    assert list(c.texts) == ["Bob is a knight", "Alice and Carol are different types", "Alice is a knight"]
    at = F.array(F.lit(0), F.lit(1), F.lit(2))
    trace = puzzles.compiled(p).select(text.fmt_reasoning_trace(F.col("masks"), at, F.col("people"))).first()[0].split("\n")
    assert len(trace) == 10 and trace[8] == "- Alice=knave, Bob=knave, Carol=knave: valid; every statement matches its speaker's type."
    assert trace[1] == "- Alice=knight, Bob=knight, Carol=knight: invalid because the statement by Bob does not match the speaker's type."


# groups


def test_advantages(spark):
    df = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate((0, 1, 0, 1))] + [("z", i, 0.0) for i in range(3)] + [("s", 0, 1.0)], "id string, k int, reward double")
    got = {m: {(r.id, r.k): r.advantage for r in groups.advantage(df, m).collect()} for m in ("population", "population_masked", "sample", "noeps")}
    assert [got["population"]["g", k] for k in range(4)] == pytest.approx([-1, 1, -1, 1], abs=1e-6)
    std = math.sqrt(1 / 3)
    assert got["sample"]["g", 1] == pytest.approx(0.5 / (std + 1e-4)) and got["noeps"]["g", 1] == pytest.approx(0.5 / std)
    assert all(v == 0 for m in got.values() for (i, _), v in m.items() if i != "g")
    with pytest.raises(ValueError, match="unknown advantage mode"):
        groups.advantage(df, "other")


def test_rescue(spark):
    answers = ["KNN", "NNK", "NNN", "NKN", "KNN", "NNN", "NNK", "NKN"]
    df = spark.createDataFrame([("g", k, a) for k, a in enumerate(answers)], "id string, k int, a string")
    df = df.select("id", "k", parsing.reward(F.col("a"), F.lit("KNK")).alias("reward"), parsing.reward(F.col("a"), F.lit("KNK"), "partial").alias("shaped"))
    r = groups.rescue(df).first()
    assert r.all_wrong and r.rescued and r.unique_values == 3 and r.shaped_std > 0
    a = {x.k: x.advantage for x in groups.advantage(df, "sample", reward="shaped").collect()}
    assert a[0] > 0 > a[3]


def test_summary_of_published_histogram(spark):
    hist = [13, 14, 13, 17, 16, 16, 20, 16, 75]
    rows = [(f"{m}-{i}", k, float(k < m)) for m, n in enumerate(hist) for i in range(n) for k in range(8)]
    s = groups.rollout_summary(groups.rollout_group(spark.createDataFrame(rows, "id string, k int, reward double"), answer=None)).first()
    assert (s.groups, s.mean_reward, s.mean_std) == (200, pytest.approx(0.666875), pytest.approx(0.24093521441020))
    assert (s.avg_correct, s.pass_at_k, s.zero_variance_ratio) == (pytest.approx(5.335), pytest.approx(0.935), pytest.approx(0.44))


def test_resampling_counts(spark):
    from ponderlake.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    assert QUERIES["bootstrap_statistics"](spark, sf).count() == 10000
    for name in ("bootstrap_two_sample", "bootstrap_cluster", "bootstrap_region"):
        assert QUERIES[name](spark, sf).collect()[0].reps == 10000
    p = QUERIES["permutation_test"](spark, sf).collect()[0].p * 1001
    assert p >= 1 - 1e-9 and abs(p - round(p)) < 1e-6


def test_binomial_quantiles():
    """The inverse of the distribution function, summed term by term."""
    for n, p in ((1, 0.3), (7, 0.5), (40, 0.02), (400, 0.11), (400, 0.97)):
        u = [0.0001, 0.01, 0.2, 0.5, 0.77, 0.99, 0.99999]
        cdf, total = [], 0.0
        for k in range(n + 1):
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            cdf.append(total)
        want = [sum(c < x for c in cdf) for x in u]
        assert significance._binomial_quantile(n, p, significance.np.array(u)).tolist() == want
    x = significance._binomial_quantile(10**9, 0.3, significance.np.array([0.5, 0.975]))
    assert abs(x[0] - 3e8) < 3 and abs(x[1] - 3e8 - 1.96 * math.sqrt(2.1e8)) < 50


def test_resampled_signs(spark):
    """Mean and spread of resamples of 1000 paired differences, and the edges."""
    df = spark.range(1000).selectExpr("CASE WHEN id < 100 THEN 1 WHEN id < 160 THEN -1 ELSE 0 END AS x")
    v = [r.value for r in significance.bootstrap_signs(df, "x", 4000).collect()]
    mean = sum(v) / len(v)
    spread = math.sqrt(sum((x - mean) ** 2 for x in v) / len(v))
    assert len(v) == 4000 and abs(mean - 0.04) < 0.001 and abs(spread - math.sqrt((0.16 - 0.04**2) / 1000)) < 0.0005
    assert {r.value for r in significance.bootstrap_signs(df.where("x = 1"), "x", 50).collect()} == {1.0}
    assert significance.bootstrap_signs(df.limit(0), "x", 50).count() == 0


def test_quantiles_ranks_and_quartiles(spark):
    """Against numpy, with ties, nulls, groups of one and null groups."""
    rng = significance.np.random.default_rng(4)
    rows = [(None if i % 5 == 0 else f"g{i % 3}", None if i % 17 == 0 else float(rng.choice([rng.normal(), 0.0, 1e6]))) for i in range(700)] + [("alone", 2.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in positions.with_quantiles(df.groupBy("g").count(), df, ["g"], {"a": ("v", 0.1), "b": ("v", 0.5), "c": ("v", 1.0)}).collect()}
    for g in {g for g, _ in rows}:
        v = [x for h, x in rows if h == g and x is not None]
        want = [significance.np.percentile(v, p) if v else None for p in (10, 50, 100)]
        assert [got[g].a, got[g].b, got[g].c] == pytest.approx(want) if v else [got[g].a, got[g].b] == [None, None]
    x = spark.createDataFrame([(i, float(i // 7 % 4)) for i in range(101)], "id long, v double")
    order = sorted(((i // 7 % 4, i) for i in range(101)))
    ends = {r.id: r.end for r in positions.quartile_ends(x, "id", ["v", "id"]).collect()}
    assert {i for i, e in ends.items() if e == "low"} == {i for _, i in order[:25]} and {i for i, e in ends.items() if e == "high"} == {i for _, i in order[-26:]}

"""Queries over training examples, candidates, samples and evaluation records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logic, text
from ..operators import generation, groups, landscape, puzzles, records, tables
from .base import ASSIGN_SQL, PRED_SQL, PUZZLE_SQL, ROLL_SQL, label, plain_rollouts, predictions, puzzle_trees, rollouts
from .landscape_queries import WITH as LAND
from .landscape_queries import _ls
from .registry import QUERIES, ORACLES, query, read
from .rollout_queries import PART_SQL, _partitions
from .text_queries import _SOLVED, _parsed, _tree_sql, PARSE_SQL, TRACE_SQL, people

R6 = lambda c: F.round(c, 6)
_UNIQUE = f"{_SOLVED}, un AS (SELECT id, pattern FROM sp WHERE n = 1)"
_BLOCK = "'<answer>' || chr(10) || 'Alice: ' || CASE pattern[1] WHEN 'K' THEN 'knight' ELSE 'knave' END || chr(10) || 'Bob: ' || CASE pattern[2] WHEN 'K' THEN 'knight' ELSE 'knave' END || chr(10) || 'Carol: ' || CASE pattern[3] WHEN 'K' THEN 'knight' ELSE 'knave' END || chr(10) || '</answer>'"


def _said(j: int) -> str:
    one, two = (
        f"(['Alice', 'Bob', 'Carol'])[CAST({x} AS INT) + 1]" for x in (f"first{j}", f"((first{j} + 1 + shift{j}) % 3)")
    )
    leaf = f"CASE kind{j} WHEN 0 THEN {one} || ' is a ' || CASE WHEN shift{j} = 0 THEN 'knight' ELSE 'knave' END WHEN 1 THEN {one} || ' and ' || {two} || ' are the same type' ELSE {one} || ' and ' || {two} || ' are different types' END"
    return f"CASE neg{j} WHEN 1 THEN 'it is not true that ' ELSE '' END || {leaf}"


def _prompt(kind: str) -> str:
    lines = [f"'{x}'" for x in text.PROMPT_HEAD] + [
        f"'{p} says: ' || {_said(j)} || '.'" for j, p in enumerate(("Alice", "Bob", "Carol"))
    ] + [f"'{x}'" for x in text.PROMPT_TAIL[kind]]
    return " || chr(10) || ".join(lines)


def _compiled(spark, d):
    return puzzles.compiled(puzzle_trees(spark, d))


def _statements():
    return F.transform(
        F.arrays_zip("speakers", "texts"),
        lambda x: F.struct(x["speakers"].alias("speaker"), F.concat(x["texts"], F.lit(".")).alias("text"))
    )


def _solved(spark, d):
    c = _compiled(spark, d).where("n_solutions = 1").withColumn("pattern", puzzles.solution(F.col("solutions")))
    return c.withColumn("answer", text.pattern_decode(F.col("pattern"), people()))


@query("expr_render", f"WITH {PUZZLE_SQL} SELECT id, {_said(0)} AS s0, {_said(1)} AS s1, {_said(2)} AS s2 FROM pz")
def expr_render(spark, d):
    return _compiled(spark, d).select("id", *[F.get("texts", F.lit(j)).alias(f"s{j}") for j in range(3)])


@query(
    "expr_construct",
    f"WITH {PUZZLE_SQL} SELECT id, {_tree_sql(0)} AS t0, {_tree_sql(1)} AS t1, {_tree_sql(2)} AS t2 FROM pz"
)
def expr_construct(spark, d):
    return puzzle_trees(spark, d).select(
        "id", *[F.get("statements", F.lit(j))["expr"].alias(f"t{j}") for j in range(3)]
    )


@query("fmt_prompt", f"WITH {PUZZLE_SQL} SELECT id, md5({_prompt('reasoning')}) AS prompt_md5 FROM pz")
def fmt_prompt(spark, d):
    return _compiled(spark, d).select("id", F.md5(text.fmt_prompt(_statements())).alias("prompt_md5"))


@query("fmt_prompt_answer_only", f"WITH {PUZZLE_SQL} SELECT id, md5({_prompt('answer_only')}) AS prompt_md5 FROM pz")
def fmt_prompt_answer_only(spark, d):
    return _compiled(spark, d).select("id", F.md5(text.fmt_prompt(_statements(), "answer_only")).alias("prompt_md5"))


@query("fmt_completion_answer_only", f"{_UNIQUE} SELECT id, {_BLOCK} AS completion FROM un")
def fmt_completion_answer_only(spark, d):
    return _solved(spark, d).select("id", text.fmt_answer_block(F.col("answer"), people()).alias("completion"))


_LINES = f"{_UNIQUE}, tr AS (SELECT id, {TRACE_SQL} AS trace FROM asg WHERE id IN (SELECT id FROM un) GROUP BY id)"


@query(
    "fmt_completion",
    f"{_LINES} SELECT id, '<reasoning>' || chr(10) || trace || chr(10) || '</reasoning>' || chr(10) || {_BLOCK} AS "
    f"completion FROM un JOIN tr USING (id)"
)
def fmt_completion(spark, d):
    trace = text.fmt_reasoning_trace(F.col("masks"), F.array(F.lit(0), F.lit(1), F.lit(2)), F.col("people"))
    return _solved(spark, d).select(
        "id", text.fmt_completion(trace, F.col("answer"), people(), F.col("n_solutions")).alias("completion")
    )


ORACLES["fmt_prompts"] = (
    f"{_LINES} SELECT id, {_prompt('reasoning')} AS prompt, {_prompt('answer_only')} AS answer_prompt, '<reasoning>' || "
    f"chr(10) || trace || chr(10) || '</reasoning>' || chr(10) || {_BLOCK} AS completion, {_BLOCK} AS answer_only "
    f"FROM un JOIN tr USING (id) JOIN pz USING (id)"
)


def _examples(spark, d):
    x = _solved(spark, d)
    return records.sft_example(
        x.select("id", "answer", _statements().alias("said")), text.fmt_prompt(F.col("said")),
        text.fmt_answer_block(F.col("answer"), people())
    ).drop("said")


_EXAMPLE = f"{_UNIQUE}, ex AS (SELECT id, {_prompt('reasoning')} AS prompt, {_BLOCK} AS completion FROM un JOIN pz USING (id))"


@query(
    "build_sft_example",
    f"{_EXAMPLE} SELECT id, 2 AS turns, 'user>assistant' AS roles, md5(prompt || completion) AS text_md5 FROM ex"
)
def build_sft_example(spark, d):
    m = F.col("messages")
    return _examples(spark, d).select(
        "id",
        F.size(m).alias("turns"),
        F.array_join(F.transform(m, lambda x: x["role"]), ">").alias("roles"),
        F.md5(F.array_join(F.transform(m, lambda x: x["content"]), "")).alias("text_md5")
    )


@query("convert_answer_only", f"{_EXAMPLE} SELECT id, md5(prompt || 'x' || completion) AS text_md5 FROM ex")
def convert_answer_only(spark, d):
    x = records.answer_only(_examples(spark, d), F.concat(F.lit("x"), F.col("completion")[0]["content"]))
    return x.select("id", F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "")).alias("text_md5"))


@query("to_rl_processed", f"{_EXAMPLE} SELECT id, md5(prompt) AS prompt_md5 FROM ex")
def to_rl_processed(spark, d):
    return records.rl_example(_examples(spark, d)).select(
        "id", F.md5(F.col("prompt")[0]["content"]).alias("prompt_md5")
    )


@query(
    "all_candidates",
    f"WITH {PRED_SQL}, c AS (SELECT CAST(c AS INT) AS cand, {label('c')} AS pattern FROM (SELECT unnest(range(8)) AS c)) "
    f"SELECT id, cand, {_BLOCK} AS completion, pattern = gold AS gold FROM pred, c"
)
def all_candidates(spark, d):
    """All eight completions of each question."""
    x = predictions(spark, d).select("id", F.col("gold").alias("right"))
    x = x.crossJoin(F.broadcast(records.candidates(spark, people())))
    return x.select("id", "cand", "completion", (F.col("pattern") == F.col("right")).alias("gold"))


@query(
    "verify_formatter",
    f"{_UNIQUE}, f AS (SELECT pattern, {_BLOCK} AS completion FROM un), c AS (SELECT {label('c')} AS pattern, "
    f"'<answer>' || chr(10) || array_to_string(list_transform([0, 1, 2], lambda i: ['Alice: ', 'Bob: ', 'Carol: '][i + "
    f"1] || CASE WHEN c // [4, 2, 1][i + 1] % 2 = 0 THEN 'knight' ELSE 'knave' END), chr(10)) || chr(10) || '</answer>' "
    f"AS completion FROM (SELECT unnest(range(8)) AS c)) SELECT count(*) AS rows, count(*) FILTER (f.completion IS "
    f"DISTINCT FROM c.completion) AS different FROM f LEFT JOIN c USING (pattern)"
)
def verify_formatter(spark, d):
    c = F.broadcast(records.candidates(spark, people()))
    return records.differing(
        _solved(spark, d).join(c, "pattern"), text.fmt_answer_block(F.col("answer"), people()), F.col("completion")
    )


@query(
    "join_cross_candidates",
    f"{_UNIQUE} SELECT id, CAST(c AS INT) AS cand, {label('c')} = pattern AS gold FROM un, (SELECT unnest(range(8)) AS "
    f"c)"
)
def join_cross_candidates(spark, d):
    c = F.broadcast(records.candidates(spark, people()).select("cand", F.col("pattern").alias("p")))
    return _solved(spark, d).select("id", "pattern").crossJoin(c).select(
        "id", "cand", (F.col("p") == F.col("pattern")).alias("gold")
    )


@query(
    "join_cross_assign",
    f"WITH {PUZZLE_SQL}, {ASSIGN_SQL} SELECT id, count(*) AS n, CAST(sum(a) AS BIGINT) AS total FROM asg GROUP BY id"
)
def join_cross_assign(spark, d):
    a = F.broadcast(puzzles.assignments(spark).select("a"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id")).crossJoin(a).groupBy("id").agg(
        F.count("*").alias("n"), F.sum("a").alias("total")
    )


_CANON = "CASE WHEN ok THEN '{\"Alice\":\"' || CASE pattern[1] WHEN 'K' THEN 'knight' ELSE 'knave' END || '\",\"Bob\":\"' || CASE pattern[2] WHEN 'K' THEN 'knight' ELSE 'knave' END || '\",\"Carol\":\"' || CASE pattern[3] WHEN 'K' THEN 'knight' ELSE 'knave' END || '\"}' END"


@query("canonical_answer", f"WITH {PARSE_SQL} SELECT id, {_CANON} AS answer FROM pa")
def canonical_answer(spark, d):
    return _parsed(spark, d).select("id", records.canonical_answer(F.col("answer"), people()).alias("answer"))


@query(
    "eval_record",
    f"WITH {PARSE_SQL} SELECT reason, ok AS format_valid, pattern AS prediction_pattern, count(*) AS n, count(*) FILTER "
    f"(pattern = gold) AS correct FROM pa GROUP BY ALL"
)
def eval_record(spark, d):
    from ..functions.parsing import eval_record as build

    e = _parsed(spark, d).select(build(F.col("text"), people(), F.col("gold")).alias("e")).select("e.*")
    return e.groupBy(
        F.col("parse_reason").alias("reason"), "format_valid", "prediction_pattern"
    ).agg(F.count("*").alias("n"), F.count_if(F.col("correct")).alias("correct"))


@query(
    "gen_split_seeds",
    "SELECT n_nationkey AS split_index, CAST(20260831 + n_nationkey * 1000003 AS BIGINT) AS seed FROM nation"
)
def gen_split_seeds(spark, d):
    n = F.col("n_nationkey").cast("bigint")
    return read(spark, d, "nation").select(
        F.col("n_nationkey").alias("split_index"), text.split_seed(F.lit(20260831).cast("bigint"), n).alias("seed")
    )


@query(
    "filter_predicates",
    f"{LAND} SELECT count(*) AS n, round(avg(gold_q), 6) AS mean_q FROM ls WHERE gold_rank > 1 AND gold_q < 0.2 AND "
    f"gold IN (0, 2, 4)"
)
def filter_predicates(spark, d):
    x = _ls(spark, d).where((F.col("gold_rank") > 1) & (F.col("gold_q") < 0.2) & F.col("gold").isin(0, 2, 4))
    return x.agg(F.count("*").alias("n"), R6(F.avg("gold_q")).alias("mean_q"))


@query(
    "agg_checkpoint_eval",
    f"WITH {PRED_SQL} SELECT id % 5 AS step, count(*) AS count, count(*) FILTER (pred_a = gold) AS exact, count(*) "
    f"FILTER (pred_a <> 'invalid') AS format_valid, round(avg(CAST(pred_a = gold AS INT)), 6) AS exact_accuracy, "
    f"round(avg(CAST(pred_a <> 'invalid' AS INT)), 6) AS format_accuracy FROM pred GROUP BY 1"
)
def agg_checkpoint_eval(spark, d):
    x = records.checkpoint_eval(predictions(spark, d).withColumn("step", F.col("id") % 5), "step", "gold", "pred_a")
    return x.withColumns({c: R6(F.col(c)) for c in ("exact_accuracy", "format_accuracy")})


@query(
    "agg_val_table",
    f"WITH {PRED_SQL} SELECT id % 5 AS step, round(avg(CAST(pred_a = gold AS INT)), 6) AS exact_accuracy, "
    f"round(avg(CAST(pred_a <> 'invalid' AS INT)), 6) AS format_accuracy FROM pred GROUP BY 1"
)
def agg_val_table(spark, d):
    return agg_checkpoint_eval(spark, d).select("step", "exact_accuracy", "format_accuracy")


@query(
    "agg_probe_by_step",
    f"WITH {ROLL_SQL} SELECT step, count(*) AS n, count(*) FILTER (reward = 1) AS correct, round(avg(reward), 6) AS "
    f"hit_rate FROM roll GROUP BY step"
)
def agg_probe_by_step(spark, d):
    return records.probe_by_step(
        plain_rollouts(spark, d), "step", "reward"
    ).withColumn("hit_rate", R6(F.col("hit_rate")))


@query("param_delta", "SELECT count(*) AS values, round(max(abs(p_retailprice - p_retailprice * (1 + p_size / 1000.0::DOUBLE))), 6) AS max_abs_delta FROM part".replace("AS values", 'AS "values"'))
def param_delta(spark, d):
    p = read(spark, d, "part")
    b = p.select("p_partkey", (F.col("p_retailprice") * (1 + F.col("p_size") / 1000.0)).alias("p_retailprice"))
    return records.param_delta(p, b, "p_partkey", "p_retailprice").withColumn(
        "max_abs_delta", R6(F.col("max_abs_delta"))
    )


@query(
    "sort_counts", f"WITH {PRED_SQL} SELECT gold, pred_a, count(*) AS n FROM pred GROUP BY ALL ORDER BY gold, pred_a"
)
def sort_counts(spark, d):
    return tables.distribution(predictions(spark, d), "gold", "pred_a").orderBy("gold", "pred_a")


@query("sample_fixed", "SELECT event_id, user_id FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 50")
def sample_fixed(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id")
    return records.sample_fixed(e, "event_id", 50, 42)


@query("make_partitions", f"""WITH {ROLL_SQL}, r AS (SELECT id, k, reward, count(*) OVER (PARTITION BY id) AS n FROM roll),
 m AS (SELECT id, k, reward, n, p, row_number() OVER (PARTITION BY id, p ORDER BY md5('1:' || p || ':' || id || ':' || k)) - 1 AS r FROM r, (SELECT unnest(range(20)) AS p)),
 h AS (SELECT 'first_last' AS partition, id, k, reward, CAST(2 * k >= n AS INT) AS half FROM r UNION ALL SELECT printf('rand%02d', CAST(p AS INT)), id, k, reward, CAST(2 * r >= n AS INT) FROM m)
 SELECT partition, half, count(*) AS n, CAST(sum(k) AS BIGINT) AS members, CAST(sum(reward) AS BIGINT) AS correct, CAST(sum(id * k) AS BIGINT) AS places FROM h GROUP BY ALL""")
def make_partitions(spark, d):
    x = groups.make_partitions(rollouts(spark, d).select("id", "k", "reward"), "id", "k")
    return x.groupBy("partition", "half").agg(
        F.count("*").alias("n"), F.sum("k").alias("members"), F.sum("reward").cast("long").alias("correct"),
        F.sum(F.col("id") * F.col("k")).alias("places")
    )


_GROWN = generation.sql(
    "(SELECT n_nationkey * 1000 + s_suppkey AS seed FROM supplier, nation WHERE s_nationkey = n_nationkey)",
    generation.DUCK,
    generation.tags("seed"),
    3
)
_ROOTS = " UNION ALL ".join(
    f"SELECT seed, '{p}' AS speaker, CAST(mask_{i}_r AS INT) AS mask, CAST(depth_{i}_r AS INT) AS depth, "
    f"CAST(nodes_{i}_r AS INT) AS nodes, md5(said_{i}_r) AS said FROM g"
    for i,
    p in enumerate(puzzles.PEOPLE)
)


@query("rand_expr", f"WITH g AS ({_GROWN.replace('(SELECT', 'SELECT', 1)[:-1]}) {_ROOTS}")
def rand_expr(spark, d):
    """Trees drawn by digests, compiled from their JSON; the SQL has mask, depth and size from the draws themselves."""
    s = read(spark, d, "supplier").select((F.col("s_nationkey") * 1000 + F.col("s_suppkey")).alias("seed"))
    g = generation.grown(s, generation.tags("seed"), 3, ("expr",))
    said = F.array(
        *[F.struct(F.lit(p).alias("speaker"), F.col(f"expr_{i}_r").alias("expr")) for i, p in enumerate(puzzles.PEOPLE)]
    )
    x = g.select("seed", F.explode(said).alias("s")).select(
        "seed", "s.speaker", logic.compile_expr()(F.col("s.expr")).alias("c")
    )
    return x.select("seed", "speaker", "c.mask", "c.depth", "c.nodes", F.md5("c.text").alias("said"))


def _measure(name: str) -> None:
    @query(name, f"{PART_SQL} SELECT id, partition, round({name}, 5) AS {name} FROM pc")
    def run(spark, d):
        return _partitions(spark, d).select("id", "partition", F.round(name, 5).alias(name))


for _n in ("cosine", "l1", "l2"):
    _measure(_n)


@query("sanity_gate", ORACLES["finite_gate"])
def sanity_gate(spark, d):
    return landscape.gate(_ls(spark, d))


@query("reward_dispatch", ORACLES["reward_partial"])
def reward_dispatch(spark, d):
    return QUERIES["reward_partial"](spark, d)

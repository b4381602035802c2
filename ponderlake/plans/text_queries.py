"""Queries over texts, answers, puzzles and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logic, parsing, text, worlds
from ..operators import audit, generation, positions, puzzles, replay
from .base import ASSIGN_SQL, CROWD_KNIGHT, CROWD_SQL, CROWD_TRUE, KNIGHT, PRED_SQL, PUZZLE_SQL, TRUTH, crowds, label, predictions, puzzle_trees, puzzles as flat_puzzles
from .registry import query, read

R6 = lambda c: F.round(c, 6)
PEOPLE_SQL = "['Alice', 'Bob', 'Carol']"


def people():
    return F.array(F.lit("Alice"), F.lit("Bob"), F.lit("Carol"))


# answers: a text for each document that reaches every branch of the parser

_TEXTS = (
    "no block at all", "<answer>\\nAlice: knight\\nBob: knave\\nCarol: knight\\n</answer>", "<ANSWER>\\nalice: KNIGHT\\n\\nBob: Knave\\nCAROL: knave\\n</ANSWER> tail",
    "<answer>\\nAlice: knight\\nBob is a knave\\nCarol: knight\\n</answer>", "<answer>\\nAlice: knight\\nDave: knave\\nCarol: knight\\n</answer>", "<answer>\\nAlice: knight\\nAlice: knave\\nCarol: knight\\n</answer>",
    "<answer>\\nAlice: knight\\nCarol: knight\\n</answer>", "x <answer>\\nAlice: knave\\nBob: knave\\nCarol: knave\\n</answer> <answer>\\nAlice: knight\\n</answer>", "<answer></answer>",
)
_ARMS = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TEXTS))
_ARMS_DUCK = " ".join(f"WHEN {i} THEN E'{t}'" for i, t in enumerate(_TEXTS))
_REASON = (
    "missing <answer> block", "ok", "ok", "invalid answer line: ''Bob is a knave''", "unknown person: Dave",
    "duplicate person: Alice", "missing people: [''Bob'']", "ok", "missing people: [''Alice'', ''Bob'', ''Carol'']"
)
_ANSWER = ("invalid", "KNK", "KNN", "invalid", "invalid", "invalid", "invalid", "NNN", "invalid")
_case = lambda xs: "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(xs)) + " END"
#: The oracle parses as well: block, lines, forms, names; the first faulty line decides.
PARSE_SQL = f"""t AS (SELECT doc_id AS id, CASE doc_id % 9 {_ARMS_DUCK} END AS text, {label('doc_id % 8')} AS gold FROM documents),
b AS (SELECT *, regexp_matches(text, '(?is)<answer>.*?</answer>') AS found, list_filter(list_transform(string_split(regexp_extract(text, '(?is)<answer>\\s*(.*?)\\s*</answer>', 1), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM t),
l AS (SELECT *, list_transform(lines, lambda x: lower(regexp_extract(x, '(?i)^([a-z][a-z0-9_-]*)\\s*:\\s*(knight|knave)$', 1))) AS names, list_transform(lines, lambda x: lower(regexp_extract(x, '(?i)^([a-z][a-z0-9_-]*)\\s*:\\s*(knight|knave)$', 2))) AS kinds FROM b),
f AS (SELECT *, list_filter(list_transform(lines, lambda x, i: CASE WHEN names[i] = '' THEN 'invalid answer line: ''' || x || '''' WHEN NOT list_contains(['alice', 'bob', 'carol'], names[i]) THEN 'unknown person: ' || regexp_extract(x, '^([^:]*?)\\s*:', 1)
 WHEN list_position(names, names[i]) < i THEN 'duplicate person: ' || upper(names[i][1]) || names[i][2:] END), lambda x: x IS NOT NULL)[1] AS fault, list_filter({PEOPLE_SQL}, lambda p: NOT list_contains(names, lower(p))) AS absent FROM l),
r AS (SELECT id, text, gold, CASE WHEN NOT found THEN 'missing <answer> block' WHEN fault IS NOT NULL THEN fault WHEN len(absent) > 0 THEN 'missing people: [''' || array_to_string(absent, ''', ''') || ''']' ELSE 'ok' END AS reason,
 list_transform({PEOPLE_SQL}, lambda p: CASE kinds[list_position(names, lower(p))] WHEN 'knight' THEN 'K' WHEN 'knave' THEN 'N' END) AS marks FROM f),
pa AS (SELECT id, text, gold, reason, reason = 'ok' AS ok, CASE WHEN reason = 'ok' THEN array_to_string(marks, '') ELSE 'invalid' END AS pattern FROM r)"""


def _parsed(spark, d):
    x = read(spark, d, "documents").selectExpr(
        "doc_id AS id", f"CASE doc_id % 9 {_ARMS} END AS text", f"{label('doc_id % 8')} AS gold"
    )
    x = x.withColumn("p", parsing.parse_answer(F.col("text"), people()))
    return x.select(
        "id",
        "text",
        "gold",
        F.col("p.answer").alias("answer"),
        F.col("p.ok").alias("ok"),
        F.col("p.reason").alias("reason"),
        text.pattern_encode(F.col("p.answer"), people()).alias("pattern")
    )


@query("parse_answer", f"WITH {PARSE_SQL} SELECT id, ok, reason, pattern FROM pa")
def parse_answer(spark, d):
    return _parsed(spark, d).select("id", "ok", "reason", "pattern")


#: Records as stored: the answer and verdict of each text, altered in every eleventh and thirteenth.
_STORED = f"CASE WHEN doc_id % 11 = 0 THEN 'KKK' ELSE {_case(_ANSWER)} END AS stored, (doc_id % 13 = 0) <> ({_case(_ANSWER)} <> 'invalid') AS stored_ok"


@query("parser_consistency", f"""WITH {PARSE_SQL}, s AS (SELECT doc_id AS id, {_STORED} FROM documents)
 SELECT count(*) AS checked, count(*) FILTER (pattern = stored AND ok = stored_ok) AS equal, count(*) FILTER (pattern <> stored) AS answer_changed, count(*) FILTER (ok <> stored_ok) AS verdict_changed FROM pa JOIN s USING (id)""")
def parser_consistency(spark, d):
    """All stored texts parsed again, against the stored answers and verdicts."""
    rec = read(spark, d, "documents").selectExpr(
        "doc_id AS id", f"CASE doc_id % 9 {_ARMS} END AS text", *_STORED.split(", (", 1)[:1],
        "(" + _STORED.split(", (", 1)[1]
    )
    return audit.parser_consistency(rec, "text", people(), "stored", "stored_ok")


@query(
    "score_completion",
    f"WITH {PARSE_SQL} SELECT id, round(CAST(pattern = gold AS INT) + 0.1::DOUBLE * CAST(ok AS INT), 6) AS total FROM "
    f"pa"
)
def score_completion(spark, d):
    return _parsed(spark, d).select(
        "id", R6(parsing.score_completion(F.col("pattern"), F.col("gold"), F.col("ok"))).alias("total")
    )


@query("reward_exact", f"WITH {PARSE_SQL} SELECT id, CAST(CAST(pattern = gold AS INT) AS DOUBLE) AS reward FROM pa")
def reward_exact(spark, d):
    return _parsed(spark, d).select(
        "id", parsing.reward(F.when(F.col("ok"), F.col("pattern")), F.col("gold")).alias("reward")
    )


@query(
    "reward_partial",
    f"WITH {PARSE_SQL} SELECT id, round(CASE WHEN ok THEN (CAST(pattern[1] = gold[1] AS INT) + CAST(pattern[2] = "
    f"gold[2] AS INT) + CAST(pattern[3] = gold[3] AS INT)) / 3 ELSE 0 END, 6) AS reward FROM pa"
)
def reward_partial(spark, d):
    return _parsed(spark, d).select(
        "id", R6(parsing.reward(F.when(F.col("ok"), F.col("pattern")), F.col("gold"), "partial")).alias("reward")
    )


@query(
    "reward_configurable",
    f"WITH {PARSE_SQL} SELECT reason = 'missing <answer> block' AS unparsed, round(sum(CASE WHEN pattern = gold THEN 1 "
    f"WHEN reason = 'missing <answer> block' THEN -0.5 WHEN NOT ok THEN -0.25 ELSE 0 END::DOUBLE), 6) AS total FROM pa "
    f"GROUP BY 1"
)
def reward_configurable(spark, d):
    parsed = F.col("reason") != "missing <answer> block"
    r = parsing.reward_configurable(F.col("pattern") == F.col("gold"), parsed, F.col("ok"), 1.0, -0.5, -0.25, 0.0)
    return _parsed(spark, d).groupBy((~parsed).alias("unparsed")).agg(R6(F.sum(r)).alias("total"))


@query("pattern_encode", f"WITH {PARSE_SQL} SELECT pattern, count(*) AS n FROM pa GROUP BY 1")
def pattern_encode(spark, d):
    return _parsed(spark, d).groupBy("pattern").agg(F.count("*").alias("n"))


_KIND = "CASE gold[{}] WHEN 'K' THEN 'knight' ELSE 'knave' END"


@query(
    "pattern_decode",
    f"WITH {PRED_SQL} SELECT id, {_KIND.format(1)} AS alice, {_KIND.format(2)} AS bob, {_KIND.format(3)} AS carol FROM pred"
)
def pattern_decode(spark, d):
    answer = text.pattern_decode(F.col("gold"), people())
    return predictions(spark, d).select("id", *[answer[p].alias(p.lower()) for p in puzzles.PEOPLE])


@query(
    "fmt_assignment",
    f"WITH {PRED_SQL} SELECT id, 'Alice=' || {_KIND.format(1)} || ', Bob=' || {_KIND.format(2)} || ', Carol=' || "
    f"{_KIND.format(3)} AS line FROM pred"
)
def fmt_assignment(spark, d):
    line = text.fmt_assignment(text.pattern_decode(F.col("gold"), people()), people())
    return predictions(spark, d).select("id", line.alias("line"))


_AGREE = " + ".join(f"CAST(t{j} = k{j} AS INT)" for j in range(3))


@query(
    "assign_enumerate",
    f"WITH {PUZZLE_SQL}, {ASSIGN_SQL} SELECT id, CAST(a AS INT) AS a, {label('a')} AS pattern, {_AGREE} AS agree FROM asg"
)
def assign_enumerate(spark, d):
    """Each puzzle under each assignment: how many statements are as true as their speaker is a knight."""
    c = puzzles.compiled(puzzle_trees(spark, d)).select("id", F.arrays_zip("masks", "speaker_bits").alias("z"))
    x = c.crossJoin(F.broadcast(puzzles.assignments(spark).select("a", "pattern")))
    same = lambda z: logic.eval_mask(z["masks"], F.col("a")) == logic.eval_mask(z["speaker_bits"], F.col("a"))
    return x.select("id", "a", "pattern", F.size(F.filter("z", same)).alias("agree"))


@query("has_repeated_line", """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
 SELECT doc_id, len(l) >= 3 AND len(list_filter(range(1, len(l) - 1), lambda i: l[i] = l[i + 1] AND l[i] = l[i + 2])) > 0 AS repeated FROM l""")
def has_repeated_line(spark, d):
    return read(spark, d, "documents").select("doc_id", text.has_repeated_line(F.col("text")).alias("repeated"))


@query(
    "json_len",
    "SELECT conv_id, turn, CAST(length(to_json(role)) + length(to_json(text)) + 25 AS INT) AS chars FROM conversations"
)
def json_len(spark, d):
    return read(spark, d, "conversations").select(
        "conv_id", "turn", text.json_len(F.col("role"), F.col("text")).alias("chars")
    )


@query(
    "char_len",
    "SELECT lang, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS INT) AS longest FROM documents "
    "GROUP BY lang"
)
def char_len(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(
        F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest")
    )


@query(
    "top_ops_multiset",
    "SELECT p_partkey, array_to_string(list_sort(string_split(p_type || '+' || p_brand || '+and', '+')), '|') AS ops "
    "FROM part"
)
def top_ops_multiset(spark, d):
    return read(spark, d, "part").select(
        "p_partkey", text.top_ops_multiset(F.concat("p_type", F.lit("+"), "p_brand", F.lit("+and"))).alias("ops")
    )


@query("json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# puzzles: flat statements in both engines, trees compiled on ours

ASSIGN = f"WITH {PUZZLE_SQL}, {ASSIGN_SQL}"


@query("expr_eval", f"{ASSIGN} SELECT id, CAST(a AS INT) AS a, t0, t1, t2 FROM asg")
def expr_eval(spark, d):
    c = puzzles.compiled(puzzle_trees(spark, d))
    x = c.select("id", "masks", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("a"))
    return x.select(
        "id", "a", *[logic.eval_mask(F.get("masks", F.lit(j)), F.col("a")).alias(f"t{j}") for j in range(3)]
    )


@query(
    "puzzle_consistent",
    f"{ASSIGN} SELECT id, CAST(a AS INT) AS a, t0 = k0 AND t1 = k1 AND t2 = k2 AS consistent FROM asg"
)
def puzzle_consistent(spark, d):
    c = puzzles.compiled(puzzle_trees(spark, d))
    return c.select("id", "solutions", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("a")).select(
        "id", "a", logic.eval_mask(F.col("solutions"), F.col("a")).alias("consistent")
    )


_SOLVED = f"{ASSIGN}, so AS (SELECT id, count(*) FILTER (t0 = k0 AND t1 = k1 AND t2 = k2) AS n, min(a) FILTER (t0 = k0 AND t1 = k1 AND t2 = k2) AS first FROM asg GROUP BY id), sp AS (SELECT id, n, {label('first')} AS pattern FROM so)"


@query("puzzle_solve", f"{_SOLVED} SELECT id, CAST(n AS INT) AS n_solutions, pattern FROM sp")
def puzzle_solve(spark, d):
    return puzzles.compiled(puzzle_trees(spark, d)).select(
        "id", "n_solutions", puzzles.solution(F.col("solutions")).alias("pattern")
    )


@query("puzzle_solve_flat", f"{_SOLVED} SELECT n AS n_solutions, pattern, count(*) AS puzzles FROM sp GROUP BY ALL")
def puzzle_solve_flat(spark, d):
    """The same by a broadcast join with the eight assignments, for statements that are columns."""
    a = puzzles.assignments(spark).select("a")
    x = flat_puzzles(spark, d).crossJoin(F.broadcast(a))
    ok = " AND ".join(f"({TRUTH[j]} = {KNIGHT.format(j)})" for j in range(3))
    s = x.groupBy("id").agg(
        F.count_if(F.expr(ok)).alias("n_solutions"), F.min(F.when(F.expr(ok), F.col("a"))).alias("first")
    )
    return s.select(
        "n_solutions", text.pattern_of_index(F.col("first")).alias("pattern")
    ).groupBy("n_solutions", "pattern").agg(F.count("*").alias("puzzles"))


@query(
    "expr_walk",
    f"WITH {PUZZLE_SQL}, s AS (SELECT id, kind0 AS kind, neg0 AS neg FROM pz UNION ALL SELECT id, kind1, neg1 FROM pz "
    f"UNION ALL SELECT id, kind2, neg2 FROM pz) SELECT CASE kind WHEN 0 THEN 'person_is' WHEN 1 THEN 'same' ELSE "
    f"'different' END AS op, count(*) AS nodes, CAST(max(1 + neg) AS INT) AS depth FROM s GROUP BY 1 UNION ALL SELECT "
    f"'not', count(*) FILTER (neg = 1), 1 FROM s"
)
def expr_walk(spark, d):
    c = puzzles.compiled(puzzle_trees(spark, d)).select(F.explode("stats").alias("s"))
    x = c.select(
        "s.depth",
        F.explode(
            F.array(
                *[F.struct(F.lit(o).alias("op"), F.get("s.ops", F.lit(i)).alias("n")) for i, o in enumerate(text.OPS)]
            )
        ).alias("x")
    ).where("x.n > 0")
    return x.groupBy("x.op").agg(
        F.sum("x.n").alias("nodes"),
        F.max(F.when(F.col("x.op") == "not", F.lit(1)).otherwise(F.col("depth"))).alias("depth")
    )


_NOPS = {
    o: "CAST(" + " + ".join(f"CAST(kind{j} = {i} AS INT)" for j in range(3)) + " AS INT)" for i,
    o in enumerate(("person_is", "same", "different"))
} | {"not": "CAST(neg0 + neg1 + neg2 AS INT)", "and": "0", "or": "0"}
_SIGN = "concat_ws(',', " + ", ".join(f"CASE WHEN n_{o} > 0 THEN '{o}:' || n_{o} END" for o in text.OPS) + ")"


@query(
    "row_features",
    f"WITH {PUZZLE_SQL}, n AS (SELECT id, {', '.join(f'{v} AS n_{k}' for k, v in _NOPS.items())}, CAST(3 + neg0 + neg1 "
    f"+ neg2 AS INT) AS nodes, CAST(1 + greatest(neg0, neg1, neg2) AS INT) AS depth FROM pz) SELECT id, {_SIGN} AS "
    f"op_signature, nodes, depth, {', '.join(f'n_{o}' for o in text.OPS)}, 'Alice>Bob>Carol' AS speaker_order FROM n"
)
def row_features(spark, d):
    f = puzzles.row_features(puzzles.compiled(puzzle_trees(spark, d)))
    return f.select("id", "op_signature", "nodes", "depth", *[f"n_{o}" for o in text.OPS], "speaker_order")


_NAME = "(['Alice', 'Bob', 'Carol'])[CAST({0} AS INT) + 1]"


def _tree_sql(j: int) -> str:
    one, two = _NAME.format(f"first{j}"), _NAME.format(f"((first{j} + 1 + shift{j}) % 3)")
    leaf = f"""CASE kind{j} WHEN 0 THEN '{{"op":"person_is","person":"' || {one} || '","value":"' || CASE WHEN shift{j} = 0 THEN 'knight' ELSE 'knave' END || '"}}' ELSE '{{"left":"' || {one} || '","op":"' || CASE kind{j} WHEN 1 THEN 'same' ELSE 'different' END || '","right":"' || {two} || '"}}' END"""
    return f"""CASE neg{j} WHEN 1 THEN '{{"expr":' || {leaf} || ',"op":"not"}}' ELSE {leaf} END"""


_KEY = """sha256('{"people":["Alice","Bob","Carol"]}' || """ + " || ',' || ".join(
    f"""'{{"expr":' || {_tree_sql(j)} || ',"speaker":{{"x":"{p}"}}}}'""" for j,
    p in enumerate(("Alice", "Bob", "Carol"))
) + ")"


@query("puzzle_key", f"WITH {PUZZLE_SQL} SELECT id, {_KEY} AS key FROM pz")
def puzzle_key(spark, d):
    return puzzle_trees(spark, d).select("id", logic.puzzle_key(F.col("people"), F.col("statements")).alias("key"))


@query("gen_balanced", f"{_SOLVED} SELECT pattern, min(id) AS id FROM sp WHERE n = 1 GROUP BY pattern")
def gen_balanced(spark, d):
    c = puzzles.compiled(puzzle_trees(spark, d)).where("n_solutions = 1")
    return puzzles.balanced(c.select("id", puzzles.solution(F.col("solutions")).alias("pattern")))


_LINE = "'- Alice=' || CASE WHEN a < 4 THEN 'knight' ELSE 'knave' END || ', Bob=' || CASE WHEN a % 4 < 2 THEN 'knight' ELSE 'knave' END || ', Carol=' || CASE WHEN a % 2 = 0 THEN 'knight' ELSE 'knave' END || ': ' || CASE WHEN t0 = k0 AND t1 = k1 AND t2 = k2 THEN 'valid; every statement matches its speaker''s type.' ELSE 'invalid because the statement by ' || concat_ws(', ', CASE WHEN t0 <> k0 THEN 'Alice' END, CASE WHEN t1 <> k1 THEN 'Bob' END, CASE WHEN t2 <> k2 THEN 'Carol' END) || ' does not match the speaker''s type.' END"


TRACE_SQL = f"'{text.TRACE_HEAD}' || chr(10) || string_agg({_LINE}, chr(10) ORDER BY a) || chr(10) || '{text.TRACE_TAIL}'"


@query("fmt_reasoning_trace", f"{ASSIGN} SELECT id, md5({TRACE_SQL}) AS trace_md5 FROM asg GROUP BY id")
def fmt_reasoning_trace(spark, d):
    c = puzzles.compiled(puzzle_trees(spark, d))
    at = F.array(F.lit(0), F.lit(1), F.lit(2))
    return c.select("id", F.md5(text.fmt_reasoning_trace(F.col("masks"), at, F.col("people"))).alias("trace_md5"))


@query("fmt_prompts")
def fmt_prompts(spark, d):
    c = puzzles.compiled(puzzle_trees(spark, d)).where("n_solutions = 1")
    said = F.transform(
        F.arrays_zip("speakers", "texts"),
        lambda x: F.struct(x["speakers"].alias("speaker"), F.concat(x["texts"], F.lit(".")).alias("text"))
    )
    answer = text.pattern_decode(puzzles.solution(F.col("solutions")), people())
    trace = text.fmt_reasoning_trace(F.col("masks"), F.array(F.lit(0), F.lit(1), F.lit(2)), F.col("people"))
    return c.select(
        "id",
        text.fmt_prompt(said).alias("prompt"),
        text.fmt_prompt(said, "answer_only").alias("answer_prompt"),
        text.fmt_completion(trace, answer, people(), F.col("n_solutions")).alias("completion"),
        text.fmt_answer_block(answer, people()).alias("answer_only")
    )


# generation: a seed for each supplier; both engines draw by the same digests

_SEEDS = "(SELECT s_suppkey AS seed FROM supplier)"
_ATTEMPTS = 192
_STATEMENT = generation.statement_first_sql(_SEEDS, 1, _ATTEMPTS, 2)
_TREES = "md5(expr_0 || expr_1 || expr_2) AS trees, md5(said_0 || '.' || said_1 || '.' || said_2 || '.') AS texts"


def _seeds(spark, d):
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("seed"))


def _generated(spark, d, kind):
    g = generation.generate(_seeds(spark, d), kind)
    joined = lambda f: F.md5(F.array_join(F.transform("statements", lambda s: s[f]), ""))
    return g.select("seed", "pattern", "attempts", joined("expr").alias("trees"), joined("text").alias("texts"))


@query(
    "rand_atom",
    f"SELECT seed, mask_0_r AS mask, expr_0_r AS expr, said_0_r AS said FROM "
    f"{generation.sql(_SEEDS, generation.DUCK, generation.tags('seed')[:1], 0, generation.SAID)}"
)
def rand_atom(spark, d):
    x = generation.grown(_seeds(spark, d), generation.tags("seed")[:1], 0, generation.SAID)
    return x.select(
        "seed", F.col("mask_0_r").alias("mask"), F.col("expr_0_r").alias("expr"), F.col("said_0_r").alias("said")
    )


@query("gen_statement_first", f"SELECT seed, pattern, attempts, {_TREES} FROM ({_STATEMENT})")
def gen_statement_first(spark, d):
    return _generated(spark, d, "statement")


@query(
    "gen_label_first",
    f"SELECT seed, pattern, attempts, {_TREES} FROM ({generation.label_first_sql(_SEEDS, 1, _ATTEMPTS, 2)})"
)
def gen_label_first(spark, d):
    return _generated(spark, d, "label")


_GEN_KEY = """sha256('{"people":["Alice","Bob","Carol"]}' || """ + " || ',' || ".join(
    f"""'{{"expr":' || expr_{j} || ',"speaker":{{"x":"{p}"}}}}'""" for j, p in enumerate(("Alice", "Bob", "Carol"))
) + ")"


@query("gen_split_dedup", f"""WITH g AS (SELECT seed, pattern, {_GEN_KEY} AS key FROM ({_STATEMENT})), f AS (SELECT key, min(seed) AS seed, arg_min(pattern, seed) AS pattern FROM g GROUP BY key)
 SELECT seed, key, pattern, printf('split_%06d', CAST(row_number() OVER (ORDER BY seed) - 1 AS INT)) AS id FROM f ORDER BY seed LIMIT 40""")
def gen_split_dedup(spark, d):
    """A split of 40 puzzles, no two alike."""
    said = F.transform("statements", lambda s: F.struct(s["speaker"].alias("speaker"), s["expr"].alias("expr")))
    g = generation.generate(_seeds(spark, d)).withColumn("key", logic.puzzle_key(F.col("people"), said))
    return puzzles.split_ids(g.select("seed", "key", "pattern"), "key", "seed", 40, "split")


# puzzles replayed from seeds: draws of a Mersenne Twister, which SQL has no words for


def _trees():
    joined = lambda f: F.md5(F.array_join(F.transform("statements", lambda s: s[f]), ""))
    return [joined("expr").alias("trees"), joined("text").alias("texts")]


@query("replay_statement_first")
def replay_statement_first(spark, d):
    """The puzzle of each order's key, statements drawn first."""
    return replay.puzzles(read(spark, d, "orders").select(F.col("o_orderkey").alias("seed"))).select("seed", "pattern", "attempts", *_trees())


@query("replay_label_first")
def replay_label_first(spark, d):
    """The puzzle of each customer's key, answer drawn first."""
    return replay.puzzles(read(spark, d, "customer").select(F.col("c_custkey").alias("seed")), "label").select("seed", "pattern", "attempts", *_trees())


@query("replay_splits")
def replay_splits(spark, d):
    """Three splits without a common puzzle, as large as there are orders of each status."""
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    sizes = read(spark, d, "orders").groupBy(status.alias("split")).agg(F.count("*").alias("size"))
    wanted = sizes.select("split", text.split_seed(F.lit(20260829).cast("bigint"), F.col("split")).alias("seed"), "size")
    return replay.splits(wanted, statements=False)


@query("replay_balanced")
def replay_balanced(spark, d):
    """For each supplier a set with one puzzle of each label."""
    split = F.col("s_suppkey").cast("bigint")
    seed = text.split_seed(F.lit(20260827).cast("bigint"), split).alias("seed")
    return replay.balanced(read(spark, d, "supplier").select(split.alias("split"), seed)).select("split", "n", "pos", "seed", "pattern", "attempts", *_trees())


# splits of documents: by id, keys are digests of the trimmed lower-case text

_SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END"
_DOCS = f"WITH d AS (SELECT doc_id, {_SPLIT} AS split, md5(lower(trim(text))) AS key, length(text) AS chars FROM documents)"


def _docs(spark, d):
    return read(spark, d, "documents").selectExpr(
        "doc_id", f"{_SPLIT} AS split", "md5(lower(trim(text))) AS key", "length(text) AS chars"
    )


@query(
    "agg_split_audit",
    f"{_DOCS} SELECT split, count(*) AS count, count(DISTINCT doc_id) AS unique_ids, count(DISTINCT key) AS "
    f"unique_keys, count(*) FILTER (chars % 17 = 0) AS bad_solution_counts, CAST(min(chars) AS INT) AS min_chars, "
    f"CAST(max(chars) AS INT) AS max_chars, round(avg(chars), 4) AS mean_chars, count(*) - count(DISTINCT key) AS "
    f"duplicate_count FROM d GROUP BY split"
)
def agg_split_audit(spark, d):
    x = audit.split_audit(
        _docs(spark, d), "split", "doc_id", F.col("key"), F.col("chars"),
        F.when(F.col("chars") % 17 == 0, 2).otherwise(1)
    )
    return x.withColumn("mean_chars", F.round("mean_chars", 4))


@query(
    "agg_processed_audit",
    "SELECT role, count(*) AS count, count(DISTINCT conv_id) AS unique_ids, CAST(min(length(text)) AS INT) AS "
    "min_chars, CAST(max(length(text)) AS INT) AS max_chars, round(avg(length(text)), 4) AS mean_chars FROM "
    "conversations GROUP BY role"
)
def agg_processed_audit(spark, d):
    c = read(spark, d, "conversations").select("role", "conv_id", F.length("text").alias("chars"))
    x = audit.split_audit(c, "role", "conv_id", F.col("conv_id"), F.col("chars"))
    return x.select(
        "role", "count", "unique_ids", "min_chars", "max_chars", F.round("mean_chars", 4).alias("mean_chars")
    )


@query(
    "agg_char_stats",
    "SELECT role, CAST(min(length(text)) AS INT) AS min_chars, CAST(max(length(text)) AS INT) AS max_chars, "
    "round(avg(length(text)), 4) AS mean_chars FROM conversations GROUP BY role"
)
def agg_char_stats(spark, d):
    x = audit.char_stats(read(spark, d, "conversations"), ["role"], F.length("text"))
    return x.withColumn("mean_chars", F.round("mean_chars", 4))


@query(
    "agg_duplicates",
    f"{_DOCS}, k AS (SELECT key, count(*) AS n FROM d GROUP BY key) SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS "
    f"unique_keys, count(*) FILTER (n > 1) AS duplicate_keys, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM k"
)
def agg_duplicates(spark, d):
    return audit.duplicates(_docs(spark, d), F.col("key"))


_OVER = f'{_DOCS} SELECT l.split AS "left", r.split AS "right", count(DISTINCT l.key) AS shared_keys FROM (SELECT DISTINCT split, key FROM d) l JOIN (SELECT DISTINCT split, key FROM d) r ON l.key = r.key AND l.split < r.split GROUP BY ALL'


@query("join_split_pairs", _OVER)
def join_split_pairs(spark, d):
    return audit.overlaps(_docs(spark, d), "split", F.col("key"))


@query(
    "set_overlap",
    f"{_DOCS} SELECT count(*) AS shared FROM (SELECT key FROM d WHERE split = 'train' INTERSECT SELECT key FROM d WHERE "
    f"split = 'test')"
)
def set_overlap(spark, d):
    x = _docs(spark, d)
    return x.where("split = 'train'").select("key").intersect(
        x.where("split = 'test'").select("key")
    ).agg(F.count("*").alias("shared"))


@query(
    "set_union_keys",
    f"{_DOCS}, u AS (SELECT key FROM d UNION ALL SELECT md5(lower(trim(text))) FROM benchmark) SELECT n, count(*) AS "
    f"keys FROM (SELECT key, count(*) AS n FROM u GROUP BY key) GROUP BY n"
)
def set_union_keys(spark, d):
    b = read(spark, d, "benchmark").select(F.md5(F.lower(F.trim("text"))).alias("key"))
    return _docs(spark, d).select("key").unionByName(b).groupBy("key").agg(F.count("*").alias("n")).groupBy("n").agg(
        F.count("*").alias("keys")
    )


@query("set_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id")).exceptAll(
        read(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct()
    )


@query(
    "set_equality",
    "SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AND (SELECT "
    "count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AS equal"
)
def set_equality(spark, d):
    g = audit.paired_gate(
        read(spark, d, "customer").select(F.col("c_custkey").alias("id")),
        read(spark, d, "orders").select(F.col("o_custkey").alias("id")),
        "id"
    )
    return g.select(((F.col("left_only") == 0) & (F.col("right_only") == 0)).alias("equal"))


@query(
    "join_anti_dedup",
    f"{_DOCS}, f AS (SELECT key, min(doc_id) AS doc_id FROM d WHERE split <> 'train' GROUP BY key) SELECT doc_id FROM f "
    f"WHERE key NOT IN (SELECT key FROM d WHERE split = 'train')"
)
def join_anti_dedup(spark, d):
    x = _docs(spark, d)
    return audit.anti_dedup(
        x.where("split <> 'train'").select("doc_id", "key"), x.where("split = 'train'"), "key", "doc_id"
    ).select("doc_id")


@query(
    "join_semi_membership",
    "SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > "
    "5000) GROUP BY 1"
)
def join_semi_membership(spark, d):
    rich = read(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return read(spark, d, "events").join(
        rich, "user_id", "left_semi"
    ).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "join_positional",
    "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey FROM orders), c AS (SELECT "
    "row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey FROM customer) SELECT pos, o_orderkey, c_custkey FROM "
    "o JOIN c USING (pos)"
)
def join_positional(spark, d):
    o = positions.numbered(read(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("pos", "o_orderkey")
    c = positions.numbered(read(spark, d, "customer").select("c_custkey"), "c_custkey").select("pos", "c_custkey")
    return o.join(c, "pos")


@query("puzzle_solve_people", f"""WITH {CROWD_SQL}, ok AS (SELECT id, n, a, bool_and(({CROWD_TRUE}) = {CROWD_KNIGHT}) AS ok FROM cw GROUP BY ALL),
 so AS (SELECT id, CAST(n AS INT) AS n, CAST(count(*) FILTER (ok) AS INT) AS n_solutions, min(a) FILTER (ok) AS f FROM ok GROUP BY ALL)
 SELECT id, n AS people, n_solutions, CASE WHEN f IS NOT NULL THEN array_to_string(list_transform(range(n), lambda j: CASE WHEN (f >> CAST(n - 1 - j AS INT)) & 1 = 0 THEN 'K' ELSE 'N' END), '') END AS pattern FROM so""")
def puzzle_solve_people(spark, d):
    """Puzzles of three to six people: how many assignments solve them, and the first."""
    x = puzzles.solved(crowds(spark, d))
    return x.select("id", F.size("people").alias("people"), "n_solutions", "pattern")


@query(
    "expr_eval_people",
    f"WITH {CROWD_SQL} SELECT id, CAST(p AS INT) AS speaker, CAST(count(*) FILTER ({CROWD_TRUE}) AS INT) AS n_true FROM cw "
    "GROUP BY ALL"
)
def expr_eval_people(spark, d):
    """Each statement: under how many assignments it is true."""
    x = crowds(spark, d).select("id", F.size("people").alias("n"), "people", F.posexplode("statements").alias("speaker", "s"))
    x = x.withColumn("steps", worlds.compiled(F.col("s.expr"), F.col("people")))
    return x.select("id", "speaker", worlds.count(worlds.truth_table(F.col("steps"), F.col("n"))).alias("n_true"))

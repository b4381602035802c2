"""Stand-ins for the records of reasoning-model training, drawn from the test tables.

Each has the same definition as a DataFrame and as SQL (``*_SQL``), integer
arithmetic only, so that both engines see the same rows:

* rollouts: a group for each order, a completion for each of its lines;
* predictions: three models' 8-way labels for labelled documents;
* scores: two models' scores of eight candidates for each vector;
* steps: a metric log of 625 steps from events, null values included;
* puzzles: three flat statements for each order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PATTERNS
from .registry import read

def label(index: str) -> str:
    """SQL of the label number ``index``, for both engines."""
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATTERNS)) + " END"


def _same_bits(a: str, b: str) -> str:
    """SQL: how many of the three bits of two labels agree."""
    bit = lambda x, k: f"cast(floor(({x}) / {float(1 << k)}) as int) % 2"
    return " + ".join(f"(CASE WHEN {bit(a, k)} = {bit(b, k)} THEN 1 ELSE 0 END)" for k in range(3))


_ROLL = {
    "gold_i": "l_orderkey % 8",
    "answer_i": "CASE WHEN l_quantity < 5 THEN NULL WHEN l_returnflag = 'R' THEN l_orderkey % 8 ELSE (l_orderkey + 1 + l_partkey % 7) % 8 END",
}
_ROLL_COLS = f"""id, k, step, price, {label('gold_i')} AS gold, {label('answer_i')} AS answer,
 CASE WHEN answer_i = gold_i THEN 1.0E0 ELSE 0.0E0 END AS reward,
 CASE WHEN answer_i IS NULL THEN 0.0E0 ELSE ({_same_bits('answer_i', 'gold_i')}) / 3.0E0 END AS shaped"""
ROLL_SQL = f"""roll AS (SELECT {_ROLL_COLS} FROM (SELECT l_orderkey AS id, l_orderkey % 25 AS step, l_extendedprice AS price,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) - 1 AS k,
 {_ROLL['gold_i']} AS gold_i, {_ROLL['answer_i']} AS answer_i FROM lineitem))"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is named after members are numbered: a group that is read by ``id`` is where it was numbered."""
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("__lineitem")
    named = ROLL_SQL.replace("SELECT id, k", "SELECT l_orderkey AS id, k").replace("SELECT l_orderkey AS id, l_orderkey", "SELECT l_orderkey, l_orderkey")
    return spark.sql("WITH " + named.replace("FROM lineitem", "FROM __lineitem") + " SELECT * FROM roll")


def plain_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts without numbers within the group: no window, so only what a query needs is shuffled."""
    x = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS id", "l_orderkey % 25 AS step", f"{_ROLL['gold_i']} AS gold_i",
        f"{_ROLL['answer_i']} AS answer_i"
    )
    return x.selectExpr(*[c for c in _split(_ROLL_COLS) if not c.startswith(("k", "price"))])


def _split(cols: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in cols:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


_G = "(quality * 4 + toxic * 2 + CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END)"
_PRED = {
    "a": f"CASE WHEN doc_id % 23 = 0 THEN 'invalid' WHEN doc_id % 3 = 0 THEN {label(f'({_G} + 1) % 8')} ELSE {label(_G)} END",
    "b": f"CASE WHEN doc_id % 29 = 0 THEN 'invalid' WHEN doc_id % 4 = 1 THEN {label(f'({_G} + n_chars % 3) % 8')} ELSE {label(_G)} END",
    "c": f"CASE WHEN doc_id % 5 = 2 THEN {label(f'({_G} + 4) % 8')} WHEN n_chars % 7 = 0 THEN {label(f'({_G} + 2) % 8')} ELSE {label(_G)} END",
}
_PRED_COLS = f"doc_id AS id, lang, source, n_chars, quality, toxic, {label(_G)} AS gold, {', '.join(f'{v} AS pred_{k}' for k, v in _PRED.items())}"
PRED_SQL = f"pred AS (SELECT {_PRED_COLS} FROM labels JOIN (SELECT doc_id, lang, source, n_chars FROM documents) USING (doc_id))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return read(spark, sf_dir, "labels").join(d, "doc_id").selectExpr(*_split(_PRED_COLS))


LONG_SQL = "lng AS (" + " UNION ALL ".join(
    f"SELECT id, gold, lang, source, '{m}' AS model, pred_{m} AS pred FROM pred" for m in "abc"
) + ")"

SCORE_SQL = """sc AS (SELECT vec_id AS id, m AS model, label % 8 AS gold, CAST(c AS INT) AS cand,
 round(3 * CAST(embedding[6 * c + 1 + CASE WHEN m = 'b' THEN 1 ELSE 0 END] AS DOUBLE) + CASE WHEN m = 'b' AND c = label % 8 THEN 0.5 ELSE 0.0 END, 4) AS score
 FROM embeddings, (SELECT unnest(range(8)) AS c), (SELECT unnest(['a', 'b']) AS m))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") % 8).alias("gold"), "embedding"
    )
    x = e.select("id", "gold", "embedding", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model")).select(
        "id", "gold", "embedding", "model", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("cand")
    )
    at = 6 * F.col("cand") + 1 + (F.col("model") == "b").cast("int")
    lift = F.when((F.col("model") == "b") & (F.col("cand") == F.col("gold")), 0.5).otherwise(0.0)
    return x.select(
        "id",
        "model",
        "gold",
        "cand",
        F.round(3 * F.element_at("embedding", at).cast("double") + lift, 4).alias("score")
    )


#: Landscape of the scores in SQL: q, gold_q, gold_rank, top1, margins, entropy for each (id, model).
LAND_SQL = """sm AS (SELECT *, exp(score - max(score) OVER w) / sum(exp(score - (SELECT 0))) OVER w AS q0, max(score) OVER w AS top FROM sc WINDOW w AS (PARTITION BY id, model)),
qq AS (SELECT id, model, gold, cand, score, exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY id, model) AS q, row_number() OVER (PARTITION BY id, model ORDER BY score DESC, cand) AS rnk FROM sm),
ls AS (SELECT id, model, any_value(gold) AS gold, max(q) FILTER (cand = gold) AS gold_q, CAST(max(rnk) FILTER (cand = gold) AS INT) AS gold_rank, max(cand) FILTER (rnk = 1) AS top1,
 max(score) FILTER (rnk = 1) - max(score) FILTER (rnk = 2) AS top1_margin, max(score) FILTER (cand = gold) - max(score) FILTER (cand <> gold) AS gold_margin,
 -sum(q * ln(greatest(q, 1e-300))) AS entropy, -sum(q * ln(greatest(q, 1e-300))) / ln(8.0::DOUBLE) AS normalized_entropy FROM qq GROUP BY id, model),
pr AS (SELECT id, any_value(gold) AS gold, """ + ", ".join(f"max({c}) FILTER (model = '{m}') AS {c}{i}" for i, m in enumerate("ab") for c in ("gold_q", "gold_rank", "top1", "gold_margin", "normalized_entropy")) + " FROM ls GROUP BY id)"
LAND_SQL = LAND_SQL.replace("exp(score - max(score) OVER w) / sum(exp(score - (SELECT 0))) OVER w AS q0, ", "")

STEP_SQL = """st AS (SELECT event_id AS id, CAST(event_id % 625 + 1 AS BIGINT) AS step, event_type AS arm, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "CAST(event_id % 625 + 1 AS BIGINT) AS step",
        "event_type AS arm",
        "user_id",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value"
    )


#: Three statements for each order: kind 0-2 (is a knight/knave, same, different), two people, negated or not.
def _statement(j: int) -> tuple[str, str, str, str]:
    x = f"(o_orderkey * {(7, 11, 13)[j]} + o_custkey * {(3, 5, 2)[j]} + {j})"
    return f"{x} % 3", f"cast(floor({x} / 3.0E0) as bigint) % 3", f"cast(floor({x} / 9.0E0) as bigint) % 2", f"cast(floor({x} / 18.0E0) as bigint) % 2"


PUZZLE_COLS = ", ".join(
    f"{v} AS {n}{j}" for j in range(3) for n, v in zip(("kind", "first", "shift", "neg"), _statement(j), strict=True)
)
PUZZLE_SQL = f"pz AS (SELECT o_orderkey AS id, {PUZZLE_COLS} FROM orders)"
#: Truth of statement j of a puzzle under an assignment a (0 to 7), and whether person p is a knight under it.
KNIGHT = "(cast(floor((7 - a) / power(2.0E0, 2 - ({0}))) as bigint) % 2 = 1)"


def _truth(j: int) -> str:
    other = f"((first{j} + 1 + shift{j}) % 3)"
    one, two = KNIGHT.format(f"first{j}"), KNIGHT.format(other)
    flat = f"CASE kind{j} WHEN 0 THEN ({one}) = (shift{j} = 0) WHEN 1 THEN ({one}) = ({two}) ELSE ({one}) <> ({two}) END"
    return f"((CASE WHEN {flat} THEN 1 ELSE 0 END + neg{j}) % 2 = 1)"


TRUTH = [_truth(j) for j in range(3)]
ASSIGN_SQL = f"asg AS (SELECT id, a, {', '.join(f'{t} AS t{j}, {KNIGHT.format(j)} AS k{j}' for j, t in enumerate(TRUTH))} FROM pz, (SELECT unnest(range(8)) AS a))"


def puzzles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", *_split(PUZZLE_COLS))


def puzzle_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same puzzles as JSON trees: id, people, statements of (speaker, expr)."""
    from ..functions import logic as L

    people = F.array(F.lit("Alice"), F.lit("Bob"), F.lit("Carol"))
    name = lambda i: F.get(people, i.cast("int"))

    def expr(j: int):
        kind, first, shift, neg = (F.col(f"{n}{j}") for n in ("kind", "first", "shift", "neg"))
        one, two = name(first), name((first + 1 + shift) % 3)
        leaf = F.when(
            kind == 0, L.person_is(one, F.when(shift == 0, "knight").otherwise("knave"))
        ).when(kind == 1, L.same(one, two)).otherwise(L.different(one, two))
        return F.when(neg == 1, L.negate(leaf)).otherwise(leaf)

    p = puzzles(spark, sf_dir)
    said = F.array(
        *[F.struct(F.lit(s).alias("speaker"), expr(j).alias("expr")) for j, s in enumerate(("Alice", "Bob", "Carol"))]
    )
    return p.select("id", people.alias("people"), said.alias("statements"))


#: Puzzles of three to six people, a statement for each: a plain one, or two joined by and / or.
NAMES = ("Alice", "Bob", "Carol", "Dave", "Erin", "Frank")
_CROWD = "o_orderkey * (7 + 4 * p) + o_custkey * (3 + 2 * p) + p"
_PLAIN = {
    "kind": "{0} % 3", "first": "{0} // 3 % n", "other": "({0} // 3 % n + 1 + {0} // 9 % (n - 1)) % n",
    "knave": "{0} // 9 % 2", "neg": "{0} // 27 % 2"
}
CROWD_SQL = f"""cr AS (SELECT o_orderkey AS id, 3 + o_orderkey % 4 AS n, p, {_CROWD} AS x FROM orders, (SELECT unnest(range(6)) AS p) WHERE p < 3 + o_orderkey % 4),
cs AS (SELECT id, n, p, x // 54 % 3 AS form, x, x * 31 + 17 AS y FROM cr),
cw AS (SELECT *, unnest(range(CAST(1 << n AS BIGINT))) AS a FROM cs)"""


def _crowd_truth(x: str) -> str:
    v = {k: f"({f.format(x)})" for k, f in _PLAIN.items()}
    knight = lambda j: f"((a >> CAST(n - 1 - {j} AS INT)) & 1 = 0)"
    one, two = knight(v["first"]), knight(v["other"])
    plain = f"CASE {v['kind']} WHEN 0 THEN {one} = ({v['knave']} = 0) WHEN 1 THEN {one} = {two} ELSE {one} <> {two} END"
    return f"(({plain}) <> ({v['neg']} = 1))"


#: Truth of a statement under an assignment, and whether its speaker is a knight under it.
CROWD_TRUE = f"CASE form WHEN 0 THEN {_crowd_truth('x')} WHEN 1 THEN {_crowd_truth('x')} AND {_crowd_truth('y')} ELSE {_crowd_truth('x')} OR {_crowd_truth('y')} END"
CROWD_KNIGHT = "((a >> CAST(n - 1 - p AS INT)) & 1 = 0)"


def crowds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same puzzles: id, people, statements of (speaker, expr as JSON)."""
    from ..functions import logic as L

    n = (3 + F.col("o_orderkey") % 4).cast("int")
    x = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderkey", "o_custkey", n.alias("n"))
    x = x.withColumn("people", F.slice(F.array(*[F.lit(p) for p in NAMES]), F.lit(1), F.col("n")))
    div = lambda a, b: F.floor(a / F.lit(b))

    # texts of all plain statements, constant: one is looked up, none is written row by row
    at = lambda texts, *places: F.get(F.array(*texts), sum((i * len(NAMES)**k for k, i in enumerate(reversed(places))), F.lit(0)).cast("int"))
    is_a = [L.person_is(a, v) for a in NAMES for v in ("knight", "knave", *[""] * (len(NAMES) - 2))]
    alike, apart = ([f(a, b) for a in NAMES for b in NAMES] for f in (L.same, L.different))

    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  a lambda's variable is computed once

    def plain(x):
        n = F.col("n")
        other = lambda first: (first + 1 + div(x, 9) % (n - 1)) % n
        leaf = lambda first: F.when(x % 3 == 0, at(is_a, first, div(x, 9) % 2)).when(
            x % 3 == 1, at(alike, first, other(first))
        ).otherwise(at(apart, first, other(first)))
        said = lambda leaf: F.when(div(x, 27) % 2 == 1, L.negate(leaf)).otherwise(leaf)
        return bound(bound(div(x, 3) % n, leaf), said)

    def form(x, one):
        two = lambda join: bound(x * 31 + 17, lambda y: join(one, plain(y)))
        return bound(div(x, 54) % 3, lambda f: F.when(f == 0, one).when(f == 1, two(L.both)).otherwise(two(L.either)))

    def said(p):
        x = F.col("o_orderkey") * (7 + 4 * p) + F.col("o_custkey") * (3 + 2 * p) + p
        expr = bound(x, lambda x: bound(plain(x), lambda one: form(x, one)))
        return F.struct(F.get(F.col("people"), p).alias("speaker"), expr.alias("expr"))

    return x.select("id", "people", F.transform(F.sequence(F.lit(0), F.col("n") - 1), said).alias("statements"))

"""Random puzzles by hashing: every choice is a digest of seed, attempt, speaker and place in the tree.

Choices need no generator and no order, so rows are drawn in any task, lost ones
drawn anew alike, and another engine draws the same.  Statements are built as
columns, from the leaves of a full binary tree up; a leaf is an entry of the
table of all statements about one or two people, an inner node is a leaf as well
in ``STOP`` of 100 cases, else not, and, or.  The expressions are SQL text that two
engines read; ``Dialect`` holds what differs.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import logic
from ..functions.text import PATTERNS
from ..sources import exchange

PEOPLE = ("Alice", "Bob", "Carol")
STOP = 60
FULL = 255
FIELDS = ("mask", "expr", "said", "nodes", "depth")


@dataclass(frozen=True)
class Dialect:
    """How an engine writes a number drawn from a digest, and an entry of a table."""

    number: str = "cast(conv(substr(md5({0}), 1, 8), 16, 10) as bigint)"
    table: str = "element_at(array({0}), cast({1} as int) + 1)"

    def draw(self, n: int, *tag: str) -> str:
        return f"({self.number.format(' || '.join(tag))} % {n})"

    def entry(self, values: list[str], at: str) -> str:
        return self.table.format(", ".join(values), at)


SPARK = Dialect()
DUCK = Dialect("CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)", "([{0}])[CAST({1} AS INT) + 1]")


def leaves(people: tuple[str, ...] = PEOPLE) -> list[dict]:
    """All statements without an operator, in a fixed order: who is what, who is alike, who differs."""
    about = [{"op": "person_is", "person": p, "value": v} for p in people for v in ("knight", "knave")]
    pairs = list(itertools.permutations(people, 2))
    return about + [{"op": op, "left": a, "right": b} for op in ("same", "different") for a, b in pairs]


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _leaf_tables() -> dict[str, list[str]]:
    rows = [(x, *logic.analyse(x, list(PEOPLE))) for x in leaves()]
    canonical = [_text(json.dumps(x, sort_keys=True, separators=(",", ":"))) for x, *_ in rows]
    return {"mask": [str(m) for _, m, *_ in rows], "expr": canonical, "said": [_text(said) for _, _, said, *_ in rows]}


def _inner(field: str, op: str, a: str, b: str) -> str:
    """A field of a node from those of its parts."""
    if field == "mask":
        return {"not": f"{FULL} - {a}", "and": f"{a} & {b}", "or": f"{a} | {b}"}[op]
    if field in ("nodes", "depth"):
        both = f"{a} + {b}" if field == "nodes" else f"greatest({a}, {b})"
        return f"1 + {a if op == 'not' else both}"
    if field == "expr":
        two = f"""'{{"left":' || {a} || ',"op":"{op}","right":' || {b} || '}}'"""
        return f"""'{{"expr":' || {a} || ',"op":"not"}}'""" if op == "not" else two
    parts = logic.SENTENCES[op].replace("{0}", "\0{0}\0").replace("{1}", "\0{1}\0").split("\0")
    return " || ".join({"{0}": a, "{1}": b}.get(x, _text(x)) for x in parts if x)


def stages(dialect: Dialect, names: list[str], depth: int, fields: tuple[str, ...] = FIELDS) -> list[list[str]]:
    """Lists of ``expression AS column``, one after another: the draws, then the tree's levels from the leaves up.

    ``names``: SQL of a tag for each statement; its root's columns are ``<field>_<number>_r``.
    """
    tables = _leaf_tables()
    tables |= {"nodes": ["1"] * len(tables["mask"]), "depth": ["1"] * len(tables["mask"])}
    paths = [["r" + "".join(x) for x in itertools.product("ab", repeat=level)] for level in range(depth + 1)]
    draws = []
    for (i, tag), path in itertools.product(enumerate(names), itertools.chain(*paths)):
        place = f"{tag} || ':{path}"
        draws.append(f"{dialect.draw(len(tables['mask']), place + ':leaf' + chr(39))} AS leaf_{i}_{path}")
        if len(path) <= depth:
            op = f"{dialect.draw(3, place + ':op' + chr(39))}"
            draws.append(
                f"CASE WHEN {dialect.draw(100, place + ':stop' + chr(39))} < {STOP} THEN -1 ELSE {op} END AS "
                f"op_{i}_{path}"
            )
    out = [draws]
    for level in reversed(paths):
        now = []
        for (i, _), path, field in itertools.product(enumerate(names), level, fields):
            leaf = dialect.entry(tables[field], f"leaf_{i}_{path}")
            a, b = f"{field}_{i}_{path}a", f"{field}_{i}_{path}b"
            arms = " ".join(f"WHEN {k} THEN {_inner(field, op, a, b)}" for k, op in enumerate(("not", "and", "or")))
            now.append(
                (leaf if len(path) > depth else f"CASE op_{i}_{path} {arms} ELSE {leaf} END")
                + f" AS {field}_{i}_{path}"
            )
        out.append(now)
    return out


def sql(source: str, dialect: Dialect, names: list[str], depth: int, fields: tuple[str, ...] = FIELDS) -> str:
    """``source`` (SQL of a table) with the statements' columns."""
    for columns in stages(dialect, names, depth, fields):
        source = f"(SELECT *, {', '.join(columns)} FROM {source} AS q)"
    return source


def _needed(names: list[str], depth: int, fields: tuple[str, ...]) -> list[list[str]]:
    """``stages`` for Spark, from the root down: a place is drawn only where its parent takes it, others are null."""
    draws, *levels = stages(SPARK, names, depth, fields)
    drawn = {x.rsplit(" AS ", 1)[1]: x.rsplit(" AS ", 1)[0] for x in draws}

    def taken(i: int, path: str) -> str:
        return "true" if path == "r" else f"op_{i}_{path[:-1]} >= {0 if path[-1] == 'a' else 1}"

    out: list[list[str]] = [[] for _ in range(depth + 1)]
    for name, x in drawn.items():
        kind, i, path = name.split("_")
        inner = len(path) <= depth
        if kind == "op":
            out[len(path) - 1].append(f"CASE WHEN {taken(int(i), path)} THEN {x} END AS {name}")
        else:
            own = f" AND op_{i}_{path} = -1" if inner else ""
            out[depth].append(f"CASE WHEN {taken(int(i), path)}{own} THEN {x} END AS {name}")
    return [*out, *levels]


def grown(rows: DataFrame, names: list[str], depth: int, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``rows`` with the statements' columns; only the roots' are kept."""
    x = rows
    for columns in _needed(names, depth, fields):
        x = x.selectExpr("*", *columns)
    return x.select(*rows.columns, *[f"{f}_{i}_r" for i in range(len(names)) for f in fields])


def _agree(mask: str, speaker: int) -> str:
    """Assignments under which a statement is as true as its speaker is a knight."""
    return f"({FULL} - (({mask} | {speaker}) - ({mask} & {speaker})))"


def solutions(masks: list[str]) -> str:
    speakers = logic.truth_masks(list(PEOPLE))
    return " & ".join(_agree(m, speakers[p]) for m, p in zip(masks, PEOPLE, strict=True))


def unique(column: str) -> str:
    return f"{column} IN ({', '.join(str(1 << i) for i in range(8))})"


def pattern(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {1 << i} THEN '{p}'" for i, p in enumerate(PATTERNS)) + " END"


def tags(*parts: str) -> list[str]:
    """A tag for each speaker: the parts, then the speaker's number."""
    head = " || ':' || ".join(f"cast({p} as varchar(20))" for p in parts)
    return [f"{head} || ':{i}'" for i in range(len(PEOPLE))]


#: Fields that a puzzle needs.
SAID = ("mask", "expr", "said")
#: Tries for a statement that agrees with the target; about every second does.
TRIES = 8


def _picked(table: str, seed: str) -> str:
    """The first attempt with one solution for each seed, as SQL of a grouping that both engines read."""
    keep = [f"min_by({f}_{i}_r, attempt) AS {f}_{i}" for i in range(len(PEOPLE)) for f in SAID[1:]]
    first = ", ".join(["min(attempt) AS attempts", "min_by(solutions, attempt) AS solutions", *keep])
    return f"SELECT {seed}, {pattern('solutions')} AS pattern, * EXCLUDE ({seed}, solutions) FROM (SELECT {seed}, {first} FROM {table} WHERE {unique('solutions')} GROUP BY {seed}) AS p"


def statement_first_sql(seeds: str, first: int, last: int, depth: int, dialect: Dialect = DUCK) -> str:
    """Puzzles whose statements are drawn without regard to any answer."""
    rows = f"(SELECT seed, attempt FROM {seeds} AS s, (SELECT unnest(range({first}, {last + 1})) AS attempt) AS t)"
    x = sql(rows, dialect, tags("seed", "attempt"), depth, SAID)
    solved = solutions([f"mask_{i}_r" for i in range(len(PEOPLE))])
    return _picked(f"(SELECT *, {solved} AS solutions FROM {x} AS g)", "seed")


def target_sql(dialect: Dialect) -> str:
    return dialect.draw(8, "cast(seed as varchar(20)) || ':' || cast(attempt as varchar(20)) || ':target'")


def _agrees(i: int) -> str:
    """Whether statement i is true under the target exactly if its speaker is a knight there."""
    speaker = logic.truth_masks(list(PEOPLE))[PEOPLE[i]]
    return f"({_agree(f'mask_{i}_r', speaker)} & bit) <> 0"


def label_first_sql(seeds: str, first: int, last: int, depth: int, dialect: Dialect = DUCK) -> str:
    """Puzzles whose answer is drawn first, then for each speaker the first statement that agrees with it."""
    rows = f"""(SELECT seed, attempt, try, cast(power(2, {target_sql(dialect)}) as int) AS bit FROM {seeds} AS s,
 (SELECT unnest(range({first}, {last + 1})) AS attempt) AS t, (SELECT unnest(range({TRIES})) AS try) AS u)"""
    x = sql(rows, dialect, tags("seed", "attempt", "try"), depth, SAID)
    best = [
        f"min_by({f}_{i}_r, try) FILTER (WHERE {_agrees(i)}) AS {f}_{i}_r" for i in range(len(PEOPLE)) for f in SAID
    ]
    solved = solutions([f"mask_{i}_r" for i in range(len(PEOPLE))])
    g = f"(SELECT seed, attempt, {', '.join(best)} FROM {x} AS g GROUP BY seed, attempt)"
    return _picked(f"(SELECT *, {solved} AS solutions FROM {g} AS h)", "seed")


_MASKS = [f"mask_{i}_r" for i in range(len(PEOPLE))]


def _said(rows: DataFrame, parts: tuple[str, ...], depth: int, fields: tuple[str, ...]) -> DataFrame:
    """``rows`` for each speaker (numbered), with the fields of their statement: one statement's columns are code enough."""
    x = rows.selectExpr("*", f"explode(sequence(0, {len(PEOPLE) - 1})) AS speaker")
    tag = " || ':' || ".join(f"cast({p} as varchar(20))" for p in (*parts, "speaker"))
    return grown(x, [tag], depth, fields)


def _statement_first(tries: DataFrame, depth: int) -> DataFrame:
    """Masks of each attempt's statements."""
    x = _said(tries, ("seed", "attempt"), depth, ("mask",))
    masks = [F.max(F.when(F.col("speaker") == i, F.col("mask_0_r"))).alias(m) for i, m in enumerate(_MASKS)]
    return x.groupBy("seed", "attempt").agg(*masks)


def _label_first(tries: DataFrame, depth: int) -> DataFrame:
    """Masks of each attempt's statements, and which ``tries`` they are: the first that agree with the answer."""
    x = tries.selectExpr(
        "seed", "attempt", f"explode(sequence(0, {TRIES - 1})) AS try",
        f"cast(power(2, {target_sql(SPARK)}) as int) AS bit"
    )
    x = _said(x, ("seed", "attempt", "try"), depth, ("mask",))
    knights = SPARK.entry([str(logic.truth_masks(list(PEOPLE))[p]) for p in PEOPLE], "speaker")
    agrees = f"({_agree('mask_0_r', knights)} & bit) <> 0"
    # try and mask in one number, so that the least is the first try's; null where no try agrees
    best = [
        F.expr(f"min(CASE WHEN speaker = {i} AND {agrees} THEN try * {FULL + 1} + mask_0_r END)").alias(f"best_{i}")
        for i in range(len(PEOPLE))
    ]
    tried = ", ".join(f"cast(floor(best_{i} / {FULL + 1}.0E0) as int)" for i in range(len(PEOPLE)))
    masks = [f"best_{i} % {FULL + 1} AS {m}" for i, m in enumerate(_MASKS)]
    return x.groupBy("seed", "attempt").agg(*best).selectExpr("seed", "attempt", *masks, f"array({tried}) AS tries")


#: How a kind's masks are drawn, and what a statement of an attempt is told by.
KINDS = {
    "statement": (_statement_first, ("seed", "attempt")),
    "label": (_label_first, ("seed", "attempt", "tries[speaker]")),
}


def spread(seeds: DataFrame) -> DataFrame:
    """Few bytes of seeds are much work: dealt to as many tasks as ``spark.sql.shuffle.partitions``."""
    return seeds.repartition(int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seed")


def generate(
    seeds: DataFrame, kind: str = "statement", depth: int = 2, attempts: int = 10_000, at_once: int = 64
) -> DataFrame:
    """One uniquely solvable puzzle for each seed (column seed): pattern, attempts, people and statements.

    Four attempts are made at first for each seed, then twice as many for the seeds that are left, up to ``at_once``; only
    masks are drawn, and what was found goes to the shared folder.  Texts are drawn for the attempts that were found.  A
    seed without a puzzle after ``attempts`` is an error.
    """
    masks, parts = KINDS[kind]
    picked, left = None, exchange.table(seeds.select(F.col("seed").cast("long").alias("seed")).distinct(), "seeds")
    last, n = 0, min(4, at_once)
    while last < attempts:
        start, last = last + 1, min(last + n, attempts)
        tries = spread(left).select("seed", F.explode(F.sequence(F.lit(start), F.lit(last))).alias("attempt"))
        x = masks(tries, depth).withColumn("solutions", F.expr(solutions(_MASKS))).where(unique("solutions"))
        row = F.struct("attempt", "solutions", *[c for c in x.columns if c == "tries"])
        found = x.groupBy("seed").agg(F.min_by(row, "attempt").alias("row")).select("seed", "row.*")
        found = exchange.table(found, "puzzles")
        picked = found if picked is None else picked.unionByName(found)
        left = exchange.table(left.join(found.select("seed"), "seed", "left_anti"), "seeds")
        if left.isEmpty():
            return _written(picked, parts, depth)
        n = min(2 * n, at_once)
    raise RuntimeError(f"{left.count()} seeds have no uniquely solvable puzzle in {attempts} attempts")


def _written(picked: DataFrame, parts: tuple[str, ...], depth: int) -> DataFrame:
    """Puzzles of the attempts picked."""
    x = _said(spread(picked), parts, depth, SAID[1:])
    people = F.array(*[F.lit(p) for p in PEOPLE])
    said = F.struct(
        "speaker", F.get(people, F.col("speaker")).alias("name"), F.col("expr_0_r").alias("expr"),
        F.concat("said_0_r", F.lit(".")).alias("text")
    )
    x = x.groupBy("seed", "attempt", "solutions").agg(F.array_sort(F.collect_list(said)).alias("said"))  # one a speaker
    statements = F.transform("said", lambda s: F.struct(s["name"].alias("speaker"), s["expr"].alias("expr"), s["text"].alias("text")))
    x = x.select("seed", statements.alias("statements"), F.expr(pattern("solutions")).alias("pattern"), F.col("attempt").alias("attempts"))
    return exchange.table(x, "puzzles").select("seed", people.alias("people"), "statements", "pattern", "attempts")

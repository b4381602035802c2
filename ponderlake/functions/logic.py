"""Expression trees over knights and knaves, compiled once to truth masks.

A tree is JSON text.  Under three people there are eight assignments, numbered
as they are enumerated (all knights first, the last person varying fastest), so
a tree's meaning is eight bits.  ``compile_expr`` reads a tree of any depth in one
vectorised pass; after that evaluation, consistency and solving are bit
arithmetic inside generated code.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import OPS

COMPILED = "struct<mask:int,text:string,nodes:int,depth:int,ops:array<int>>"
#: The sentence of each operator; {0} and {1} are names or rendered parts.
SENTENCES = {
    "person_is": "{0} is a {1}",
    "same": "{0} and {1} are the same type",
    "different": "{0} and {1} are different types",
    "not": "it is not true that {0}",
    "and": "both ({0}) and ({1})",
    "or": "either ({0}) or ({1})",
}


def person_is(person: str | Column, value: str | Column) -> Column:
    return _node(op="person_is", person=person, value=value)


def same(left: str | Column, right: str | Column) -> Column:
    return _node(left=left, op="same", right=right)


def different(left: str | Column, right: str | Column) -> Column:
    return _node(left=left, op="different", right=right)


def negate(expr: Column) -> Column:
    return F.concat(F.lit('{"expr":'), expr, F.lit(',"op":"not"}'))


def both(left: Column, right: Column) -> Column:
    return F.concat(F.lit('{"left":'), left, F.lit(',"op":"and","right":'), right, F.lit("}"))


def either(left: Column, right: Column) -> Column:
    return F.concat(F.lit('{"left":'), left, F.lit(',"op":"or","right":'), right, F.lit("}"))


def _node(**fields: str | Column) -> Column:
    """Canonical JSON (sorted keys, no spaces) of a leaf."""
    return F.to_json(F.struct(*[(F.lit(x) if isinstance(x, str) else x).alias(k) for k, x in sorted(fields.items())]))


def truth_masks(people: list[str]) -> dict[str, int]:
    """Bit i of a person's mask: knight under assignment i."""
    n = len(people)
    return {p: sum(1 << i for i in range(1 << n) if not i >> (n - 1 - j) & 1) for j, p in enumerate(people)}


def analyse(tree: dict, people: list[str]) -> tuple[int, str, int, int, list[int]]:
    """Mask, sentence, nodes, depth and count of each operator, by an explicit stack (any depth)."""
    masks, full = truth_masks(people), (1 << (1 << len(people))) - 1
    meaning: dict[str, Callable[..., int]] = {
        "not": lambda a: full & ~a, "and": lambda a, b: a & b, "or": lambda a, b: a | b
    }
    ops, depth, done, todo = dict.fromkeys(OPS, 0), 0, [], [(tree, 1, False)]
    while todo:
        node, level, ready = todo.pop()
        op = node.get("op")
        if op not in ops:
            raise ValueError(f"unknown expression operator: {op}")
        if ready:
            parts = [done.pop() for _ in range(1 if op == "not" else 2)][::-1]
            done.append((meaning[op](*[m for m, _ in parts]), SENTENCES[op].format(*[t for _, t in parts])))
            continue
        ops[op] += 1
        depth = max(depth, level)
        if op == "person_is":
            mask = masks[node["person"]]
            done.append(
                (
                    mask if node["value"] == "knight" else full & ~mask,
                    SENTENCES[op].format(node["person"], node["value"])
                )
            )
        elif op in ("same", "different"):
            differ = masks[node["left"]] ^ masks[node["right"]]
            done.append(
                (differ if op == "different" else full & ~differ, SENTENCES[op].format(node["left"], node["right"]))
            )
        else:
            todo.append((node, level, True))
            todo.extend((node[k], level + 1, False) for k in (("expr",) if op == "not" else ("right", "left")))
    return done[0][0], done[0][1], sum(ops.values()), depth, [ops[k] for k in OPS]


@functools.lru_cache(1 << 16)
def _compiled(tree: str, people: tuple[str, ...]) -> dict:
    """A tree's compiled form; the trees that a worker meets again cost a look-up."""
    return dict(zip(("mask", "text", "nodes", "depth", "ops"), analyse(json.loads(tree), list(people)), strict=True))


def compile_expr(people: tuple[str, ...] = ("Alice", "Bob", "Carol")):
    """Column function: JSON text of a tree to its compiled struct; null stays null."""
    none = dict.fromkeys(("mask", "text", "nodes", "depth", "ops"))

    @F.pandas_udf(COMPILED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([none if x is None else _compiled(x, people) for x in texts], columns=list(none))

    return run


def compile_all(people: tuple[str, ...] = ("Alice", "Bob", "Carol")):
    """The same for an array of trees: an array of structs, so that a puzzle's statements stay together."""

    @F.pandas_udf(f"array<{COMPILED}>")
    def run(trees: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [_compiled(t, people) for t in x] for x in trees])

    return run


def eval_mask(mask: Column, assignment: Column) -> Column:
    """Truth under assignment number ``assignment``."""
    return F.shiftright(mask, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), assignment.cast("int"))) != 0


def consistent_mask(statement_masks: Column, speaker_masks: Column, n_people: int = 3) -> Column:
    """Bit i: under assignment i every statement is as true as its speaker is a knight."""
    full = (1 << (1 << n_people)) - 1
    return F.aggregate(
        F.arrays_zip(statement_masks.alias("m"), speaker_masks.alias("s")),
        F.lit(full),
        lambda t, x: t.bitwiseAND(F.bitwise_not(x["m"].bitwiseXOR(x["s"])))
    )


def puzzle_key(people: Column, statements: Column) -> Column:
    """Digest of people, speakers and canonical trees; ids, texts and answers don't count.

    ``statements``: array of struct(speaker, expr as JSON text).
    """
    canon = F.transform(
        statements,
        lambda s: F.concat(
            F.lit('{"expr":'), F.to_json(F.parse_json(s["expr"])), F.lit(',"speaker":'),
            F.to_json(F.struct(s["speaker"].alias("x"))), F.lit("}")
        )
    )
    return F.sha2(F.concat(F.to_json(F.struct(people.alias("people"))), F.array_join(canon, ",")), 256)

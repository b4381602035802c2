"""Puzzles of any number of people: truth tables as arrays of 64-bit words, made inside generated SQL.

Assignments are numbered as they are enumerated: all knights first, the last person varying fastest.  A word holds 64 of them,
in which the last six people vary; the others are constant in it, as the number of the word tells.  A statement's JSON is read
once into postfix steps, in Python (a fold over tokens in SQL took four times as long); a word of a truth table is then a fold
over the steps, and a puzzle's word a fold over its statements that stops looking where none of the 64 assignments is left.
No row is multiplied.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A step: what it does, and up to two people (or a person and whether a knight is meant).
STEPS = "array<struct<do:int,a:int,b:int>>"
PERSON_IS, SAME, DIFFERENT, NOT, AND, OR = range(6)
#: Bits of a word in which the person that many places from the last is a knight.
_PATTERNS = [sum(1 << i for i in range(64) if not i >> s & 1) for s in range(6)]
_WORD = "bigint"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _long(x: int) -> Column:
    return F.lit(_signed(x)).cast(_WORD)


def _once(pairs: list) -> dict:
    if len(node := dict(pairs)) < len(pairs):
        raise ValueError("a key is there twice")
    return node


@functools.lru_cache(1 << 14)
def _steps(text: str, people: tuple[str, ...]) -> list[int]:
    """Postfix steps of a tree, three numbers each, by an explicit stack; statements met again cost a look-up."""
    wrong = f"not a statement: {text}"
    try:
        todo = [json.loads(text, object_pairs_hook=_once)]
    except ValueError as e:
        raise ValueError(wrong) from e

    def place(name: object) -> int:
        if not isinstance(name, str):
            raise ValueError(wrong)
        if name not in people:
            raise ValueError(f"unknown person: {name}")
        return people.index(name)

    out: list[tuple[int, int, int]] = []  # last step first: a node before its right side, that before its left
    while todo:
        match todo.pop():
            case {"op": "person_is", "person": who, "value": ("knight" | "knave") as value, **rest} if not rest:
                out.append((PERSON_IS, place(who), int(value == "knight")))
            case {"op": ("same" | "different") as op, "left": a, "right": b, **rest} if not rest:
                out.append((SAME if op == "same" else DIFFERENT, place(a), place(b)))
            case {"op": "not", "expr": a, **rest} if not rest:
                out.append((NOT, 0, 0))
                todo.append(a)
            case {"op": ("and" | "or") as op, "left": a, "right": b, **rest} if not rest:
                out.append((AND if op == "and" else OR, 0, 0))
                todo += [a, b]
            case _:
                raise ValueError(wrong)
    return [x for step in reversed(out) for x in step]


def _lists(statements: Iterable[tuple[str | None, tuple[str, ...]]]) -> pa.Array:
    flat, ends, none = [], [0], []
    for text, people in statements:
        none.append(text is None)
        if text is not None:
            flat += _steps(text, people)
        ends.append(len(flat) // 3)
    columns = np.array(flat, np.int32).reshape(-1, 3).T
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["do", "a", "b"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(none, pa.bool_()))


def _each(texts: pa.Array, people: pa.Array) -> pa.Array:
    return _lists((t, tuple(p or ())) for t, p in zip(texts.to_pylist(), people.to_pylist(), strict=True))


def _all(texts: pa.Array, people: pa.Array) -> pa.Array:
    rows = texts.to_pylist()
    inner = _lists((t, who) for ts, p in zip(rows, people.to_pylist(), strict=True) for who in [tuple(p or ())] for t in ts or ())
    ends = np.concatenate([[0], np.cumsum([len(ts or ()) for ts in rows])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, mask=pa.array([ts is None for ts in rows], pa.bool_()))


def compiled(expr: Column, people: Column) -> Column:
    """Postfix steps of a tree (JSON text); unknown operators and people are errors, null stays null."""
    return F.arrow_udf(_each, STEPS)(expr, people)


def compiled_all(exprs: Column, people: Column) -> Column:
    """The same for an array of trees."""
    return F.arrow_udf(_all, f"array<{STEPS}>")(exprs, people)


def _bound(x: Column, f) -> Column:
    """f of x, computed once: within a lambda, a column is computed each time that it is named."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def words(n: Column) -> Column:
    """Numbers of the words of a truth table over n people."""
    return F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.greatest(n - 6, F.lit(0))) - 1)


def valid(n: Column) -> Column:
    """Bits of a word that stand for assignments."""
    few = F.coalesce(*[F.when(n == k, _long((1 << (1 << k)) - 1)) for k in range(6)])
    return F.coalesce(few, F.lit(-1).cast(_WORD))


def knight(person: Column, n: Column, word: Column) -> Column:
    """The word of a person: where they are a knight."""
    s = n - 1 - person
    low = F.element_at(F.array(*[_long(p) for p in _PATTERNS]), F.least(s, F.lit(5)) + 1)
    high = F.when(F.shiftright(word, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), F.greatest(s - 6, F.lit(0)))) == 0, -1)
    return F.when(s < 6, low).otherwise(F.coalesce(high, F.lit(0)).cast(_WORD))


def truth(steps: Column, n: Column, word: Column) -> Column:
    """A word of a statement's truth table; bits beyond ``valid`` mean nothing."""

    def apply(stack: Column, s: Column) -> Column:
        top, below = F.element_at(stack, -1), lambda k: F.slice(stack, F.lit(1), F.size(stack) - k)
        second = F.element_at(stack, -2)
        a, b = knight(s["a"], n, word), knight(s["b"], n, word)
        push = lambda x: F.concat(stack, F.array(x))
        return (
            F.when(s["do"] == PERSON_IS, push(F.when(s["b"] == 1, a).otherwise(F.bitwise_not(a))))
            .when(s["do"] == SAME, push(F.bitwise_not(a.bitwiseXOR(b))))
            .when(s["do"] == DIFFERENT, push(a.bitwiseXOR(b)))
            .when(s["do"] == NOT, F.concat(below(1), F.array(F.bitwise_not(top))))
            .when(s["do"] == AND, F.concat(below(2), F.array(second.bitwiseAND(top))))
            .otherwise(F.concat(below(2), F.array(second.bitwiseOR(top))))
        )

    return F.aggregate(steps, F.array().cast(f"array<{_WORD}>"), apply, lambda stack: F.element_at(stack, 1))


def truth_table(steps: Column, n: Column) -> Column:
    """All words of a statement's truth table."""
    return _bound(steps, lambda s: F.transform(words(n), lambda w: truth(s, n, w).bitwiseAND(valid(n))))


def solutions(statements: Column, n: Column) -> Column:
    """Words of the assignments under which every statement is as true as its speaker is a knight.

    ``statements``: array of struct(speaker: place among the people, steps).
    """

    def word(all_said: Column, w: Column) -> Column:
        agree = lambda s: F.bitwise_not(truth(s["steps"], n, w).bitwiseXOR(knight(s["speaker"], n, w)))
        return F.aggregate(all_said, valid(n), lambda left, s: F.when(left == 0, left).otherwise(left.bitwiseAND(agree(s))))

    return _bound(statements, lambda x: F.transform(words(n), lambda w: word(x, w)))


def count(table: Column) -> Column:
    """Assignments of a table of words."""
    return F.aggregate(table, F.lit(0), lambda t, w: t + F.bit_count(w))


def first(table: Column) -> Column:
    """Number of the first assignment, null without one."""
    some = F.filter(F.transform(table, lambda w, i: F.when(w != 0, i)), lambda i: i.isNotNull())
    at = F.get(some, F.lit(0))
    bits = F.reverse(F.lpad(F.bin(F.get(table, at)), 64, "0"))
    return at * 64 + F.instr(bits, "1") - 1


def pattern(assignment: Column, n: Column) -> Column:
    """K/N string of an assignment's number."""
    mark = lambda j: F.when(assignment.bitwiseAND(F.call_function("shiftleft", F.lit(1), n - 1 - j)) == 0, "K").otherwise("N")
    return F.when(assignment.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), mark), ""))

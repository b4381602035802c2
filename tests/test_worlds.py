"""Puzzles of three to sixteen people against plain Python."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from ponderlake.functions import worlds
from ponderlake.operators import puzzles

KIND = "id long, people array<string>, statements array<struct<speaker:string,expr:string>>"


def grown(rng, people, depth):
    kind = rng.choice(["person_is", "same", "different", "not", "and", "or"] if depth else ["person_is", "same", "different"])
    if kind == "person_is":
        return {"op": kind, "person": rng.choice(people), "value": rng.choice(["knight", "knave"])}
    if kind in ("same", "different"):
        left, right = rng.sample(people, 2)
        return {"op": kind, "left": left, "right": right}
    if kind == "not":
        return {"op": kind, "expr": grown(rng, people, depth - 1)}
    return {"op": kind, "left": grown(rng, people, depth - 1), "right": grown(rng, people, depth - 1)}


def true(tree, world):
    op = tree["op"]
    if op == "person_is":
        return world[tree["person"]] == (tree["value"] == "knight")
    if op in ("same", "different"):
        return (world[tree["left"]] == world[tree["right"]]) == (op == "same")
    if op == "not":
        return not true(tree["expr"], world)
    parts = true(tree["left"], world), true(tree["right"], world)
    return all(parts) if op == "and" else any(parts)


def test_any_number_of_people(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(60):
        n = rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 10]) if i > 3 else 11
        people = ['A "quoted" name', "op", "back\\slash", *[f"p{k}" for k in range(20)]][: max(2, n)]
        said = [(p, grown(rng, people, rng.randint(0, 4))) for p in people if rng.random() < 0.8 or n < 4]
        rows.append((i, people, [(p, json.dumps(t, indent=rng.choice([None, 2]))) for p, t in said]))
        ok, first = 0, None
        for world in itertools.product([True, False], repeat=len(people)):
            w = dict(zip(people, world))
            if all(true(t, w) == w[p] for p, t in said):
                ok += 1
                first = first or "".join("K" if k else "N" for k in world)
        want[i] = (ok, first)
    df = spark.createDataFrame(rows, KIND).repartition(4)
    assert {r.id: (r.n_solutions, r.pattern) for r in puzzles.solved(df).collect()} == want


def test_sixteen_people(spark):
    """A word for each 64 of 65,536 assignments; a chain has one solution, and its last person decides it."""
    people = [f"p{k}" for k in range(16)]
    said = [(people[k], json.dumps({"op": "same", "left": people[k], "right": people[k + 1]})) for k in range(15)]
    said.append((people[15], json.dumps({"op": "not", "expr": {"op": "person_is", "person": people[0], "value": "knave"}})))
    df = spark.createDataFrame([(1, people, said), (2, people, said[:15]), (3, people, [])], KIND)
    got = {r.id: (r.n_solutions, r.pattern) for r in puzzles.solved(df).collect()}
    # a speaker's "same as the next" makes the next a knight, whoever speaks
    assert got == {1: (1, "K" * 16), 2: (2, "K" * 16), 3: (65536, "K" * 16)}
    table = df.where("id = 1").select(worlds.truth_table(worlds.compiled(F.lit('{"op":"person_is","person":"p15","value":"knave"}'), F.col("people")), F.lit(16)).alias("t")).first().t
    assert len(table) == 1024 and set(table) == {-0x5555555555555556}


def test_faults(spark):
    one = spark.createDataFrame([(1, ["A", "B"])], "id long, people array<string>")
    read = lambda t: one.select(worlds.compiled(F.lit(t), F.col("people")).alias("s")).first().s
    assert read(None) is None
    with pytest.raises(Exception, match="unknown person: C"):
        read('{"op":"person_is","person":"C","value":"knight"}')
    with pytest.raises(Exception, match="not a statement"):
        read('{"op":"xor","left":"A","right":"B"}')
    deep = '{"op":"not","expr":' * 150 + '{"op":"same","left":"A","right":"B"}' + "}" * 150
    assert len(read(deep)) == 151


def test_statements_are_read_once(spark):
    """A puzzle's statements are read in one pass, and none in a lambda; half-formed trees are errors."""
    rows = [(1, ["A", "B"], [("A", '{"op":"same","left":"A","right":"B"}'), ("B", None)]), (2, ["A", "B"], None), (3, ["A"], [])]
    df = spark.createDataFrame(rows, KIND)
    x = df.select("id", worlds.compiled_all(F.col("statements.expr"), F.col("people")).alias("s"))
    assert x._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.id: r.s and [s and [tuple(t) for t in s] for s in r.s] for r in x.collect()} == {1: [[(worlds.SAME, 0, 1)], None], 2: None, 3: []}
    a = '{"op":"person_is","person":"A","value":"knight"}'
    for text in (f'{{"expr":{a},"op":"and","right":{a}}}', f'{{"op":"not","op":"not","expr":{a}}}', f'{{"left":{a},"op":"not"}}', a[:-1], "[]", ""):
        with pytest.raises(Exception, match="not a statement"):
            df.select(worlds.compiled(F.lit(text), F.col("people"))).collect()

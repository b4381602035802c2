"""Replayed draws against Python's generator, and against puzzles and counts that were published with their seeds."""

import functools
import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ponderlake.functions import logic
from ponderlake.functions.twister import Twisters, first_longs, longs, stretch, stretches
from ponderlake.operators import puzzles, replay

#: A balanced set made from seed 20260827, its puzzles' seeds and their statements.
BALANCED = (
    (4778939271783111549, "KKK", (
        "both (Carol is a knight) and (Bob is a knight).", "Bob and Carol are the same type.",
        "it is not true that it is not true that Carol and Bob are the same type.")),
    (7716293532561764648, "KKN", (
        "it is not true that both (Bob and Alice are different types) and (Bob is a knave).",
        "either (Alice and Carol are different types) or (Carol and Bob are the same type).", "Bob is a knave.")),
    (3372933021218688247, "KNK", (
        "it is not true that Bob and Carol are the same type.", "Bob and Carol are the same type.",
        "Carol and Alice are the same type.")),
    (7125982604456595756, "KNN", (
        "Carol is a knave.", "it is not true that Alice is a knight.",
        "it is not true that either (Alice is a knight) or (Carol and Alice are different types).")),
    (4363190866079718726, "NKK", (
        "both (it is not true that Bob and Alice are the same type) and (Bob and Alice are the same type).",
        "either (Alice and Carol are different types) or (Alice is a knight).",
        "it is not true that both (Bob and Carol are different types) and (Alice is a knave).")),
    (4145831385123650664, "NKN", (
        "either (Bob is a knave) or (both (Alice and Bob are the same type) and (Bob and Alice are the same type)).",
        "both (it is not true that Bob and Alice are the same type) and (Alice and Bob are different types).",
        "both (Alice is a knight) and (Bob and Carol are the same type).")),
    (4085558372838289626, "NNK", (
        "Carol and Bob are the same type.", "Carol is a knave.",
        "either (Alice is a knave) or (it is not true that Bob and Alice are the same type).")),
    (613809130830731986, "NNN", (
        "Carol and Alice are different types.", "Alice and Bob are different types.",
        "Alice and Bob are different types.")),
)
#: Sizes and label counts (KKK to NNN) of three splits made from seed 20260829, statements first.
SPLITS = (
    (5000, (591, 621, 674, 603, 597, 633, 628, 653)),
    (500, (60, 73, 52, 63, 60, 63, 65, 64)),
    (1000, (126, 120, 128, 140, 98, 133, 129, 126)),
)
LABELS = ["".join(x) for x in itertools.product("KN", repeat=3)]


def test_draws_are_pythons():
    r = random.Random(5)
    seeds = [0, 1, -7, 2**32 - 1, 2**32, 2**63 - 1, *[r.randrange(2**63) for _ in range(40)]]
    ours, pythons = Twisters(len(seeds)), [random.Random(s) for s in seeds]
    ours.seed(np.arange(len(seeds)), np.array(seeds))
    for k in range(900):
        who = np.array([i for i in range(len(seeds)) if (k * 7 + i * 3) % 5])
        n = (2, 3, 5, 16, 1, 1000)[k % 6]
        if k % 4:
            assert ours.below(n, who).tolist() == [pythons[i].choice(range(n)) for i in who]
        else:
            assert ours.unit(who).tolist() == [pythons[i].random() for i in who]
    ours.seed(np.array([3, 5]), np.array([11, 12]))
    assert ours.unit(np.array([3, 4, 5])).tolist() == [random.Random(11).random(), pythons[4].random(), random.Random(12).random()]
    none = np.zeros(0, dtype=int)
    assert len(ours.below(3, none)) == len(ours.unit(none)) == 0


@pytest.mark.parametrize("seed", [0, 42, 20260829, 2**40 + 1])
def test_stream_of_seeds(seed):
    g, r = longs(seed), random.Random(seed)
    x = np.concatenate([next(g) for _ in range(6)]).tolist()
    assert len(x) > 8000 and x == [r.randrange(0, 2**63) for _ in x]


def test_streams_together():
    seeds = np.array([0, -7, 42, 20260829, 2**40 + 1, 2**63 - 1])
    for n in (0, 1, 155, 700):
        assert first_longs(seeds, n).tolist() == [np.concatenate([next(longs(s)) for _ in range(1)] + [x for _, x in zip(range(9), longs(s))][1:])[:n].tolist() for s in seeds.tolist()]


def test_stretches():
    """Any part of a long stream follows from the states written for it."""
    g = longs(-42)
    x = np.concatenate([next(g) for _ in range(9)])[:40_000]
    for start, end in ((0, 1), (9_000, 30_000), (39_999, 40_000), (5, 5)):
        got = [(pos + np.arange(len(y)), y) for pos, state in stretches(-42, start, end) for y in [stretch(state)]]
        assert sum(((at >= start) & (at < end)).sum() for at, _ in got) == end - start
        assert all((y[at < len(x)] == x[at[at < len(x)]]).all() for at, y in got)


@pytest.mark.parametrize(("people", "depth"), [(2, 0), (2, 2), (3, 0), (3, 1), (3, 2), (4, 1), (6, 0)])
def test_tabled_draws(people, depth):
    """Puzzles read from tables of trees are those drawn word by word, also where a window is too short."""
    names = tuple(f"p{i}" for i in range(people))
    assert replay._Tabled.fits(names, depth)
    w, seeds = replay._Tabled(names, depth), np.concatenate([[0, -7, 2**63 - 1], np.random.default_rng(3).integers(0, 2**63, 900)])
    rows = np.stack([seeds, np.arange(len(seeds))], axis=1)
    drawn = {}
    for part in replay._puzzles(w.world, iter([rows]), "statement", 10_000, 512, 1):
        exprs = [part[f"expr_{p}"] for p in range(people)]
        for i, (_, at) in enumerate(part["rows"].tolist()):
            drawn[at] = (int(w.number(part["trees"][i : i + 1])[0]), int(part["attempts"][i]), part["pattern"][i], [x[i] for x in exprs])
    number, tried = w.draw(seeds, 10_000)
    inside = np.flatnonzero(tried)
    assert 0 < len(inside) and (people, depth) != (3, 2) or 0.9 < len(inside) / len(seeds) < 1
    keys, patterns = w.texts(number[inside])
    for i, key, pattern in zip(inside.tolist(), keys, patterns, strict=True):
        assert (number[i], tried[i], pattern) == drawn[i][:3]
        said = ",".join(f'{{"expr":{x},"speaker":{{"x":"{p}"}}}}' for x, p in zip(drawn[i][3], names, strict=True))
        head = '{"people":[' + ",".join(f'"{p}"' for p in names) + "]}"
        assert key == hashlib.sha256((head + said).encode()).hexdigest()
    with pytest.raises(ValueError, match="no uniquely solvable puzzle in 1 attempts"):
        w.draw(seeds, 1)


def test_tabled_share_of_leaves():
    """Whether a tree is a leaf rests on 53 bits: two words, of which the first may leave it open."""
    w, share = replay._Tabled(replay.PEOPLE, 1), int(replay.STOP * 2**53)
    high, low = share >> 26, share & (1 << 26) - 1
    pairs = [(high, low - 1), (high, low), (high - 1, (1 << 26) - 1), (high + 1, 0)]
    words = np.zeros((227, len(pairs)), dtype=np.uint32)  # zeros after it: all draws fit
    for i, (a, b) in enumerate(pairs):
        words[0, i], words[1, i] = a << 5 | 31, b << 6 | 63
    none = np.zeros(len(pairs), dtype=np.int64)
    number, _ = w._drawn(w._begun(words), len(pairs), np.arange(len(pairs)), none, 1)
    assert (number < w.sizes[0]).tolist() == [(a * 67108864.0 + b) / 9007199254740992.0 < replay.STOP for a, b in pairs] == [True, False, True, False]


def _said(r, names, depth):
    """A tree drawn word by word by Python's generator: canonical JSON."""
    if depth == 0 or r.random() < 0.60:
        op = r.choice(("person_is", "same", "different"))
        if op == "person_is":
            a, b = r.choice(names), r.choice(("knight", "knave"))
            return f'{{"op":"{op}","person":"{a}","value":"{b}"}}'
        a, b = r.sample(names, 2)
        return f'{{"left":"{a}","op":"{op}","right":"{b}"}}'
    op = r.choice(("not", "and", "or"))
    left = _said(r, names, depth - 1)
    return f'{{"expr":{left},"op":"not"}}' if op == "not" else f'{{"left":{left},"op":"{op}","right":{_said(r, names, depth - 1)}}}'


def _walked(wanted, names, depth):
    """Splits as one generator after another makes them, puzzle by puzzle: (split, n, pos, seed, key, pattern, attempts)."""
    masks, seen, out = logic.truth_masks(list(names)), set(), []
    full, n = (1 << (1 << len(names))) - 1, len(names)
    for split, seed, size in wanted:
        stream, pos, have = random.Random(seed), -1, 0
        while have < size:
            pos, one = pos + 1, stream.randrange(0, 2**63)
            r, left, attempts = random.Random(one), 0, 0
            while left.bit_count() != 1:
                left, attempts = full, attempts + 1
                trees = [_said(r, names, depth) for _ in names]
                for p, tree in zip(names, trees, strict=True):
                    left &= ~(logic.analyse(json.loads(tree), list(names))[0] ^ masks[p])
            if tuple(trees) not in seen:
                seen.add(tuple(trees))
                case = left.bit_length() - 1
                said = ",".join(f'{{"expr":{x},"speaker":{{"x":"{p}"}}}}' for x, p in zip(trees, names, strict=True))
                key = hashlib.sha256((json.dumps({"people": names}, separators=(",", ":")) + said).encode()).hexdigest()
                out.append((split, have, pos, one, key, "".join("KN"[case >> n - 1 - p & 1] for p in range(n)), attempts))
                have += 1
    return out


@pytest.mark.parametrize(("names", "depth"), [(replay.PEOPLE, 2), (("Ann", "Bo"), 1), (("Ann", "B-o"), 1)])
def test_splits_walk_on(spark, monkeypatch, names, depth):
    """Splits of a stream of which ever fewer puzzles are new: as drawn one by one, and no seed of a stream is drawn twice."""
    drawn, table = [], replay.exchange.table

    def noted(df, name):
        out = table(df, name)
        if name in ("seeds", "new"):
            drawn.append(out.select("pos"))
        return out

    monkeypatch.setattr(replay.exchange, "table", noted)
    wanted = [(0, 11, 400), (1, 12, 150)]
    got = replay.splits(spark.createDataFrame(wanted, "split long, seed long, size long"), people=names, depth=depth, statements=False)
    assert sorted(map(tuple, got.collect())) == _walked(wanted, names, depth)
    drawn.clear()
    replay.splits(spark.createDataFrame(wanted[:1], "split long, seed long, size long"), people=names, depth=depth, statements=False)
    rounds = functools.reduce(lambda a, b: a.unionByName(b), drawn)
    assert rounds.distinct().count() == rounds.count() and (depth == 2 or len(drawn) > 1)


def test_candidates_carry_no_texts(spark, tmp_path, monkeypatch):
    """What the operators write is keys and numbers: no statement of a candidate goes through a shuffle or a table."""
    written = []
    table = replay.exchange.table
    monkeypatch.setattr(replay.exchange, "table", lambda df, name: written.append((name, df.columns)) or table(df, name))
    wanted = spark.createDataFrame([(0, 5, 40), (1, 6, 30)], "split long, seed long, size long")
    got = replay.splits(wanted, statements=False)
    assert got.count() == 70 and "statements" not in got.columns and not any("statements" in c for _, c in written)
    texts = replay.splits(wanted)
    assert texts.drop("statements").exceptAll(got).count() == 0 and texts.count() == 70
    assert replay.balanced(wanted.select("split", "seed")).count() == 16
    assert all(name == "balanced" for name, c in written if "statements" in c)


def test_stored_puzzles(spark):
    df = spark.createDataFrame([(s, "kept out") for s, *_ in BALANCED] + [(None, "null"), (BALANCED[0][0], "again")], "seed long, text string")
    rows = {r.seed: r for r in replay.puzzles(df, "label").collect()}
    assert {s: (r.pattern, tuple(x.text for x in r.statements)) for s, r in rows.items()} == {s: (p, t) for s, p, t in BALANCED}


def test_balanced_set(spark):
    """The whole set follows from one seed; a second one beside it changes nothing."""
    wanted = spark.createDataFrame([(7, 20260827), (8, 1), (None, 3), (9, None)], "split long, seed long")
    rows = replay.balanced(wanted).orderBy("split", "n").collect()
    assert [(r.seed, r.pattern, tuple(x.text for x in r.statements)) for r in rows[:8]] == list(BALANCED)
    assert [(r.split, r.n, r.pattern) for r in rows] == [(s, n, p) for s in (7, 8) for n, p in enumerate(LABELS)]
    with pytest.raises(ValueError):
        replay.balanced(spark.createDataFrame([(1, 2), (1, 3)], "split long, seed long"))
    assert replay.balanced(wanted.limit(0)).count() == 0


def test_published_splits(spark):
    """Label counts of all 6500 puzzles; no key twice; each puzzle has exactly the one solution it names."""
    rows = [(i, 20260829 + i * 1_000_003, size) for i, (size, _) in enumerate(SPLITS)]
    wanted = spark.createDataFrame([*rows, (3, 5, 0), (4, 5, None)], "split long, seed long, size long")
    got = replay.splits(wanted)
    counts = {(r.split, r.pattern): r["count"] for r in got.groupBy("split", "pattern").count().collect()}
    assert counts == {(i, p): c for i, (_, cs) in enumerate(SPLITS) for p, c in zip(LABELS, cs, strict=True)}
    assert got.select("key").distinct().count() == 6500
    assert got.groupBy("split").agg(F.max("n") + 1).rdd.collectAsMap() == {i: n for i, (n, _) in enumerate(SPLITS)}
    people = F.array(*[F.lit(p) for p in replay.PEOPLE])
    said = F.transform("statements", lambda s: F.struct(s["speaker"].alias("speaker"), s["expr"].alias("expr")))
    solved = puzzles.solved(got.select("key", F.col("pattern").alias("told"), people.alias("people"), said.alias("statements")))
    assert solved.where((F.col("n_solutions") != 1) | (F.col("pattern") != F.col("told"))).count() == 0
    assert replay.splits(wanted.where("size <= 0 OR size IS NULL")).count() == 0


@pytest.mark.parametrize("people", [2, 5, 8])
@pytest.mark.parametrize("kind", ["statement", "label"])
def test_more_people(spark, people, kind):
    names = tuple(['Q"uote', "back\\slash", *[f"p{i}" for i in range(2, people)]])
    got = replay.puzzles(spark.range(24).withColumnRenamed("id", "seed"), kind, names, 3)
    said = F.transform("statements", lambda s: F.struct(s["speaker"].alias("speaker"), s["expr"].alias("expr")))
    solved = puzzles.solved(got.select("seed", F.col("pattern").alias("told"), "people", said.alias("statements"))).collect()
    assert sorted(r.seed for r in solved) == list(range(24))
    assert all(r.n_solutions == 1 and r.pattern == r.told for r in solved)


def test_refused(spark):
    seeds = spark.range(3).withColumnRenamed("id", "seed")
    for kind, names in (("other", replay.PEOPLE), ("label", ("a",)), ("label", ("a", "a"))):
        with pytest.raises(ValueError):
            replay.puzzles(seeds, kind, names)
    with pytest.raises(Exception, match="no uniquely solvable puzzle in 1 attempts for seed"):
        replay.puzzles(seeds, attempts=1).collect()
    assert replay.puzzles(seeds.limit(0)).count() == 0

"""The trie of conversations and their repair against plain Python, on conversations with every awkward case."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest
from test_llm_operators import table

from ponderlake.llm import conversation_repair, conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string, depth string, cost string, copies string, audit string, x string"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def turn_digest(role: str, text: str) -> str:
    return sha(f"{len(role)}:{role}:{text}")


def conversations() -> list[tuple]:
    rng = random.Random(3)
    texts = ["One two.", "Three?", "four five six", "", " \t", "Seven!", "Ünï cödé.", "word " * 30000 + "end.", "a.b!c?", "x\ny \n"]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c, t, rng.choice(roles[:3]), rng.choice(texts[:4])) for c in range(70) if c not in (20, 33) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Same {t}.") for c in (100, 101, 102, 103, 121, 141) for t in range(4)]
    rows += [(200, t, rng.choice(roles), rng.choice(texts)) for t in range(150)]  # crosses borders between partitions
    rows += [(201 + c, rng.choice([None, 0, 5, 9]), rng.choice(roles), rng.choice([*texts, None])) for c in range(9) for _ in range(4)]
    rows += [(-7, 0, "user", "Below."), (-20, 0, "user", "Zero."), (None, 0, "user", "nobody's."), (None, None, None, None)]
    return [*rows, *rows[:3], (220, 0, "user", "only.")]


@pytest.fixture(scope="module")
def rows():
    return conversations()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA).repartition(3)


def in_order(rows, of):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, turn_digest(*of(r))))


def brute_trie(rows):
    full = lambda r: (r[2] or "", r[3] or "")
    own = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    own = {c: [full(r) for r in in_order(x, full)] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + x[h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    children = collections.defaultdict(set)
    for n in members:
        if n:
            children[n[:-1]].add(n)
    saved, leaves = collections.Counter(), collections.Counter()
    for n in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(members[n]) - 1) * words
            leaves[n[:d]] += not children[n]
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children[n]), leaves[n], saved[n], sha(",".join(map(str, ends[n]))))
        for n, m in members.items()
    )


def test_trie(frame, rows):
    out = conversation_trie.prefix_trie(frame)
    cols = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert out.columns == cols
    assert sorted(tuple(r) for r in out.collect()) == brute_trie(rows)


def test_trie_does_not_depend_on_partitions(spark, frame):
    few = sorted(map(tuple, conversation_trie.prefix_trie(frame).collect()))
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        many = sorted(map(tuple, conversation_trie.prefix_trie(frame.repartition(11)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert few == many


def test_empty(frame):
    for f in (conversation_trie.prefix_trie, conversation_repair.repair):
        assert f(frame.limit(0)).collect() == []


def damaged(rows):
    out = []
    for r in rows:
        c, t, role, text = (" " if v is None else v for v in r[:4])
        code = zlib.crc32(f"{c}:{t}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(r[0], r[1], "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def cheapest(kinds):
    """Least (cost, audit) with the roles it leaves: shortest paths over (row, place), strings and all."""
    start = (0, "", 0, "", ())
    heap, seen = [start], set()
    while heap:
        cost, audit, i, last, roles = heapq.heappop(heap)
        if i == len(kinds) and last in ("", "a"):
            return cost, audit, roles
        if (i, last) in seen:
            continue
        seen.add((i, last))
        add = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", i, add, (*roles, (add, None))))
        if i < len(kinds):
            must, late, r = kinds[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, roles))
            if not must:
                late = 3 * late
                heapq.heappush(heap, (cost + 3 + late, audit + "R", i + 1, add, (*roles, (add, i))))
                if (r == "s" and last == "") or (r in ("u", "a") and r == add):
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, r, (*roles, ("keep", i))))
    raise AssertionError


def brute_repair(rows):
    out = []
    for c in {r[0] for r in rows}:
        mine = in_order([r for r in damaged(rows) if r[0] == c], lambda r: (r[2], r[3]))
        seen, kinds, faults = set(), [], collections.Counter()
        for _, _, role, text in mine:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            kinds.append((fault in ("blank", "duplicate"), fault == "truncated", role[:1]))
        cost, audit, roles = cheapest(kinds)
        named = {"u": "user", "a": "assistant"}
        lines = [f"{mine[i][2] if r == 'keep' else named[r]}:{'' if i is None else mine[i][3]}" for r, i in roles]
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2] + b[2] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
        out.append((c, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


def test_repair(frame, rows):
    out = conversation_repair.repair(frame)
    assert out.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_repair(rows)


def test_determinised_automaton():
    """Every short conversation of all kinds of rows, and few states."""
    machine, rng = conversation_repair.Determinised(), random.Random(1)
    for n in range(9):
        for _ in range(150):
            kinds = [rng.randrange(conversation_repair.KINDS) for _ in range(n)]
            plain = [(k == 0, k > 0 and (k - 1) % 2 == 1, conversation_repair.ROLES[(k - 1) // 2] if k else "x") for k in kinds]
            assert machine.repair(bytes(kinds)) == cheapest(plain)[:2]
    cost, audit = machine.repair(bytes(rng.randrange(1, 3) for _ in range(200_000)))
    assert len(audit) >= 200_000 and cost > 0 and len(machine.vectors) < 100


def test_columns_may_be_few(spark):
    one = spark.createDataFrame([(5, 0, "user", "Hi there.")], "conv_id int, turn int, role string, text string")
    assert [r.depth for r in conversation_trie.prefix_trie(one).orderBy("depth").collect()][:1] == [0]
    assert table(conversation_repair.repair(one).select("conv_id", "cost"), "conv_id")

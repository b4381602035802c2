"""Repair of the structure of conversations by lazy weighted determinisation.

Allowed are the role initials ``(s?(ua)+)?``.  Edits of rows: Keep (0), Rerole to user or assistant (3), Delete (4), Insert an
empty row of user or assistant anywhere (3); a truncated row that isn't deleted adds 3; blank rows and duplicates must go.

The automaton has four places: nothing yet, after s, after u, after a.  The least costs from each place to the end, less the
least of them, are one vector; few vectors occur, so a vector becomes a state of a deterministic automaton as soon as it is
met, and its way on by each kind of row an entry of a transition table.

1. The scan reads a conversation's kinds of rows from the end, one look into the table for each: its cost.
2. The trace follows tight arcs back along the scan, from the first row on, and takes the least letter where several are
   tight.  What it does at a row depends on the state, the kind of row and the place: cached as well.
3. The edits meet the texts again in a second pass, which streams them into the hash of the repaired conversation.

A task holds a byte and a state for each row of a conversation, never its texts.  One hash over all of a conversation is
defined from front to back, so one task streams it.

Defined results: null ids, turns, roles and texts read as one space where they are written out, null turns come first, rows
without conv_id are one conversation; rows of equal turn are taken in order of the SHA-256 of their damaged role and text,
so that copies are adjacent; roles whose first character isn't s, u or a (an empty role, too) can't be kept; initials are
case-sensitive; the first fault of a row counts, in the order blank, duplicate, truncated; a conversation without rows after
damage has zeros, an empty audit and the hash of nothing; an empty table gives an empty result; columns besides conv_id,
turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .conversation_trie import crc32_sql, digest

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Places: nothing yet, after s, after u, after a.  Where a rerole or an insert leads from each; where a kept row of each role leads.
NOTHING, S, U, A = range(4)
_ADDED = (U, U, A, U)
_KEPT = {"u": (U, U, None, U), "a": (None, None, A, None), "s": (S, None, None, None), "": (None,) * 4}
#: Roles of kinds of rows: kind 0 must go, 1 + 2 * role is whole, 2 + 2 * role truncated.
ROLES = ("u", "a", "s", "")
KINDS = 1 + 2 * len(ROLES)
_FAR = 1 << 30


class Determinised:
    """The automaton so far: vectors as states, transitions and traces as they are first needed."""

    def __init__(self):
        end = self._closed([0, _FAR, _FAR, 0])
        self.vectors, self.number = [end], {end: 0}
        self.next: list[list[int]] = [[-1] * KINDS]
        self.added: list[list[int]] = [[0] * KINDS]
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}

    @staticmethod
    def _closed(v: list[int]) -> tuple[int, ...]:
        for _ in range(4):  # from a place to the farthest one by inserts
            v = [min(v[p], INSERT + v[_ADDED[p]]) for p in range(4)]
        return tuple(v)

    @staticmethod
    def _edits(kind: int, p: int) -> list[tuple[str, int, int]]:
        """Edits of a row of a kind at a place: letter, cost, place after it; letters ascend."""
        out = [("D", DELETE, p)]
        if kind:
            late = TRUNCATED * ((kind - 1) % 2)
            kept = _KEPT[ROLES[(kind - 1) // 2]][p]
            if kept is not None:
                out.append(("K", late, kept))
            out.append(("R", REROLE + late, _ADDED[p]))
        return out

    def _ahead(self, state: int, kind: int) -> tuple[int, ...]:
        v = self.vectors[state]
        return self._closed([min(c + v[q] for _, c, q in self._edits(kind, p)) for p in range(4)])

    def step(self, state: int, kind: int) -> int:
        """The state before a row, from the one after it."""
        v = self._ahead(state, kind)
        least = min(v)
        v = tuple(x - least for x in v)
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
            self.next.append([-1] * KINDS)
            self.added.append([0] * KINDS)
        self.next[state][kind], self.added[state][kind] = self.number[v], least
        return self.number[v]

    def trace(self, state: int, kind: int, p: int) -> tuple[str, int]:
        """Least letters of tight arcs that take a row, from the state after it; and the place reached."""
        if (got := self.traces.get((state, kind, p))) is None:
            v, after, letters, q = self._ahead(state, kind), self.vectors[state], "", p
            while True:
                tight = [(e, to) for e, c, to in self._edits(kind, q) if v[q] == c + after[to]]
                if v[q] == INSERT + v[_ADDED[q]]:
                    tight.append(("I", _ADDED[q]))
                e, q = min(tight)
                letters += e
                if e != "I":
                    break
            got = self.traces[state, kind, p] = letters, q
        return got

    def repair(self, kinds: bytes) -> tuple[int, str]:
        """Cost and audit of a conversation."""
        state, cost, states, nxt, added = 0, 0, [], self.next, self.added
        for kind in reversed(kinds):
            states.append(state)
            to = nxt[state][kind]
            if to < 0:
                to = self.step(state, kind)
            cost += added[state][kind]
            state = to
        cost += self.vectors[state][NOTHING]
        p, out = NOTHING, []
        for kind in kinds:
            letters, p = self.trace(states.pop(), kind, p)
            out.append(letters)
        while p in (S, U):
            out.append("I")
            p = _ADDED[p]
        return cost, "".join(out)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage; ``copies`` tells rows that stand twice."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), code.alias("code"))
    return rows.where("code <> 0").select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("code") == 3, 2).otherwise(1).alias("copies")
    )


def _last_mark(text: Column) -> Column:
    """The last character that isn't white space, null if there is none."""
    bare = F.rtrim(F.translate(text, "\t\n\v\f\r", "     "))
    return F.when(bare != "", F.substring(bare, -1, 1))


def kinds(rows: DataFrame) -> DataFrame:
    """conv_id, turn, x (digest), fault, role (initial), each row once for each copy."""
    mark = _last_mark(F.col("text"))
    seen = rows.select(
        "conv_id", "turn", digest(F.col("role"), F.col("text")).alias("x"), F.substring("role", 1, 1).alias("role"),
        F.when(mark.isNull(), 1).when(~mark.isin(".", "!", "?"), 3).otherwise(0).alias("own"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    before = F.row_number().over(Window.partitionBy("conv_id", "x").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("own") == 1, 1).when(F.col("n") > 1, 2).otherwise(F.col("own"))
    return seen.withColumn("n", before).select("conv_id", "turn", "x", fault.alias("fault"), "role")


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine, done, now = Determinised(), [], None
    roles = {r: i for i, r in enumerate(ROLES)}

    def finish() -> None:
        cost, audit = machine.repair(bytes(now["kinds"]))
        gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
        done.append((now["id"], gaps, *now["faults"][1:], now["illegal"], cost, audit))

    def out() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True))
        done.clear()
        kinds = [pa.int64()] * 7 + [pa.string()]
        names = [c.split()[0] for c in _REPORT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "fault", "role"))
        for conv, turn, fault, role in zip(*columns, strict=True):
            if now is None or conv != now["id"]:
                if now is not None:
                    finish()
                now = {"id": conv, "kinds": bytearray(), "faults": [0] * 4, "illegal": 0, "turns": 0, "role": None}
            if turn is not None:
                if not now["turns"]:
                    now["low"] = now["high"] = turn
                    now["turns"] = 1
                elif turn != now["high"]:
                    now["high"] = turn
                    now["turns"] += 1
            now["faults"][fault] += 1
            if now["role"] is not None and (now["role"], role) not in _LEGAL:
                now["illegal"] += 1
            now["role"] = role
            now["kinds"].append(0 if fault in (1, 2) else 1 + 2 * roles.get(role, 3) + (fault == 3))
        if len(done) > 1024:
            yield out()
    if now is not None:
        finish()
        yield out()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams each conversation's audit and then its rows into the hash of the repaired one."""
    done, conv, sha, audit, at, place, first = [], None, None, "", 0, NOTHING, True

    def put(role: str, text: str) -> None:
        nonlocal first
        sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
        first = False

    def added() -> str:
        nonlocal place
        place = _ADDED[place]
        return "user" if place == U else "assistant"

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put(added(), "")
            at += 1

    def finish() -> None:
        inserts()
        done.append((conv, sha.hexdigest()))

    def out() -> pa.RecordBatch:
        ids, hashes = zip(*done, strict=True)
        done.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"]
        )

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit"))
        for c, role, text, edits in zip(*columns, strict=True):
            if edits is not None:  # the row that comes before a conversation's own
                if sha is not None:
                    finish()
                conv, sha, audit, at, place, first = c, hashlib.sha256(), edits, 0, NOTHING, True
                continue
            inserts()
            edit = audit[at]
            at += 1
            if edit == "K":
                place = _KEPT[role[:1]][place]
                put(role, text)
            elif edit == "R":
                put(added(), text)
        if len(done) > 1024:
            yield out()
    if sha is not None:
        finish()
        yield out()


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the repaired form; a table in the shared folder.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    shared.prepare(conversations.sparkSession)
    with shared.scratch() as keep:
        rows = conversations.withColumn("conv_id", F.col("conv_id").cast("long"))
        damaged = damage(rows)
        by = [F.col("turn").asc_nulls_first(), F.col("x")]
        found = kinds(damaged).repartition("conv_id").sortWithinPartitions("conv_id", *by)
        found = found.select("conv_id", F.col("turn").cast("long"), "fault", "role").mapInArrow(_report, _REPORT)
        found = shared.table(found, "reports")
        x = digest(F.col("role"), F.col("text")).alias("x")
        copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
        texts = damaged.select("conv_id", F.lit(1).alias("kind"), "turn", x, "role", "text", copies.alias("copy"))
        texts = texts.withColumn("audit", F.lit(None).cast("string")).drop("copy")
        turn = F.lit(None).cast(texts.schema["turn"].dataType).alias("turn")
        none = [F.lit(None).cast("string").alias(c) for c in ("x", "role", "text")]
        both = found.select("conv_id", F.lit(0).alias("kind"), turn, *none, "audit").unionByName(texts)
        both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *by)
        hashes = both.select("conv_id", "role", "text", "audit").mapInArrow(
            _repaired, "conv_id long, repaired_sha256 string"
        )
        every = rows.select("conv_id").distinct()
        hashes = hashes.withColumnRenamed("conv_id", "id")
        found = found.withColumnRenamed("conv_id", "of")
        joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").join(
            hashes, F.col("conv_id").eqNullSafe(F.col("id")), "left"
        )
        numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        nothing = F.lit(hashlib.sha256().hexdigest())
        return keep(shared.table(joined.select(
            "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
        ), "repaired"))


def _add(x: str, cost: str, letter: str) -> str:
    return f"lpad(CAST(CAST(substr({x}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{letter}'"


def _oracle() -> str:
    """Least (cost, audit) of each place after each row, one string each, so that the least string wins."""
    white = r"\x20\x09-\x0D"
    kept = {"u": [("u", p) for p in "nsa"], "a": [("a", "u")], "s": [("s", "n")]}
    rerole = [("u", "n"), ("u", "s"), ("u", "a"), ("a", "u")]
    after = {p: [_add(p, "4", "D")] for p in "nsua"}
    for role, ways in kept.items():
        for to, p in ways:
            after[to].append(f"CASE WHEN NOT must AND r = '{role}' THEN {_add(p, 'late', 'K')} END")
    for to, p in rerole:
        after[to].append(f"CASE WHEN NOT must THEN {_add(p, '3 + late', 'R')} END")
    step = ", ".join(f"least({', '.join(after[p])}{', NULL' * (len(after[p]) == 1)}) AS {p}" for p in "nsua")
    closed = "SELECT ck, i, n, s, u, least(a, " + _add("u", "3", "I") + ") AS a FROM (SELECT ck, i, n, s, a, least(u, " + (
        ", ".join(_add(p, "3", "I") for p in "nsa")
    ) + ") AS u FROM dp)"
    return rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') AS ck, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
 {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS code FROM conversations),
dam AS (SELECT ck, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
 FROM raw, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS c(copy) WHERE code <> 0),
dig AS (SELECT *, sha256(concat_ws(':', CAST(length(role) AS VARCHAR), role, text)) AS x FROM dam),
seen AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, x, copy) AS i, row_number() OVER (PARTITION BY ck, x ORDER BY turn NULLS FIRST, copy) AS nth FROM dig),
o AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{white}]') THEN 1 WHEN nth > 1 THEN 2
 WHEN regexp_extract(text, '([^{white}])[{white}]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, substr(role, 1, 1) AS r,
 lag(substr(role, 1, 1)) OVER (PARTITION BY ck ORDER BY i) || substr(role, 1, 1) AS pair FROM seen),
st AS (SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
 count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows FROM o GROUP BY ck),
dp AS (SELECT ck, CAST(0 AS BIGINT) AS i, '000000000' AS n, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM st
 UNION ALL SELECT ck, i, {step} FROM (SELECT c.ck, o.i, n, s, u, a, r, fault IN (1, 2) AS must, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS late FROM ({closed}) c JOIN o ON o.ck = c.ck AND o.i = c.i + 1)),
best AS (SELECT ck, least(n, a) AS v FROM ({closed}) JOIN st USING (ck) WHERE i = rows),
au AS (SELECT ck, CAST(substr(v, 1, 9) AS BIGINT) AS cost, substr(v, 10) AS audit FROM best),
le AS (SELECT ck, k, substr(audit, k, 1) AS l FROM au, unnest(range(1, length(audit) + 1)) AS t(k)),
lr AS (SELECT *, count(*) FILTER (l <> 'I') OVER w AS i, count(*) FILTER (l <> 'D') OVER w AS j FROM le WINDOW w AS (PARTITION BY ck ORDER BY k)),
rw AS (SELECT lr.*, o.role, o.text, max(CASE WHEN j = 1 AND l = 'K' AND o.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY lr.ck) AS shift FROM lr LEFT JOIN o ON o.ck = lr.ck AND o.i = lr.i AND l <> 'I' WHERE l <> 'D'),
rp AS (SELECT ck, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (j - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha FROM rw GROUP BY ck)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS ck FROM conversations) c LEFT JOIN st USING (ck) LEFT JOIN au USING (ck) LEFT JOIN rp USING (ck)
"""


ORACLE = _oracle()

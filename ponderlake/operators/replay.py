"""Puzzles replayed from their seeds: the same draws in the same order as a Mersenne Twister gives them, so that stored seeds of
earlier data sets yield their puzzles again.  ``generation`` draws by digests instead, which any engine follows.

Some thousand seeds are drawn in lockstep in numpy: trees are arrays over (seed, place in the tree), truth tables 64-bit words
over assignments; a seed whose puzzle is found makes room for the next.  Seeds are spread over tasks by their hash.  The seeds of
a set follow from one stream, which has no shortcut: one task a set writes it, 8 bytes a puzzle.  For splits it writes the
stream's state at every 8,192 numbers or so, from which all tasks go on.  Where there are few trees (three people), the candidates of splits are
read from a table of the tree that begins at each word, and move as numbers.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logic
from ..functions.text import PATTERNS
from ..functions.twister import STRETCH, Twisters, first_longs, first_words, longs, stretch, stretches
from ..sources import exchange
from .positions import numbered
from .puzzles import PEOPLE

#: Operators in the order in which they are drawn, types likewise, share of nodes without an operator, and how
#: often a statement is drawn that must agree with the answer.
LEAVES, INNER, TYPES = ("person_is", "same", "different"), ("not", "and", "or"), ("knight", "knave")
STOP = 0.60
REDRAWS = 500
_NONE, _IS, _SAME, _DIFFERENT, _NOT, _AND, _OR = range(-1, 6)
#: Words of truth tables that the seeds drawn at once may hold for one node of a tree.
_BLOCK = 4096
#: Streams of at most so many seeds are written together, so many at a time.
_SHORT, _TOGETHER = 4096, 256
#: Trees that may be tabled, seeds whose words are tabled at once, and what stands for a word beyond those tabled.
_FEW, _WIDTH, _BEYOND = 1 << 20, 8192, 255


class _World:
    """Truth tables and texts over some people; a tree's places are numbered parent first, then left, then right."""

    def __init__(self, people: tuple[str, ...], depth: int):
        self.people, self.depth, n = people, depth, len(people)
        self.levels = self._levels(depth)
        self.leaves: dict[tuple[int, int, int], tuple[str, str]] = {}
        cases = np.arange(1 << n)
        knights = (cases[None] >> np.arange(n - 1, -1, -1)[:, None]) & 1 == 0
        pad = np.zeros((n, max(64, 1 << n)), dtype=bool)
        pad[:, : 1 << n] = knights
        self.knights = np.packbits(pad, axis=1, bitorder="little").view("<u8")
        self.valid = np.uint64((1 << min(64, 1 << n)) - 1)

    @staticmethod
    def _levels(depth: int, level: int = 0) -> list[int]:
        below = [] if level == depth else _World._levels(depth, level + 1)
        return [level, *below, *below]

    def parts(self, i: int) -> tuple[int, int]:
        return i + 1, i + (1 << (self.depth - self.levels[i]))

    def draw(self, t: Twisters, who: np.ndarray) -> np.ndarray:
        """A tree for each column named: (columns, places, [what, first, second]); a place outside the tree is -1."""
        n = len(self.people)
        tree = np.full((len(who), len(self.levels), 3), _NONE, dtype=np.int8)
        wanted = np.zeros((len(who), len(self.levels)), dtype=bool)
        wanted[:, 0] = True
        for i, level in enumerate(self.levels):
            here = np.flatnonzero(wanted[:, i])
            leaf = np.ones(len(here), dtype=bool)
            if level < self.depth:
                leaf = t.unit(who[here]) < STOP
                inner = here[~leaf]
                tree[inner, i, 0] = _NOT + t.below(len(INNER), who[inner])
                left, right = self.parts(i)
                wanted[inner, left] = True
                wanted[inner, right] = tree[inner, i, 0] != _NOT
            here = here[leaf]
            tree[here, i, 0] = t.below(len(LEAVES), who[here])
            one, two = here[tree[here, i, 0] == _IS], here[tree[here, i, 0] != _IS]
            tree[one, i, 1] = t.below(n, who[one])
            tree[one, i, 2] = t.below(len(TYPES), who[one])
            # two people without repetition: the last takes the place of the first drawn
            a, b = t.below(n, who[two]), t.below(n - 1, who[two])
            tree[two, i, 1], tree[two, i, 2] = a, np.where(b == a, n - 1, b)
        return tree

    def truth(self, tree: np.ndarray) -> np.ndarray:
        """Words of the root's truth table: (columns, words)."""
        table: dict[int, np.ndarray] = {}
        for i in reversed(range(len(self.levels))):
            what, a, b = tree[:, i, 0, None], self.knights[tree[:, i, 1]], self.knights[tree[:, i, 2]]
            x = np.where(what == _IS, np.where(tree[:, i, 2, None] == 0, a, ~a), np.where(what == _SAME, ~(a ^ b), a ^ b))
            if self.levels[i] < self.depth:
                left, right = (table.pop(j) for j in self.parts(i))
                both = np.where(what == _AND, left & right, left | right)
                x = np.where(what < _NOT, x, np.where(what == _NOT, ~left, both))
            table[i] = x
        return table[0] & self.valid

    def texts(self, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Canonical JSON and sentence of each tree."""
        said: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i in reversed(range(len(self.levels))):
            out = np.full((2, len(tree)), "", dtype=object)
            inner = tree[:, i, 0] >= _NOT
            for k in np.flatnonzero((tree[:, i, 0] >= 0) & ~inner):
                out[:, k] = self._leaf(*tree[k, i].tolist())
            if inner.any():
                left, right = (said.pop(j) for j in self.parts(i))
                for code, op in zip((_NOT, _AND, _OR), INNER, strict=True):
                    at = np.flatnonzero(tree[:, i, 0] == code)
                    for k in at:
                        out[:, k] = self._inner(op, left[:, k], right[:, k])
            said[i] = out
        return said[0]

    def _leaf(self, what: int, a: int, b: int) -> tuple[str, str]:
        if (what, a, b) not in self.leaves:
            self.leaves[what, a, b] = self._written(what, a, b)
        return self.leaves[what, a, b]

    def _written(self, what: int, a: int, b: int) -> tuple[str, str]:
        op, first = LEAVES[what], self.people[a]
        second = TYPES[b] if what == _IS else self.people[b]
        names = ("person", "value") if what == _IS else ("left", "right")
        tree = {"op": op, names[0]: first, names[1]: second}
        return json.dumps(tree, sort_keys=True, separators=(",", ":")), logic.SENTENCES[op].format(first, second)

    @staticmethod
    def _inner(op: str, left: np.ndarray, right: np.ndarray) -> tuple[str, str]:
        expr = f'{{"expr":{left[0]},"op":"not"}}' if op == "not" else f'{{"left":{left[0]},"op":"{op}","right":{right[0]}}}'
        return expr, logic.SENTENCES[op].format(left[1], right[1])

    def holds(self, table: np.ndarray, case: np.ndarray) -> np.ndarray:
        word = table[np.arange(len(table)), case >> 6]
        return (word >> (case & 63).astype(np.uint64)) & np.uint64(1) == 1


class _Tabled:
    """Trees by number (leaves, then not, and, or of trees one level lower), a puzzle by the numbers of its trees in a row."""

    def __init__(self, people: tuple[str, ...], depth: int):
        self.people, self.depth, self.world, n = people, depth, _World(people, depth), len(people)
        self.sizes, self.bits = self._sizes(n, depth)
        kind = np.min_scalar_type((1 << (1 << n)) - 1)
        self.knights, self.valid = self.world.knights[:, 0].astype(kind), self.world.valid.astype(kind)
        leaves = [self._leaf(i) for i in range(self.sizes[0])]
        meaning = {_IS: lambda a, b: ~a if b else a, _SAME: lambda a, b: ~(a ^ self.knights[b]), _DIFFERENT: lambda a, b: a ^ self.knights[b]}
        first = np.array([meaning[what](self.knights[a], b) for what, a, b in leaves], dtype=kind)
        self.truth = first
        for _ in range(depth):
            x = self.truth
            self.truth = np.concatenate([first, ~x, (x[:, None] & x).ravel(), (x[:, None] | x).ravel()])
        self.marks = np.array(["".join("KN"[c >> n - 1 - p & 1] for p in range(n)) for c in range(1 << n)], dtype=object)
        begin, end = self._pieces([self.world._leaf(*x) for x in leaves])
        self.head = json.dumps({"people": people}, separators=(",", ":")).encode()
        self.begin = np.array([f'{{"expr":{x}'.encode() for x in begin], dtype=object)
        speakers = [f',"speaker":{{"x":"{p}"}}}}' + ("," if p != people[-1] else "") for p in people]
        self.end = [np.array([(x + speaker).encode() for x in end], dtype=object) for speaker in speakers]

    @staticmethod
    def _sizes(n: int, depth: int) -> tuple[list[int], int]:
        sizes = [2 * n + 2 * n * (n - 1)]
        for _ in range(depth):
            sizes.append(sizes[0] + sizes[-1] + 2 * sizes[-1] ** 2)
        return sizes, (sizes[-1] - 1).bit_length()

    @staticmethod
    def fits(people: tuple[str, ...], depth: int) -> bool:
        """Few trees, a puzzle's number in 63 bits, and names that canonical JSON leaves as they are."""
        n = len(people)
        if not 2 <= n <= 6 or depth > 3 or len(set(people)) < n or not all(p.isascii() and p.isalnum() for p in people):
            return False
        sizes, bits = _Tabled._sizes(n, depth)
        return sizes[-1] <= _FEW and n * bits <= 63

    def _leaf(self, i: int) -> tuple[int, int, int]:
        n = len(self.people)
        if i < 2 * n:
            return _IS, i // 2, i % 2
        what, i = divmod(i - 2 * n, n * (n - 1))
        a, b = divmod(i, n - 1)
        return (_SAME, _DIFFERENT)[what], a, n - 1 if b == a else b

    def _begun(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word and seed, flat: whether a tree that begins there is a leaf; the leaf, and the inner operator, drawn from there.

        Both are numbers times 256 and the word after it, ``_BEYOND`` if not there.  From the last word to the first, a row of
        seeds at a time: a digit that doesn't fit gives what the next word gives.
        """
        (k, width), n, u = words.shape, len(self.people), np.uint16
        leaf, inner = (np.full((260, width), _BEYOND, dtype=u) for _ in range(2))
        stop = np.zeros((260, width), dtype=bool)
        line = np.full(width, _BEYOND, dtype=u)
        number = {m: line.copy() for m in (2, n - 1)}
        about = {m: line.copy() for m in (2, n - 1)} if n != 3 else {2: line.copy()}
        share, eight = int(STOP * 2**53), u(256)
        high, low = np.uint32(share >> 26 << 5), np.uint32(share & (1 << 26) - 1)

        def put(old: np.ndarray, new: np.ndarray, bits: np.ndarray, out: np.ndarray) -> None:
            x = old ^ new  # several times as fast as where
            x &= bits
            np.bitwise_xor(new, x, out=out)

        for p in range(k - 1, -1, -1):
            top = (words[p] >> np.uint32(24)).astype(u)
            digits = {m: top >> u(8 - m.bit_length()) for m in {2, 3, n - 1, n}}
            again = {m: (d >= m) * u(0xFFFF) for m, d in digits.items()}
            what, who = digits[3], digits[n]
            two = about[n - 1] + (what - u(1)) * u(256 * n * (n - 1) & 0xFFFF) + u(512 * n)
            put(about[2], two, (what == 0) * u(0xFFFF), two)
            put(leaf[p + 1], two, again[3], leaf[p])
            put(inner[p + 1], what * eight + u(p + 1), again[3], inner[p])
            for m, x in about.items():
                put(x, number[m] + who * u(256 * m), again[n], x)
            for m, x in number.items():
                put(x, digits[m] * eight + u(p + 1), again[m], x)
            # numbers of 53 bits below the share: nearly always the first word's 27 bits tell
            np.less(words[p], high, out=stop[p])
            near = (words[p] ^ high) < 32
            if p + 1 < k and near.any():
                stop[p] |= near & (words[p + 1] >> np.uint32(6) < low)
        return stop.ravel(), leaf.ravel(), inner.ravel()

    def _drawn(self, begun: tuple[np.ndarray, ...], width: int, who: np.ndarray, at: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the tree that begins at a word of each seed named, and the word after it."""
        stop, leaf, inner = begun
        if height == 0:
            x = leaf[at * width + who].astype(np.int64)
            return x >> 8, x & 255
        small, size = self.sizes[0], self.sizes[height - 1]
        place = at * width + who
        x = leaf[place + 2 * width].astype(np.int64)
        number, end = x >> 8, x & 255
        rest = np.flatnonzero(~stop[place])
        x = inner[place[rest] + 2 * width].astype(np.int64)
        what = x >> 8
        left, after = self._drawn(begun, width, who[rest], x & 255, height - 1)
        both = np.flatnonzero(what)
        right, after[both] = self._drawn(begun, width, who[rest[both]], after[both], height - 1)
        left[both] = size + (what[both] - 1) * size * size + left[both] * size + right
        number[rest], end[rest] = small + left, after
        return number, end

    def draw(self, seeds: np.ndarray, attempts: int) -> tuple[np.ndarray, np.ndarray]:
        """Number and attempts of each seed's puzzle; no attempts where it takes more words than are tabled."""
        width = len(seeds)
        begun = self._begun(first_words(seeds))
        number, tried = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
        who, at, attempt = np.arange(width), np.zeros(width, dtype=np.int64), 0
        while len(who):
            attempt += 1
            if attempt > attempts:
                raise ValueError(f"no uniquely solvable puzzle in {attempts} attempts for seed {seeds[who[0]]}")
            left, code = np.full(len(who), self.valid), np.zeros(len(who), dtype=np.int64)
            for knights in self.knights:
                x, at = self._drawn(begun, width, who, at, self.depth)
                left &= ~(self.truth[x] ^ knights)
                code = code << self.bits | x
            inside = at != _BEYOND
            one = inside & (np.bitwise_count(left) == 1)
            number[who[one]], tried[who[one]] = code[one], attempt
            who, at = who[inside & ~one], at[inside & ~one]
        return number, tried

    def number(self, trees: np.ndarray) -> np.ndarray:
        """The number of puzzles drawn as arrays: (puzzles, people, places, [what, first, second])."""
        n, codes = len(self.people), {}
        for i in reversed(range(len(self.world.levels))):
            what, a, b = (trees[:, :, i, j].astype(np.int64) for j in range(3))
            raw = np.where(b == n - 1, a, b)
            x = np.where(what == _IS, 2 * a + b, 2 * n + (what - _SAME) * n * (n - 1) + a * (n - 1) + raw)
            if (level := self.world.levels[i]) < self.depth:
                size = self.sizes[self.depth - level - 1]
                left, right = (codes.pop(j) for j in self.world.parts(i))
                two = self.sizes[0] + size + (what - _AND) * size * size + left * size + right
                x = np.where(what < _NOT, x, np.where(what == _NOT, self.sizes[0] + left, two))
            codes[i] = x
        out = np.zeros(len(trees), dtype=np.int64)
        for p in range(n):
            out = out << self.bits | codes[0][:, p]
        return out

    def _pieces(self, leaves: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
        """Beginnings and ends of which the canonical JSON of any tree is put together."""
        if not self.depth:
            return [x for x, _ in leaves], [""]
        lower, cut, inner = leaves, ("\0", ""), _World._inner
        for _ in range(self.depth - 1):
            two = [inner(op, x, y) for op in INNER[1:] for x in lower for y in lower]
            lower = [*leaves, *[inner("not", x, x) for x in lower], *two]
        begin = [*leaves, *[inner("not", x, x) for x in lower]]
        lefts = [inner(op, x, cut)[0].split("\0")[0] for op in INNER[1:] for x in lower]
        return [*[x for x, _ in begin], *lefts], ["", *[x + "}" for x, _ in lower]]

    def texts(self, numbers: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Key (as ``logic.puzzle_key``) and pattern of each number."""
        n = len(self.people)
        codes = np.stack([numbers >> self.bits * (n - 1 - p) & (1 << self.bits) - 1 for p in range(n)], axis=1)
        left = np.full(len(numbers), self.valid)
        for p in range(n):
            left &= ~(self.truth[codes[:, p]] ^ self.knights[p])
        begin, last = codes, np.zeros_like(codes)
        if self.depth:
            size, few = self.sizes[-2], self.sizes[0] + self.sizes[-2]
            op_left, right = np.divmod(codes - few, size)
            begin, last = np.where(codes < few, codes, few + op_left), np.where(codes < few, 0, 1 + right)
        parts = [part for p in range(n) for part in (self.begin[begin[:, p]].tolist(), self.end[p][last[:, p]].tolist())]
        keys = [hashlib.sha256(b"".join((self.head, *x))).hexdigest() for x in zip(*parts, strict=True)]
        return keys, self.marks[np.log2(left.astype(np.float64)).astype(np.int64)]


KINDS = ("statement", "label")


def _puzzles(w: _World, batches: Iterator[np.ndarray], kind: str, attempts: int, width: int, kept: int = 0, texts: bool = True) -> Iterator[dict]:
    """Columns of the puzzles of arrays of rows, some thousands at a time: a seed, then ``kept`` numbers that stay beside it.

    ``width`` seeds are drawn for at once, in each step one statement for each, of the speaker whose turn it is there: a
    seed whose puzzle is found leaves, and once half the places are free the next seeds take them.
    """
    n, places = len(w.people), len(w.levels)
    t, row = Twisters(width), np.zeros((width, 1 + kept), dtype=np.int64)
    attempt, speaker, tries, case = (np.zeros(width, dtype=np.int64) for _ in range(4))
    trees, left = np.zeros((width, n, places, 3), dtype=np.int8), np.full((width, w.knights.shape[1]), w.valid)
    busy = np.zeros(width, dtype=bool)
    waiting, more, out, rows = np.zeros((0, 1 + kept), dtype=np.int64), True, [], 0
    while True:
        while more and len(waiting) < width and 2 * busy.sum() <= width:
            batch = next(batches, None)
            more = batch is not None
            waiting = np.concatenate([waiting, batch]) if more else waiting
        if len(waiting) and 2 * busy.sum() <= width:
            who = np.flatnonzero(~busy)[: len(waiting)]
            row[who], waiting = waiting[: len(who)], waiting[len(who) :]
            t.seed(who, row[who, 0])
            busy[who], attempt[who], speaker[who], tries[who], left[who] = True, 1, 0, 0, w.valid
        who = np.flatnonzero(busy)
        if not len(who):
            break
        if kind == "label":
            new = who[(speaker[who] == 0) & (tries[who] == 0)]
            case[new] = 0
            for _ in w.people:
                case[new] = 2 * case[new] + t.below(len(TYPES), new)
        x = w.draw(t, who)
        table, knights = w.truth(x), w.knights[speaker[who]]
        fits = np.ones(len(who), dtype=bool)
        if kind == "label":
            fits = w.holds(table, case[who]) == w.holds(knights, case[who])
            tries[who] = np.where(fits, 0, tries[who] + 1)
            if (tries[who] >= REDRAWS).any():
                raise ValueError(f"no statement agrees with the answer in {REDRAWS} draws")
        at = who[fits]
        trees[at, speaker[at]] = x[fits]
        left[at] &= ~(table ^ knights)[fits]
        speaker[at] += 1
        done = at[speaker[at] == n]
        one = np.bitwise_count(left[done]).sum(axis=1) == 1
        found, again = done[one], done[~one]
        if (attempt[again] >= attempts).any():
            first = row[again[attempt[again] >= attempts][0], 0]
            raise ValueError(f"no uniquely solvable puzzle in {attempts} attempts for seed {first}")
        attempt[again] += 1
        speaker[again], left[again] = 0, w.valid
        busy[found] = False
        if len(found):
            out.append((row[found], attempt[found], left[found], trees[found]))
            rows += len(found)
        if rows >= width:
            yield _written(w, out, texts)
            out, rows = [], 0
    if out:
        yield _written(w, out, texts)


def _written(w: _World, found: list[tuple], texts: bool) -> dict:
    rows, attempt, left, trees = (np.concatenate(x) for x in zip(*found, strict=True))
    word = (left != 0).argmax(axis=1)
    case = 64 * word + np.log2(left[np.arange(len(left)), word].astype(np.float64)).astype(np.int64)
    n = len(w.people)
    marks = ["".join("KN"[c >> n - 1 - p & 1] for p in range(n)) for c in case.tolist()]
    row = {"rows": rows, "pattern": marks, "attempts": attempt, "trees": trees}
    for p in range(n) if texts else ():
        row[f"expr_{p}"], row[f"said_{p}"] = w.texts(trees[:, p])
    return row


def puzzles(
    seeds: DataFrame, kind: str = "statement", people: tuple[str, ...] = PEOPLE, depth: int = 2, attempts: int = 10_000
) -> DataFrame:
    """The uniquely solvable puzzle of each seed (column seed): people, statements, pattern, attempts.  Lazy.

    ``kind``: ``statement`` (statements are drawn without regard to an answer) or ``label`` (an answer is drawn first, then
    for each speaker statements until one agrees with it).  2 to 16 people.  Equal seeds give one row, null seeds none, no
    seeds an empty table; other columns are left out.  As many tasks as ``spark.sql.shuffle.partitions``.
    """
    rows = seeds.select(F.col("seed").cast("long").alias("seed")).where("seed IS NOT NULL")
    return _drawn(_spread(rows).dropDuplicates(), (), kind, people, depth, attempts)


def _spread(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Dealt by seed to as many tasks as ``spark.sql.shuffle.partitions``, to fewer where ``n`` rows fill no block each."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(most if n is None else min(most, n // _BLOCK + 1), "seed")


def _drawn(
    rows: DataFrame, kept: tuple[str, ...], kind: str, people: tuple[str, ...] = PEOPLE, depth: int = 2,
    attempts: int = 10_000, texts: bool = True
) -> DataFrame:
    """The puzzle of each row's seed, drawn where the row is: ``kept`` (whole numbers, no nulls) stay, so nothing is joined.

    Without ``texts``: seed, pattern and attempts alone.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    if not 2 <= len(people) <= 16 or len(set(people)) < len(people):
        raise ValueError("2 to 16 people with different names")
    n = len(people)
    block = max(1, _BLOCK >> max(0, n - 6))
    said = [f"{f}_{p}" for p in range(n) for f in ("expr", "said")] if texts else []
    longs_of = ["seed", *kept]
    names_of = [*longs_of, "pattern", "attempts", *said]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _World(people, depth)
        arrays = (np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) for b in batches)
        for row in _puzzles(w, arrays, kind, attempts, block, len(kept), texts):
            columns = [pa.array(row["rows"][:, i]) for i in range(len(longs_of))]
            columns += [pa.array(row["pattern"], pa.string()), pa.array(row["attempts"], pa.int32())]
            columns += [pa.array(row[f], pa.string()) for f in said]
            yield pa.RecordBatch.from_arrays(columns, names_of)

    kinds_of = [*[f"{c} long" for c in longs_of], "pattern string", "attempts int", *[f"{c} string" for c in said]]
    drawn = rows.select(*[F.col(c).cast("long").alias(c) for c in longs_of]).mapInArrow(draw, ", ".join(kinds_of))
    if not texts:
        return drawn
    statements = [
        F.struct(
            F.lit(p).alias("speaker"), F.col(f"expr_{i}").alias("expr"), F.concat(f"said_{i}", F.lit(".")).alias("text")
        )
        for i, p in enumerate(people)
    ]
    names = F.array(*[F.lit(p) for p in people])
    return drawn.select(*longs_of, names.alias("people"), F.array(*statements).alias("statements"), "pattern", "attempts")


def split_seeds(splits: DataFrame, sizes: Column) -> DataFrame:
    """split, pos (from 0) and seed: the first ``sizes`` puzzle seeds that follow from each split's own seed.

    ``splits``: columns split (whole number) and seed, no nulls.  A long stream is written in pieces by one task, which holds
    5 KB; short ones some hundred at once.
    """

    def short(rows: list[dict]) -> pa.RecordBatch:
        sizes = np.array([max(r["size"], 0) for r in rows])
        x = first_longs(np.array([r["seed"] for r in rows], dtype=np.int64), int(sizes.max()))
        taken = np.arange(x.shape[1])[None] < sizes[:, None]
        split = np.repeat(np.array([r["split"] for r in rows], dtype=np.int64), sizes)
        return pa.RecordBatch.from_arrays([pa.array(split), pa.array(np.nonzero(taken)[1]), pa.array(x[taken])], ["split", "pos", "seed"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            few = [r for r in rows if (r["size"] or 0) <= _SHORT and r["size"] is not None]
            for i in range(0, len(few), _TOGETHER):
                yield short(few[i : i + _TOGETHER])
            for row in rows:
                if row["size"] is None or row["size"] <= _SHORT:
                    continue
                pos = 0
                for x in longs(row["seed"]):
                    x = x[: row["size"] - pos]
                    if len(x):
                        at = pa.array(np.arange(pos, pos + len(x)))
                        split = pa.array([row["split"]] * len(x), pa.int64())
                        yield pa.RecordBatch.from_arrays([split, at, pa.array(x)], ["split", "pos", "seed"])
                    pos += len(x)
                    if pos >= row["size"]:
                        break

    rows = splits.select(F.col("split").cast("long"), F.col("seed").cast("long"), sizes.cast("long").alias("size"))
    tasks = int(splits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "split").mapInArrow(stream, "split long, pos long, seed long")


def _key() -> Column:
    said = F.transform("statements", lambda s: F.struct(s["speaker"].alias("speaker"), s["expr"].alias("expr")))
    return logic.puzzle_key(F.col("people"), said)


def _stretches(spark: SparkSession, seed: int, start: int, end: int) -> DataFrame:
    """The numbers ``start`` to ``end`` of a seed's stream, as states from which tasks go on: pos (of the first number), state."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for pos, state in stretches(row["seed"], start, end):
                    yield pa.RecordBatch.from_arrays([pa.array([pos]), pa.array([state])], ["pos", "state"])

    one = spark.range(0, 1, 1, 1).select(F.lit(seed).cast("long").alias("seed"))
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * (end - start) // STRETCH + 2)
    return one.mapInArrow(states, "pos long, state binary").repartition(tasks)


def _candidates(
    spark: SparkSession, seed: int, start: int, end: int, kind: str, people: tuple[str, ...], depth: int, attempts: int = 10_000
) -> DataFrame:
    """The puzzles of the seeds ``start`` to ``end`` of a stream: key, pos, seed, attempts, in the general case pattern.

    ``key`` is a number (``_Tabled``) where that fits, else the digest.
    """

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for row in batch.to_pylist():
                seeds = stretch(row["state"])
                pos = row["pos"] + np.arange(len(seeds))
                inside = (pos >= start) & (pos < end)
                yield np.stack([seeds[inside], pos[inside]], axis=1)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in numbers(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["seed", "pos"])

    def batch_of(key: np.ndarray, rows: np.ndarray, attempt: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(key), pa.array(rows[:, 1]), pa.array(rows[:, 0]), pa.array(attempt.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["key", "pos", "seed", "attempts"])

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, late = _Tabled(people, depth), []

        def longer() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(late) if late else np.zeros((0, 2), dtype=np.int64)
            late.clear()
            if len(rows):
                for row in _puzzles(w.world, iter([rows]), kind, attempts, min(_BLOCK, len(rows)), 1, False):
                    yield batch_of(w.number(row["trees"]), row["rows"], row["attempts"])

        for x in _cut(numbers(batches)):
            key, tried = w.draw(x[:, 0], attempts)
            yield batch_of(key[tried > 0], x[tried > 0], tried[tried > 0])
            late.append(x[tried == 0])
            if sum(map(len, late)) >= _BLOCK:
                yield from longer()
        yield from longer()

    rows = _stretches(spark, seed, start, end)
    if kind == "statement" and _Tabled.fits(people, depth):
        return rows.mapInArrow(tabled, "key long, pos long, seed long, attempts int")
    made = _drawn(rows.mapInArrow(plain, "seed long, pos long"), ("pos",), kind, people, depth, attempts)
    return made.select(F.unhex(_key()).alias("key"), "pos", "seed", "attempts", "pattern")


def _cut(arrays: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The same rows, ``_WIDTH`` at a time."""
    rest = []
    for x in arrays:
        rest.append(x)
        if sum(map(len, rest)) >= _WIDTH:
            x = np.concatenate(rest)
            whole = len(x) - len(x) % _WIDTH
            yield from np.split(x[:whole], whole // _WIDTH)
            rest = [x[whole:]]
    if sum(map(len, rest)):
        yield np.concatenate(rest)


def _keyed(taken: DataFrame, people: tuple[str, ...], depth: int) -> DataFrame:
    """split, n, pos, seed, key, pattern, attempts: keys that are numbers are written as digests, with their patterns."""
    cols = ["split", "n", "pos", "seed", "key", "pattern", "attempts"]
    if "pattern" in taken.columns:
        return taken.withColumn("key", F.lower(F.hex("key"))).select(*cols)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _Tabled(people, depth)
        for batch in batches:
            x = dict(zip(batch.schema.names, batch.columns, strict=True))
            keys, patterns = w.texts(x["key"].to_numpy())
            x |= {"key": pa.array(keys, pa.string()), "pattern": pa.array(patterns, pa.string())}
            yield pa.RecordBatch.from_arrays([x[c] for c in cols], cols)

    kinds = "split long, n long, pos long, seed long, key string, pattern string, attempts int"
    return taken.select("split", "n", "pos", "seed", "key", "attempts").mapInArrow(write, kinds)


def splits(
    wanted: DataFrame, kind: str = "statement", people: tuple[str, ...] = PEOPLE, depth: int = 2, statements: bool = True
) -> DataFrame:
    """Splits as one generator after another makes them: split, n (from 0), pos, seed, key, pattern, attempts, statements.

    ``wanted``: columns split, seed and size, a row a split and few of them.  Splits are filled in order of their number: each
    takes puzzles along its own stream, passes over keys that it or a split before it took, and stops at its size.  Jobs run
    for each split.  The more puzzles there are, the fewer are new: as many candidates are drawn as the split before took for
    its size (the first: one each), then, from where that stopped, as many as the share of new ones in the last round asks
    for and a quarter more.  A size of 0 or less, or null, gives no rows.  Candidates move as numbers of 8 bytes, or digests of 32; ``statements``
    are drawn again, for puzzles that were taken, or left out.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    spark, out, share = wanted.sparkSession, None, 1.0
    for row in sorted(wanted.collect(), key=lambda r: r["split"]):  # few
        size = row["size"] or 0
        if size <= 0:
            continue
        kept, have, start, end = None, 0, 0, int(size * share) + 64
        while True:
            made = _candidates(spark, row["seed"], start, end, kind, people, depth)
            fields = [c for c in made.columns if c != "key"]
            new = made.groupBy("key").agg(F.min_by(F.struct(*fields), "pos").alias("row")).select("key", "row.*")
            for seen in (out, kept):
                if seen is not None:
                    new = new.join(seen.select("key"), "key", "left_anti")
            new = exchange.table(new, "new")
            n = new.count()
            kept, have = new if kept is None else kept.unionByName(new), have + n
            if have >= size:
                break
            more = (size - have) * (end - start) * 5 // (4 * max(n, 1)) + 64
            start, end = end, end + min(more, 2 * end)
        share = end / size
        taken = numbered(kept, "pos", "n").where(F.col("n") < size).drop("total")
        taken = taken.withColumn("split", F.lit(row["split"]).cast("long"))
        out = taken if out is None else out.unionByName(taken)
    if out is None:
        kinds = "split long, n long, pos long, seed long, key string, pattern string, attempts int"
        texts = ", statements array<struct<speaker:string,expr:string,text:string>>" if statements else ""
        return spark.createDataFrame([], kinds + texts)
    out = _keyed(out, people, depth)
    return out.join(puzzles(out.select("seed"), kind, people, depth).select("seed", "statements"), "seed").select(*out.columns, "statements") if statements else out


def balanced(wanted: DataFrame, targets: tuple[str, ...] = PATTERNS, kind: str = "label", depth: int = 2) -> DataFrame:
    """A set with one puzzle for each target label: split, n (place of the label), pos, seed, pattern, attempts, statements.

    ``wanted``: columns split and seed.  A set goes along its stream of puzzle seeds and takes, label by label, the next puzzle
    with that answer; ``targets`` differ, so no two puzzles of a set are alike.  Ten candidates a label are drawn for each
    set, then, from where it stopped, half as many and on from there twice as many for the sets that are not full yet.
    Candidates have no texts; those of a set's puzzles are drawn again.  Null seeds give no rows; equal splits are an error.
    """
    left = exchange.table(wanted.where("split IS NOT NULL AND seed IS NOT NULL").select("split", "seed"), "sets")
    if left.groupBy("split").count().where("count > 1").limit(1).count():
        raise ValueError("a split is named twice")
    labels = F.array(*[F.lit(t) for t in targets])
    left = left.withColumn("taken", F.array().cast("array<struct<pos:bigint,seed:bigint,pattern:string>>"))
    out, start, more = None, 0, 10 * len(targets)
    while True:
        end = start + more
        seeds = split_seeds(left, F.lit(end)).where(F.col("pos") >= start)
        made = _drawn(_spread(seeds, left.count() * more), ("split", "pos"), kind, PEOPLE, depth, texts=False)
        # a set's candidates: as many as were drawn for it
        line = F.array_sort(F.collect_list(F.struct("pos", "seed", "pattern")))
        walk = lambda s, x: F.when(x["pattern"] == F.get(labels, F.size(s)), F.concat(s, F.array(x))).otherwise(s)
        lines = made.groupBy(F.col("split").alias("__split")).agg(line.alias("line"))
        sets = left.join(lines, F.col("split") == F.col("__split"))
        sets = exchange.table(sets.select("split", left["seed"], F.aggregate("line", F.col("taken"), walk).alias("taken")), "sets")
        full = sets.where(F.size("taken") == len(targets)).select("split", F.posexplode("taken").alias("n", "row"))
        full = full.select("split", "n", "row.*")
        out = full if out is None else out.unionByName(full)
        left = sets.where(F.size("taken") < len(targets))
        if left.isEmpty():
            break
        start, more = end, 5 * len(targets) if start == 0 else 2 * more
    made = _drawn(_spread(out.select("split", "n", "pos", "seed"), out.count()), ("split", "n", "pos"), kind, PEOPLE, depth)
    made = made.select("split", F.col("n").cast("int").alias("n"), "pos", "seed", "pattern", "attempts", "statements")
    return exchange.table(made, "balanced")

"""Near-duplicate documents by HyperMinHash, exact at the threshold.

A document's set: distinct five-word shingles of its text with A-Z lower-cased;
with one to four words the whole sequence; else empty and linked with nothing.
Documents are linked when 100 * |intersection| >= 75 * |union|.

1. Sketch, one pass over whole texts: the set's size, a 128-bit digest of it,
   and ``REGISTERS`` registers.  A shingle's hash picks a bucket by its first
   bits; of the least remainder in each bucket only the count of leading zeros
   and ``MANTISSA`` further bits are kept (two bytes).
2. Equal sets form a class, found by digest; only one row of a class goes on,
   so exact copies never meet one another.
3. Banding: each run of ``ROWS`` registers is a band key.  Small sets leave
   buckets empty; for banding these borrow the register of another bucket, the
   first that isn't empty in an order of hashes fixed for each bucket, so that a
   band is as selective for a short text as for a long one.  Keys held by one
   class are discarded.  At the threshold itself a link shares a band with
   probability over 1 - 1e-6, above it with more.
4. Lead rounds: of the bands whose classes lie in different components, each has
   a lead, its least class, later its first by hash.  A class is paired with one
   lead only, the first of those of its bands, so a group of any number of mutual
   copies costs a pair each.  The collision-corrected estimate of the Jaccard
   similarity from two sketches drops pairs that are more than five standard
   errors below the threshold; the others are verified on the full sets.
   Verified links give components.
5. Bands that still join different components are searched exactly: members with
   their sketches and sets are cut into blocks of at most ``PER_BLOCK`` classes
   and ``PER_SETS`` shingles, and block meets block in one call.  It estimates
   pairs of different components, confirms at once, on the sets, those that may
   be links, and returns only links that join what it hasn't joined yet: fewer
   than it has classes, never the pairs that it has looked at.
6. Components of all verified links; the least doc_id of a component is kept.

Nothing is capped: groups of any size are cut into blocks that are compared
exactly.  Copies linked in the lead rounds aren't compared again.  What stays
quadratic is the number of sketches compared within a band whose classes share
most of their registers and yet aren't linked (similarity just below 0.75).
Joins on a hot lead or band are split by the skew join of adaptive execution;
what is broadcast has a checked size, with a shuffle beyond it.

Defined results: null and empty texts have n_shingles 0 and stay; rows that
repeat a doc_id and text are all kept or all dropped; rows with a null doc_id
are linked with nothing, their component is null and they are kept; texts of any
length are taken whole, one by one if long; ties can't occur, as the least doc_id
of a component is kept; an empty table gives an empty result; columns besides id
and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components
from .textops import U64, Block, blocks, mix, windows

SHINGLE, PER_CENT = 5, 75
REGISTERS, MANTISSA, ROWS = 256, 10, 5
EMPTY = 0xFFFF
LEAD_ROUNDS = 2
PER_BLOCK, PER_SETS, SMALL = 1000, 1 << 20, 64
#: Bytes that one call is given to compare, groups of a band packed together.
CHUNK = 12 << 20


def shingles(b: Block, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, document after document, and each document's first one (repeats included)."""
    h = b.hashes()
    count = b.counts
    take = b.valid(k)
    value = windows(h, k) if len(h) else h
    for n in range(1, k):
        few = b.first[:-1][count == n]
        if len(few):
            value[few] = windows(h, n)[few]
            take[few] = True
    first = np.concatenate([[0], np.cumsum(take)])[b.first]
    return value[take], first


def registers(x: np.ndarray) -> np.ndarray:
    """Compressed registers of a sorted array of distinct hashes."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    bits = REGISTERS.bit_length() - 1
    bucket = (x >> U64(64 - bits)).astype(np.int64)
    lead = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    rest = x[lead] << U64(bits)
    # position of the highest bit by splitting off 32 bits, so that doubles are exact
    high = (rest >> U64(32)).astype(np.float64)
    low = (rest & U64(0xFFFFFFFF)).astype(np.float64)
    exp = np.where(high > 0, np.frexp(high)[1] + 32, np.where(low > 0, np.frexp(low)[1], 0))
    zeros = np.minimum(64 - exp, 62).astype(np.int64)
    shifted = np.where(zeros + 1 < 64, rest << (zeros + 1).astype(U64), U64(0))
    mantissa = (shifted >> U64(64 - MANTISSA)).astype(np.int64)
    out[bucket[lead]] = zeros << MANTISSA | mantissa
    return out


#: Where an empty bucket looks for a register, attempt by attempt.
_LOOK = (
    mix(np.arange(REGISTERS * 64, dtype=U64) + U64(0x5DEECE66D)) % U64(REGISTERS)
).astype(np.int64).reshape(REGISTERS, 64)


def dense(regs: np.ndarray) -> np.ndarray:
    """Rows of registers with the empty ones filled in (rows that are wholly empty stay so)."""
    out = regs.copy()
    row, col = np.nonzero((regs == EMPTY) & (regs != EMPTY).any(1)[:, None])
    for t in range(_LOOK.shape[1]):
        if not len(row):
            return out
        got = regs[row, _LOOK[col, t]]
        out[row, col] = got
        left = got == EMPTY
        row, col = row[left], col[left]
    for step in range(1, REGISTERS):  # very small sets: the next one round
        if not len(row):
            break
        got = regs[row, (col + step) % REGISTERS]
        out[row, col] = got
        left = got == EMPTY
        row, col = row[left], col[left]
    return out


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of rows of registers, less expected collisions, and registers used."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(-1)
    same = ((a == b) & (a != EMPTY)).sum(-1)
    n, m = np.maximum(size_a, size_b).astype(float), np.minimum(size_a, size_b).astype(float)
    ratio = n / m
    chance = 0.169919487159739093975315012348 * REGISTERS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(same - chance, 0) / np.maximum(used, 1), used


def _near(est: np.ndarray, used: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether an estimate may belong to a link: registers are a sample, without replacement, of the union."""
    t = PER_CENT / 100
    union = np.maximum((size_a + size_b) / (1 + t), 2)
    error = np.sqrt(t * (1 - t) / np.maximum(used, 1) * np.clip((union - used) / (union - 1), 0, 1))
    return est >= t - 5 * error - 1 / np.maximum(used, 1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in blocks(batches):
        b = Block(data, off, fold=True)
        value, first = shingles(b)
        n, k1, k2, regs = np.zeros(b.n, np.int64), np.zeros(b.n, np.int64), np.zeros(b.n, np.int64), np.full(
            (b.n, REGISTERS), EMPTY, np.uint16
        )
        for i in range(b.n):
            x = np.sort(value[first[i] : first[i + 1]])
            if not len(x):
                continue
            x = x[np.append(True, x[1:] != x[:-1])]
            n[i] = len(x)
            k1[i] = mix(x).sum(dtype=U64).astype(np.int64)
            k2[i] = mix(x ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).astype(np.int64)
            regs[i] = registers(x)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id"),
                pa.array(n),
                pa.array(k1),
                pa.array(k2),
                *(pa.array([x.tobytes() for x in m], pa.binary()) for m in (regs, dense(regs)))
            ],
            names=["doc_id", "n", "k1", "k2", "regs", "full"]
        )


def _bands(classes: DataFrame) -> DataFrame:
    """band, node, n: natively, from the bytes of the registers."""
    i = F.explode(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1))).alias("i")
    key = F.expr(f"substring(full, i * {2 * ROWS} + 1, {2 * ROWS})")
    return classes.select("node", "n", "full", i).select(F.xxhash64("i", key).alias("band"), "node", "n")


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint16).reshape(len(col), REGISTERS)


def _estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        if len(p):
            est, used = similarity(_matrix(p["regs_u"]), _matrix(p["regs_v"]), p["n_u"].to_numpy(), p["n_v"].to_numpy())
            yield p.loc[_near(est, used, p["n_u"].to_numpy(), p["n_v"].to_numpy()), ["u", "v"]]


class _Joined:
    """Components joined within one call."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        self.up[max(x, y)] = min(x, y)


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets of hashes are similar enough."""
    if 100 * min(len(x), len(y)) < PER_CENT * max(len(x), len(y)):
        return False
    if len(x) < len(y):
        x, y = y, x
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * both >= PER_CENT * (len(x) + len(y) - both)


def _block_links(p: pd.DataFrame) -> pd.DataFrame:
    """Links between different components within each (band, x, y) of a chunk, none that others imply.

    Side 0: one block against itself; 1 and 2: one block against another.  Small groups are compared all at once.
    """
    p = p.iloc[np.lexsort((p["node"], p["side"], p["y"], p["x"], p["band"]))]
    regs, n, comp, node, side = _matrix(p["regs"]), *(p[c].to_numpy() for c in ("n", "component", "node", "side"))
    sets = p["set"].to_numpy()
    key = p[["band", "x", "y"]].to_numpy()
    heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    tails = np.append(heads[1:], len(p))
    group = np.repeat(np.arange(len(heads)), tails - heads)
    small = ((tails - heads <= SMALL) & (side[heads] == 0))[group]
    joined, seen = _Joined(), set()
    out: list[tuple[int, int]] = []

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        fit = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= PER_CENT * np.maximum(n[i], n[j]))
        i, j = i[fit], j[fit]
        for k in range(0, len(i), 4096):
            a, b = i[k : k + 4096], j[k : k + 4096]
            near = _near(*similarity(regs[a], regs[b], n[a], n[b]), n[a], n[b])
            for u, v in zip(a[near].tolist(), b[near].tolist(), strict=True):
                pair = (int(max(node[u], node[v])), int(min(node[u], node[v])))
                x, y = joined.root(int(comp[u])), joined.root(int(comp[v]))
                if x == y or pair in seen:
                    continue
                seen.add(pair)  # the same two meet again in their other bands of this chunk
                if _linked(np.frombuffer(sets[u], U64), np.frombuffer(sets[v], U64)):
                    joined.join(x, y)
                    out.append(pair)

    at = np.flatnonzero(small)
    for d in range(1, SMALL):
        left = at[at + d < len(p)]
        left = left[group[left] == group[left + d]]
        if not len(left):
            break
        compare(left, left + d)
    for a, b in zip(heads[~small[heads]].tolist(), tails[~small[heads]].tolist(), strict=True):
        own = side[a] == 0
        right = np.arange(a, b) if own else np.flatnonzero(side[a:b] == 2) + a
        for i in range(a, b if own else int(right[0]) if len(right) else a):
            rest = right[right > i]
            compare(np.full(len(rest), i), rest)
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in blocks(batches):
        b = Block(data, off, fold=True)
        value, first = shingles(b)
        x = [np.unique(value[first[i] : first[i + 1]]).tobytes() for i in range(b.n)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(x, pa.binary())], names=["node", "set"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        both = zip(rows.column("set_u"), rows.column("set_v"), strict=True)
        keep = [_linked(np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)) for a, b in both]
        yield rows.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node and its whole set, for the documents of a table of ids (doc_id, distinct)."""
    texts = docs.join(shared.checked(ids), "doc_id", "left_semi")
    return shared.table(texts.mapInArrow(_sets, "node long, set binary").dropDuplicates(["node"]), "sets")


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) that are links on their full sets, as a table; estimates leave out most others."""
    def of(table: DataFrame, s: str, *columns: str) -> DataFrame:
        return table.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])

    both = pairs.join(of(classes, "v", "n", "regs"), "v").join(of(classes, "u", "n", "regs"), "u")
    near = shared.table(both.mapInPandas(_estimate, "u long, v long"), "near")
    ids = shared.table(near.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "needed")
    sets = _sets_of(docs, ids)
    x = near.join(of(sets, "v", "set"), "v").join(of(sets, "u", "set"), "u").select("u", "v", "set_u", "set_v")
    with shared.conf(docs.sparkSession, maxRecordsPerBatch="256"):
        links = shared.table(x.mapInArrow(_confirm, "u long, v long"), "links")
    shared.drop(near, ids, sets)
    return links


def _named(members: DataFrame, found: DataFrame | None, turn: int) -> tuple[DataFrame, DataFrame]:
    """Members with their components, and the bands that lie in several: size, all shingles, lead.

    The lead is the least class in the first turn, in later ones the first in an order of hashes, so that others are tried.
    """
    component = F.col("node") if found is None else F.coalesce("component", "node")
    named = members if found is None else members.join(found, "node", "left")
    named = shared.table(named.select("band", "node", "n", component.alias("component")), "named")
    order = F.xxhash64("node", F.lit(turn)) if turn else F.col("node")
    lead = F.min(F.struct(order.alias("order"), "node", "component", "n")).alias("lead")
    ends = F.min("component").alias("a"), F.max("component").alias("b")
    bands = named.groupBy("band").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), lead, *ends)
    return named, shared.table(bands.where("a <> b").drop("a", "b"), "open")


def _lead_pairs(named: DataFrame, bands: DataFrame) -> DataFrame:
    """u, v: each class with the first lead of its bands that is of another component and may be linked with it."""
    fit = f"component <> lead.component AND 100 * least(n, lead.n) >= {PER_CENT} * greatest(n, lead.n)"
    found = named.join(bands.select("band", "lead"), "band").where(fit).groupBy("node").agg(F.min("lead").alias("lead"))
    return shared.table(found.select(F.col("node").alias("u"), F.col("lead.node").alias("v")), "pairs")


def _search(named: DataFrame, bands: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (u, v) between different components of a band, found block against block, as a table."""
    parts = F.ceil(F.greatest(F.col("size") / PER_BLOCK, F.col("shingles") / PER_SETS)).cast("int")
    rows = named.join(
        bands.select("band", parts.alias("parts")), "band"
    ).withColumn("mine", F.pmod(F.hash("node"), F.col("parts")))
    # a row goes to each pair of blocks that its own is one of: side 0 within a block, 1 and 2 between two
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    pair = F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")
    rows = shared.table(rows.select("band", "node", "n", "component", *pair, side.alias("side")), "blocks")
    ids = shared.table(rows.select(F.col("node").alias("doc_id")).distinct(), "needed")
    sets = _sets_of(docs, ids)
    size = rows.agg(F.sum(8 * F.col("n") + 2 * REGISTERS)).first()[0] or 0
    chunk = F.pmod(F.xxhash64("band", "x", "y"), F.lit(1 + size // CHUNK)).alias("chunk")
    held = classes.select("node", "regs").join(sets, "node")
    links = rows.join(held, "node").groupBy(chunk).applyInPandas(_block_links, "u long, v long")
    links = shared.table(links.distinct(), "more")
    shared.drop(rows, ids, sets)
    return links


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of ``docs``; a table in the shared folder."""
    shared.prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with shared.scratch() as keep:
        sketch = "doc_id long, n long, k1 long, k2 long, regs binary, full binary"
        rows = shared.table(docs.mapInArrow(_sketch, sketch), "sketches")
        one = F.min("doc_id").alias("node"), F.first("regs").alias("regs"), F.first("full").alias("full")
        some = rows.where("n > 0 AND doc_id IS NOT NULL")
        classes = shared.table(some.groupBy("k1", "k2", "n").agg(*one), "classes")
        repeated = _bands(classes).groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
        members = shared.table(_bands(classes).join(repeated, "band", "left_semi"), "members")

        found = None
        tied = docs.sparkSession.createDataFrame([], "u long, v long")

        def join(links: DataFrame) -> None:
            nonlocal found, tied
            found = shared.table(components(tied.unionByName(links)), "components")
            tied = found.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))

        for turn in range(LEAD_ROUNDS):
            named, bands = _named(members, found, turn)
            pairs = _lead_pairs(named, bands)
            join(_verify(pairs, classes, docs))
            shared.drop(named, bands, pairs)
        named, bands = _named(members, found, LEAD_ROUNDS)
        if not bands.isEmpty():
            join(_search(named, bands, classes, docs))

        names = ["k1", "k2", "n"]
        label = classes.join(found, "node", "left").select(*names, F.coalesce("component", "node").alias("component"))
        out = rows.select("doc_id", *names).join(label, names, "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        kept = F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
        out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept)
        return keep(shared.table(out, "near"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, b AS other FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.other = u.a),
c AS (SELECT doc_id, min(other) AS m FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

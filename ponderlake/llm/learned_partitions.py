"""Approximate nearest neighbours by learned partitions.

1. Equal vectors are searched once: each distinct vector is a row, with its least ids as members.
2. A level of the index: from at most about ``FIT`` vectors of a part (chosen by hash), a graph of nearest neighbours is made
   and cut into ``PARTS`` balanced pieces, few edges between them; a small network learns the piece of a vector and of its
   neighbours.  All vectors of the part go to their most probable piece.  Parts of more than ``LEAF`` vectors are divided
   again, each by a network of its own, so that a leaf stays as small at any number of vectors.
3. A query goes to its most probable pieces until their probabilities reach a share that each network's own held-out
   queries needed for a recall of ``RECALL``.
4. Within the leaves reached, vectors are compared in blocks: 64-bit arithmetic on the original vectors.

Only samples of a part, networks and blocks of about ``BLOCK`` vectors meet in a task; nothing passes through the driver but
counts.  How near a vector is never decides whether it is indexed: each distinct vector is in exactly one leaf.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
id; shorter vectors count as padded with zeros; of several vectors under one id the least in array order counts; ties of
score go to the smaller id; a query alone in its table has no row; an empty table gives an empty result; columns besides id
and vector are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Pieces of a part; vectors a network is fitted on; vectors of a leaf; vectors of a block.
PARTS, FIT, LEAF, BLOCK = 16, 6144, 16384, 1024
#: Neighbours of a vector in the graph; units of the network's hidden layer; share of true neighbours to reach at a level.
DEGREE, HIDDEN, RECALL = 10, 64, 0.97
#: Bytes of networks that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Directions; the largest component is brought to one first, so that squares stay finite and above zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def nearest(x: np.ndarray, y: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Places in ``y`` of the k rows nearest to each row of ``x``; a row isn't its own neighbour if ``own``."""
    k = min(k, len(y) - own)
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ y.T
        if own:
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 0.05) -> np.ndarray:
    """A piece for each vertex: pieces of nearly equal size with few edges of ``graph`` between them.

    Halved along principal directions at first; then vertices move to the piece of most of their neighbours, largest gain
    first, while no piece gets more than ``slack`` above its share or falls as far below.
    """
    n, piece = len(x), np.zeros(len(x), np.int64)
    rng = np.random.default_rng(7)
    for _ in range(parts.bit_length() - 1):
        halves = 2 * piece
        for p in range(int(piece.max()) + 1):
            rows = np.flatnonzero(piece == p)
            y = x[rows] - x[rows].mean(axis=0)
            v = rng.standard_normal(x.shape[1])
            for _ in range(8):
                v = y.T @ (y @ v)
                v /= np.linalg.norm(v) or 1.0
            halves[rows[np.argsort(y @ v, kind="stable")[len(rows) // 2 :]]] += 1
        piece = halves
    u = np.repeat(np.arange(n), graph.shape[1])
    v = graph.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    most, least = int(np.ceil(n / parts * (1 + slack))), int(np.floor(n / parts * (1 - slack)))
    size = np.bincount(piece, minlength=parts)
    for _ in range(rounds):
        near = np.bincount(u * parts + piece[v], minlength=n * parts).reshape(n, parts)
        to = near.argmax(axis=1)
        gain = near[np.arange(n), to] - near[np.arange(n), piece]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if size[to[i]] < most and size[piece[i]] > least:
                size[piece[i]] -= 1
                size[to[i]] += 1
                piece[i] = to[i]
                moved += 1
        if moved < n // 200:
            break
    return piece


def _forward(net: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.maximum(x @ net["a"] + net["b"], 0)
    z = h @ net["c"] + net["d"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return h, z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, target: np.ndarray, epochs: int = 24, batch: int = 128, rate: float = 0.01) -> dict:
    """A network of one hidden layer for the distribution ``target`` of each row (cross entropy, Adam)."""
    rng = np.random.default_rng(11)
    d, m = x.shape[1], target.shape[1]
    net = {
        "a": rng.standard_normal((d, HIDDEN)) * np.sqrt(2.0), "b": np.zeros(HIDDEN),
        "c": rng.standard_normal((HIDDEN, m)) / np.sqrt(HIDDEN), "d": np.zeros(m)
    }
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    t = 0
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            rows = order[a : a + batch]
            h, p = _forward(net, x[rows])
            dz = (p - target[rows]) / len(rows)
            dh = (dz @ net["c"].T) * (h > 0)
            grads = {"a": x[rows].T @ dh, "b": dh.sum(axis=0), "c": h.T @ dz, "d": dz.sum(axis=0)}
            t += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net[k] -= step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return net


def fit(x: np.ndarray) -> dict:
    """Network and share of probability to reach, from a sample of a part's vectors (unit rows)."""
    parts = PARTS
    while parts > 1 and len(x) < 8 * parts:
        parts //= 2
    if parts == 1:
        return {"parts": 1}
    held = np.zeros(len(x), bool)
    held[:: max(4, len(x) // 512)] = True
    base, asked = x[~held], x[held]
    graph = nearest(base, base, DEGREE, True)
    piece = balanced(base, graph, parts)
    target = np.full((len(base), parts), 1e-3)
    own = np.arange(len(base))
    for j in range(graph.shape[1]):
        target[own, piece[graph[:, j]]] += 1.0
    target[own, piece] += 1.0
    net = train(base, target / target.sum(axis=1, keepdims=True))
    where = _forward(net, base)[1].argmax(axis=1)  # vectors are indexed by the network, so recall is measured on its pieces
    p = _forward(net, asked)[1]
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
    ahead = np.empty_like(before)
    np.put_along_axis(ahead, order, before, 1)  # probability of all pieces that a query reaches before this one
    need = np.sort(np.take_along_axis(ahead, where[nearest(asked, base, 5, False)], 1).ravel())
    share = need[min(len(need) - 1, int(np.ceil(RECALL * len(need))) - 1)] + 1e-9
    return {"parts": parts, "share": float(share)} | {k: v.astype(np.float32) for k, v in net.items()}


def _networks(groups: DataFrame) -> DataFrame:
    def one(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        blob = pickle.dumps(fit(_unit(_matrix(t.column("vec")))[order]))
        return pa.table({"part": pa.array([part], pa.int64()), "net": pa.array([blob], pa.binary())})

    return groups.groupBy("part").applyInArrow(one, "part long, net binary")


def _blocks(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of a part in blocks of about ``BLOCK``, dealt by hash of the id."""
    salt = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.floor(F.col("n") / BLOCK))).alias("salt")
    dealt = rows.join(counts.select("part", "n"), "part").select("part", "id", "vec", salt)
    both = F.collect_list(F.struct("id", "vec")).alias("rows")
    return dealt.groupBy("part", "salt").agg(both).select(
        "part", "salt", F.col("rows.id").alias("ids"), F.col("rows.vec").alias("vecs")
    )


def _route(blocks: DataFrame, nets: DataFrame, kind: str, ask: bool) -> DataFrame:
    """part, id, vec with the piece of each vector, or with all pieces that a query must look at."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vecs = batch.column("ids")[i].values, batch.column("vecs")[i].values
                net, part = pickle.loads(batch.column("net")[i].as_py()), batch.column("part")[i].as_py()
                at, to = np.arange(len(ids)), np.zeros(len(ids), np.int64)
                if net["parts"] > 1:
                    p = _forward(net, _unit(_matrix(vecs)).astype(np.float32))[1].astype(np.float64)
                    to = p.argmax(axis=1)
                    if ask:
                        order = np.argsort(-p, axis=1, kind="stable")
                        own = np.take_along_axis(p, order, 1)
                        at, j = np.nonzero(np.cumsum(own, axis=1) - own <= net["share"])
                        to = order[at, j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part * PARTS + to), ids.take(pa.array(at)), vecs.take(pa.array(at))], ["part", "id", "vec"]
                )

    return blocks.join(nets, "part").select("part", "ids", "vecs", "net").mapInArrow(each, f"part long, id long, vec {kind}")


def _compare(blocks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, id, score: the k vectors nearest to each query within a leaf, from pairs of blocks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, queries = (batch.column(c)[i].values.to_numpy() for c in ("ids", "queries"))
                x, q = _matrix(batch.column("vecs")[i].values), _matrix(batch.column("asked")[i].values)
                s = _unit(q) @ _unit(x).T
                n = min(k, len(ids))
                edge = -np.partition(-s, n - 1, axis=1)[:, n - 1] - 1e-9  # whatever may be among the first after rounding
                a, b = np.nonzero(s >= edge[:, None])
                score = np.concatenate([exact(q[a[j : j + 4096]], x[b[j : j + 4096]]) for j in range(0, len(a), 4096)])
                order = np.lexsort((ids[b], -score, a))
                a, b, score = a[order], b[order], score[order]
                first = np.searchsorted(a, np.arange(len(q)))
                keep = np.arange(len(a)) - first[a] < n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries[a[keep]]), pa.array(ids[b[keep]]), pa.array(score[keep])], ["query", "id", "score"]
                )

    pairs = blocks.select("part", "ids", "vecs").join(
        asked.select("part", F.col("ids").alias("queries"), F.col("vecs").alias("asked")), "part"
    )
    return pairs.select("ids", "vecs", "queries", "asked").mapInArrow(each, "query long, id long, score double")


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with the same row of ``y``, in doubles."""
    dot = np.einsum("ij,ij->i", x, y)
    size = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
    with np.errstate(all="ignore"):
        out = dot / size
    odd = ~np.isfinite(size) | (size < 1e-280)  # squares left the range of doubles: from the directions
    if odd.any():
        out[odd] = np.einsum("ij,ij->i", _unit(x[odd]), _unit(y[odd]))
    return out


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec of the vectors that take part, padded to one length."""
    v = F.col("vec")
    ok = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull()).where(ok)
    rows = rows.groupBy("id").agg(F.min("vec").alias("vec"))
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    zero = F.lit(0).cast(rows.schema["vec"].dataType.elementType)  # type: ignore[attr-defined]
    return rows.withColumn("vec", F.concat("vec", F.array_repeat(zero, F.lit(longest) - F.size("vec"))))


def search(
    vectors: DataFrame, asks: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row for which ``asks``; a table in the shared folder."""
    spark = shared.prepare(vectors.sparkSession)
    with shared.scratch() as keep:
        rows = clean(vectors, id_col, vec_col)
        kind = rows.schema["vec"].dataType.simpleString()
        is_asked = vectors.where(asks).select(F.col(id_col).cast("long").alias("id")).distinct()
        rows = shared.table(rows.join(is_asked.withColumn("asks", F.lit(True)), "id", "left"), "vectors")
        # the least ids of equal vectors: Spark limits groups before they shuffle
        same = Window.partitionBy("vec")
        members = rows.withColumn("n", F.row_number().over(same.orderBy("id"))).where(F.col("n") <= k + 1)
        members = shared.table(members.select(F.min("id").over(same).alias("rep"), "id", "vec"), "members")
        level = members.where("id = rep").select(F.lit(1).cast("long").alias("part"), "id", "vec")
        asked = rows.where("asks").join(members.where("id = rep").select("rep", "vec"), "vec")
        asked = shared.table(asked.select(F.col("id").alias("query"), "rep"), "asked")
        reps = asked.select(F.col("rep").alias("id")).distinct()
        ask = members.join(reps, "id", "left_semi").where("id = rep")
        ask = ask.select(F.lit(1).cast("long").alias("part"), "id", "vec")

        # parts are numbered so that numbers of all levels differ: 1, then 16 to 31, then 256 to 511
        counts = shared.table(level.groupBy("part").agg(F.count("*").alias("n")), "counts")
        leaves, leaf_asks = level.where("false"), ask.where("false")
        while not counts.isEmpty():
            # by a hash of its own: the parts were formed by content
            chance = F.pmod(F.xxhash64("id", F.lit(99)), F.lit(1 << 30)) < F.lit(float(FIT << 30)) / F.col("n")
            nets = shared.table(_networks(level.join(counts, "part").where(chance).select("part", "id", "vec")), "nets")
            size = nets.agg(F.sum(F.octet_length("net"))).first()[0] or 0
            nets = F.broadcast(nets) if size <= BROADCAST_BYTES else nets
            asks_of = ask.groupBy("part").agg(F.count("*").alias("n"))
            level = shared.table(_route(_blocks(level, counts), nets, kind, False), "level")
            ask = shared.table(_route(_blocks(ask, asks_of), nets, kind, True), "ask")
            above = counts.select(F.col("part").alias("above"), F.col("n").alias("of"))
            counts = level.groupBy("part").agg(F.count("*").alias("n"))
            counts = counts.join(above, F.floor(F.col("part") / PARTS) == F.col("above"))
            # what a network could not divide is a leaf of many blocks
            counts = shared.table(counts.where(f"n > {LEAF} AND n < 0.9 * of").select("part", "n"), "counts")
            parts = counts.select("part")
            leaves = leaves.unionByName(level.join(parts, "part", "left_anti"))
            leaf_asks = leaf_asks.unionByName(ask.join(parts, "part", "left_anti"))
            level, ask = level.join(parts, "part", "left_semi"), ask.join(parts, "part", "left_semi")

        sizes = [x.groupBy("part").agg(F.count("*").alias("n")) for x in (leaves, leaf_asks)]
        found = _compare(_blocks(leaves, sizes[0]), _blocks(leaf_asks, sizes[1]), k + 1)
        first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        found = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
        near = found.select(F.col("query").alias("rep"), F.col("id").alias("near"), "score")
        near = near.join(members.select(F.col("rep").alias("near"), F.col("id").alias("vec_id")), "near")
        first = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
        near = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
        answers = asked.join(near.select("rep", "vec_id", "score"), "rep").where("vec_id <> query")
        first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        answers = answers.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        return keep(
            shared.table(answers.select(F.col("query").alias("query_id"), "rank", "vec_id", "score"), "neighbours")
        )

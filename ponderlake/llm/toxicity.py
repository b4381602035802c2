"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word (A-Z lower-cased): the embedding of the word itself, if frequent
in the training documents, and the scaled sum of embeddings of its character
n-grams (3 and 5 bytes, with marks for its ends, hashed).  Windows of ``WIDTH``
words overlap by half and cover every word of a text, whatever its length.  A
window's states are pooled by learned attention; its probability is logistic.  A
text scores the largest probability of its windows.

Training.  Labels are read only for rows whose ``crc32(doc_id as text) mod 3`` is
not 1.  The number of labelled rows is bounded: of each class the ``PER_CLASS``
documents with words that have the least ``md5(doc_id)``, of these the first that
have ``BYTES`` together; all windows of their whole texts are learnt from, in about
``STEPS`` steps whatever their number.  The loss is that of a noisy or
over a document's windows; gradients are worked out by hand (backpropagation
through time) and followed by Adam from fixed seeds.  The model has a bounded
size and travels to the executors with the function.  Nothing but the text
enters a score.

Defined results: null and empty texts, and texts without words, score 0; texts of
any length are scored whole, a block of them at a time; without labelled
documents of both classes every text with words scores 0.5 times the share of
toxic ones (and a warning says so if there are labels); repeated rows score
alike; of an id's several texts the least is learnt from, of its several labels
the greatest; a null doc_id counts as the text ''; labels without a document, or
documents without labels, are no error; an empty table gives an empty result;
columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .textops import LOWER, U64, Block, blocks, mix

PER_CLASS = 1000
WIDTH, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 8, 8, 8, 8
VOCABULARY, GRAM_BITS, GRAMS = 4000, 14, (3, 5)
#: Steps of training, whatever the number of documents; documents of a step.
STEPS, BATCH, RATE = 378, 32, 0.012
#: Bytes of the texts of a class that are learnt from.
BYTES = 32 << 20
THRESHOLD, HELD_OUT, FOLDS = 0.7, 1, 3
f32 = np.float32


class Words:
    """Distinct words of a block: hash, place of each word in them, and n-gram buckets."""

    def __init__(self, b: Block):
        h = b.hashes()
        self.hash, first, self.of = np.unique(h, return_index=True, return_inverse=True)
        start, size = b.start[first], (b.end - b.start)[first]
        low = LOWER[b.data].astype(U64)
        # each distinct word framed by marks, one after another
        n = size + 2
        at = np.concatenate([[0], np.cumsum(n)])
        flat = np.full(int(at[-1]), 257, U64)
        own = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(flat)) - at[own]
        body = (inner > 0) & (inner < n[own] - 1)
        flat[body] = low[(start[own] + inner - 1)[body]]
        grams, owner = [], []
        for k in GRAMS:
            code, ok = np.zeros(len(flat), U64), inner <= n[own] - k
            for j in range(k):
                code = code * U64(0x9E3779B97F4A7C15) + np.roll(flat, -j)
            grams.append((mix(code[ok] + U64(k)) >> U64(64 - GRAM_BITS)).astype(np.int64))
            owner.append(own[ok])
        grams, owner = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.grams, self.owner = grams[order], owner[order]
        self.n_grams = np.bincount(self.owner, minlength=len(n))
        self.scale = (1 / np.sqrt(np.maximum(self.n_grams, 1))).astype(f32)[:, None]


def window_starts(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word in it, and length of every window."""
    n = np.where(count > 0, np.maximum(1, -(-(count - WIDTH) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(len(count)), n)
    at = (np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)) * STRIDE
    return doc, at, np.minimum(WIDTH, count[doc] - at)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        self.vocabulary = np.sort(vocabulary)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(f32)
        self.p = {
            "word": (
                r.normal(size=(len(vocabulary) + 1, WORD_DIM)) * 0.1
            ).astype(f32), "char": (r.normal(size=(1 << GRAM_BITS, CHAR_DIM)) * 0.1).astype(f32),
            "wf": draw(d, 3 * h), "uf": draw(h, 3 * h), "bf": np.zeros(
                3 * h, f32
            ), "wb": draw(d, 3 * h), "ub": draw(h, 3 * h), "bb": np.zeros(3 * h, f32),
            "att": draw(
                2 * h, ATTEND
            ), "v": draw(ATTEND, 1)[:, 0], "out": draw(2 * h, 1)[:, 0], "bias": np.array([-3], f32),
        }
        self.m = {k: np.zeros_like(x) for k, x in self.p.items()}
        self.s = {k: np.zeros_like(x) for k, x in self.p.items()}
        self.t = 0

    def inputs(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Input vector of each distinct word, and its place in the vocabulary (last: unknown)."""
        n = len(self.vocabulary)
        at = np.searchsorted(self.vocabulary, w.hash)
        known = (at < n) & (self.vocabulary[np.minimum(at, n - 1)] == w.hash) if n else np.zeros(len(at), bool)
        ids = np.where(known, at, n)
        sums = np.add.reduceat(
            self.p["char"][w.grams], np.concatenate([[0], np.cumsum(w.n_grams)[:-1]])
        ) if len(w.hash) else np.zeros((0, CHAR_DIM), f32)
        return np.concatenate([self.p["word"][ids], sums * w.scale], 1), ids

    def _run(
        self, proj: np.ndarray, index: np.ndarray, mask: np.ndarray | None, d: str, keep: list | None
    ) -> np.ndarray:
        """States [step, window, hidden] in one direction; index [window, step] into proj."""
        u, n, h = self.p["u" + d], len(index), HIDDEN
        out = np.empty((WIDTH, n, h), f32)
        state = np.zeros((n, h), f32)
        for t in range(WIDTH) if d == "f" else range(WIDTH - 1, -1, -1):
            x, g = proj[index[:, t]], state @ u
            zr = _sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = 2 * _sigmoid(2 * (x[:, 2 * h :] + r * g[:, 2 * h :])) - 1
            nxt = new + z * (state - new)
            if mask is not None:
                nxt = np.where(mask[:, t, None], nxt, state)
            if keep is not None:
                keep.append((t, state, z, r, new, g[:, 2 * h :]))
            state = out[t] = nxt
        return out

    def forward(self, x: np.ndarray, index: np.ndarray, size: np.ndarray, store: dict | None = None) -> np.ndarray:
        """Logit of each window; x: inputs of distinct words, index [window, step]."""
        mask = None if (size == WIDTH).all() else np.arange(WIDTH) < size[:, None]
        kf, kb = ([], []) if store is not None else (None, None)
        h = np.concatenate(
            [self._run(x @ self.p["w" + d] + self.p["b" + d], index, mask, d, k) for d, k in (("f", kf), ("b", kb))], 2
        )
        a = np.tanh(h @ self.p["att"])
        e = a @ self.p["v"]
        if mask is not None:
            e = np.where(mask.T, e, f32(-1e9))
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        c = (e[:, :, None] * h).sum(0)
        if store is not None:
            store |= {"mask": mask, "f": kf, "b": kb, "h": h, "a": a, "e": e, "c": c, "x": x, "index": index}
        return c @ self.p["out"] + self.p["bias"][0]

    def backward(self, s: dict, d: np.ndarray, w: Words, ids: np.ndarray) -> dict[str, np.ndarray]:
        p, h, g = self.p, HIDDEN, {}
        g["bias"], g["out"] = d.sum(keepdims=True), s["c"].T @ d
        dc = d[:, None] * p["out"]
        dh = s["e"][:, :, None] * dc
        de = (s["h"] * dc).sum(2)
        ds = s["e"] * (de - (s["e"] * de).sum(0))
        g["v"] = np.tensordot(ds, s["a"], ([0, 1], [0, 1]))
        da = ds[:, :, None] * p["v"] * (1 - s["a"] ** 2)
        g["att"] = np.tensordot(s["h"], da, ([0, 1], [0, 1]))
        dh = dh + da @ p["att"].T
        dx = np.zeros_like(s["x"])
        for name, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, carry = p["u" + name], np.zeros((len(d), h), f32)
            du, rows, places = np.zeros_like(u), [], []
            for t, prev, z, r, new, gn in reversed(s[name]):
                total = dh[t][:, part] + carry
                passed = 0
                if s["mask"] is not None:
                    m = s["mask"][:, t, None]
                    passed, total = np.where(m, 0, total), np.where(m, total, 0)
                dn = total * (1 - z) * (1 - new**2)
                dz, dr = total * (prev - new) * z * (1 - z), dn * gn * r * (1 - r)
                inner = np.concatenate([dz, dr, dn * r], 1)
                du += prev.T @ inner
                carry = total * z + inner @ u.T + passed
                rows.append(np.concatenate([dz, dr, dn], 1))
                places.append(s["index"][:, t])
            rows, places = np.concatenate(rows), np.concatenate(places)
            proj = np.stack([np.bincount(places, rows[:, j], len(dx)) for j in range(3 * h)], 1).astype(f32)
            g["u" + name], g["b" + name], g["w" + name] = du, proj.sum(0), s["x"].T @ proj
            dx += proj @ p["w" + name].T
        g["word"] = np.stack([np.bincount(ids, dx[:, j], len(p["word"])) for j in range(WORD_DIM)], 1)
        each = (dx[:, WORD_DIM:] * w.scale)[w.owner]
        g["char"] = np.stack([np.bincount(w.grams, each[:, j], len(p["char"])) for j in range(CHAR_DIM)], 1)
        return g

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, x in self.p.items():
            d = g[k].astype(f32) + 1e-5 * x
            self.m[k] += 0.1 * (d - self.m[k])
            self.s[k] += 0.01 * (d * d - self.s[k])
            x -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.99**self.t)) + 1e-7)


def _block(texts: list[str]) -> Block:
    raw = [x.encode() for x in texts]
    return Block(
        np.frombuffer(b"".join(raw), np.uint8),
        np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64),
        fold=True
    )


def _index(b: Block, of: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return of[np.minimum((b.first[doc] + at)[:, None] + np.arange(WIDTH), len(of) - 1)]


def train(texts: list[str], toxic: np.ndarray, seed: int = 11) -> Network:
    """Fit on whole texts with labels 0 and 1; classes weigh the same."""
    has = [i for i, x in enumerate(texts) if x.strip(" \t\n\v\f\r")]
    texts, toxic = [texts[i] for i in has], toxic[has]
    b = _block(texts)
    h, doc = b.hashes(), b.doc_of_word()
    u, n = np.unique(np.unique(np.stack([h, doc.astype(U64)], 1), axis=0)[:, 0], return_counts=True)
    often = np.argsort(-n, kind="stable")[:VOCABULARY]
    net = Network(u[often[n[often] >= 3]])
    order, r = np.arange(len(texts)), np.random.default_rng(seed)
    weight = np.where(
        toxic == 1, len(toxic) / 2 / max(1, (toxic == 1).sum()), len(toxic) / 2 / max(1, (toxic == 0).sum())
    )
    rounds = max(1, round(STEPS / max(1, -(-len(texts) // BATCH))))
    for epoch in range(rounds):
        r.shuffle(order)
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            part = _block([texts[j] for j in pick])
            w = Words(part)
            x, ids = net.inputs(w)
            d, at, size = window_starts(part.counts)
            s: dict = {}
            prob = _sigmoid(net.forward(x, _index(part, w.of, d, at), size, s).astype(float))
            none = np.exp(np.bincount(d, np.log1p(-np.minimum(prob, 1 - 1e-7)), len(pick)))
            some = np.maximum(1 - none, 1e-7)
            y = toxic[pick]
            grad = np.where(y[d] == 1, -prob * (none / some)[d], prob) * weight[pick][d] / len(pick)
            net.step(net.backward(s, grad.astype(f32), w, ids), RATE * (1 - 0.85 * epoch / rounds))
    net.m = net.s = {}
    return net


def score_block(net: Network, b: Block) -> np.ndarray:
    """Largest window probability of each document."""
    out = np.zeros(b.n)
    if not len(b.start):
        return out
    w = Words(b)
    x, _ = net.inputs(w)
    doc, at, size = window_starts(b.counts)
    order = np.argsort(size != WIDTH, kind="stable")
    full = int((size == WIDTH).sum())
    for lo, hi in ((0, full), (full, len(order))):
        for i in range(lo, hi, 2048):
            pick = order[i : min(i + 2048, hi)]
            # only the words of these windows are projected
            index = _index(b, w.of, doc[pick], at[pick])
            used, index = np.unique(index, return_inverse=True)
            np.maximum.at(
                out,
                doc[pick],
                _sigmoid(net.forward(x[used], index.reshape(len(pick), WIDTH), size[pick]).astype(float))
            )
    return out


def _remainder(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % FOLDS for x in ids.to_pylist()], np.int64)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[str], np.ndarray]:
    """Whole texts and labels of the bounded training sample, in a fixed order."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.where(
        (rest != HELD_OUT) & F.col("toxic").isin(0, 1)
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    worded = docs.where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    known = usable.join(worded.select("doc_id"), "doc_id", "left_semi")
    place = F.md5(F.col("doc_id").cast("string"))
    first = [known.where(F.col("toxic") == c).orderBy(place, "doc_id").limit(per_class) for c in (0, 1)]
    ids = F.broadcast(first[0].unionByName(first[1]))  # 2 * per_class rows at most
    own = worded.join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy("place", "doc_id"))
    with shared.scratch():
        own = shared.table(own.withColumn("place", F.md5(F.col("doc_id").cast("string"))), "sample")
        rows = own.withColumn("upto", upto).where(F.col("upto") <= BYTES).select("doc_id", "toxic", "text").collect()
    rows.sort(key=lambda r: r["doc_id"])
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    if rows and len(set(toxic.tolist())) < 2:
        warnings.warn(
            f"all {len(rows)} labelled documents outside the held-out part have toxic = {toxic[0]}: nothing is learnt",
            stacklevel=3
        )
    return [r["text"] for r in rows], toxic


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    shared.prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts, toxic = sample(docs, labels)
    net = train(texts, toxic) if len(set(toxic.tolist())) == 2 else None
    prior = 0.5 * float(toxic.mean()) if len(toxic) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in blocks(batches, size=2 << 20):
            b = Block(data, off, fold=True)
            s = score_block(net, b) if net else np.where(b.counts > 0, prior, 0.0)
            ids = rows.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(_remainder(ids) == HELD_OUT), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"]
            )

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

"""Language-model scores by deleted interpolation.

Tokens of a text: its words with A-Z lower-cased, then one end.  Documents whose
``crc32(doc_id as text) mod 10`` is not 0 are the training documents.  The model
mixes maximum-likelihood estimates,

    P(w | v) = l2[k] * c(v, w) / c(v) + l1[k] * c(w) / N + l0[k] / (V + 1),

with weights for each bucket k of the context's frequency c(v) (powers of two).
The weights are learned by expectation-maximisation on held-out counts: the
training documents with remainder ``DEV`` are scored with the counts of the other
training documents.  Their events are aggregated into cells of
(k, bigram estimate, unigram estimate), estimates in steps of 1/``STEP`` of a
power of two, so that the driver gets a table of bounded size however large the
corpus; the counts used for scoring are those of all training documents.

Counting by request and answer.  A task turns about ``FLUSH`` bytes of text into
one row with the local numbers of its tokens, and asks for the counts of its
distinct tokens and bigrams: one packed row for each bucket of hash values, which
also carries what it has counted itself.  A bucket adds up and answers in the
order asked.  A frequent word is one entry for each ``FLUSH`` bytes, so no key is
hot; nothing is capped and every token of every text is counted.  The number of
buckets follows the bytes of all texts (``PER_BUCKET``), so a bucket stays as
large at any size.  A bucket is a range of hashes, and n-grams are told apart by
all 64 bits at any size: sent are the differences of a flush's sorted hashes, whose
size depends on the flush alone, not on the number of buckets.  Requests and token
numbers go through one shuffle, and only token numbers and answers are kept.

Defined results: null and empty texts have one token, the end; texts of any
length are scored whole, one by one if longer than a flush; a null doc_id counts
as the text ''; repeated rows are counted and scored each, ties don't occur;
without training documents every count is 0 and the score is log10(1 / (V + 1)) a
token; an empty table gives an empty result; columns besides id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .textops import U64, Block, blocks, mix, mix_int

FLUSH = 6 << 20
#: Bytes of text for each bucket.
PER_BUCKET = 5 << 20
DEV, FOLDS = 1, 10
STEP, FREQUENCIES = 8, 24
_END, _BEGIN = U64(mix_int(0x656E64)), U64(mix_int(0x626567))
_HELD = "bucket int, flush long, a binary, b binary, c binary, d binary"
_SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)
_NAMES = [x.split()[0] for x in _HELD.split(", ")]


def fold(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % FOLDS for x in ids.to_pylist()], np.int64)


def bucket_of(key: np.ndarray, n_buckets: int) -> np.ndarray:
    """Ranges of keys of equal size, in order."""
    return (((key >> U64(32)) * U64(n_buckets)) >> U64(32)).astype(np.int64)


def first_key(bucket: np.ndarray, n_buckets: int) -> np.ndarray:
    """The least key of each bucket."""
    return (((bucket.astype(U64) << U64(32)) + U64(n_buckets - 1)) // U64(n_buckets)) << U64(32)


class Local:
    """Distinct tokens and bigrams of a flush, in the order in which they are asked for."""

    def __init__(self, hashes: np.ndarray, token: np.ndarray, count: np.ndarray, n_buckets: int):
        self.n = len(hashes)
        doc = np.repeat(np.arange(len(count)), count)
        before = np.append(self.n, token[:-1])
        before[np.append(True, doc[1:] != doc[:-1])] = self.n
        self.before = before
        pair, self.bigram = np.unique(before.astype(np.int64) * (self.n + 1) + token, return_inverse=True)
        self.left, self.right = pair // (self.n + 1), pair % (self.n + 1)
        left = np.append(hashes, _BEGIN)[self.left]
        asked = np.concatenate(
            [hashes, mix(left * U64(0x9E3779B97F4A7C15) + mix(hashes[self.right] if len(pair) else hashes[:0]))]
        )
        # the lowest bit tells tokens from bigrams
        asked = asked & ~U64(1) | (np.arange(len(asked)) < self.n).astype(U64)
        self.order = np.argsort(asked, kind="stable")
        self.asked = asked[self.order]
        self.bucket = bucket_of(self.asked, n_buckets)

    def counts(self, answered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts by token and by bigram from answers in the order asked."""
        out = np.empty(len(answered), answered.dtype)
        out[self.order] = answered
        return out[: self.n], out[self.n :]


_WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def _squeeze(blob: bytes) -> bytes:
    """A blob with its size, compressed: counts and token numbers are small and uneven, which the shuffle's codec leaves."""
    return len(blob).to_bytes(4, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def _loosen(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:4], "little")
    return pa.decompress(blob[4:], decompressed_size=size, codec="zstd", asbytes=True)


def _narrow(x: np.ndarray, span: list[tuple[int, int]]) -> list[bytes]:
    """Each span's counts as bytes, as narrow as its largest allows."""
    top = np.maximum.reduceat(x, [a for a, _ in span])
    width = np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, np.where(top < 1 << 32, 4, 8))).tolist()
    raw = {w: x.astype(_WIDTHS[w]).tobytes() for w in set(width)}
    return [_squeeze(raw[w][w * a : w * e]) for (a, e), w in zip(span, width, strict=True)]


def _widen(blob: bytes, n: int) -> np.ndarray:
    blob = _loosen(blob)
    return np.frombuffer(blob, _WIDTHS[len(blob) // n]).astype(np.int64)


def _gather(n_buckets: int):
    def pack(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], flush: int) -> Iterator[pa.RecordBatch]:
        ids, null, count, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        unique, token = np.unique(hashes, return_inverse=True)
        often = np.argsort(-np.bincount(token), kind="stable")  # small numbers for frequent tokens
        place = np.empty(len(often), np.int64)
        place[often] = np.arange(len(often))
        unique, token = unique[often], place[token]
        local = Local(unique, token, count, n_buckets)
        part = np.repeat(np.where(null, zlib.crc32(b"") % FOLDS, fold(pa.array(ids))), count)
        sums = [
            np.concatenate(
                [np.bincount(token[m], minlength=local.n), np.bincount(local.bigram[m], minlength=len(local.left))]
            )[local.order]
            for m in (part != 0, part == DEV)
        ]
        heads = np.flatnonzero(np.append(True, local.bucket[1:] != local.bucket[:-1]))
        span = list(zip(heads.tolist(), np.append(heads[1:], len(local.bucket)).tolist(), strict=True))
        steps = np.diff(local.asked, prepend=U64(0))
        steps[heads] = local.asked[heads] - first_key(local.bucket[heads], n_buckets)
        top = np.maximum.reduceat(steps, heads)
        width = (4 + sum((top >= U64(1 << bits)).astype(np.int64) for bits in (32, 40, 48, 56))).tolist()
        by = {w: np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :w]).tobytes() for w in set(width)}
        keys = [by[w][w * a : w * e] for (a, e), w in zip(span, width, strict=True)]
        bins = [keys, *(_narrow(x, span) for x in sums), [np.int64(e - a).tobytes() for a, e in span]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(local.bucket[heads].astype(np.int32)), pa.array([flush] * len(heads), pa.int64()),
                *(pa.array(x, pa.binary()) for x in bins)
            ],
            names=_NAMES
        )
        planes = np.ascontiguousarray(
            token.astype(np.uint32).view(np.uint8).reshape(-1, 4).T[: 3 if local.n < 1 << 24 else 4]
        ).tobytes()
        docs = pa.array([np.concatenate([ids, null.astype(np.int64)]).tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-1 - mix_int(flush) % n_buckets], pa.int32()), pa.array([flush], pa.int64()), docs,
                pa.array([count.astype(np.int64).tobytes()], pa.binary()), pa.array([unique.tobytes()], pa.binary()),
                pa.array([_squeeze(planes)], pa.binary())
            ],
            names=_NAMES
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        flush = TaskContext.get().partitionId() << 32
        for rows, data, off in blocks(batches):
            b = Block(data, off, fold=True)
            hashes = np.insert(b.hashes(), b.first[1:], _END)
            col = rows.column("doc_id")
            held.append((np.asarray(col.fill_null(0)), np.asarray(col.is_null()), b.counts + 1, hashes))
            size += len(data) + 64 * b.n
            if size >= FLUSH:
                yield from pack(held, flush)
                held, size, flush = [], 0, flush + 1
        if held:
            yield from pack(held, flush)

    return run


def _answer(p: pd.DataFrame) -> pd.DataFrame:
    """Counts over all flushes, in the order of each request; and this bucket's tokens and types.  Rows that ask nothing pass.

    Keys count from the bucket's first one.
    """
    if p["bucket"].iat[0] < 0:
        return p
    sizes = np.frombuffer(b"".join(p["d"]), np.int64)
    key = np.zeros(int(sizes.sum()), np.uint64)
    at = 0
    for x, n in zip(p["a"], sizes.tolist(), strict=True):
        width = len(x) // n
        steps = np.zeros((n, 8), np.uint8)
        steps[:, :width] = np.frombuffer(x, np.uint8).reshape(n, width)
        key[at : at + n] = np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)
        at += n
    unique, at = np.unique(key, return_inverse=True)
    out = [
        np.bincount(
            at, np.concatenate([_widen(x, n) for x, n in zip(p[c], sizes.tolist(), strict=True)]), len(unique)
        ).astype(np.int64)
        for c in ("b", "c")
    ]
    word = (unique & U64(1)) > 0
    fit = out[0] - out[1]
    total = np.array([out[0][word].sum(), (out[0][word] > 0).sum(), fit[word].sum(), (fit[word] > 0).sum()], np.int64)
    cut = np.concatenate([[0], np.cumsum(sizes)])
    span = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    per = [_narrow(x[at], span) for x in out]
    rows = pd.DataFrame({"bucket": p["bucket"], "flush": p["flush"], "a": None, "b": per[0], "c": per[1], "d": None})
    return pd.concat(
        [
            rows,
            pd.DataFrame(
                {
                    "bucket": p["bucket"].iloc[:1], "flush": [-1], "a": [None], "b": [total.astype(">i8").tobytes()],
                    "c": [b""], "d": [None]
                }
            )
        ]
    )


def _shares(two: np.ndarray, left: np.ndarray, one: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequency bucket of the context, bigram and unigram estimates."""
    k = np.minimum(np.ceil(np.log2(left + 1)).astype(np.int64), FREQUENCIES - 1)
    return k, two / np.maximum(left, 1), one / max(n, 1)


def _opened(row: dict, n_buckets: int) -> tuple[Local, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["a"], np.int64)
    count = np.frombuffer(row["b"], np.int64)
    planes = np.frombuffer(_loosen(row["d"]), np.uint8).reshape(-1, int(count.sum()))
    token = sum(x.astype(np.int64) << (8 * i) for i, x in enumerate(planes))
    return Local(
        np.frombuffer(row["c"], np.uint64), token, count, n_buckets
    ), token, count, ids[: len(count)], ids[len(count) :] > 0


def _answers(row: dict, which: str, local: Local) -> np.ndarray:
    """Counts in the order asked."""
    size = np.bincount(local.bucket).tolist()
    return np.concatenate(
        [_widen(x[which], size[x["bucket"]]) for x in sorted(row["answers"], key=lambda x: x["bucket"])]
    )


def _cells(n_buckets: int, n: int, docs: int):
    """Held-out events by cell: frequency bucket, steps of the two estimates below 1 (-1: zero)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                local, token, count, ids, null = _opened(row, n_buckets)
                part = np.repeat(np.where(null, 0, fold(pa.array(ids))), count)
                dev = np.flatnonzero(part == DEV)
                one, two = local.counts(_answers(row, "b", local) - _answers(row, "c", local))  # without the held-out documents
                left = np.append(one, docs)[local.before]
                k, p2, p1 = _shares(two[local.bigram][dev], left[dev], one[token][dev], n)
                q = [
                    np.where(p > 0, np.rint(-STEP * np.log2(np.maximum(p, 1e-300))), -1).astype(np.int64)
                    for p in (p2, p1)
                ]
                cell, events = np.unique(k << 40 | (q[0] + 1) << 20 | (q[1] + 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(events)], names=["cell", "events"])

    return run


def fit_weights(cell: np.ndarray, events: np.ndarray, types: int, rounds: int = 60) -> np.ndarray:
    """Weights (zero-, one-, two-word) for each frequency bucket, by expectation-maximisation."""
    k, q2, q1 = cell >> 40, (cell >> 20 & 0xFFFFF) - 1, (cell & 0xFFFFF) - 1
    p = np.stack(
        [
            np.full(len(cell), 1 / (types + 1)), np.where(q1 < 0, 0, 2.0 ** (-q1 / STEP)),
            np.where(q2 < 0, 0, 2.0 ** (-q2 / STEP))
        ],
        1
    )
    out = np.tile([0.1, 0.6, 0.3], (FREQUENCIES, 1))
    out[0] = [0.3, 0.7, 0.0]  # contexts never seen have no bigrams
    for j in range(FREQUENCIES):
        x, n = p[k == j], events[k == j]
        if not len(x):
            if j > 1:
                out[j] = out[j - 1]
            continue
        for _ in range(rounds):
            share = out[j] * x
            share *= (n / share.sum(1))[:, None]
            out[j] = share.sum(0) / n.sum()
        out[j] = (out[j] + 1e-6) / (1 + 3e-6)  # no event of positive estimate becomes impossible
        if not j:
            out[j] /= out[j][:2].sum()
            out[j][2] = 0
    return out


def _score(n_buckets: int, n: int, types: int, docs: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                local, token, count, ids, null = _opened(row, n_buckets)
                one, two = local.counts(_answers(row, "b", local))
                base = np.log10((one + 0.1) / (n + 0.1 * (types + 1)))[token]
                # a bigram's probability is worked out once for each distinct one
                k, p2, p1 = _shares(two, np.append(one, docs)[local.left], one[local.right], n)
                w = weights[k]
                model = np.log10(w[:, 0] / (types + 1) + w[:, 1] * p1 + w[:, 2] * p2)[local.bigram]
                at = np.concatenate([[0], np.cumsum(count)])[:-1]
                held = np.where(null, zlib.crc32(b"") % FOLDS, fold(pa.array(ids))) == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=null),
                        pa.array(held),
                        pa.array(count),
                        pa.array(np.add.reduceat((one[token] > 0).astype(np.int64), at)),
                        pa.array(np.full(len(ids), n, np.int64)),
                        pa.array(np.add.reduceat(base, at)),
                        pa.array(np.add.reduceat(model, at))
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``, as a table."""
    spark = shared.prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_buckets = shared.buckets(spark, shared.text_bytes(docs), PER_BUCKET)
    with shared.scratch() as keep:
        asked = docs.mapInArrow(_gather(n_buckets), _HELD)
        held = shared.table(asked.groupBy("bucket").applyInPandas(_answer, _HELD), "flushes")
        answers = held.where("bucket >= 0")
        four = (F.conv(F.hex(F.substring("b", 1 + 8 * i, 8)), 16, 10).cast("long") for i in range(4))
        sums = answers.where("flush = -1").agg(*[F.sum(x) for x in four]).first()
        n, types, n_fit, types_fit = (x or 0 for x in sums)
        rest = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
        fit = F.count_if(F.expr(f"r <> 0 AND r <> {DEV}"))
        train, fit = docs.select(rest.alias("r")).agg(F.count_if(F.col("r") != 0), fit).first()
        got = F.collect_list(F.struct("bucket", "b", "c")).alias("answers")  # a flush has a bounded number of n-grams
        got = answers.where("flush <> -1").groupBy("flush").agg(got)
        full = held.where("bucket < 0").select("flush", "a", "b", "c", "d").join(got, "flush")
        with shared.conf(spark, maxRecordsPerBatch="1"):  # a row holds a flush
            cells = full.mapInArrow(_cells(n_buckets, n_fit, fit), "cell long, events long")
            cells = cells.groupBy("cell").agg(F.sum("events").alias("events")).toPandas()
            weights = fit_weights(cells["cell"].to_numpy(np.int64), cells["events"].to_numpy(float), types_fit)
            scored = full.mapInArrow(_score(n_buckets, n, types, train, weights), _SCORED)
            return keep(shared.table(scored, "scores"))

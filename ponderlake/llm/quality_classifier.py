"""Quality by importance resampling of hashed n-gram models.

Two generative models of n-grams hashed into ``BUCKETS``: the target, fitted on
a sample of documents labelled good, and the raw corpus, fitted on all
documents.  A document's importance weight is the product over its n-grams of
target over raw probability.  Documents are drawn without replacement by Gumbel
top-k: the k largest of log weight + Gumbel noise are a sample with
probabilities proportional to the weights.  k is the share of good documents
among the labelled, plus ``MARGIN``, of all documents with words.

N-grams: words and neighbouring words (A-Z lower-cased), and, so that the models
see form where words are rare, shapes and neighbouring shapes.  A word's shape
is its classes of bytes in order of first appearance (letters, digits, symbols
``#*$%&|<>``, marks), its length up to 3 and whether it repeats the word before.

The sample of labelled rows is bounded: of each class the ``PER_CLASS`` ids with
the least ``md5(doc_id)``.  Everything else covers all data: raw counts are
summed over all documents (``BUCKETS`` sums, whatever the corpus), and the k-th
largest key is found exactly by counting keys in ever finer intervals, so no
sort and no list of documents reaches one task or the driver.

Defined results: null and empty texts, and texts without words, have log weight
0 (an empty product), no key, and are never drawn; texts of any length are
weighed whole; ties at the k-th key are all kept; repeated rows get equal keys; of
an id's several labels the greatest counts; a null doc_id has noise like the text
''; without labels of both classes all is kept; an empty table gives an empty
result; columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .textops import U64, Block, blocks, mix, mix_int

BUCKETS, PER_CLASS, MARGIN = 1 << 14, 5000, 0.01
#: Keys left when the search for the k-th stops counting and sorts.
FEW = 5000
_CLASS = np.ones(256, np.uint8)  # bytes of letters beyond ASCII count as letters
_CLASS[list(range(33, 48)) + list(range(58, 65)) + list(range(91, 97)) + list(range(123, 127))] = 8
_CLASS[list(range(48, 58))] = 2
_CLASS[list(b"#*$%&|<>")] = 4


def ngrams(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a block and the document of each."""
    h, doc = b.hashes(), b.doc_of_word()
    kinds = _CLASS[b.data]
    classes = np.zeros(len(h), np.uint8)
    for bit in (1, 2, 4, 8):
        sums = np.concatenate([[0], np.cumsum((kinds & bit) > 0)])
        classes |= ((sums[b.end] - sums[b.start]) > 0).astype(np.uint8) * np.uint8(bit)
    pair = np.append(False, doc[1:] == doc[:-1]) if len(h) else np.zeros(0, bool)
    same = pair & (h == np.roll(h, 1))
    shape = mix(
        classes.astype(U64) | (np.minimum(b.end - b.start, 3).astype(U64) << U64(8)) | (same.astype(U64) << U64(16))
    )
    out, owner = [], []
    for x, seed in ((h, mix_int(1)), (shape, mix_int(2))):
        two = mix(np.roll(x, 1) * U64(0x9E3779B97F4A7C15) + x)[pair]
        out += [x ^ U64(seed), two ^ U64(mix_int(seed))]
        owner += [doc, doc[pair]]
    return (mix(np.concatenate(out)) % U64(BUCKETS)).astype(np.int64), np.concatenate(owner)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts by model: 0 raw, 1 target, and by model its documents in bucket -1, labelled ones under 2."""
    sums, docs = np.zeros((2, BUCKETS), np.int64), np.zeros(3, np.int64)
    for rows, data, off in blocks(batches):
        b = Block(data, off, fold=True)
        bucket, owner = ngrams(b)
        label = np.asarray(rows.column("quality").fill_null(-1))
        sums[0] += np.bincount(bucket, minlength=BUCKETS)
        sums[1] += np.bincount(bucket[label[owner] == 1], minlength=BUCKETS)
        docs += [b.n, int((label == 1).sum()), int((label >= 0).sum())]
    model, at = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(model, [0, 1, 2]).astype(np.int32)),
            pa.array(np.append(at, [-1, -1, -1]).astype(np.int32)), pa.array(np.append(sums[model, at], docs))
        ],
        names=["model", "bucket", "n"]
    )


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Log ratio of target to raw probability for each bucket, and the share of good documents among labelled ones."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good, all_ = usable.agg(F.count_if(F.col("quality") == 1), F.count("*")).first()
    if not good or good == all_:
        return np.zeros(BUCKETS), 1.0
    ids = usable.where("quality = 1").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(per_class)
    x = docs.join(F.broadcast(ids), "doc_id", "left").select("text", "quality")  # per_class ids at most
    rows = x.mapInArrow(
        _counts, "model int, bucket int, n long"
    ).groupBy("model", "bucket").agg(F.sum("n").alias("n")).where("bucket >= 0").toPandas()
    counts = np.zeros((2, BUCKETS))
    counts[rows["model"].to_numpy(), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    p = (counts + 1) / (counts + 1).sum(1, keepdims=True)
    # the fewer n-grams of the corpus a bucket holds, the less its ratio is trusted: those held once count half
    ratio = np.log(p[1] / p[0]) * (counts[0] / (counts[0] + 1))
    return ratio, good / all_


def log_weight(ratio: np.ndarray):
    """Column function: log importance weight of a text."""

    @F.pandas_udf("double")
    def weigh(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = []
            batch = pa.RecordBatch.from_arrays([pa.array(s, pa.string())], names=["text"])
            for _, data, off in blocks(iter([batch])):
                b = Block(data, off, fold=True)
                bucket, owner = ngrams(b)
                out.append(np.bincount(owner, ratio[bucket], b.n))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return weigh


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the id and the seed."""
    u = (
        F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 52)) + 0.5
    ) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, n: int) -> float:
    """The k-th largest of the n values of column ``key``, exactly, by counting."""
    if k >= n:
        return float("inf") if not n else keys.agg(F.min("key")).first()[0]
    low, high, above = *keys.agg(F.min("key"), F.max("key")).first(), 0
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / 1024
        if width <= 0:
            return high
        counts = inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(1023)).alias("bin")).agg(
            F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")
        ).toPandas().sort_values("bin", ascending=False)
        for n_bin, a, b in zip(counts["n"], counts["a"], counts["b"], strict=True):
            if above + n_bin >= k:
                break
            above += int(n_bin)
        if n_bin <= FEW:
            x = np.sort(keys.where((F.col("key") >= a) & (F.col("key") <= b)).toPandas()["key"].to_numpy())
            return float(x[len(x) - (k - above)])
        low, high = float(a), float(b)


def keyed(docs: DataFrame, labels: DataFrame, seed: int, margin: float, carry: list[str]) -> tuple[DataFrame, float]:
    """Columns to ``carry`` of ``docs`` (doc_id, text and any others) in ``row``, log weight ``w`` and ``key``, as a table; the least key drawn."""
    shared.prepare(docs.sparkSession)
    ratio, share = fit(docs.select("doc_id", "text"), labels)
    text = F.coalesce("text", F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    worded = F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")).alias("worded")
    weighed = docs.select(row, worded, log_weight(ratio)(text).alias("w"))
    key = F.when(F.col("worded"), F.col("w") + gumbel(F.col("row.doc_id"), seed)).alias("key")
    out = shared.table(weighed.select("row", "w", key), "keys")
    if share == 1:
        return out, float("-inf")
    n = out.agg(F.count("key")).first()[0]
    return out, kth_largest(out.where("key IS NOT NULL"), min(n, int(np.ceil(n * (share + margin)))), n)


def drawn(least: float) -> Column:
    """Whether a row is among those drawn."""
    return F.lit(True) if least == float("-inf") else F.coalesce(F.col("key") >= least, F.lit(False))


def resample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, margin: float = MARGIN
) -> DataFrame:
    """doc_id, log_weight, key, kept: one row per row of ``docs``; a table in the shared folder."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with shared.scratch() as keep:
        keys, least = keyed(docs, labels, seed, margin, ["doc_id"])
        out = keys.select("row.doc_id", F.col("w").alias("log_weight"), "key", drawn(least).alias("kept"))
        return keep(shared.table(out, "resampled"))


def keep_good(docs: DataFrame, labels: DataFrame, seed: int = 1, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that the sample holds; weights are worked out once."""
    keys, least = keyed(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels, seed, margin, docs.columns)
    return keys.where(drawn(least)).select("row.*")

"""Importance resampling: n-grams, log weights, noise and the draw worked out one by one; the odd cases of tables."""

import collections
import hashlib
import math
import struct

import numpy as np
import pytest
import xxhash
from test_llm_operators import fold_case, labelled, table, words

from ponderlake.llm import quality_classifier as q
from ponderlake.llm.textops import Block, mix, mix_int

M = (1 << 64) - 1
CLASSES = {**dict.fromkeys("0123456789", 2), **dict.fromkeys("#*$%&|<>", 4)}


def word_hash(w):
    raw = np.frombuffer(w.encode(), np.uint8)
    return int(Block(raw, np.array([0, len(raw)])).hashes()[0])


def grams(text):
    """Buckets of a text's words, pairs, shapes and pairs of shapes."""
    ws = words((text or "").translate(fold_case))
    hs = [word_hash(w) for w in ws]
    shapes = []
    for i, w in enumerate(ws):
        kinds = 0
        for c in w:
            kinds |= CLASSES.get(c, 1 if c.isalpha() or ord(c) > 126 or ord(c) < 33 else 8)
        shapes.append(mix_int(kinds | min(len(w.encode()), 3) << 8 | (i > 0 and hs[i] == hs[i - 1]) << 16))
    out = []
    for xs, seed in ((hs, mix_int(1)), (shapes, mix_int(2))):
        out += [mix_int(x ^ seed) % q.BUCKETS for x in xs]
        for a, b in zip(xs, xs[1:], strict=False):
            out.append(mix_int(mix_int((a * 0x9E3779B97F4A7C15 + b) & M) ^ mix_int(seed)) % q.BUCKETS)
    return out


def noise(doc_id, seed):
    x = xxhash.xxh64(("" if doc_id is None else str(doc_id)).encode(), seed=42).intdigest()
    x = xxhash.xxh64(struct.pack("<i", seed), seed=x).intdigest()
    x -= (x >> 63) << 64
    u = (x % (1 << 52) + 0.5) / float(1 << 52)
    return -math.log(-math.log(u))


def test_weights_keys_and_draw(spark):
    docs, labels, truth = labelled(spark)
    raw, target, texts = collections.Counter(), collections.Counter(), {r.doc_id: r.text for r in docs.collect()}
    chosen = sorted((i for i, (good, _) in truth.items() if good), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[: q.PER_CLASS]
    of = {i: grams(t) for i, t in texts.items()}
    for i, g in of.items():
        raw.update(g)
        if i in chosen:
            target.update(g)
    total = [sum(c.values()) + q.BUCKETS for c in (target, raw)]
    ratio = {b: math.log((target[b] + 1) / total[0] / ((raw[b] + 1) / total[1])) * raw[b] / (raw[b] + 1) for b in raw}
    weight = {i: sum(ratio[b] for b in g) for i, g in of.items()}
    got = table(q.resample(docs, labels))
    keys = {}
    for i, w in weight.items():
        assert got[i][0].log_weight == pytest.approx(w, abs=1e-6)
        if words(texts[i]):
            keys[i] = w + noise(i, 1)
            assert got[i][0].key == pytest.approx(keys[i], abs=1e-6)
        else:
            assert got[i][0].key is None and not got[i][0].kept
    known = [good for good, _ in truth.values()] + [1]  # the label whose document is missing
    k = min(len(keys), math.ceil(len(keys) * (sum(known) / len(known) + q.MARGIN)))
    assert {i for i, r in got.items() if r[0].kept} == set(sorted(keys, key=lambda i: -keys[i])[:k])


def test_repeated_long_and_clashing_rows(spark):
    docs, labels, _ = labelled(spark)
    long = "good words here " * 30_000
    more = spark.createDataFrame([(2000, long), (2000, long), (None, "abc def")], "doc_id long, text string")
    df = docs.unionByName(more).selectExpr("*", "'x' AS key", "'y' AS row", "'z' AS w", "'v' AS quality")
    got = table(q.resample(df, labels.unionByName(labels)))
    assert len(got[2000]) == 2 and got[2000][0] == got[2000][1] and len(got[None]) == 1
    kept = q.keep_good(df, labels)
    assert kept.columns == df.columns and sum(r.doc_id == 2000 for r in kept.collect()) == 2 * got[2000][0].kept
    assert {r.row for r in kept.collect()} == {"y"}

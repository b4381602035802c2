"""Toxicity: an independent forward pass, long labelled texts, and the odd cases of tables."""

import math
import random
import zlib

import numpy as np
import pytest

from ponderlake.llm import toxicity


def naive_score(net, text):
    """The network written out for one word, window and unit at a time."""
    p = {k: np.asarray(v, float) for k, v in net.p.items()}
    h = toxicity.HIDDEN
    b = toxicity._block([text])
    w = toxicity.Words(b)
    x = []
    for i in w.of:
        place = np.flatnonzero(net.vocabulary == w.hash[i])
        word = p["word"][place[0] if len(place) else len(net.vocabulary)]
        grams = w.grams[w.owner == i]
        x.append(np.concatenate([word, p["char"][grams].sum(0) / math.sqrt(len(grams))]))
    sig = lambda v: 1 / (1 + math.exp(-v))

    def states(seq, d):
        s, out = [0.0] * h, []
        for v in seq:
            gx = [sum(v[k] * p["w" + d][k, j] for k in range(len(v))) + p["b" + d][j] for j in range(3 * h)]
            gs = [sum(s[k] * p["u" + d][k, j] for k in range(h)) for j in range(3 * h)]
            z, r = [sig(gx[j] + gs[j]) for j in range(h)], [sig(gx[h + j] + gs[h + j]) for j in range(h)]
            new = [math.tanh(gx[2 * h + j] + r[j] * gs[2 * h + j]) for j in range(h)]
            s = [(1 - z[j]) * new[j] + z[j] * s[j] for j in range(h)]
            out.append(s)
        return out

    best, n = 0.0, len(x)
    for at in range(0, max(1, n - toxicity.WIDTH + toxicity.STRIDE), toxicity.STRIDE):
        seq = x[at : at + toxicity.WIDTH]
        both = [np.array(f + g) for f, g in zip(states(seq, "f"), states(seq[::-1], "b")[::-1], strict=True)]
        e = [float(np.tanh(s @ p["att"]) @ p["v"]) for s in both]
        top = max(e)
        a = [math.exp(v - top) for v in e]
        pooled = sum(v * s for v, s in zip(a, both, strict=True)) / sum(a)
        best = max(best, sig(float(pooled @ p["out"] + p["bias"][0])))
    return best


def test_forward_pass_written_out():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab cd Ef g! hij".split()) + str(rng.randint(0, 9)) for _ in range(n)) for n in (1, 5, 31, 32, 33, 70)]
    toxic = np.array([0, 1, 0, 1, 0, 1])
    net = toxicity.train(texts, toxic)
    got = toxicity.score_block(net, toxicity._block(texts))
    assert got == pytest.approx([naive_score(net, t) for t in texts], abs=2e-5)


def long_texts(spark, n=150):
    rng, rows = random.Random(2), []
    for i in range(n):
        w = [f"w{rng.randint(0, 400)}" for _ in range(1000)]
        if i % 2:
            for k in range(0, 1000, 2):
                w[k] = "vile"
        rows.append((i, " ".join(w), "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")


def test_long_labelled_texts_are_learnt(spark):
    docs, labels = long_texts(spark)
    rows = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out]
    assert rows and sum(r.predicted == r.doc_id % 2 for r in rows) >= 0.95 * len(rows)


def test_sample_is_bounded_by_rows_and_depends_on_ids_alone(spark):
    docs, labels = long_texts(spark, 60)
    twice = docs.unionByName(docs.limit(7)).unionByName(spark.createDataFrame([(3, "", "x"), (None, "vile", "x")], docs.schema))
    more = labels.unionByName(spark.createDataFrame([(900, 1), (None, 1), (4, None)], "doc_id long, toxic int"))
    a, b = toxicity.sample(docs, labels, 10), toxicity.sample(twice.repartition(5), more, 10)
    assert a[0] == b[0] and a[1].tolist() == b[1].tolist() and sorted(a[1].tolist()) == [0] * 10 + [1] * 10


def test_ties_repeated_rows_long_and_empty_texts(spark):
    docs, labels = long_texts(spark, 40)
    long = "w1 " * 60_000
    extra = spark.createDataFrame([(500, long, "x"), (500, long, "x"), (501, " \n", "x"), (502, None, "x"), (None, "vile vile", "x")], docs.schema)
    got = toxicity.toxicity(docs.unionByName(extra), labels).collect()
    assert len(got) == 45 and len({r.score for r in got if r.doc_id == 500}) == 1
    assert {r.score for r in got if r.doc_id in (501, 502)} == {0.0}
    assert {r.held_out for r in got if r.doc_id is None} == {zlib.crc32(b"") % 3 == 1}


def test_one_class_alone_warns(spark):
    docs, labels = long_texts(spark, 20)
    with pytest.warns(UserWarning, match="nothing is learnt"):
        got = toxicity.toxicity(docs, labels.where("toxic = 1")).collect()
    assert {r.score for r in got} == {0.5}

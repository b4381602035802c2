"""Learned partitions against brute force: recall, exact scores, copies, levels, vectors that take no part."""

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from ponderlake.llm import learned_partitions as lp
from ponderlake.llm.queries import QUERIES


def brute(ids, x, asked, k=5):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in asked:
        i = ids.index(q)
        s = u @ u[i]
        out[q] = sorted(((-s[j], ids[j]) for j in range(len(ids)) if j != i))[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({v for _, v, _ in got[q]} & {v for _, v in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    rows = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    got = found(QUERIES["op11_nearest_neighbours"](spark, f"{DATA}/{sf}"))
    want = brute(ids, x, [i for i in ids if i % 50 == 0])
    assert set(got) == set(want) and recall(got, want) >= 0.9
    at = {v: i for i, v in enumerate(ids)}
    for q, near in got.items():
        assert [r for r, _, _ in near] == [1, 2, 3, 4, 5]
        assert near == sorted(near, key=lambda n: (-n[2], n[1]))
        for _, v, s in near:
            a, b = x[at[q]], x[at[v]]
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-14)


def test_levels_and_hot_copies(spark, monkeypatch):
    """A third of all rows equal, clusters, and several levels of small leaves: copies come back by least ids, none lost."""
    monkeypatch.setattr(lp, "LEAF", 150)
    monkeypatch.setattr(lp, "FIT", 600)
    monkeypatch.setattr(lp, "BLOCK", 64)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 8))
    x = centres[rng.integers(0, 12, 3000)] + 0.2 * rng.standard_normal((3000, 8))
    x[1000:2000] = x[1000]
    rows = [(int(i), v.tolist(), "x", "x") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part string, score string").repartition(5)
    got = found(lp.search(df, F.col("vec_id") % 50 == 0))
    want = brute(list(range(3000)), x, range(0, 3000, 50))
    near = {q: w for q, w in want.items() if not 1000 <= q < 2000}
    assert set(got) == set(want) and recall(got, near) >= 0.9
    for q in range(1000, 2000, 50):
        first = [i for i in range(1000, 1006) if i != q][:5]
        assert [v for _, v, _ in got[q]] == first


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, None), (50, []), (100, [0.0, 0.0]), (150, [1.0, None]), (200, [nan, 1.0]), (250, [inf, 1.0]), (None, [1.0, 1.0])]
    good = [(300, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0]), (3, [0.0, 1.0]), (4, [1e-200, 0.0]), (5, [1e200, 1e200]), (3, [0.0, 1.0]), (350, [-1.0, 0.5])]
    df = spark.createDataFrame(odd + good, "vec_id long, embedding array<double>")
    got = found(lp.search(df, F.col("vec_id") % 50 == 0))
    assert set(got) == {300, 350}
    assert [v for _, v, _ in got[300]] == [1, 2, 4, 5, 3] and [s for *_, s in got[300][:3]] == [1.0, 1.0, 1.0]
    assert [v for _, v, _ in got[350]] == [3, 5, 1, 2, 4]
    assert lp.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert lp.search(df.where("vec_id = 300"), F.col("vec_id") % 50 == 0).collect() == []


def test_pieces_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = lp.nearest(x, x, 10, True)
    piece = lp.balanced(x, graph, 16)
    size = np.bincount(piece, minlength=16)
    assert size.min() >= 90 and size.max() <= 110
    inside = (piece[graph] == piece[:, None]).mean()
    assert inside > 3 * (piece[rng.permuted(graph)] == piece[:, None]).mean()

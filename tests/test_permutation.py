"""Shuffled tables of counts against shuffled columns in numpy, at few and at many categories."""

import math

import numpy as np
import pytest

from ponderlake.operators import permutation as P


def information(a, b):
    _, a = np.unique(a, return_inverse=True)
    _, b = np.unique(b, return_inverse=True)
    t = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(t, (a, b), 1)
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    some = t > 0
    return float((t[some] / t.sum() * np.log(t[some] / e[some])).sum())


def frame(spark, a, b):
    return spark.createDataFrame([(int(i), int(j)) for i, j in zip(a, b)], "a int, b int").repartition(3)


@pytest.mark.parametrize(("rows", "x", "y", "chunk"), [(200, 3, 4, 4096), (900, 40, 9, 7), (600, 5, 300, 16)])
def test_against_shuffles(spark, monkeypatch, rows, x, y, chunk):
    """The same distribution, whatever the chunks, and whichever column has more categories."""
    monkeypatch.setattr(P, "CHUNK", chunk)
    r = np.random.default_rng(3)
    a, b = np.floor(x * r.random(rows) ** 2), np.floor(y * r.random(rows) ** 2)
    df = frame(spark, a, b)
    one = P.permutation_test(df, "a", "b", 400).first()
    null = [information(a, r.permutation(b)) for _ in range(400)]
    assert one.observed == pytest.approx(information(a, b), abs=1e-10)
    error = np.std(null) * (2 / 400) ** 0.5
    assert abs(one.null_mean - np.mean(null)) < 5 * error and abs(one.null_std - np.std(null)) < 0.2 * np.std(null)
    assert abs(one.p - (1 + sum(m >= information(a, b) for m in null)) / 401) < 0.13
    assert abs(P.expected(P.cells_of(df, "a", "b")).first().expected - one.null_mean) < 5 * error


def test_dependent_columns(spark):
    a = np.arange(500) % 7
    one = P.permutation_test(frame(spark, a, a), "a", "b", 99).first()
    assert one.p == pytest.approx(0.01) and one.observed > one.null_max
    assert P.permutation_test(frame(spark, a, a).limit(0), "a", "b", 20).count() == 0
    same = P.permutation_test(frame(spark, a, 0 * a), "a", "b", 20).first()
    assert same.observed == pytest.approx(0, abs=1e-12) and same.p == pytest.approx(1)


def test_formulas():
    n = np.array([0, 1, 2, 10, 63, 64, 65, 1000, 10**6])
    assert np.allclose(P.log_factorial(n), [math.lgamma(int(k) + 1) for k in n], rtol=1e-13, atol=1e-13)
    rng = np.random.default_rng(2)
    left = np.array([3 * 10**9, 10**9, 5, 0])
    got = np.array([P.draw(rng, left, 2 * 10**9) for _ in range(300)])
    assert (got.sum(axis=1) == 2 * 10**9).all() and (got <= left).all() and (got >= 0).all()
    spread = math.sqrt(2e9 * 0.75 * 0.25 * 0.5)
    assert abs(got[:, 0].mean() - 1.5e9) < 5 * spread / 300**0.5 and got[:, 0].std() == pytest.approx(spread, rel=0.25)

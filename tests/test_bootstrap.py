"""The Poisson bootstrap against rows weighed one by one in numpy, and against known variances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ponderlake.operators import bootstrap as B

REPS = 700


def weighed(x, w, p):
    """Quantile of the values, each repeated as often as it weighs."""
    return [np.percentile(np.repeat(x, k), 100 * p) if k.sum() else None for k in w.T]


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(9)
    x = np.where(r.random(3000) < 0.3, 5.0, r.normal(5, 2, 3000))  # nearly a third of all rows are equal
    rows = [(i, i // 3, None if i % 50 == 0 else float(x[i]), i % 4) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, cluster long, x double, g int").repartition(5), rows


def unit_weights(spark, units, seed=1):
    a, b = B.words(F.col("u"), seed)
    got = spark.createDataFrame([(u,) for u in units], "u long").select("u", a.alias("a"), b.alias("b")).toPandas().set_index("u")
    return B.weights(got.a.to_numpy(), got.b.to_numpy(), np.arange(REPS)).astype(int), list(got.index)


@pytest.mark.parametrize("unit", ["id", "cluster"])
@pytest.mark.parametrize("most", [10**6, 40])
def test_equal_to_weighing_rows(spark, table, monkeypatch, unit, most):
    """Exact, whether intervals are looked at at once or divided further."""
    monkeypatch.setattr(B, "MOST", most)
    df, rows = table
    x = F.col("x")
    stats = {"mean": B.Ratio(x), "median": B.Quantile(x, 0.5), "p01": B.Quantile(x, 0.01), "top": B.Quantile(x, 1.0), "share": B.share(x > 6),
             "ratio": B.Ratio(x, F.col("g")), "other": B.Quantile(F.when(F.col("g") == 2, x), 0.9)}
    got = B.resample(df, F.col(unit), stats, REPS).orderBy("rep").toPandas()
    w, order = unit_weights(spark, sorted({r[unit == "cluster"] for r in rows}))
    at = {u: i for i, u in enumerate(order)}
    known = [r for r in rows if r[2] is not None]
    v, k = np.array([r[2] for r in known]), np.array([w[at[r[unit == "cluster"]]] for r in known])
    assert np.allclose(got["mean"], v @ k / k.sum(0)) and np.allclose(got["share"], (v > 6) @ k / k.sum(0))
    for name, p in (("median", 0.5), ("p01", 0.01), ("top", 1.0)):
        assert np.allclose(got[name], weighed(v, k, p), rtol=1e-12), name
    every = np.array([w[at[r[unit == "cluster"]]] for r in rows])
    assert np.allclose(got["ratio"], v @ k / (np.array([r[3] for r in rows]) @ every))
    some = np.array([r[3] == 2 for r in known])
    assert np.allclose(got["other"], weighed(v[some], k[some], 0.9), rtol=1e-12)


def test_weights_are_poisson_and_independent(spark):
    w, _ = unit_weights(spark, range(4000))
    assert abs(w.mean() - 1) < 0.003 and abs(w.var() - 1) < 0.006 and abs((w == 0).mean() - np.exp(-1)) < 0.002
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.004
    assert abs(np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]) < 0.004
    assert abs(w.mean(axis=0).std() * 4000**0.5 - 1) < 0.1 and abs(w.mean(axis=1).std() * REPS**0.5 - 1) < 0.05


def test_known_variance(spark):
    """Deviation of a mean, and of the median of a normal column."""
    x = np.random.default_rng(4).normal(0, 3, 20000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    got = B.resample(df, F.col("id"), {"mean": B.Ratio(F.col("x")), "median": B.Quantile(F.col("x"), 0.5)}, 2000).toPandas()
    assert got["mean"].std() == pytest.approx(3 / 20000**0.5, rel=0.06)
    assert got["median"].std() == pytest.approx(3 * (np.pi / 2 / 20000) ** 0.5, rel=0.12)


def test_empty_and_null(spark, table):
    df, _ = table
    stats = {"mean": B.Ratio(F.col("x")), "median": B.Quantile(F.col("x"), 0.5)}
    for none in (df.limit(0), df.withColumn("x", F.lit(None).cast("double"))):
        got = B.resample(none, F.col("id"), stats, 3).collect()
        assert sorted(r.rep for r in got) == [0, 1, 2] and {(r["mean"], r.median) for r in got} == {(None, None)}
    odd = df.limit(4).withColumn("x", F.lit(float("inf")))
    assert {r.median for r in B.resample(odd, F.lit(None).cast("long"), {"median": B.Quantile(F.col("x"), 0.5)}, 40).collect()} <= {None, float("inf")}

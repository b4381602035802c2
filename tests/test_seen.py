"""Successive splits against the batch anti-join; which pages are read; runs that failed."""

import random

import pytest
from pyspark.sql import functions as F

from ponderlake.operators.seen import KeyIndex


@pytest.fixture()
def index(spark, tmp_path):
    return KeyIndex(spark, str(tmp_path / "index"), pages=16, parts=2)


def rows(spark, keys):
    return spark.createDataFrame(list(enumerate(keys)), "i long, k string").repartition(3)


def test_splits(spark, index):
    rng, seen = random.Random(4), set()
    for n in (300, 200, 400):
        keys = [rng.choice([f"k{rng.randint(0, 600)}", None, ""]) if rng.random() < 0.1 else f"k{rng.randint(0, 600)}" for _ in range(n)]
        want, now = set(), set()
        for i, k in enumerate(keys):
            if (k or "") not in seen | now:
                want.add((i, k))
                now.add(k or "")
        got = index.split(rows(spark, keys), F.col("k"), ["i"])
        assert {(r.i, r.k) for r in got.collect()} == want and got.columns == ["i", "k"]
        seen |= now
    assert index.runs() == [0, 1, 2]
    p = index.probe(rows(spark, ["k1", "new", None]), F.col("k"))
    assert {r.k: r.seen for r in p.collect()} == {"k1": "k1" in seen, "new": False, None: "" in seen}


def test_only_probed_pages_are_read(spark, index):
    index.split(rows(spark, [f"k{i}" for i in range(200)]), F.col("k"), ["i"])
    index.split(rows(spark, [f"n{i}" for i in range(50)]), F.col("k"), ["i"])
    assert len(index.probed) < 16  # few of the new keys meet a bit
    p = index.probe(rows(spark, ["k5"]), F.col("k"))
    assert [r.seen for r in p.collect()] == [True] and len(index.probed) == 1
    known = index.known(index.probed)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "(page#" in plan.split("PartitionFilters: [")[1].split("]")[0] and f"= {index.probed[0]})" in plan  # directories are pruned
    assert {r.f.split("/page=")[1].split("/")[0] for r in known.select(F.col("_metadata.file_path").alias("f")).collect()} == {str(index.probed[0])}
    assert index.probe(rows(spark, ["zz"]), F.col("k")).where("seen").count() == 0


def test_a_run_that_failed_is_written_again(spark, index):
    index.split(rows(spark, ["a", "b"]), F.col("k"), ["i"])
    # the keys of a run arrived, its bitmaps didn't: it doesn't count
    x = index._placed(rows(spark, ["c"]), F.col("k")).select(F.col("__key").alias("key"), F.col("__page").alias("page"))
    x.write.partitionBy("page").parquet(f"{index.path}/keys/run=1")
    assert index.runs() == [0]
    got = index.split(rows(spark, ["a", "c", "d"]), F.col("k"), ["i"])
    assert {r.k for r in got.collect()} == {"c", "d"} and index.runs() == [0, 1]

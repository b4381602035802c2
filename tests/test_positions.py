"""Row numbers and ranks under skewed keys; slices of files in file order."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ponderlake.operators import positions
from ponderlake.sources import readers


def keys(kind: str, n: int):
    r = np.random.default_rng(5)
    return {
        "hashed": r.integers(-(2**62), 2**62, n), "lognormal": np.floor(np.exp(r.normal(0, 4, n)) * 1000).astype(int),
        "equal": np.full(n, 7), "third": np.where(r.random(n) < 0.4, 3, r.integers(0, 10**9, n)),
    }[kind]


@pytest.mark.parametrize("kind", ["hashed", "lognormal", "equal", "third"])
def test_no_partition_gets_many_rows(spark, kind):
    n = 20000
    k = keys(kind, n)
    df = spark.createDataFrame([(int(v), i) for i, v in enumerate(k)], "k long, i long").repartition(3)
    sizes = [r["count"] for r in positions.spread(df, ["k"]).groupBy("__pid").count().collect()]
    assert max(sizes) < 2 * n / 4  # four partitions
    got = sorted((r.pos, r.k) for r in positions.numbered(df, "k").collect())
    assert [p for p, _ in got] == list(range(n)) and [v for _, v in got] == sorted(k.tolist())
    exact = positions.numbered(df, "k", ties=["i"]).collect()
    want = sorted(range(n), key=lambda i: (k[i], i))
    assert [r.i for r in sorted(exact, key=lambda r: r.pos)] == want and {r.total for r in exact} == {n}


def test_numbers_within_groups(spark):
    r = np.random.default_rng(6)
    rows = [(None if i % 7 == 0 else f"g{int(r.integers(0, 3)) if i % 3 else 0}", int(r.integers(0, 50)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, i long")
    got = {x.i: (x.pos, x.total) for x in positions.numbered(df, "k", by=["g"], ties=["i"]).collect()}
    for g in {x[0] for x in rows}:
        mine = sorted((k, i) for h, k, i in rows if h == g)
        assert [got[i] for _, i in mine] == [(p, len(mine)) for p in range(len(mine))]
    assert positions.numbered(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("kind", ["hashed", "lognormal", "third"])
def test_sums_over_intervals(spark, kind):
    v, n = np.unique(keys(kind, 20000).astype(float), return_counts=True)
    df = spark.createDataFrame([(None if i % 2 else "a", float(x), int(c)) for i, (x, c) in enumerate(zip(v, n))], "g string, v double, n long")
    got = {(r.g, r.v): (r.before, r.total) for r in positions.running(df, "v", "n", ["g"], parts=32).collect()}
    for g, first in (("a", 0), (None, 1)):
        own, c = v[first::2], n[first::2]
        ends = np.cumsum(c)
        assert all(got[g, float(x)] == (e - k, ends[-1]) for x, e, k in zip(own, ends, c))


@pytest.fixture()
def folder(tmp_path):
    """Five files of different sizes, one empty, blank lines between, a name with a space."""
    n, at = [40, 0, 1, 25, 34], 0
    for f, k in enumerate(n):
        name = tmp_path / f"part {f}.jsonl"
        name.write_text("".join(json.dumps({"id": at + i}) + "\n" + "\n" * (i % 3 == 0) for i in range(k)))
        at += k
    return tmp_path


def test_slices_in_file_order(spark, folder):
    path = str(folder)
    index = readers.lines_index(spark, path).cache()
    assert [(r.lines, r.before) for r in index.orderBy("file").collect()] == [(40, 0), (1, 40), (25, 41), (34, 66)]
    for offset, limit in ((0, 5), (38, 4), (40, 1), (0, 100), (99, 10), (100, 5), (50, 0)):
        got = readers.jsonl_slice(spark, path, "id long", offset, limit, index).collect()
        assert sorted((r.line, r.id) for r in got) == [(i, i) for i in range(offset, min(100, offset + limit))]
    x = readers.jsonl_slice(spark, path, "id long", 42, 20, index)
    assert [f.rsplit("part", 1)[1] for f in x.inputFiles()] == ["%203.jsonl"]  # no other file is opened


def test_slices_over_blocks(spark, folder):
    """A file in many blocks: lines are numbered across them."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "64")
        got = readers.jsonl_slice(spark, str(folder), "id long", 30, 50)
        blocks = spark.read.text(str(folder / "part 0.jsonl")).select(F.col("_metadata.file_block_start")).distinct().count()
        assert blocks > 3 and sorted((r.line, r.id) for r in got.collect()) == [(i, i) for i in range(30, 80)]
        assert [r.id for r in readers.jsonl_first(spark, str(folder), "id long", 3).orderBy("line").collect()] == [0, 1, 2]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

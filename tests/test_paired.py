"""Log entries and statistics paired as a stream: any order, restarts, and halves that stay alone."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ponderlake.streaming import logs, paired


@pytest.fixture()
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    paired.rocksdb_state(spark)
    yield
    spark.conf.set(key, before)


def entry(run, step, kind, minute, value):
    return {"run": run, "step": step, "at": f"2024-05-01T{minute // 60:02d}:{minute % 60:02d}:00.000Z", "kind": kind, "body": json.dumps({"v": value})}


def run(spark, folder, k, rows, late="5 minutes"):
    """A file arrives; the stream starts again from its checkpoint, handles it and stops."""
    (folder / "in").mkdir(exist_ok=True)
    (folder / "in" / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    s = paired.paired(logs.stream_jsonl(spark, str(folder / "in"), paired.ROWS), late, 60 * 60_000)
    logs.append_to(s, str(folder / "out"), str(folder / "ck")).awaitTermination(120)
    return sorted(tuple(r) for r in spark.read.schema(paired.PAIRS).json(str(folder / "out")).collect())


def test_any_order_across_restarts(spark, store, tmp_path):
    rows = [entry(f"r{i % 3}", i // 3, kind, i, f"{kind}{i}") for i in range(24) for kind in ("log", "stats")]
    random.Random(1).shuffle(rows)
    for k in range(3):
        run(spark, tmp_path, k, rows[k::3], "2 hours")
    # an entry of a pair that has left waits alone; other kinds don't count
    got = run(spark, tmp_path, 3, [entry("r0", 0, "log", 0, "again"), {**entry("r0", 99, "log", 0, ""), "kind": "other"}], "2 hours")
    table = spark.createDataFrame([(r["run"], r["step"], r["kind"], r["body"]) for r in rows], "run string, step long, kind string, body string")
    assert [g for g in got if g[2] and g[3]] == sorted(tuple(r) for r in paired.paired_batch(table).collect())


def test_halves_that_stay_alone(spark, store, tmp_path):
    assert run(spark, tmp_path, 0, [entry("a", 1, "log", 0, 1), entry("a", 2, "stats", 10, 2), entry("b", 1, "log", 0, 3)]) == []
    assert run(spark, tmp_path, 1, [entry("b", 1, "stats", 50, 4)]) == [("b", 1, '{"v": 3}', '{"v": 4}')]
    got = run(spark, tmp_path, 2, [entry("c", 1, "log", 120, 5)])  # the watermark passes an hour after the first entries
    assert [g for g in got if g[0] == "a"] == [("a", 1, '{"v": 1}', None), ("a", 2, None, '{"v": 2}')]
    assert not [g for g in got if g[0] == "c"] and spark.range(1).select(F.lit(1)).count() == 1

"""Readers, sinks, streams, audits and configuration on small files."""

import json
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from ponderlake import schemas
from ponderlake.operators import audit, bootstrap, positions, significance, tables
from ponderlake.sources import readers, sinks
from ponderlake.streaming import logs


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n\n" for r in rows))
    return str(path)


def test_jsonl(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", [{"id": "a", "x": 1}, {"id": "b", "x": 2}, {"id": "a", "x": 3}])
    assert readers.jsonl(spark, p, "id string, x int").count() == 3
    assert {(r.id, r.x) for r in readers.jsonl_keyed(spark, p, "id string, x int").collect()} == {("a", 3), ("b", 2)}
    assert readers.optional(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "id string").collect()


def test_probe_and_groups(spark, tmp_path):
    doc = {"groups": [{"probe_step": 5, "prompts": [{"id": "p", "ground_truth_pattern": "KKN", "rollouts": [{"text": "t", "reward": 1.0}]}]}]}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=1))
    assert readers.probe(readers.json_doc(spark, str(tmp_path / "p.json"), schemas.PROBE_FILE)).first().key == "p@step5"
    g = {"id": "a", "ground_truth": {"Alice": "knight", "Bob": "knave", "Carol": "knave"}, "generations": [{"parsed_answer": None, "reward": 0}, {"parsed_answer": {"Alice": "knight", "Bob": "knave", "Carol": "knave"}, "reward": 1}]}
    x = readers.rollout_groups(readers.jsonl(spark, write(tmp_path / "g.jsonl", [g]), schemas.ROLLOUT_GROUP), F.array(F.lit("Alice"), F.lit("Bob"), F.lit("Carol")))
    assert [(r.gold, r.k, r.pattern) for r in x.orderBy("k").collect()] == [("KNN", 0, "invalid"), ("KNN", 1, "KNN")]


def test_models_arrays_logs(spark, tmp_path):
    a, b = write(tmp_path / "a.jsonl", [{"step": 1, "kl": 0.5}]), write(tmp_path / "b.jsonl", [{"step": 2}])
    assert {r.model for r in readers.multi_model(spark, {"a": a, "b": b}, "step int, kl double").collect()} == {"a", "b"}
    n = readers.metrics_normalised(readers.jsonl(spark, a, "step int, kl double"), readers.jsonl(spark, b, "step int"), fill={"kl": 0.0})
    assert {(r.step, r.kl) for r in n.collect()} == {(1, 0.5), (2, 0.0)}
    w = spark.createDataFrame([(["x", "y"], ["KKK", "KKN"], [0.1, 0.2])], schemas.WIDE_ARRAYS)
    assert [r.gold_q for r in readers.wide_arrays(w, ["ids", "gold", "gold_q"]).collect()] == [0.1, 0.2]
    d = spark.createDataFrame([("c/checkpoint-100",), ("c/checkpoint-20",), ("c/final",)], "path string")
    assert [r.step for r in readers.checkpoint_dirs(d).collect()] == [20, 100]


def test_configured_rows(spark):
    @dataclass
    class C:
        a: int = 1
        b: str = "x"

    df = spark.createDataFrame([(1, '{"a": 2}', None), (2, '{"b": "y", "a": null}', 5), (3, None, None), (4, "{}", 6)], "id int, doc string, a int")
    got = df.select("id", *readers.configured(C, F.col("doc"), {"a": F.col("a")})).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 2, "x"), (2, 5, "y"), (3, 1, "x"), (4, 6, "x")]
    with pytest.raises(ValueError, match="unknown"):
        readers.configured(C, F.col("doc"), {"c": F.lit(1)})
    with pytest.raises(Exception, match="unknown settings: c"):
        df.select(*readers.configured(C, F.lit('{"c": 1}'))).collect()


def test_config():
    @dataclass
    class C:
        a: int = 1
        b: str = "x"

    assert readers.config(C, {"a": 2, "b": "y"}, {"a": 3, "b": None}) == C(3, "y")
    with pytest.raises(ValueError, match="unknown settings"):
        readers.config(C, {"c": 1})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "b int, a string")
    out = str(tmp_path / "out")
    sinks.jsonl(df, out)
    line = next(x for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines())
    assert line == '{"a":"é","b":1}'
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.jsonl(df, out)
    sinks.append_metrics(df, out)
    assert spark.read.json(out).count() == 2
    sinks.csv(df, str(tmp_path / "csv"))
    assert sinks.markdown(df).splitlines()[2] == "| 1 | é |"
    assert json.loads(sinks.json_report(df)) == {"b": 1, "a": "é"}
    m = sinks.manifest(spark.createDataFrame([("t", "k"), ("t", "k"), ("v", "l")], "s string, k string"), "s", "k", 7).first()
    assert m.rows == 3 and [tuple(x) for x in m.splits] == [("t", 2, 1), ("v", 1, 1)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "1.json", [{"id": "a"}, {"id": "b"}, {"id": "a"}])
    s = logs.new_keys(logs.stream_jsonl(spark, str(tmp_path / "in"), "id string"), F.col("id"))
    for _ in range(2):  # the second run finds the same files and the first run's keys
        logs.append_to(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    write(tmp_path / "in" / "2.json", [{"id": "b"}, {"id": "c"}])
    logs.append_to(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_audit_gate(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int")
    audit.require(df, F.col("n") > 0, "fine")
    with pytest.raises(audit.GateFailure, match="counts"):
        audit.require(df, F.col("n") > 1, "counts")


def test_paired_identity(spark):
    cells = [(True, True, 1365), (True, False, 133), (False, True, 154), (False, False, 348)]
    df = spark.createDataFrame(cells, "a boolean, b boolean, n int").withColumn("n", F.explode(F.sequence(F.lit(1), "n")))
    r = tables.paired_correctness(df, F.col("a"), F.col("b")).first()
    assert (r.cc, r.cw, r.wc, r.ww) == (1365, 133, 154, 348) and (r.acc_a, r.acc_b, r.delta) == (pytest.approx(0.749), pytest.approx(0.7595), pytest.approx(0.0105))
    m = significance.mcnemar(df, F.col("a"), F.col("b")).first()
    assert m.exact_p == pytest.approx(0.23772336278505) and m.chi2_p == pytest.approx(0.23777649970011)
    b = df.withColumn("id", F.monotonically_increasing_id()).withColumn("x", (F.col("b").cast("int") - F.col("a").cast("int")).cast("double"))
    i = significance.interval(bootstrap.resample(b, F.col("id"), {"value": bootstrap.Ratio(F.col("x"))}, 10000)).first()
    apart = 0.2 * (0.0275 + 0.006) / 3.92  # a fifth of a deviation
    assert i.low == pytest.approx(-0.006, abs=apart) and i.high == pytest.approx(0.0275, abs=apart) and i.crosses_zero


def test_numbered_and_constant_correlation(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    x = positions.numbered(df, "k").orderBy("k").collect()
    assert [r.pos for r in x] == list(range(len(x))) and {r.total for r in x} == {len(x)}
    assert significance.spearman(spark.createDataFrame([(1, 1), (2, 1)], "a int, b int"), "a", "b").first().rho is None
    assert positions.quartile_ends(df, "k", ["k"]).groupBy("end").count().orderBy("end").collect()[0]["count"] == -(-len(x) // 4)

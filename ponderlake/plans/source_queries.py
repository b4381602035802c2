"""Queries over sources and sinks: test tables written as the files in question and read back.

The SQL has the rows themselves, so a green row means that nothing was lost, added or changed on the way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pattern_decode
from ..operators import audit, seen
from ..sources import exchange, readers, sinks
from ..streaming import logs, paired
from .base import LONG_SQL, PRED_SQL, ROLL_SQL, SCORE_SQL, predictions, rollouts, scores
from .registry import query, read
from .text_queries import people

EVENT = "event_id bigint, event_type string, user_id bigint, value double"
EVENT_SQL = "SELECT event_id, event_type, user_id, value FROM events"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", "event_type", "user_id", "value")


def _written(df: DataFrame, name: str) -> str:
    """``df`` as JSON Lines; the path."""
    path = exchange.folder(df.sparkSession, name)
    sinks.jsonl(df, path)
    return path


@query("scan_jsonl", EVENT_SQL)
def scan_jsonl(spark, d):
    return readers.jsonl(spark, _written(_events(spark, d), "events"), EVENT)


@query("sink_jsonl", "SELECT doc_id, lang, source, md5(text) AS text_md5 FROM documents")
def sink_jsonl(spark, d):
    """Whole texts through JSON Lines, letters unescaped."""
    path = _written(read(spark, d, "documents").select("doc_id", "text", "lang", "source"), "documents")
    x = readers.jsonl(spark, path, "doc_id bigint, text string, lang string, source string")
    return x.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@query(
    "scan_jsonl_keyed",
    "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id"
)
def scan_jsonl_keyed(spark, d):
    """Files in order of event_id: the last row of a user is the one of the greatest id."""
    ordered = _events(spark, d).repartitionByRange(F.col("event_id")).sortWithinPartitions("event_id")
    x = readers.jsonl_keyed(spark, _written(ordered, "keyed"), EVENT, "user_id")
    return x.select("user_id", "event_id", "value")


def _in_order(spark: SparkSession, d: str) -> str:
    """Events as files in order of event_id, in several files; the path."""
    return _written(_events(spark, d).repartitionByRange(6, "event_id").sortWithinPartitions("event_id"), "ordered")


@query("scan_slice", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 50 OFFSET 100")
def scan_slice(spark, d):
    """Lines 100 to 149 in file order."""
    return readers.jsonl_slice(spark, _in_order(spark, d), EVENT, 100, 50).select("event_id", "user_id")


@query("scan_first_n", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 200")
def scan_first_n(spark, d):
    return readers.jsonl_first(spark, _in_order(spark, d), EVENT, 200).select("event_id", "user_id")


@query("scan_optional", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def scan_optional(spark, d):
    there = readers.optional(spark, _written(_events(spark, d), "events"), EVENT)
    missing = readers.optional(spark, exchange.folder(spark, "never-written"), EVENT)
    return there.unionByName(missing).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "scan_json_doc",
    "SELECT r_regionkey AS region, r_name AS name, n_nationkey AS nation, n_name AS nation_name FROM region JOIN nation "
    "ON n_regionkey = r_regionkey"
)
def scan_json_doc(spark, d):
    """A document of several lines for each region."""
    inner = F.struct(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("nation_name"))
    x = read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(inner).alias("nations"))  # a dozen
    x = x.join(read(spark, d, "region"), "r_regionkey")
    doc = F.to_json(
        F.struct(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"), "nations"), {"pretty": "true"}
    )
    path = exchange.folder(spark, "regions")
    x.select(
        "r_regionkey", doc.alias("value")
    ).repartition("r_regionkey").select("value").write.option("maxRecordsPerFile", 1).text(path)
    schema = "region bigint, name string, nations array<struct<nation:bigint,nation_name:string>>"
    return readers.json_doc(spark, path, schema).select(
        "region", "name", F.explode("nations").alias("n")
    ).select("region", "name", "n.*")


@query(
    "scan_probe_nested",
    f"WITH {ROLL_SQL} SELECT id || '@step' || step AS key, CAST(id AS VARCHAR) AS id, CAST(step AS INT) AS probe_step, "
    f"any_value(gold) AS gold, CAST(count(*) AS INT) AS n, sum(reward) AS reward FROM roll GROUP BY id, step"
)
def scan_probe_nested(spark, d):
    """Probe documents, one for each prompt, as JSON Lines."""
    r = F.struct(
        F.lit("t").alias("text"), "reward", F.col("answer").alias("pattern"),
        F.col("answer").isNotNull().alias("format_valid")
    )
    g = rollouts(spark, d).groupBy("id", "step", "gold").agg(F.collect_list(r).alias("rollouts"))  # a group's completions
    prompt = F.struct(F.col("id").cast("string").alias("id"), F.col("gold").alias("ground_truth_pattern"), "rollouts")
    group = F.struct(F.col("step").cast("int").alias("probe_step"), F.array(prompt).alias("prompts"))
    one = "struct<text:string,reward:double,pattern:string,format_valid:boolean>"
    schema = f"groups array<struct<probe_step:int,prompts:array<struct<id:string,ground_truth_pattern:string,rollouts:array<{one}>>>>>"
    x = readers.probe(readers.jsonl(spark, _written(g.select(F.array(group).alias("groups")), "probe"), schema))
    total = F.aggregate("rollouts", F.lit(0.0), lambda t, v: t + v["reward"]).alias("reward")
    return x.select(
        "key", "id", "probe_step", F.col("ground_truth_pattern").alias("gold"), F.size("rollouts").alias("n"), total
    )


@query(
    "scan_rollout_groups",
    f"WITH {ROLL_SQL} SELECT CAST(id AS VARCHAR) AS id, gold, k, coalesce(answer, 'invalid') AS pattern, reward, answer "
    f"IS NOT NULL AS format_valid FROM roll"
)
def scan_rollout_groups(spark, d):
    """Groups with answers as maps; patterns are worked out anew from them."""
    def generation(v):
        answer = pattern_decode(v["answer"], people()).alias("parsed_answer")
        return F.struct(answer, v["reward"].alias("reward"), v["answer"].isNotNull().alias("format_valid"))

    each = F.array_sort(F.collect_list(F.struct("k", "answer", "reward")))  # as above
    g = rollouts(spark, d).groupBy("id", "gold").agg(F.transform(each, generation).alias("generations"))
    truth = pattern_decode(F.col("gold"), people()).alias("ground_truth")
    g = g.select(F.col("id").cast("string").alias("id"), truth, "generations")
    schema = "id string, ground_truth map<string,string>, generations array<struct<parsed_answer:map<string,string>,reward:double,format_valid:boolean>>"
    return readers.rollout_groups(readers.jsonl(spark, _written(g, "groups"), schema), people())


@query("scan_multi_model", f"WITH {PRED_SQL}, {LONG_SQL} SELECT id, gold, model, pred FROM lng")
def scan_multi_model(spark, d):
    p = predictions(spark, d)
    paths = {m: _written(p.select("id", "gold", F.col(f"pred_{m}").alias("pred")), f"model-{m}") for m in "abc"}
    return readers.multi_model(spark, paths, "id bigint, gold string, pred string")


@query(
    "scan_landscape",
    f"WITH {SCORE_SQL} SELECT CAST(id AS VARCHAR) AS id, CAST(gold AS INT) AS gold, model, cand, score FROM sc"
)
def scan_landscape(spark, d):
    """Nested scores by model."""
    from ..functions.text import pattern_of_index

    g = scores(spark, d).groupBy("id", "gold", "model").agg(F.array_sort(F.collect_list(F.struct("cand", "score"))).alias("c"))  # eight
    m = g.groupBy("id", "gold").agg(
        F.map_from_entries(
            F.collect_list(F.struct("model", F.struct(F.transform("c", lambda x: x["score"]).alias("scores"))))
        ).alias("models")
    )
    rec = m.select(
        F.col("id").cast("string").alias("id"), pattern_of_index(F.col("gold")).alias("gold_pattern"), "models"
    )
    schema = "id string, gold_pattern string, models map<string,struct<scores:array<double>>>"
    x = readers.landscape_long(readers.jsonl(spark, _written(rec, "landscape"), schema))
    return x.select(
        "id", F.col("gold").cast("int").alias("gold"), "model", F.col("cand").cast("int").alias("cand"), "score"
    )


@query("scan_wide_arrays", f"WITH {ROLL_SQL} SELECT step, k, reward, gold FROM roll")
def scan_wide_arrays(spark, d):
    """Parallel arrays, a document for each group of rollouts."""
    g = rollouts(spark, d).groupBy("id").agg(F.collect_list(F.struct("step", "k", "reward", "gold")).alias("x"))  # a group's completions
    names = ["step", "k", "reward", "gold"]
    doc = g.select(*[F.col(f"x.{c}").alias(c) for c in names])
    schema = "step array<bigint>, k array<int>, reward array<double>, gold array<string>"
    return readers.wide_arrays(readers.jsonl(spark, _written(doc, "wide"), schema), names)


@dataclass
class _Settings:
    batch: int = 16
    rate: float = 0.5
    mode: str = "full"
    limit: int = 0


@query(
    "scan_yaml_config",
    "SELECT s_suppkey AS id, CAST(CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey ELSE coalesce(CASE WHEN s_suppkey % 3 > 0 "
    "THEN s_suppkey % 64 END, 16) END AS INT) AS batch, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey / 8.0::DOUBLE ELSE 0.5 "
    "END AS rate, CASE WHEN s_suppkey % 7 = 0 THEN 'fast' ELSE 'full' END AS mode, 0 AS \"limit\" FROM supplier"
)
def scan_yaml_config(spark, d):
    """Defaults, then each run's file (a document a row), then its command line."""
    s = read(spark, d, "supplier")
    file = F.to_json(F.struct(
        F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 64).alias("batch"),
        F.when(F.col("s_suppkey") % 5 > 0, F.col("s_suppkey") / 8).alias("rate"),
        F.when(F.col("s_suppkey") % 7 == 0, "fast").alias("mode"),
    ))
    line = {"batch": F.when(F.col("s_suppkey") % 4 == 0, F.col("s_nationkey"))}
    return s.select(F.col("s_suppkey").alias("id"), *readers.configured(_Settings, file, line))


_PATHS = "CASE WHEN s_suppkey % 7 = 0 THEN 'runs/final' ELSE 'runs/checkpoint-' || s_suppkey * 25 END"


@query(
    "scan_checkpoint_dirs",
    f"SELECT {_PATHS} AS path, CAST(s_suppkey * 25 AS INT) AS step FROM supplier WHERE s_suppkey % 7 <> 0"
)
def scan_checkpoint_dirs(spark, d):
    return readers.checkpoint_dirs(read(spark, d, "supplier").selectExpr(f"{_PATHS} AS path"))


@query(
    "scan_metrics_normalize",
    "SELECT event_id AS step, value AS loss, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS DOUBLE) ELSE 0.0::DOUBLE "
    "END AS kl, CASE WHEN event_id % 2 = 1 THEN event_type END AS mode FROM events"
)
def scan_metrics_normalize(spark, d):
    """An older log without ``mode``, a newer one without ``kl``."""
    e = _events(spark, d)
    old = e.where("event_id % 2 = 0").select(
        F.col("event_id").alias("step"), F.col("value").alias("loss"), F.col("user_id").cast("double").alias("kl")
    )
    new = e.where("event_id % 2 = 1").select(
        F.col("event_id").alias("step"), F.col("value").alias("loss"), F.col("event_type").alias("mode")
    )
    x = readers.jsonl(spark, _written(old, "old"), "step bigint, loss double, kl double")
    y = readers.jsonl(spark, _written(new, "new"), "step bigint, loss double, mode string")
    return readers.metrics_normalised(x, y, fill={"kl": 0.0})


@query("sink_jsonl_incremental", "SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def sink_jsonl_incremental(spark, d):
    """Rows that arrive as files, appended by a stream with a checkpoint in two runs."""
    e, arrived, out, state = _events(spark, d), *(exchange.folder(spark, x) for x in ("arrived", "appended", "state"))
    for i in range(2):
        sinks.append_metrics(e.where(F.col("event_id") % 2 == i), arrived)
        logs.append_to(logs.stream_jsonl(spark, arrived, EVENT), out, state).awaitTermination()
    x = readers.jsonl(spark, out, EVENT)
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query(
    "sink_metrics_append",
    f"{EVENT_SQL} UNION ALL SELECT event_id, event_type, user_id, -value FROM events WHERE event_id % 3 = 0"
)
def sink_metrics_append(spark, d):
    path, e = exchange.folder(spark, "metrics"), _events(spark, d)
    sinks.append_metrics(e, path)
    sinks.append_metrics(e.where("event_id % 3 = 0").withColumn("value", -F.col("value")), path)
    return readers.jsonl(spark, path, EVENT)


@query(
    "sink_json_report",
    "SELECT count(*) AS orders, max(o_orderkey) AS last, count(DISTINCT o_orderpriority) AS priorities, "
    "min(o_orderpriority) AS first FROM orders"
)
def sink_json_report(spark, d):
    o = read(spark, d, "orders")
    report = sinks.json_report(
        o.agg(
            F.count("*").alias("orders"), F.max("o_orderkey").alias("last"),
            F.count_distinct("o_orderpriority").alias("priorities"), F.min("o_orderpriority").alias("first")
        )
    )
    schema = "orders bigint, last bigint, priorities bigint, first string"
    return spark.createDataFrame([(report,)], "r string").select(F.from_json("r", schema).alias("r")).select("r.*")


@query(
    "sink_csv",
    "SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"
)
def sink_csv(spark, d):
    g = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    path = exchange.folder(spark, "priorities")
    sinks.csv(g, path)
    return spark.read.schema(
        "priority string, n bigint, total double"
    ).option("header", True).option("enforceSchema", False).csv(path)


@query("sink_markdown", """WITH c AS (SELECT r_regionkey AS k, r_name AS name, count(n_nationkey) / 3.0::DOUBLE AS third FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL),
 g AS (SELECT k, '| ' || k || ' | ' || name || ' | ' || printf('%.4f', third) || ' |' AS line FROM c)
 SELECT 0 AS at, '| region | name | third |' AS line UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT CAST(row_number() OVER (ORDER BY k) + 1 AS INT), line FROM g""")
def sink_markdown(spark, d):
    n = read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg((F.count("*") / 3.0).alias("third"))
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"))
    text = sinks.markdown(
        r.join(n, "region", "left").fillna(0.0, ["third"]).orderBy("region").select("region", "name", "third")
    )
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "at int, line string")


@query(
    "sink_manifest",
    "SELECT 7 AS seed, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split, count(*) AS count, "
    "count(DISTINCT md5(text)) AS keys, (SELECT count(*) FROM documents) AS rows FROM documents GROUP BY 2"
)
def sink_manifest(spark, d):
    x = read(spark, d, "documents").selectExpr(
        "CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split", "md5(text) AS key"
    )
    path = _written(sinks.manifest(x, "split", "key", 7), "manifest")
    m = readers.jsonl(spark, path, "seed int, splits array<struct<split:string,count:bigint,keys:bigint>>, rows bigint")
    return m.select("seed", "rows", F.explode("splits").alias("s")).select("seed", "s.*", "rows")


@query(
    "sink_guard_overwrite",
    "SELECT true AS refused, (SELECT count(*) FROM nation) AS kept, (SELECT count(*) FROM region) AS replaced"
)
def sink_guard_overwrite(spark, d):
    """A second write is refused and leaves the first; told to, it replaces it."""
    n, r = read(spark, d, "nation").select(
        F.col("n_nationkey").alias("k")
    ), read(spark, d, "region").select(F.col("r_regionkey").alias("k"))
    path, refused = _written(n, "guarded"), False
    try:
        sinks.jsonl(r, path)
    except Exception as e:  # Spark's own error class, told by its condition
        refused = "PATH_ALREADY_EXISTS" in str(e)
        if not refused:
            raise
    kept = readers.jsonl(spark, path, "k bigint").count()
    sinks.jsonl(r, path, overwrite=True)
    return readers.jsonl(spark, path, "k bigint").agg(
        F.lit(refused).alias("refused"), F.lit(kept).cast("bigint").alias("kept"), F.count("*").alias("replaced")
    )


@query(
    "sink_gate_exit",
    "SELECT count(*) > 0 AS failed, CAST(count(*) AS INT) AS splits FROM (SELECT lang FROM documents GROUP BY lang "
    "HAVING count(*) > count(DISTINCT md5(text)))"
)
def sink_gate_exit(spark, d):
    """A gate over languages: no text twice.  Its failure names every language that breaks it."""
    g = read(spark, d, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_distinct(F.md5("text")).alias("keys")
    )
    try:
        audit.require(g.where(F.col("lang").isNotNull()), F.col("n") == F.col("keys"), "no text twice")
        failed: list[str] = []
    except audit.GateFailure as e:
        failed = str(e).split("Row(")[1:]
    return spark.createDataFrame([(len(failed) > 0, len(failed))], "failed boolean, splits int")


@query(
    "puzzle_of",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'wrapped' ELSE 'plain' END AS form, o_custkey AS seed "
    "FROM orders"
)
def puzzle_of(spark, d):
    """A record's puzzle, whether it is the record itself or a field of it."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    inner = F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("seed"))
    even = F.col("o_orderkey") % 2 == 0
    rec = o.select(
        F.when(even, inner).alias("puzzle"), F.when(~even, F.col("o_orderkey")).alias("id"),
        F.when(~even, F.col("o_custkey")).alias("seed")
    )
    x = readers.jsonl(spark, _written(rec, "puzzles"), "puzzle struct<id:bigint,seed:bigint>, id bigint, seed bigint")
    form = F.when(F.col("puzzle").isNotNull(), "wrapped").otherwise("plain").alias("form")
    p = readers.puzzle_of(x)
    return p.select("id", form, "seed")


@query(
    "sort_ids",
    "SELECT name, CAST(row_number() OVER (ORDER BY n) - 1 AS BIGINT) AS at FROM (SELECT 'r' || s_suppkey AS name, "
    "s_suppkey AS n FROM supplier)"
)
def sort_ids(spark, d):
    """Names in the order of their numbers: r2 before r10."""
    from ..operators.positions import numbered

    x = read(spark, d, "supplier").select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("name"))
    x = x.withColumn("n", F.regexp_extract("name", r"(\d+)$", 1).cast("bigint"))
    return numbered(x, "n", "at").select("name", "at")


@query(
    "seen_keys_splits",
    "SELECT CAST(o_orderkey % 3 AS INT) AS split, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY "
    "o_custkey ORDER BY o_orderkey % 3, o_orderkey) AS n FROM orders) WHERE n = 1"
)
def seen_keys_splits(spark, d):
    """Three splits one after another, each without the customers that earlier ones had: by the index of their keys."""
    index = seen.KeyIndex(spark, exchange.folder(spark, "seen"))
    o, out = read(spark, d, "orders").select("o_orderkey", "o_custkey"), None
    for k in range(3):
        kept = index.split(o.where(F.col("o_orderkey") % 3 == k), F.col("o_custkey"), ["o_orderkey"])
        kept = kept.select(F.lit(k).alias("split"), "o_orderkey")
        out = kept if out is None else out.unionByName(kept)
    return out


@query(
    "paired_step_log",
    "WITH r AS (SELECT CAST(event_id % 4 AS INT) AS run, event_id // 4 % 97 AS step, CASE WHEN event_id % 3 = 0 THEN 'log' ELSE "
    "'stats' END AS kind, event_id FROM events), p AS (SELECT run, step, min(event_id) FILTER (kind = 'log') AS log, "
    "min(event_id) FILTER (kind = 'stats') AS stats FROM r GROUP BY ALL) SELECT 'r' || run AS run, step, log, stats FROM p "
    "WHERE log IS NOT NULL AND stats IS NOT NULL"
)
def paired_step_log(spark, d):
    """Steps' log entries and statistics, out of order in one stream: the first of each half, paired by a stateful processor."""
    e = read(spark, d, "events")
    step, kind = F.floor(F.col("event_id") / 4) % 97, F.when(F.col("event_id") % 3 == 0, "log").otherwise("stats")
    rows = e.groupBy(F.concat(F.lit("r"), F.col("event_id") % 4).alias("run"), step.alias("step"), kind.alias("kind")).agg(
        F.lpad(F.min("event_id").cast("string"), 12, "0").alias("body")
    )
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("step")).alias("at")
    arrived, out, state = (exchange.folder(spark, n) for n in ("arriving", "pairs", "pairing"))
    sinks.jsonl(rows.select("run", "step", at, "kind", "body"), arrived)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    paired.rocksdb_state(spark)
    try:
        pairs = paired.paired(logs.stream_jsonl(spark, arrived, paired.ROWS), "1 day")
        logs.append_to(pairs, out, state).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    x = spark.read.schema(paired.PAIRS).json(out)
    return x.select("run", "step", F.col("log").cast("long"), F.col("stats").cast("long"))

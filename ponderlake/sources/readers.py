"""Scans.  Schemas are explicit, paths are anything Spark reads, and nothing is opened by the driver."""

from __future__ import annotations

from dataclasses import fields, is_dataclass
from typing import Any, get_type_hints
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or pattern) is there, in any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON Lines; blank lines give no row, a malformed one is an error unless not ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def lines_index(spark: SparkSession, path: str) -> DataFrame:
    """file, lines, before: lines of each file that aren't blank, and those of the files before it in order of name.

    One scan; a row for each file.  To be kept where slices of the same files are taken often.
    """
    x = spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"))
    counts = x.groupBy("file").agg(F.count("*").alias("lines"))
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "lines", F.coalesce(F.sum("lines").over(ahead), F.lit(0)).alias("before"))


def jsonl_slice(
    spark: SparkSession, path: str, schema: str, offset: int, limit: int, index: DataFrame | None = None
) -> DataFrame:
    """``line`` and the record of lines offset .. offset + limit in file order (names, then lines; blank lines are none).

    Only files that hold lines of the range are opened.  Of these, blocks that are within the range are counted, not moved;
    lines are numbered within blocks.
    """
    found = (lines_index(spark, path) if index is None else index).where(
        (F.col("before") < offset + limit) & (F.col("before") + F.col("lines") > offset)
    ).collect()  # a row for each file of the range
    if not found:
        return spark.createDataFrame([], f"line long, {schema}")
    before = spark.createDataFrame([(r.file, r.before) for r in found], "file string, start long")
    block = F.col("_metadata.file_block_start").alias("block")
    rows = spark.read.text([unquote(r.file) for r in found]).where("trim(value) <> ''").select(
        F.col("_metadata.file_path").alias("file"), block, "value", F.monotonically_increasing_id().alias("row")
    )
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n")).join(F.broadcast(before), "file")
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.withColumn("first", F.col("start") + F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    blocks = blocks.where((F.col("first") < offset + limit) & (F.col("first") + F.col("n") > offset))
    mine = rows.join(blocks.select("file", "block", "first"), ["file", "block"])
    # rows of a block come from one task, in order
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("row")) - 1
    lines = mine.withColumn("line", F.col("first") + place).where(F.col("line").between(offset, offset + limit - 1))
    return lines.select("line", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("line", "r.*")


def jsonl_first(spark: SparkSession, path: str, schema: str, n: int, index: DataFrame | None = None) -> DataFrame:
    """The first ``n`` records in file order."""
    return jsonl_slice(spark, path, schema, 0, n, index)


def jsonl_keyed(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """One row for each key; of repeated keys the last in file order stays.

    The order is that of (file, byte block of it, row in block), known without a global sort.
    """
    x = jsonl(spark, path, schema)
    at = F.struct(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("r")
    )
    names = x.columns
    return x.select(
        at.alias("__at"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    ).groupBy(f"row.{key}").agg(F.max_by("row", "__at").alias("row")).select("row.*")


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a file that may be missing: then an empty table of the same schema."""
    return jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def json_doc(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document spread over lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def probe(doc: DataFrame) -> DataFrame:
    """Groups of a probe document: key ``id@stepN``, its step, gold pattern and rollouts."""
    g = doc.select(F.explode("groups").alias("g")).select("g.probe_step", F.explode("g.prompts").alias("p"))
    return g.select(
        F.concat("p.id", F.lit("@step"), F.col("probe_step").cast("string")).alias("key"),
        F.col("p.id").alias("id"),
        "probe_step",
        "p.ground_truth_pattern",
        "p.rollouts"
    )


def rollout_groups(groups: DataFrame, people: Column) -> DataFrame:
    """Rollouts in long form: id, gold pattern, k, pattern, reward; the order of people is carried explicitly."""
    from ..functions.text import pattern_encode

    x = groups.select(
        "id", pattern_encode(F.col("ground_truth"), people).alias("gold"), F.posexplode("generations").alias("k", "g")
    )
    return x.select(
        "id",
        "gold",
        "k",
        pattern_encode(F.col("g.parsed_answer"), people).alias("pattern"),
        F.col("g.reward").cast("double").alias("reward"),
        F.col("g.format_valid").alias("format_valid")
    )


def multi_model(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """One file for each model, in one table with a column ``model``."""
    out = None
    for model, path in paths.items():
        x = jsonl(spark, path, schema).withColumn("model", F.lit(model))
        out = x if out is None else out.unionByName(x)
    return out


def landscape_long(records: DataFrame) -> DataFrame:
    """Nested scores by model as rows (id, gold, model, cand, score)."""
    from ..functions.text import PATTERNS

    gold = F.array_position(F.array(*[F.lit(p) for p in PATTERNS]), F.col("gold_pattern")) - 1
    x = records.select("id", gold.alias("gold"), F.explode("models").alias("model", "m"))
    return x.select("id", "gold", "model", F.posexplode("m.scores").alias("cand", "score"))


def puzzle_of(records: DataFrame, field: str = "puzzle") -> DataFrame:
    """The struct ``field`` of each record, or the record's own fields of those names where it has none."""
    inner = [f.name for f in records.schema[field].dataType.fields]  # type: ignore[attr-defined]
    here = F.struct(*[F.col(c) for c in inner])
    unwrapped = F.coalesce(F.col(field), here).alias("own")
    return records.select(field, unwrapped).select(field, "own.*")


def wide_arrays(doc: DataFrame, columns: list[str]) -> DataFrame:
    """Parallel arrays as rows."""
    return doc.select(F.explode(F.arrays_zip(*columns)).alias("x")).select("x.*")


def checkpoint_dirs(paths: DataFrame, column: str = "path") -> DataFrame:
    """Checkpoint folders with their numbers, in numeric order; names without a number are left out."""
    n = F.regexp_extract(column, r"(\d+)$", 1)
    return paths.where(n != "").withColumn("step", n.cast("int")).orderBy("step")


def metrics_normalised(*logs: DataFrame, fill: dict[str, Any] | None = None) -> DataFrame:
    """Metric logs of different versions under one schema; missing columns are null or filled."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.fillna(fill) if fill else out


def config(cls: type, file: dict[str, Any] | None = None, overrides: dict[str, Any] | None = None):
    """A dataclass from defaults, then a parsed file, then the command line; unknown names are errors, None means not given."""
    if not is_dataclass(cls):
        raise TypeError("a dataclass is needed")
    known = {f.name for f in fields(cls)}
    merged = {k: v for layer in (file or {}, overrides or {}) for k, v in layer.items() if v is not None}
    if extra := set(merged) - known:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    return cls(**merged)


def configured(cls: type, file: Column, overrides: dict[str, Column] | None = None) -> list[Column]:
    """Columns of a dataclass's settings for each row: defaults, then a document (JSON text), then a command line's.

    Null means not given; a name in a document that the class hasn't is an error, as is one in ``overrides``.
    """
    kinds, types = {int: "int", float: "double", str: "string", bool: "boolean"}, get_type_hints(cls)
    known = {f.name: f.default for f in fields(cls)}
    if extra := set(overrides or {}) - set(known):
        raise ValueError(f"unknown settings: {sorted(extra)}")
    schema = ", ".join(f"`{n}`: {kinds[types[n]]}" for n in known)
    own = F.from_json(file, f"struct<{schema}>")
    unknown = F.array_except(F.json_object_keys(file), F.array(*[F.lit(n) for n in known]))
    wrong = F.raise_error(F.concat(F.lit("unknown settings: "), F.array_join(unknown, ", ")))
    checked = F.when(F.size(unknown) > 0, wrong.cast(f"struct<{schema}>")).otherwise(own)
    value = lambda n: F.coalesce((overrides or {}).get(n, F.lit(None)), checked[n], F.lit(known[n]))
    return [value(n).cast(kinds[types[n]]).alias(n) for n in known]

"""Sinks: JSON Lines, metric logs, reports as JSON, CSV and Markdown, manifests, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON Lines with sorted keys, letters unescaped; refuses to replace unless told to."""
    sorted_columns(df).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    sorted_columns(df).write.mode("append").json(path)


def json_report(df: DataFrame) -> str:
    """A one-row result as indented JSON; more rows are an error."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"})).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report is one row")
    return rows[0][0]


def csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One CSV file with a header, for small results."""
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table; a result longer than ``limit`` is an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write them as CSV")
    line = lambda xs: "| " + " | ".join(xs) + " |"
    show = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line([show(x) for x in r]) for r in rows]])


def manifest(splits: DataFrame, split: str, key: str, seed: int) -> DataFrame:
    """One row: seed, universe of keys, and count and distinct keys by split."""
    per = splits.groupBy(split).agg(F.count("*").alias("count"), F.count_distinct(key).alias("keys"))
    entry = F.struct(F.col(split).alias("split"), "count", "keys")
    return per.agg(F.lit(seed).alias("seed"), F.array_sort(F.collect_list(entry)).alias("splits"), F.sum("count").alias("rows"))  # splits are few

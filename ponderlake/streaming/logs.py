"""Structured Streaming over JSON Lines folders: files that arrive become rows, results are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_jsonl(spark: SparkSession, path: str, schema: str, files: int = 50) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def new_keys(rows: DataFrame, key: Column, time: str | None = None, late: str = "1 day") -> DataFrame:
    """First row of each key.  With an event time, state is dropped when the watermark passes."""
    x = rows.withColumn("__key", key)
    x = x.withWatermark(time, late).dropDuplicatesWithinWatermark(["__key"]) if time else x.dropDuplicates(["__key"])
    return x.drop("__key")


def step_means(metrics: DataFrame, bucket: Column, columns: list[str]) -> DataFrame:
    """Running means by step bucket, null values skipped; for update or complete mode."""
    return metrics.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def windowed(
    events: DataFrame, time: str, size: str, slide: str | None, late: str, keys: list[str], aggs: list[Column]
) -> DataFrame:
    """Sliding or tumbling windows of event time with a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, size, slide or size), *keys).agg(*aggs)


def append_to(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append to a folder of JSON Lines, exactly once by the checkpoint; handles what has arrived, then stops."""
    return rows.writeStream.format("json").option("path", path).option(
        "checkpointLocation", checkpoint
    ).outputMode(mode).trigger(availableNow=True).start()


def each_batch(
    rows: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """A callback for each batch (its number makes repeats recognisable)."""
    return rows.writeStream.foreachBatch(f).option(
        "checkpointLocation", checkpoint
    ).outputMode(mode).trigger(availableNow=True).start()

"""Training examples, candidates, samples and evaluation records built from puzzles and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def sft_example(df: DataFrame, prompt: Column, completion: Column) -> DataFrame:
    """prompt, completion and messages (their concatenation) as chat turns."""
    x = df.withColumn("prompt", F.array(message("user", prompt))).withColumn(
        "completion", F.array(message("assistant", completion))
    )
    return x.withColumn("messages", F.concat("prompt", "completion"))


def answer_only(examples: DataFrame, block: Column) -> DataFrame:
    """The same rows with the completion replaced, messages with it."""
    x = examples.withColumn("completion", F.array(message("assistant", block)))
    return x.withColumn("messages", F.concat("prompt", "completion"))


def rl_example(examples: DataFrame) -> DataFrame:
    return examples.drop("completion", "messages")


def candidates(spark, people: Column) -> DataFrame:
    """cand, pattern and completion of all eight answers: a fixed table, to broadcast."""
    c = spark.range(8).select(
        F.col("id").cast("int").alias("cand"), text.pattern_of_index(F.col("id")).alias("pattern")
    )
    return c.withColumn("completion", text.fmt_answer_block(text.pattern_decode(F.col("pattern"), people), people))


def differing(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: rows and rows on which two formatters disagree."""
    return df.agg(F.count("*").alias("rows"), F.count_if(~a.eqNullSafe(b)).alias("different"))


def canonical_answer(answer: Column, people: Column) -> Column:
    """Sorted compact JSON of an assignment; null stays null."""
    pairs = F.array_sort(
        F.transform(people, lambda p: F.concat(F.lit('"'), p, F.lit('":"'), F.try_element_at(answer, p), F.lit('"')))
    )
    return F.when(answer.isNotNull(), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def sample_fixed(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """A sample of k rows without replacement: those whose seeded digest of the key is least, a bounded top-k over all rows."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(k)


def checkpoint_eval(records: DataFrame, checkpoint: str, gold: str, pred: str, invalid: str = "invalid") -> DataFrame:
    """Per checkpoint: rows, exact and valid counts and rates."""
    g = records.groupBy(checkpoint).agg(
        F.count("*").alias("count"), F.count_if(F.col(gold) == F.col(pred)).alias("exact"),
        F.count_if(F.col(pred) != invalid).alias("format_valid")
    )
    return g.withColumn("exact_accuracy", F.col("exact") / F.col("count")).withColumn(
        "format_accuracy", F.col("format_valid") / F.col("count")
    )


def probe_by_step(rollouts: DataFrame, step: str, reward: str) -> DataFrame:
    return rollouts.groupBy(step).agg(
        F.count("*").alias("n"), F.count_if(F.col(reward) == 1).alias("correct")
    ).withColumn("hit_rate", F.col("correct") / F.col("n"))


def param_delta(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: largest absolute difference of two snapshots of named values."""
    j = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    return j.agg(F.count("*").alias("values"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_abs_delta"))

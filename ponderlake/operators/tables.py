"""Distributions, contingency, confusion and transition tables, over long or paired predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PATTERNS
from .positions import with_quantiles


def combinations(spark, **values: Sequence[str]) -> DataFrame:
    """Every combination of a few values of each column: one row's arrays exploded, no join."""
    x = spark.range(0, 1, 1, 1).select()
    for name, few in values.items():
        x = x.select("*", F.explode(F.array(*[F.lit(v) for v in few])).alias(name))
    return x


def labels(spark, extra: Sequence[str] = (), name: str = "label") -> DataFrame:
    """The fixed dimension of labels (at most a dozen rows)."""
    return combinations(spark, **{name: (*PATTERNS, *extra)})


def distribution(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def zero_filled(counts: DataFrame, dims: DataFrame, keys: Sequence[str], value: str = "n") -> DataFrame:
    """Every combination in ``dims``, with 0 where ``counts`` has none; dims is a product of small label sets."""
    return dims.join(counts, list(keys), "left").withColumn(value, F.coalesce(value, F.lit(0)))


def crosstab(df: DataFrame, row: str, col: str, dim: DataFrame | None = None) -> DataFrame:
    """Counts of row by column values; with ``dim`` (the few values of ``row``), a zero for each of them that a column value lacks.

    A column value's counts are gathered by those few values in one grouping, so its values may be any number.
    """
    counts = df.groupBy(row, col).agg(F.count("*").alias("n"))
    if dim is None:
        return counts
    few = [r[0] for r in dim.select(row).collect()]
    each = F.array(
        *[
            F.struct(F.lit(v).alias(row), F.coalesce(F.max(F.when(F.col(row) == v, F.col("n"))), F.lit(0)).alias("n"))
            for v in few
        ]
    )
    return counts.groupBy(col).agg(each.alias("x")).select(
        col, F.explode("x").alias("x")
    ).select(f"x.{row}", col, "x.n")


def confusion(df: DataFrame, gold: str, pred: str, invalid: str = "invalid") -> DataFrame:
    """gold x predicted counts, zero-filled; invalid predictions are left out (count them with n_invalid)."""
    cells = combinations(df.sparkSession, **{gold: PATTERNS, pred: PATTERNS})
    return zero_filled(
        df.where(F.col(pred) != invalid).groupBy(gold, pred).agg(F.count("*").alias("n")), cells, (gold, pred)
    )


def per_class(df: DataFrame, gold: str, pred: str, invalid: str = "invalid") -> DataFrame:
    """Support and accuracy by class over valid predictions, invalid ones counted apart."""
    ok = F.col(pred) != invalid
    return df.groupBy(gold).agg(
        F.count_if(ok).alias("support"),
        F.try_divide(
            F.count_if(ok & (F.col(gold) == F.col(pred))), F.nullif(F.count_if(ok), F.lit(0))
        ).alias("accuracy"),
        F.count_if(~ok).alias("n_invalid")
    )


def macro(classes: DataFrame) -> DataFrame:
    return classes.agg(F.avg("accuracy").alias("macro_accuracy"), F.count_if(F.col("support") > 0).alias("classes"))


def metrics(
    df: DataFrame, keys: Sequence[str], correct: Column, format_valid: Column, parsed: Column, chars: Column,
    repeated: Column
) -> DataFrame:
    """Count and rates of evaluation records; zeros without rows."""
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count("*").alias("count"), rate(correct).alias("exact_accuracy"), rate(format_valid).alias("format_accuracy"),
        rate(parsed).alias("parse_success_rate"), rate(chars).alias("average_response_chars"),
        rate(repeated).alias("repetition_rate")
    )


def paired_correctness(df: DataFrame, a: Column, b: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of both right, left only, right only, neither; accuracies and their difference (WC - CW) / N."""
    both = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(a & b).alias("cc"), F.count_if(a & ~b).alias("cw"),
        F.count_if(~a & b).alias("wc"), F.count_if(~a & ~b).alias("ww")
    )
    n = F.nullif(F.col("n"), F.lit(0))
    return both.withColumn(
        "acc_a", F.try_divide(F.col("cc") + F.col("cw"), n)
    ).withColumn(
        "acc_b",
        F.try_divide(F.col("cc") + F.col("wc"), n)
    ).withColumn("delta", F.try_divide(F.col("wc") - F.col("cw"), n))


def transition(a: Column, b: Column) -> Column:
    return F.when(a & b, "CC").when(a & ~b, "CW").when(~a & b, "WC").otherwise("WW")


def feature_transition(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Mean, median, least and greatest of each feature by transition group."""
    long = df.select(
        group,
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
        ).alias("x")
    ).select(group, "x.feature", "x.value")
    g = long.groupBy(group, "feature").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return with_quantiles(g, long, [group, "feature"], {"median": ("value", 0.5)})


def prediction_transition(
    df: DataFrame, a: str, b: str, transition_col: str, subsets: Sequence[str] = ("WC", "CW"), invalid: str = "invalid"
) -> DataFrame:
    """Zero-filled counts of prediction a -> prediction b, over all rows and over named transitions; one pass."""
    spark = df.sparkSession
    names = F.array(F.lit("all"), *[F.when(F.col(transition_col) == s, F.lit(s)) for s in subsets])
    counts = df.select(
        F.col(a).alias("from"),
        F.col(b).alias("to"),
        F.explode(F.filter(names, lambda x: x.isNotNull())).alias("subset")
    ).groupBy("subset", "from", "to").agg(F.count("*").alias("n"))
    nine = (*PATTERNS, invalid)
    cells = combinations(spark, **{"subset": ("all", *subsets), "from": nine, "to": nine})
    return zero_filled(counts, cells, ("subset", "from", "to"))


def structure_accuracy(
    long: DataFrame, keys: Sequence[str], model: str = "model", correct: str = "correct", base: str = "a",
    least: int = 20
) -> DataFrame:
    """Accuracy of each model by structure with at least ``least`` rows, and its difference to the base model."""
    g = long.groupBy(*keys, model).agg(
        F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy")
    ).where(F.col("n") >= least)
    b = g.where(F.col(model) == base).select(*keys, F.col("accuracy").alias("base"))
    return g.join(b, list(keys), "left").select(
        *keys, model, "n", "accuracy", (F.col("accuracy") - F.col("base")).alias("delta")
    )


def class_bias(
    long: DataFrame, structure: str, pred: str = "pred", model: str = "model", least: float = 0.02
) -> DataFrame:
    """P(prediction | structure) by model, rows where some model reaches ``least``; small label sets pivot to columns upstream."""
    total = long.groupBy(structure, model).agg(F.count("*").alias("total"))
    rate = long.groupBy(structure, pred, model).agg(F.count("*").alias("n")).join(total, [structure, model]).withColumn(
        "rate", F.col("n") / F.col("total")
    )
    top = rate.groupBy(structure, pred).agg(F.max("rate").alias("top")).where(F.col("top") >= least)
    return rate.join(top, [structure, pred]).select(structure, pred, model, "rate")


def prompt_bias(long: DataFrame, gold: str = "gold", pred: str = "pred", model: str = "model") -> DataFrame:
    """Predicted less true frequency of each class by model."""
    x = long.select(
        model,
        F.explode(
            F.array(
                F.struct(F.col(gold).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")),
                F.struct(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"))
            )
        ).alias("x")
    )
    n = long.groupBy(model).agg(F.count("*").alias("n"))
    g = x.groupBy(model, "x.label").agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p")).join(n, model)
    return g.select(
        model, "label", (F.col("p") / F.col("n")).alias("predicted"), (F.col("t") / F.col("n")).alias("true"),
        ((F.col("p") - F.col("t")) / F.col("n")).alias("bias")
    )


def long_models(df: DataFrame, models: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """One row for each model's prediction: keep columns, model, pred."""
    return df.select(
        *keep,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("pred")) for m, c in models.items()])
        ).alias("x")
    ).select(*keep, "x.model", "x.pred")

"""Audits of splits: sizes, uniqueness, duplicates, leakage, set algebra, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.text import pattern_encode


def char_stats(df: DataFrame, keys: Sequence[str], chars: Column) -> DataFrame:
    """Least, greatest and mean length; zeros without rows."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.min(chars), F.lit(0)).alias("min_chars"), F.coalesce(F.max(chars), F.lit(0)).alias("max_chars"),
        F.coalesce(F.avg(chars), F.lit(0.0)).alias("mean_chars")
    )


def split_audit(
    df: DataFrame, split: str, ident: str, key: Column, chars: Column, solutions: Column | None = None
) -> DataFrame:
    """Per split: rows, distinct ids and keys, extra rows, bad solution counts, lengths.  One grouping by (split, key) pre-aggregates."""
    bad = solutions != 1 if solutions is not None else F.lit(False)
    g = df.groupBy(split).agg(
        F.count("*").alias("count"), F.count_distinct(ident).alias("unique_ids"),
        F.count_distinct(key).alias("unique_keys"), F.count_if(bad).alias("bad_solution_counts"),
        F.min(chars).alias("min_chars"), F.max(chars).alias("max_chars"), F.avg(chars).alias("mean_chars")
    )
    return g.withColumn("duplicate_count", F.col("count") - F.col("unique_keys"))


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """One row: rows, unique keys, keys held more than once, extra rows."""
    g = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    return g.agg(
        F.sum("n").alias("total"), F.count("*").alias("unique_keys"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.sum(F.col("n") - 1).alias("extra_rows")
    )


def overlaps(df: DataFrame, split: str, key: Column) -> DataFrame:
    """Keys shared by each unordered pair of splits.

    Splits are few, so a key's splits form a small set: pairs come from that set, not from a join of the table with itself.
    """
    sets = df.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    left = sets.select("s", F.posexplode("s").alias("i", "left"))
    return left.select(
        "left", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("right")
    ).groupBy("left", "right").agg(F.count("*").alias("shared_keys"))


def anti_dedup(candidates: DataFrame, universe: DataFrame, key: str, pos: str, n: int | None = None) -> DataFrame:
    """First occurrence of each candidate key that the universe doesn't hold, in order of position, the first n."""
    first = candidates.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in candidates.columns]), pos).alias("row")
    ).select("row.*")
    new = first.join(universe.select(key), key, "left_anti")
    return new.orderBy(pos).limit(n) if n is not None else new


def paired_gate(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids on one side only; a paired analysis needs both 0."""
    x = a.select(key, F.lit(1).alias("l")).distinct().join(
        b.select(key, F.lit(1).alias("r")).distinct(), key, "full_outer"
    )
    return x.agg(
        F.count_if(F.col("r").isNull()).alias("left_only"),
        F.count_if(F.col("l").isNull()).alias("right_only"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both")
    )


def parser_consistency(records: DataFrame, text: str, people: Column, answer: str, valid: str) -> DataFrame:
    """One row: records whose text, parsed again, gives the stored pattern and verdict, and those that differ in either."""
    x = records.withColumn("parsed", parsing.parse_answer(F.col(text), people))
    pattern, ok = pattern_encode(F.col("parsed.answer"), people), F.col("parsed.ok")
    same, alike = pattern.eqNullSafe(F.col(answer)), ok.eqNullSafe(F.col(valid))
    changed = F.count_if(~same).alias("answer_changed"), F.count_if(~alike).alias("verdict_changed")
    return x.agg(F.count("*").alias("checked"), F.count_if(same & alike).alias("equal"), *changed)


def lookup(facts: DataFrame, dimension: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Facts with the dimension's columns, and a one-row gate: facts without a match.

    Spark broadcasts the dimension if it is found small, else sorts both sides.
    """
    return facts.join(dimension, key, "left"), facts.join(dimension, key, "left_anti").agg(
        F.count("*").alias("unmatched")
    )


#: Names of a gate's decisions, and their bounds.
WEAK, GO_ON, BORDERLINE = "H2_INTERVENTION_WEAK_STOP", "CONTINUE_TO_PHASE_B", "BORDERLINE_REVIEW"
STOP, GO = 0.10, 0.25


def decision(rate: Column, stop: float = STOP, go: float = GO) -> Column:
    """Ladder of a gate: below ``stop`` weak, above ``go`` continue, else (and for null) borderline."""
    return F.when(rate < stop, WEAK).when(rate > go, GO_ON).otherwise(BORDERLINE)


def rescue_rate(hits: Column, n: Column) -> Column:
    return F.try_divide(hits, F.nullif(n, F.lit(0)))


class GateFailure(RuntimeError):
    """An audit's gate didn't hold."""


def require(gate: DataFrame, ok: Column, name: str) -> None:
    """Raise with the failing rows of a small gate table; of more than 100, how many more there are."""
    bad = gate.where(~ok).limit(100).collect()
    if bad:
        n = gate.where(~ok).count() if len(bad) == 100 else len(bad)
        raise GateFailure(f"{name}: {', '.join(map(str, bad))}" + (f" and {n - 100} more" if n > 100 else ""))

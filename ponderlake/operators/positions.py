"""Row numbers without a single sorted partition, and operators on positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import exchange

_INSIDE = (1 << 33) - 1


def spread(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` in order over range partitions: ``__pid`` (partition) and ``__in`` (place in it), in a table of its own.

    Splitters come from a sample, so partitions are alike however keys are distributed; rows that are equal in ``order`` are
    split as well, as the place of a row in the input comes last.
    """
    last = df.withColumn("__row", F.monotonically_increasing_id())
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, "__row"]
    x = last.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("__row")
    inside = F.monotonically_increasing_id().bitwiseAND(_INSIDE)
    return exchange.table(x.select("*", F.spark_partition_id().alias("__pid"), inside.alias("__in")), "spread")


def numbered(df: DataFrame, key: str, name: str = "pos", by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """``name``: 0-based position in the order of ``key`` (then ``ties``), within each group of ``by``; ``total``: its rows.

    A row's number is its place in its partition and the rows of the partitions before: of all rows, only a count for each
    partition is put in order, so neither sparse keys nor equal ones bring many rows together.  Writes a table when called.
    """
    rows = spread(df, [*by, key, *ties])
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = rows.groupBy("__pid").agg(F.count("*").alias("__n"))
    counts = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    x = rows.join(F.broadcast(counts), "__pid").withColumn(name, F.col("__before") + F.col("__in"))
    x = x.drop("__pid", "__in", "__before")
    if not by:
        return x.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))
    starts = x.groupBy(*by).agg(F.min(name).alias("__start"), F.count("*").alias("total"))
    return _null_safe(x, starts, by).withColumn(name, F.col(name) - F.col("__start")).drop("__start")


def running(
    counts: DataFrame, key: str, n: str, by: Sequence[str] = (), parts: int = 256, name: str = "before"
) -> DataFrame:
    """``counts`` (one row for each value of ``key``, ``n`` rows of it) with the number of rows of smaller values, and ``total``.

    Values are summed within ``parts`` intervals and only the intervals' sums in order of them.  Intervals end at quantiles
    of a group's values, so each holds about as many of them, whatever their distribution.  Groups may be null.
    """
    g = list(by) or ["__all"]
    x = counts if by else counts.withColumn("__all", F.lit(0))
    shares = [i / parts for i in range(1, parts)]
    ends = x.groupBy(*g).agg(F.percentile_approx(key, shares, 10 * parts).alias("__ends"), F.sum(n).alias("total"))
    x = _null_safe(x, ends, g)
    # how many ends are no greater than the value, by bisection
    steps = F.array(*[F.lit(1 << b) for b in range((parts - 1).bit_length() - 1, -1, -1)])
    up = lambda at, s: F.when(F.get("__ends", at + s - 1) <= F.col(key), at + s).otherwise(at)
    x = x.withColumn("__b", F.aggregate(steps, F.lit(0), up)).drop("__ends")
    sums = x.groupBy(*g, "__b").agg(F.sum(n).alias("__n"))
    ahead = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*g, "__b", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    inner = Window.partitionBy(*g, "__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__in", F.coalesce(F.sum(n).over(inner), F.lit(0)))
    x = _null_safe(x, sums, [*g, "__b"])
    return x.withColumn(name, F.col("__before") + F.col("__in")).drop("__b", "__in", "__before", "__all")


def _null_safe(x: DataFrame, y: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys of which nulls are equal."""
    other = y.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], *[c for c in y.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    return x.join(other, same).drop(*[f"__{i}" for i in range(len(keys))])


def quantiles(df: DataFrame, by: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact quantiles (linear between two rows) of columns by group: {name: (column, share)}, one row a group.

    Rows are counted by value first, then ranked by sums over intervals; no buffer holds a group's values.  Nulls don't count.
    """
    out = None
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        counts = df.where(F.col(column).isNotNull()).groupBy(
            *by, F.col(column).cast("double").alias("__v")
        ).agg(F.count("*").alias("__c"))
        x = running(counts, "__v", "__c", by)
        aggs = []
        for name, (c, p) in wanted.items():
            if c == column:
                at = F.lit(p) * (F.col("total") - 1)

                def value(rank):
                    return F.max(
                        F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("__c")), F.col("__v"))
                    )

                share = F.max(at - F.floor(at))
                aggs.append((value(F.floor(at)) + share * (value(F.ceil(at)) - value(F.floor(at)))).alias(name))
        q = x.groupBy(*by).agg(*aggs)
        out = q if out is None else _null_safe(out, q, by)
    return out


def with_quantiles(
    aggregated: DataFrame, df: DataFrame, by: Sequence[str], wanted: dict[str, tuple[str, float]]
) -> DataFrame:
    """A grouping of ``df`` with quantiles of its groups; null for groups without values."""
    q = quantiles(df, by, wanted)
    other = q.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(by)], *wanted)
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    return aggregated.join(other, same, "left").drop(*[f"__{i}" for i in range(len(by))])


def quartile_ends(df: DataFrame, key: str, total_order: Sequence[str]) -> DataFrame:
    """Rows with ``end``: low for the lowest floor(n / 4) by the order, high for the highest ceil(n / 4), others dropped.

    ``total_order``: a column, then columns that break its ties.
    """
    first, *ties = total_order
    x = numbered(df, first, "__r", ties=ties or [key])
    low, high = F.floor(F.col("total") / 4), F.col("total") - F.ceil(F.col("total") / 4)
    end = F.when(F.col("__r") < low, "low").when(F.col("__r") >= high, "high")
    return x.withColumn("end", end).where(F.col("end").isNotNull()).drop("__r", "total")


def unique_in_order(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values with the position of their first appearance."""
    return df.groupBy(value).agg(F.min(pos).alias("first_pos"))


def first_mismatch(a: DataFrame, b: DataFrame, step: str, value: str) -> DataFrame:
    """One row: the first step at which two sequences differ (null if they never do), and the steps compared."""
    j = a.select(step, F.col(value).alias("x")).join(b.select(step, F.col(value).alias("y")), step)
    return j.agg(
        F.count("*").alias("compared"),
        F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col(step))).alias("first_mismatch")
    )


def topk(df: DataFrame, groups: Sequence[str], order: Sequence, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(name) <= k)


def select_interleave(df: DataFrame, m: str, key: str, n: int) -> DataFrame:
    """Rare successes (1 to 3) first, then middle (4 to 12) and high (13 to 15) in turn, leftovers after, n rows in all.

    Each class needs its first n rows only, so three bounded top-k selections are merged.
    """
    kind = F.when(F.col(m).between(1, 3), 0).when(F.col(m).between(4, 12), 1).when(F.col(m).between(13, 15), 2)
    rows = topk(df.withColumn("kind", kind).where(F.col("kind").isNotNull()), ["kind"], [key], n, "turn")
    rare = F.col("kind") == 0
    return rows.withColumn(
        "place", F.struct((~rare).cast("int"), "turn", "kind")
    ).orderBy("place").limit(n).withColumn(
        "rank",
        F.row_number().over(Window.orderBy("place"))
    ).drop("kind", "turn", "place")

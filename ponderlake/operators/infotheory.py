"""Entropy and mutual information from counts; the unit is a parameter (bits or nats).

Everything is computed from one aggregated table of counts, so only the number
of distinct combinations is shuffled after the first grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _log(x: Column, unit: str) -> Column:
    return F.log2(x) if unit == "bits" else F.log(x)


def entropy(df: DataFrame, col: str, unit: str = "nats") -> DataFrame:
    """One row: entropy of a column, 0 without rows."""
    c = df.groupBy(col).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return c.crossJoin(F.broadcast(total)).agg(F.coalesce(-F.sum(p * _log(p, unit)), F.lit(0.0)).alias("entropy"))


def mutual_information(df: DataFrame, x: str, y: str, unit: str = "nats") -> DataFrame:
    """One row: mi, h_x, h_y and both normalisations (null where an entropy is 0)."""
    c = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    c = c.withColumn(
        "nx", F.sum("n").over(Window.partitionBy("x"))
    ).withColumn("ny", F.sum("n").over(Window.partitionBy("y"))).crossJoin(F.broadcast(total))
    p = F.col("n") / F.col("total")
    ratio = F.col("n").cast("double") * F.col("total") / (F.col("nx").cast("double") * F.col("ny"))
    out = c.agg(
        F.sum(p * _log(ratio, unit)).alias("mi"),
        (-F.sum(p * _log(F.col("nx") / F.col("total"), unit))).alias("h_x"),
        (-F.sum(p * _log(F.col("ny") / F.col("total"), unit))).alias("h_y")
    )
    share = lambda h: F.when(F.col(h) > 1e-12, F.col("mi") / F.col(h))
    return out.select("mi", "h_x", "h_y", share("h_x").alias("nmi_x"), share("h_y").alias("nmi_y"))


def conditional(df: DataFrame, x: str, y: str, z: str, unit: str = "nats") -> DataFrame:
    """One row: I(X; Y | Z) and H(X | Z)."""
    c = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    over = lambda *k: F.sum("n").over(Window.partitionBy(*k)).cast("double")
    c = c.withColumn("nz", over("z")).withColumn(
        "nxz", over("x", "z")
    ).withColumn("nyz", over("y", "z")).crossJoin(F.broadcast(total))
    p = F.col("n") / F.col("total")
    return c.agg(
        F.sum(p * _log(F.col("n") * F.col("nz") / (F.col("nxz") * F.col("nyz")), unit)).alias("cmi"),
        (-F.sum(p * _log(F.col("nxz") / F.col("nz"), unit))).alias("h_x_given_z")
    )

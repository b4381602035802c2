"""Geometry of weighted sums of long vectors from Gram matrices, so that vectors are read once.

A group (a prompt's completions, say) has members, each with a vector in blocks of any number: rows (group, member, block,
values).  A block's inner products are made where its members meet; their sums over blocks are the group's Gram matrix, a
number for each pair of its members.  Norms, ratios, cosines and differences of sums of members under any weights follow from
it.  Members of a group are few by nature (a group's block of values meets in one task); blocks and groups may be any number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks(vectors: DataFrame, keys: list[str], values: str, size: int) -> DataFrame:
    """Vectors that fit a row, in blocks of ``size`` values."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / size)))
    x = vectors.select(*keys, F.explode(starts).alias("block"), values)
    return x.select(*keys, "block", F.slice(values, F.col("block").cast("int") * size + 1, F.lit(size)).alias(values))


def gram(vectors: DataFrame, group: str, member: str, block: str, values: str) -> DataFrame:
    """group, i, j, dot for members i <= j; a block that a member lacks counts as zeros, nulls in a block too."""
    own = F.struct(F.col(member).cast("long").alias("member"), F.col(values).cast("array<double>").alias("values"))
    met = vectors.where(F.col(values).isNotNull()).groupBy(group, block).agg(F.array_sort(F.collect_list(own)).alias("rows"))
    kind = vectors.schema[group].dataType.simpleString()

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, rows = batch.column(group), batch.column("rows")
            for at in range(batch.num_rows):
                own = rows[at].values
                members = own.field("member").to_numpy()
                values = own.field("values")
                flat = values.flatten().fill_null(0.0).to_numpy()
                sizes = pc.list_value_length(values).to_numpy()
                x = np.zeros((len(members), max(1, sizes.max())))
                x[np.arange(x.shape[1]) < sizes[:, None]] = flat
                g = x @ x.T
                i, j = np.triu_indices(len(members))
                yield pa.RecordBatch.from_arrays(
                    [groups.take(pa.array(np.full(len(i), at))), pa.array(members[i]), pa.array(members[j]), pa.array(g[i, j])],
                    [group, "i", "j", "dot"],
                )

    parts = met.select(group, "rows").mapInArrow(products, f"`{group}` {kind}, i long, j long, dot double")
    return parts.groupBy(group, "i", "j").agg(F.sum("dot").alias("dot"))


def compared(grams: DataFrame, weights: DataFrame, group: str, name: str, member: str, base: str, other: str) -> DataFrame:
    """group, ``name``, norm, base_norm, norm_ratio, cosine, relative_diff of the members' sums under two weights.

    ``weights``: a row for each member under each name, with the columns ``base`` and ``other``.  Ratios and the difference
    relative to the other norm are null if that norm is 0, the cosine if either is.
    """
    w = weights.select(group, name, F.col(member).cast("long").alias("m"), F.col(base).alias("p"), F.col(other).alias("q"))
    left = w.select(group, name, F.col("m").alias("i"), F.col("p").alias("pi"), F.col("q").alias("qi"))
    right = w.select(group, name, F.col("m").alias("j"), F.col("p").alias("pj"), F.col("q").alias("qj"))
    x = grams.join(left, [group, "i"]).join(right, [group, name, "j"])
    twice = F.when(F.col("i") < F.col("j"), 2.0).otherwise(1.0)
    cross = F.col("pi") * F.col("qj") + F.when(F.col("i") < F.col("j"), F.col("pj") * F.col("qi")).otherwise(0.0)
    s = x.groupBy(group, name).agg(
        F.sum(twice * F.col("dot") * F.col("pi") * F.col("pj")).alias("pp"),
        F.sum(twice * F.col("dot") * F.col("qi") * F.col("qj")).alias("qq"), F.sum(F.col("dot") * cross).alias("pq"),
    )
    p, q = (F.sqrt(F.greatest(F.col(c), F.lit(0.0))) for c in ("pp", "qq"))
    apart = F.sqrt(F.greatest(F.col("pp") - 2 * F.col("pq") + F.col("qq"), F.lit(0.0)))
    none = lambda c: F.nullif(c, F.lit(0.0))
    return s.select(
        group, name, q.alias("norm"), p.alias("base_norm"), F.try_divide(p, none(q)).alias("norm_ratio"),
        F.try_divide(F.col("pq"), none(p * q)).alias("cosine"), F.try_divide(apart, none(q)).alias("relative_diff"),
    )

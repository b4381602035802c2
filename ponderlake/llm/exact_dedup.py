"""Exact deduplication by two-pass Bloom filtering, DataFrame functions only.

Texts are equal when identical after deleting white space ``[\\x20\\x09-\\x0D]``.

1. Every row's digest is computed once and kept in the shared folder.
2. First pass: each digest sets one bit of a filter of ``BITS_PER_ROW`` bits for
   each row, a power of two.  Bits hit at least twice form a second filter ("seen
   again"), in bitmaps of 4 KB.  It is broadcast, and so at most ``MOST_BITS`` bits
   (256 MB) whatever the input.  One probe is the cheapest number here: a second
   would move as much again as it saves among the rows that look repeated.
3. Second pass: rows whose bit isn't in the second filter are unique for certain
   and pass straight through.  Only the others shuffle: they are grouped by the
   whole digest (partial aggregation first) and joined back on digest and salt,
   so that a group of copies of any size is spread over ``SALTS`` tasks.

Up to 1.3e8 rows one unique row in 16 shuffles beside the repeated ones; beyond
that the filter no longer grows and the share rises (to 2 in 5 at 1e9 rows, nearly
all at 1e10).  A full filter costs shuffles, never results.

Defined results: a null text counts as empty; empty texts are equal to each
other; texts of any length are read whole; ids may be of any type that can be
ordered; of texts of the same length (ties) the least id stays; a row without id
stays only if no row of its group has an id, and then all of the group do, as
nothing tells them apart; rows that repeat an id and text count each in
``group_size`` and are all kept if their id is; an empty table gives an empty
result; columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

BITS_PER_ROW, MOST_BITS, SALTS = 16, 31, 16
#: Bits of a bitmap as Spark's bitmap functions have them.
_BITMAP = 15


def filter_size(rows: int) -> int:
    """Bits of the filter, as a power of two, for a number of rows."""
    return min(MOST_BITS, max(_BITMAP, math.ceil(math.log2(max(1, rows) * BITS_PER_ROW))))


def digest(text: Column) -> Column:
    white = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")
    return F.sha2(white.cast("binary"), 256)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256; a table in the shared folder."""
    shared.prepare(docs.sparkSession)
    size = F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("size")
    with shared.scratch() as keep:
        rows = docs.select(F.col(id_col).alias("doc_id"), size, digest(F.col(text_col)).alias("text_sha256"))
        rows = shared.table(rows, "digests")
        bits = filter_size(rows.count()) if filter_bits is None else filter_bits
        bit = F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long").bitwiseAND((1 << bits) - 1)

        hits = rows.groupBy(bit.alias("bit")).agg(F.count("*").alias("n")).where("n > 1")
        place = F.col("bit").bitwiseAND((1 << _BITMAP) - 1)
        again = hits.groupBy(F.shiftright("bit", _BITMAP).alias("page")).agg(
            F.bitmap_construct_agg(place).alias("bitmap")
        )

        probed = rows.withColumn("page", F.shiftright(bit, _BITMAP)).withColumn(
            "at", bit.bitwiseAND((1 << _BITMAP) - 1).cast("int")
        )
        probed = probed.join(F.broadcast(again), "page", "left")  # 2 ** MOST_BITS bits at most
        byte = "conv(hex(substring(bitmap, at div 8 + 1, 1)), 16, 10)"
        maybe = F.expr(f"coalesce(shiftright(int({byte}), at % 8) & 1 = 1, false)").alias("maybe")
        tested = shared.table(probed.select("doc_id", "size", "text_sha256", maybe), "tested")

        one = F.lit(1).cast("long").alias("group_size")
        alone = tested.where(~F.col("maybe"))
        alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), one, F.lit(True).alias("kept"), "text_sha256")
        salt = F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt")
        some = tested.where("maybe").select("doc_id", "size", "text_sha256", salt)
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), -F.col("size"), "doc_id")).alias("best")
        groups = some.groupBy("text_sha256").agg(F.count("*").alias("group_size"), best).where("group_size > 1")
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        groups = groups.select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), salts)
        both = some.join(groups, ["text_sha256", "salt"], "left")
        single = F.col("group_size").isNull()
        keep_id = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id")
        kept = (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept")
        found = both.select(
            "doc_id", keep_id, F.coalesce("group_size", F.lit(1)).alias("group_size"), kept, "text_sha256"
        )
        return keep(shared.table(alone.unionByName(found), "copies"))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, each judged by its own id and text."""
    gone = exact_dedup(docs, id_col, text_col).where("NOT kept").select("doc_id", "text_sha256").distinct()
    gone = shared.checked(shared.table(gone.toDF("gone_id", "gone_text"), "gone"))
    same = docs[id_col].eqNullSafe(gone["gone_id"]) & (digest(docs[text_col]) == gone["gone_text"])
    return docs.join(gone, same, "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
      CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""

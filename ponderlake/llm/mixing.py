"""Mixing sources to target weights along a time-varying curriculum, DataFrame functions only.

Each source has a cumulative demand of words: its target times the integral of
its weight schedule, piecewise constant over equal phases of training.  A
source's documents form a stream in the order of ``md5(id)``, repeated as often
as its target asks.  The place of a document in the stream is a number of words
demanded before it; the inverse of the cumulative demand turns that into a
position in training (0 to 1), by which documents are range-sorted.

Prefix sums never gather a source: words are summed for each (source, bucket of
md5), the few bucket sums are accumulated, and only within a bucket are rows
ordered.  The table of sources is an aggregate (one row per source).

Sources by code point, null last, weigh 5, 2, 1, repeating.  Targets share all
words by weight but stop at ``max_repeats`` times their source's words, the
excess reshared by weight: the water level is found in closed form from the
sources sorted by cap over weight.  Documents are taken whole; of the last pass
through a stream those are taken whose middle word the target reaches, so a
source's taken words are its target to within half a document.

The table of sources has a row for each; it is sorted by one task, which is right
for up to some 1e7 sources.

Defined results: null text has size 0; texts of any length are counted whole; a
null source is a source of its own; a source without words has target 0; null or
repeated ids (ties) are ordered by size; rows alike in id, source and size share
their places; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WEIGHTS = (5, 2, 1)
#: Multipliers of a source's weight in four equal phases of training, by its weight; each averages 1.
SCHEDULES = {5: (1.0, 1.0, 1.0, 1.0), 2: (0.5, 0.75, 1.25, 1.5), 1: (1.5, 1.25, 0.75, 0.5)}
BUCKET_HEX = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """source_id, source_size, weight, target: one row per source (null-safe key ``source_id``)."""
    total = sizes.groupBy("source_id").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("source_id")
    weigh = F.element_at(
        F.array(*[F.lit(float(x)) for x in WEIGHTS]),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")
    )
    t = total.withColumn("weight", weigh).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "source_id")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn(
        "past", F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    t = t.withColumn(
        "all_words", F.sum("source_size").over(whole)
    ).withColumn("all_weight", F.sum("weight").over(whole))
    # the level if all before are at their caps and none from here on; it holds from the first that stays below its cap
    t = t.withColumn("level", (F.col("all_words") - F.col("capped")) / (F.col("all_weight") - F.col("past")))
    t = t.withColumn(
        "level",
        F.min(
            F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("past"), F.col("level")))
        ).over(whole)["level"]
    )
    return t.select(
        "source_id", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target")
    )


def _invert(share: Column, weight: Column) -> Column:
    """Position in training at which ``share`` of a source's words has been demanded."""
    out = None
    for w, phases in SCHEDULES.items():
        n, done, x = len(phases), 0.0, None
        for i, m in enumerate(phases):
            part = m / sum(phases)
            value = (F.lit(float(i)) + (share - F.lit(done)) / F.lit(part)) / F.lit(float(n))
            x = F.when(share < F.lit(done + part), value) if x is None else x.when(share < F.lit(done + part), value)
            done += part
        x = F.least(x.otherwise(F.lit(1.0)), F.lit(1.0))
        out = F.when(weight == float(w), x) if out is None else out.when(weight == float(w), x)
    return F.round(out, 9)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3,
    carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, size, source_size, target, taken, position (of its first use; null if never), its place ``before`` in the stream, ``weight``, and inner columns to ``carry``."""
    spark = shared.prepare(docs.sparkSession)
    size = words(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.struct(F.col(source_col).isNull().alias("none"), F.col(source_col).alias("name")).alias("source_id"),
        size.alias("size")
    )
    rows = shared.table(rows.withColumn("place", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sizes")
    rows = rows.withColumn("bucket", F.substring("place", 1, BUCKET_HEX))
    per = targets(rows, max_repeats)
    sums = rows.groupBy("source_id", "bucket").agg(F.sum("size").alias("bucket_words"))
    ahead = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(
        "ahead", F.coalesce(F.sum("bucket_words").over(ahead), F.lit(0))
    ).join(per, "source_id").drop("bucket_words")
    within = Window.partitionBy("source_id", "bucket").orderBy("place", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    t = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["source_id", "bucket"])
    t = t.withColumn("before", F.col("ahead") + F.col("inside")).withColumn("goal", F.round("target").cast("long"))
    full = F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("full", full).withColumn("rest", F.col("goal") - F.col("full") * F.col("source_size"))
    again = (F.col("size") > 0) & (2 * (F.col("rest") - F.col("before")) >= F.col("size"))
    t = t.withColumn("taken", (F.col("full") + again.cast("long")) * F.col("size"))
    share = F.try_divide(F.col("before").cast("double"), F.col("target"))
    return t.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        F.when(F.col("taken") > 0, _invert(share, F.col("weight"))).alias("position"),
        "before",
        "weight",
        *carry
    )


def training_order(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3
) -> DataFrame:
    """The rows of ``docs`` as training takes them, repeats included, range-sorted by position.

    Texts stay as they are.  Rows that repeat id, source and size share what one of them takes.
    """
    names = docs.columns
    m = mix(docs, id_col, text_col, source_col, max_repeats, carry=("source_id",)).where("taken > 0")
    m = m.dropDuplicates(["doc_id", "source_id", "size"])
    turns = F.sequence(F.lit(0), F.expr("int(taken div size)") - 1)

    def at(turn: Column) -> Column:
        share = (F.col("before") + turn * F.col("source_size")).cast("double") / F.col("target")
        return F.struct(_invert(share, F.col("weight")).alias("position"), turn.alias("turn"))

    m = m.select(F.struct("doc_id", "source_id", "size").alias("same"), F.transform(turns, at).alias("turns"))
    source = F.struct(F.col(source_col).isNull().alias("none"), F.col(source_col).alias("name"))
    same = F.struct(F.col(id_col).alias("doc_id"), source.alias("source_id"), words(F.col(text_col)).alias("size"))
    rows = docs.select(F.struct("*").alias("row"), same.alias("of"))
    x = rows.join(m, F.col("of").eqNullSafe(F.col("same"))).select("row", F.explode("turns").alias("take"))
    return x.orderBy("take.position", f"row.{id_col}", "take.turn").select(*[F.col(f"row.`{c}`") for c in names])


def _oracle() -> str:
    phases = []
    for w, parts in SCHEDULES.items():
        done, n, arms = 0.0, len(parts), []
        for i, m in enumerate(parts):
            part = m / sum(parts)
            arms.append(
                f"WHEN share < CAST({done + part!r} AS DOUBLE) THEN (CAST({float(i)!r} AS DOUBLE) + (share - "
                f"CAST({done!r} AS DOUBLE)) / CAST({part!r} AS DOUBLE)) / CAST({float(n)!r} AS DOUBLE)"
            )
            done += part
        phases.append(f"WHEN weight = {w} THEN least(CASE {' '.join(arms)} ELSE 1.0::DOUBLE END, 1.0::DOUBLE)")
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM d GROUP BY source),
k AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, 0 AS step, false AS full_ FROM s),
f AS (SELECT source, source_size, weight, cap, 0 AS step, false AS at_cap FROM k
      UNION ALL
      SELECT source, source_size, weight, cap, step + 1,
             at_cap OR weight * ((sum(source_size) OVER () - coalesce(sum(cap) FILTER (at_cap) OVER (), 0)) / nullif(sum(weight) FILTER (NOT at_cap) OVER (), 0)) > cap
      FROM f WHERE step < 60),
t AS (SELECT source, source_size, weight, CASE WHEN at_cap THEN cap ELSE least(cap, ((sum(source_size) OVER () - coalesce(sum(cap) FILTER (at_cap) OVER (), 0)) / sum(weight) FILTER (NOT at_cap) OVER ()) * weight) END AS target FROM f WHERE step = 60),
b AS (SELECT d.doc_id, size, source_size, weight, target, CAST(round(target) AS BIGINT) AS goal,
      CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS turns, before / nullif(target, 0) AS share FROM b),
h AS (SELECT *, CAST(turns * size + CASE WHEN size > 0 AND 2 * (goal - turns * source_size - before) >= size THEN size ELSE 0 END AS BIGINT) AS taken FROM g)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE {' '.join(phases)} END, 9) END AS position FROM h
"""


ORACLE = _oracle()

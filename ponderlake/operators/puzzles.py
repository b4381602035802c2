"""Puzzles as rows: compiling, solving, describing, rendering, naming and balancing.

A puzzle row has ``id``, ``people`` (array of names) and ``statements`` (array of
struct(speaker, expr as JSON text)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logic, text, worlds

PEOPLE = ("Alice", "Bob", "Carol")


def compiled(puzzles: DataFrame, people: tuple[str, ...] = PEOPLE) -> DataFrame:
    """id, people, speakers, ``masks``, ``texts``, ``stats`` (per statement) and the solution mask.

    A puzzle's statements stay in their array: no row is exploded and none shuffled.
    """
    said = puzzles.select(
        "id", "people", F.col("statements.speaker").alias("speakers"), F.col("statements.expr").alias("trees")
    )
    c = said.withColumn("stats", logic.compile_all(people)(F.col("trees"))).drop("trees")
    bits = logic.truth_masks(list(people))
    speaker = F.create_map(*[F.lit(x) for p, m in bits.items() for x in (p, m)])
    masks, texts = F.col("stats.mask").alias("masks"), F.col("stats.text").alias("texts")
    g = c.select(
        "id",
        "people",
        "speakers",
        masks,
        texts,
        "stats",
        F.transform("speakers", lambda s: speaker[s]).alias("speaker_bits")
    )
    solved = logic.consistent_mask(F.col("masks"), F.col("speaker_bits"), len(people))
    return g.withColumn("solutions", solved).withColumn("n_solutions", F.bit_count("solutions"))


def solution(solutions: Column) -> Column:
    """Pattern of the first solution in enumeration order, null without one."""
    first = F.get(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: logic.eval_mask(solutions, i)), F.lit(0))
    return F.when(solutions != 0, text.pattern_of_index(first))


def solved(puzzles: DataFrame) -> DataFrame:
    """``puzzles`` of any number of people with ``steps`` (of each statement), ``n_solutions`` and ``pattern`` (of the first).

    A puzzle's table has a 64-bit word for each 64 assignments and stays in its row.
    """
    n = F.size("people")
    x = puzzles.withColumn("steps", worlds.compiled_all(F.col("statements.expr"), F.col("people")))
    speaker = lambda s: F.array_position(F.col("people"), s["speaker"]).cast("int") - 1
    said = F.zip_with("statements", "steps", lambda s, t: F.struct(speaker(s).alias("speaker"), t.alias("steps")))
    x = x.withColumn("__said", said).withColumn("__table", worlds.solutions(F.col("__said"), n))
    x = x.withColumn("n_solutions", worlds.count(F.col("__table")))
    return x.withColumn("pattern", worlds.pattern(worlds.first(F.col("__table")), n)).drop("__said", "__table")


def assignments(spark, people: tuple[str, ...] = PEOPLE) -> DataFrame:
    """a (0 to 2^n - 1, all knights first), pattern and map: a table of fixed small size, to broadcast."""
    n = len(people)
    a = spark.range(1 << n).select(F.col("id").cast("int").alias("a"))
    marks = [
        F.when(F.shiftright("a", n - 1 - j).bitwiseAND(1) == 0, F.lit("K")).otherwise(F.lit("N")) for j in range(n)
    ]
    names = F.array(*[F.lit(p) for p in people])
    return a.withColumn("pattern", F.concat(*marks)).withColumn("answer", text.pattern_decode(F.col("pattern"), names))


def row_features(c: DataFrame) -> DataFrame:
    """Per puzzle: label, top operators, operator signature, characters, nodes, depth and six operator counts."""

    def count(i: int) -> Column:
        return F.aggregate("stats", F.lit(0), lambda t, s: t + s["ops"][i])

    c = c.withColumns({f"n_{o}": count(i) for i, o in enumerate(text.OPS)})
    sign = F.array_join(
        F.filter(
            F.array(
                *[
                    F.when(F.col(f"n_{o}") > 0, F.concat(F.lit(f"{o}:"), F.col(f"n_{o}").cast("string")))
                    for o in text.OPS
                ]
            ),
            lambda x: x.isNotNull()
        ),
        ","
    )
    return c.select(
        "id", solution(F.col("solutions")).alias("pattern"), sign.alias("op_signature"), F.aggregate(
            "texts", F.lit(0), lambda t, x: t + F.length(x)
        ).alias("chars"), F.aggregate("stats", F.lit(0), lambda t, s: t + s["nodes"]).alias("nodes"),
        F.array_max(
            F.transform("stats", lambda s: s["depth"])
        ).alias("depth"), *[f"n_{o}" for o in text.OPS], F.array_join("speakers", ">").alias("speaker_order"),
    )


def balanced(solved: DataFrame, pattern: str = "pattern", pos: str = "id") -> DataFrame:
    """First puzzle of each label; one row a group leaves each task (partial aggregation)."""
    return solved.where(F.col(pattern).isNotNull()).groupBy(pattern).agg(F.min(pos).alias(pos))


def split_ids(new: DataFrame, key: str, pos: str, n: int, prefix: str) -> DataFrame:
    """The first n distinct keys in order of position, named ``prefix_000000`` on; n is the size of a split."""
    from pyspark.sql import Window

    first = new.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in new.columns]), pos).alias("row")
    ).select("row.*").orderBy(pos).limit(n)
    return first.withColumn(
        "id", F.format_string(f"{prefix}_%06d", (F.row_number().over(Window.orderBy(pos)) - 1).cast("int"))
    )

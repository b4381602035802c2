"""Tolerant parsing of answers, and rewards, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The block, the form of a line in it, and what is said of faults.
BLOCK = r"(?isU)<answer>\s*(.*?)\s*</answer>"
FORM = r"(?iU)^([A-Za-z][A-Za-z0-9_-]*)\s*:\s*(knight|knave)$"
NO_BLOCK, BAD_LINE, UNKNOWN, TWICE, MISSING = (
    "missing <answer> block",
    "invalid answer line: ",
    "unknown person: ",
    "duplicate person: ",
    "missing people: ",
)


def parse_answer(text: Column, people: Column) -> Column:
    """struct(answer map or null, ok, reason): the first <answer> block, line by line; the first bad line decides.

    Names and values are matched without case and returned as in ``people`` and in lower case.
    """
    block, found = F.regexp_extract(text, BLOCK, 1), F.regexp_like(text, F.lit(BLOCK))
    lines = F.filter(
        F.transform(F.split(block, r"\R"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""
    )

    def read(line: Column) -> Column:
        name = F.lower(F.regexp_extract(line, FORM, 1))
        return F.struct(
            line.alias("line"),
            F.regexp_like(line, F.lit(FORM)).alias("ok"),
            F.regexp_extract(line, FORM, 1).alias("name"),
            F.get(F.filter(people, lambda p: F.lower(p) == name), F.lit(0)).alias("person"),
            F.lower(F.regexp_extract(line, FORM, 2)).alias("kind"),
        )

    rows = F.transform(lines, read)
    names = F.transform(rows, lambda r: r["person"])

    def fault(r: Column, i: Column) -> Column:
        bad = F.when(~r["ok"], F.concat(F.lit(BAD_LINE + "'"), r["line"], F.lit("'")))
        bad = bad.when(r["person"].isNull(), F.concat(F.lit(UNKNOWN), r["name"]))
        return bad.when(F.array_position(names, r["person"]) <= i, F.concat(F.lit(TWICE), r["person"]))

    first = F.get(F.filter(F.transform(rows, fault), lambda x: x.isNotNull()), F.lit(0))
    absent = F.array_sort(F.array_except(people, names))
    missing = F.concat(F.lit(MISSING + "['"), F.array_join(absent, "', '"), F.lit("']"))
    reason = F.when(
        text.isNull() | ~found, NO_BLOCK
    ).when(first.isNotNull(), first).when(F.size(absent) > 0, missing).otherwise("ok")
    answer = F.when(reason == "ok", F.map_from_arrays(names, F.transform(rows, lambda r: r["kind"])))
    return F.struct(answer.alias("answer"), (reason == "ok").alias("ok"), reason.alias("reason"))


def score_completion(pattern: Column, gold: Column, format_valid: Column, format_weight: float = 0.1) -> Column:
    return (pattern == gold).cast("double") + F.lit(format_weight) * format_valid.cast("double")


def reward_exact(answer: Column, gold: Column) -> Column:
    """1 for the whole assignment (K/N strings), else 0; null answers give 0."""
    return F.coalesce((answer == gold).cast("double"), F.lit(0.0))


def reward_partial(answer: Column, gold: Column) -> Column:
    """Share of people whose type is right (K/N strings of one length)."""
    same = F.aggregate(
        F.sequence(F.lit(1), F.length(gold)),
        F.lit(0),
        lambda t, i: t + (F.substring(answer, i, 1) == F.substring(gold, i, 1)).cast("int")
    )
    return F.coalesce(same / F.length(gold), F.lit(0.0))


def reward(answer: Column, gold: Column, mode: str = "exact") -> Column:
    """Reward by mode; an unknown mode is an error, an empty gold assignment raises."""
    modes = {"exact": reward_exact, "partial": reward_partial}
    if mode not in modes:
        raise ValueError(f"unknown reward mode {mode!r}")
    return F.when(
        F.length(gold) == 0, F.raise_error(F.lit("no people"))
    ).when(answer.isNull(), F.lit(0.0)).otherwise(modes[mode](answer, gold))


def reward_configurable(
    correct: Column, parsed: Column, format_valid: Column, right: float = 1.0, unparsed: float = 0.0,
    malformed: float = 0.0, wrong: float = 0.0
) -> Column:
    return F.when(correct, F.lit(right)).when(~parsed, F.lit(unparsed)).when(
        ~format_valid, F.lit(malformed)
    ).otherwise(F.lit(wrong))


def eval_record(text: Column, people: Column, gold: Column) -> Column:
    """Parse, pattern and correctness of a completion."""
    from .text import pattern_encode

    p = parse_answer(text, people)
    pattern = pattern_encode(p["answer"], people)
    return F.struct(
        p["answer"].alias("parsed_answer"), p["reason"].alias("parse_reason"), p["ok"].alias("format_valid"),
        pattern.alias("prediction_pattern"), (pattern == gold).alias("correct")
    )

"""Labels, templates and text measures of three-person puzzles, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The labels of all assignments, in enumeration order, and operator names.
PATTERNS = ("KKK", "KKN", "KNK", "KNN", "NKK", "NKN", "NNK", "NNN")
OPS = ("person_is", "same", "different", "not", "and", "or")


def pattern_encode(answer: Column, people: Column, invalid: str = "invalid") -> Column:
    """K/N string of an assignment map in the order of ``people``; a null map or a missing person is invalid."""
    marks = F.transform(
        people,
        lambda p: F.when(F.try_element_at(answer, p) == "knight", "K").when(F.try_element_at(answer, p) == "knave", "N")
    )
    whole = F.when(~F.exists(marks, lambda m: m.isNull()), F.array_join(marks, ""))
    return F.coalesce(F.when(answer.isNotNull(), whole), F.lit(invalid))


def pattern_decode(pattern: Column, people: Column) -> Column:
    """Assignment map of a K/N string."""
    values = F.transform(F.split(pattern, ""), lambda c: F.when(c == "K", "knight").otherwise("knave"))
    return F.map_from_arrays(people, F.slice(values, F.lit(1), F.size(people)))


def pattern_of_index(i: Column) -> Column:
    return F.when(i.between(0, 7), F.element_at(F.array(*[F.lit(p) for p in PATTERNS]), (i + 1).cast("int")))


def fmt_assignment(answer: Column, people: Column) -> Column:
    """``Alice=knight, Bob=knave`` in the order of people."""
    return F.array_join(F.transform(people, lambda p: F.concat(p, F.lit("="), F.try_element_at(answer, p))), ", ")


#: The lines around the statements of a prompt, by kind of prompt.
PROMPT_HEAD = ("Determine whether each person is a knight or a knave.", "")
PROMPT_TAIL = {
    "reasoning": (
        "",
        "Return your reasoning inside <reasoning>...</reasoning>.",
        "Then return exactly this format inside <answer>...</answer>:",
        "Alice: knight|knave",
        "Bob: knight|knave",
        "Carol: knight|knave",
    ),
    "answer_only": (
        "",
        "Return exactly one answer block inside <answer>...</answer>:",
        "Alice: knight",
        "Bob: knave",
        "Carol: knight"
    ),
}
#: The first and last line of a reasoning trace, and its sentences.
TRACE_HEAD = "I check all possible assignments."
TRACE_TAIL = "Only one assignment is valid, so it is the answer."
TRACE_VALID = "valid; every statement matches its speaker's type."
TRACE_INVALID = ("invalid because the statement by ", " does not match the speaker's type.")


def _lines(xs: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def fmt_prompt(statements: Column, kind: str = "reasoning") -> Column:
    """The question about a puzzle, one line for each statement (speaker, text); the three names are literal."""
    said = F.transform(statements, lambda s: F.concat(s["speaker"], F.lit(" says: "), s["text"]))
    return F.array_join(F.concat(_lines(PROMPT_HEAD), said, _lines(PROMPT_TAIL[kind])), "\n")


def fmt_answer_block(answer: Column, people: Column) -> Column:
    lines = F.transform(people, lambda p: F.concat(p, F.lit(": "), F.try_element_at(answer, p)))
    return F.concat(F.lit("<answer>\n"), F.array_join(lines, "\n"), F.lit("\n</answer>"))


def fmt_reasoning_trace(statement_masks: Column, speaker_at: Column, people: Column) -> Column:
    """One line for each of the eight assignments: valid, or the speakers whose statement contradicts their type.

    ``statement_masks``: per statement an integer whose bit i is its truth under assignment i;
    ``speaker_at``: per statement the position of its speaker among ``people``.
    """

    def line(i: Column) -> Column:
        kinds = F.transform(people, lambda p, j: F.concat(p, F.when(_knight(i, j), "=knight").otherwise("=knave")))
        wrong = F.filter(
            F.sequence(F.lit(0), F.size(statement_masks) - 1),
            lambda s: _bit(F.get(statement_masks, s), i) != _knight(i, F.get(speaker_at, s))
        )
        names = F.array_join(F.transform(wrong, lambda s: F.get(people, F.get(speaker_at, s))), ", ")
        because = F.concat(F.lit(TRACE_INVALID[0]), names, F.lit(TRACE_INVALID[1]))
        return F.concat(
            F.lit("- "),
            F.array_join(kinds, ", "),
            F.lit(": "),
            F.when(F.size(wrong) == 0, F.lit(TRACE_VALID)).otherwise(because)
        )

    body = F.transform(F.sequence(F.lit(0), F.lit(7)), line)
    return F.array_join(F.concat(F.array(F.lit(TRACE_HEAD)), body, F.array(F.lit(TRACE_TAIL))), "\n")


def _bit(mask: Column, i: Column) -> Column:
    return F.call_function("getbit", mask.cast("bigint"), i.cast("int")) == 1


def _knight(assignment: Column, person: Column) -> Column:
    """Whether person number ``person`` is a knight under assignment 0 (all knights) to 7 (none)."""
    return F.call_function("getbit", (F.lit(7) - assignment).cast("bigint"), (F.lit(2) - person).cast("int")) == 1


def fmt_completion(trace: Column, answer: Column, people: Column, solutions: Column) -> Column:
    """Reasoning and answer; raises unless there is exactly one solution."""
    text = F.concat(F.lit("<reasoning>\n"), trace, F.lit("\n</reasoning>\n"), fmt_answer_block(answer, people))
    return F.when(solutions == 1, text).otherwise(F.raise_error(F.lit("a completion needs exactly one solution")))


def has_repeated_line(text: Column) -> Column:
    """Whether three consecutive non-empty lines, trimmed, are equal."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    runs = F.sequence(F.lit(0), F.greatest(F.size(lines) - 3, F.lit(0)))
    return F.when(
        F.size(lines) >= 3,
        F.exists(runs, lambda i: (F.get(lines, i) == F.get(lines, i + 1)) & (F.get(lines, i) == F.get(lines, i + 2)))
    ).otherwise(F.lit(False))


def json_len(role: Column, content: Column) -> Column:
    """Length of one message as JSON with spaced separators and unescaped letters."""
    quoted = lambda c: F.length(F.to_json(F.struct(c.alias("x")))) - F.length(F.lit('{"x":}'))
    return quoted(content) + quoted(role) + F.length(F.lit('[{"content": , "role": }]'))


def top_ops_multiset(signature: Column) -> Column:
    """Sorted components of ``a+b+c``, joined with a pipe."""
    return F.array_join(F.array_sort(F.split(signature, "[+]")), "|")


def bin_label(low: Column, high: Column, last: Column) -> Column:
    """``[0.05,0.10)``; the last bin is closed at 1."""
    return F.when(last, F.format_string("[%.2f,1.00]", low)).otherwise(F.format_string("[%.2f,%.2f)", low, high))


#: Names of ranges of the number of correct ones among 16.
M_BUCKETS = {
    "m=0": (0, 0),
    "m=1": (1, 1),
    "m=2": (2, 2),
    "m=3": (3, 3),
    "m=4-7": (4, 7),
    "m=8": (8, 8),
    "m=9-12": (9, 12),
    "m=13-15": (13, 15),
    "m=16": (16, 16),
}


def m_bucket(m: Column) -> Column:
    """Name of the range of the number of correct ones among 16."""
    return F.coalesce(*[F.when(m.between(a, b), name) for name, (a, b) in M_BUCKETS.items()])


def split_seed(seed: Column, offset: Column) -> Column:
    return seed + offset * F.lit(1_000_003)


def epoch_of_step(step: Column, train_rows: int, batch: int = 16) -> Column:
    return step / F.lit(train_rows / batch)

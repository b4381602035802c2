"""Quality rules as a bitmask ledger.

Every rule is evaluated once; a document's row keeps the measurements and one
bit per failed rule.  Policies are versioned masks over those bits, so a policy
is applied, compared or ablated by bit operations on the ledger, without
reading a text again.

Measurements of a document: n_words, word_chars (code points in words),
n_symbols (characters of ``#*$%&|<>``), n_dup_lines (lines with a word that
equal an earlier line), n_repeat_words (words in a 3-word window found twice or
more in the document).  Windows are compared by 64-bit hashes of their words
within one document.

Defined results: null and empty texts have no words and fail the base rules;
texts of any length are measured whole in blocks; an empty table gives an empty
ledger; rows repeat as in the input (ties don't occur: no row is chosen among
others); columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .textops import U64, WHITE, Block, blocks, mix, per_doc, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Rules by bit; a rule is an SQL condition over the measurements that is true where the document fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]
#: Versions of the policy: the rules that remove a document.
POLICIES = {
    "v1": BASE | BITS["symbols"],
    "v2": BASE | BITS["symbols"] | BITS["duplicate_lines"] | BITS["short_words"] | BITS["long_words"]
}
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def _repeats(h: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Which of the valid windows occur twice or more."""
    at = np.flatnonzero(ok)
    order = at[np.argsort(h[at])]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(len(h), bool)
    out[order[twice]] = True
    return out


def measure_block(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    b = Block(data, off)
    doc = b.doc_of_word()
    if len(b.start) >= 3:
        h = windows(b.hashes(), 3) ^ mix(doc.astype(U64) + U64(1))
        r = _repeats(h, b.valid(3))
        r[2:] |= r[1:-1] | r[:-2]
        r[1] |= r[0]
    else:
        r = np.zeros(len(b.start), bool)
    heads = (data & 0xC0) != 0x80
    chars = per_doc(heads & ~WHITE[data], b.off)
    symbols = per_doc(_SYMBOL[data], b.off)
    dup, lines = np.zeros(b.n, np.int64), np.zeros(b.n, np.int64)
    raw = data.tobytes()
    for i in range(b.n):
        parts = raw[b.off[i] : b.off[i + 1]].split(b"\n")
        lines[i] = len(parts)
        if len(parts) > 1 and len(set(parts)) < len(parts):
            seen: set[bytes] = set()
            for x in parts:
                if x in seen:
                    dup[i] += bool(x.strip(b" \t\n\x0b\x0c\r"))
                else:
                    seen.add(x)
    return [b.counts.astype(np.int64), chars, symbols, dup, per_doc(r, b.first), lines]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in blocks(batches):
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), *map(pa.array, measure_block(data, off))],
            names=[x.split()[0] for x in _SCHEMA.split(", ")]
        )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failed`` (bit mask of failed rules), one row per document."""
    shared.prepare(docs.sparkSession)
    m = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(_measure, _SCHEMA)
    failed = sum((F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES), F.lit(0))
    return m.withColumn("failed", failed.cast("long"))


def passes(policy: str = "v1", failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(POLICIES[policy]) == 0


def apply_policy(led: DataFrame, policy: str = "v1") -> DataFrame:
    return led.withColumn("base_failed", F.col("failed").bitwiseAND(BASE) != 0).withColumn("kept", passes(policy))


def ablations(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents it fails, and those only it removes (kept if it were dropped).

    Masks are counted first (at most ``2**len(RULES)`` groups), then compared bit by bit.
    """
    mask = POLICIES[policy]
    masks = led.groupBy(F.col("failed").bitwiseAND(mask).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("long").alias("bit")) for name,
            _ in RULES if BITS[name] & mask
        ]
    )
    x = masks.withColumn("r", F.explode(rules)).select("failed", "n", "r.rule", "r.bit")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    only = F.col("failed") == F.col("bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return x.groupBy("rule").agg(total(hit)("n_failed"), total(only)("n_only"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c) GROUP BY doc_id),
l AS (SELECT doc_id, l, count(*) - 1 AS extra FROM (SELECT doc_id, unnest(ls) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
x AS (SELECT doc_id, sum(extra) AS n FROM l GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(x.n, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {base} <> 0 AS base_failed, failed & {policy} = 0 AS kept, n_lines, failed FROM b
""".replace("{bits}", " + ".join(f"CASE WHEN {rule} THEN {BITS[name]} ELSE 0 END" for name, rule in RULES)).replace("{base}", str(BASE)).replace("{policy}", str(POLICIES["v1"]))


def _ablation_sql() -> str:
    ledger = ORACLE.split("SELECT doc_id, n_words, word_chars")[0]
    parts = [
        f"SELECT '{p}' AS policy, '{name}' AS rule, count(*) FILTER (failed & {BITS[name]} <> 0) AS n_failed, "
        f"count(*) FILTER (failed & {mask} = {BITS[name]}) AS n_only FROM b"
        for p, mask in POLICIES.items() for name in BITS if BITS[name] & mask
    ]
    return ledger + " UNION ALL ".join(parts)


#: For each policy and rule, from the same ledger: documents that fail it, and those that nothing else would remove.
ABLATIONS = _ablation_sql()

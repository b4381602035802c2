"""Personal data: format-preserving pseudonyms by keyed Feistel permutations, SQL expressions only.

One pattern finds candidates of all kinds; each is then validated by kind, and a
candidate that isn't valid (a number that fails its check digit, a 13th month)
stays as it is.  Valid values are replaced:

* card numbers (Luhn): the digits between the first and the check digit are
  permuted, the check digit is worked out anew;
* telephone numbers (a valid exchange, 2 to 9 first; without separators or country
  code also a valid area): the ten national digits are permuted, walking on until
  area and exchange are valid in the same way as before;
* social security numbers: the nine digits are permuted among valid ones;
* IPv4 addresses (four numbers up to 255, not after a letter or a word such as
  "version" or "chapter"): the 32 bits are permuted;
* dates (1900 to 2099; ``y-m-d``, ``d.m.y``, ``m/d/y``): the day's number is permuted;
* e-mail addresses and secrets (``password=``, ``token:`` ...) have no number to
  permute: a keyed digest of the value takes their place.

Separators and layout are kept.  A permutation depends on key, kind and length
alone, so equal values get equal pseudonyms in all documents, different values
different ones, and the holder of the key can undo it.  A Feistel network of
``ROUNDS`` rounds acts on two halves; where valid values are a part of all, it is
applied until the result is as valid as its input was (cycle walking, which keeps
it a permutation); a walk that doesn't end within ``WALK`` steps is an error (its
probability is below 1e-19).  The key is an argument without a default; as all
literals it shows in the plan, so plans are as secret as the key.

Defined results: null texts stay null with no findings; empty texts stay empty;
texts of any length are masked whole; a place that fits several kinds (ties) is
of the first of ``KINDS``; repeated rows are masked alike; null ids are kept;
columns besides id and text are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

ROUNDS, WALK = 8, 256
KINDS = ("email", "secret", "ip", "card", "ssn", "date", "phone")
#: Patterns by kind; earlier kinds win.  Quantifiers before a rare sign are possessive, so that no text makes them slow.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?i:\b(?:password|passwd|secret|token|api[_-]?key)\b)[ \t]*[=:][ \t]*\"?[A-Za-z0-9_/+=.-]{8,}+\"?",
    "ip": r"(?<![\w.])(?<!(?i:version|release|chapter|section) )\d{1,3}+(?:\.\d{1,3}+){3}(?!\.?\d)",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}(?![ -]?\d)|\d{4}(?:[ -]\d{4}){3}|\d{4}(?:[ -]\d{4}){2}[ -]\d|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])[2-9]\d{2}[ .-]?\d{4}(?![\d-])"
    r"|(?<![\d+])\+\d{1,3}[ .-]?\d{3}[2-9]\d{6}(?![\d-])|(?<![\w+.-])[2-9]\d{2}[2-9]\d{6}(?![\w-])",
}
#: Card candidates that may hold less: four groups and a number after them, and a phone number after four digits.
_FIVE, _DINERS = r"^(\d{4}(?:[ -]\d{4}){3})[ -]\d{1,3}$", r"^\d{4}[ -]\d{6}[ -]\d{4}$"
ALL = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)
_FIRST_DAY, _DAYS = "1900-01-01", 73049


def _sql(text: str) -> str:
    """An SQL string literal."""
    return "r'" + text.replace("'", "''") + "'" if "'" not in text else "'" + text.replace(
        "\\", "\\\\"
    ).replace("'", "\\'") + "'"


def _network(value: str, left: str, right: str, kind: str, key: str) -> str:
    """SQL of the permutation of an integer below left * right, two SQL numbers."""
    f = lambda half, size: f"cast(conv(substr(sha2(concat_ws(':', {_sql(key)}, '{kind}', {left}, {right}, i, {half}), 256), 1, 15), 16, 10) as bigint) % ({size})"
    start = f"named_struct('l', cast(({value}) div ({right}) as bigint), 'r', cast(({value}) % ({right}) as bigint))"
    step = f"CASE WHEN i % 2 = 0 THEN named_struct('l', cast((s.l + {f('s.r', left)}) % ({left}) as bigint), 'r', s.r) ELSE named_struct('l', s.l, 'r', cast((s.r + {f('s.l', right)}) % ({right}) as bigint)) END"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> {step}, s -> s.l * ({right}) + s.r)"


def _walk(value: str, left: str, right: str, kind: str, key: str, valid) -> str:
    """The permutation, repeated until the result is as valid as the value; ``valid``: SQL of a number -> SQL."""
    once = lambda x: _network(x, left, right, kind, key)
    first = f"named_struct('x', {once(value)}, 'ok', {valid(f'({value})')})"
    end = f"CASE WHEN {valid('w.x')} <=> w.ok THEN w.x ELSE cast(raise_error('a pseudonym was not found in {WALK} steps') as bigint) END"
    return f"aggregate(sequence(1, {WALK}), {first}, (w, j) -> CASE WHEN {valid('w.x')} <=> w.ok THEN w ELSE named_struct('x', {once('w.x')}, 'ok', w.ok) END, w -> {end})"


def _digits(n: str) -> tuple[str, str]:
    """Sizes of the halves for n decimal digits."""
    return f"cast(pow(10, ({n}) div 2) as bigint)", f"cast(pow(10, ({n}) - ({n}) div 2) as bigint)"


def _luhn(d: str, shift: int = 0) -> str:
    """Sum of the Luhn rule over a string of digits; shift 1: as if a check digit followed."""
    return f"aggregate(sequence(1, length({d})), 0L, (t, p) -> t + CASE WHEN (length({d}) - p + {shift}) % 2 = 0 THEN int(substr({d}, p, 1)) ELSE (2 * int(substr({d}, p, 1))) div 10 + (2 * int(substr({d}, p, 1))) % 10 END)"


def _lay(h: str, d: str) -> str:
    """New digits in the places of the old ones."""
    return f"array_join(zip_with(split({h}, '[0-9]', -1), concat(split({d}, ''), array('')), (a, b) -> concat(a, b)), '')"


def _replace(kind: str, h: str, key: str) -> str:
    """SQL of the pseudonym of a candidate, or null if it isn't valid."""
    d = f"regexp_replace({h}, '[^0-9]', '')"
    digest = f"sha2(concat_ws(':', {_sql(key)}, '{kind}', {{}}), 256)"
    if kind == "email":
        return f"concat('u', substr({digest.format(f'lower({h})')}, 1, 12), '@masked.invalid')"
    if kind == "secret":
        head = f"regexp_extract({h}, r'^([A-Za-z_-]+[ \\t]*[=:][ \\t]*\"?)', 1)"
        body = f"regexp_extract({h}, r'^[A-Za-z_-]+[ \\t]*[=:][ \\t]*\"?([^\"]*)', 1)"
        return f"concat({head}, 'masked', substr({digest.format(body)}, 1, 12), CASE WHEN endswith({h}, '\"') THEN '\"' ELSE '' END)"
    if kind == "ip":
        parts = f"transform(split({h}, r'\\.'), x -> cast(x as bigint))"
        number = f"aggregate({parts}, 0L, (t, x) -> t * 256 + x)"
        out = _network(number, "65536", "65536", kind, key)
        dotted = f"aggregate(array({out}), '', (t, v) -> concat_ws('.', v div 16777216, v div 65536 % 256, v div 256 % 256, v % 256))"
        return f"CASE WHEN forall({parts}, x -> x <= 255) THEN {dotted} END"
    if kind == "card":
        # the whole candidate if its sum is right, else its first four groups if theirs is
        four = f"regexp_extract({h}, {_sql(_FIVE)}, 1)"
        used = f"CASE WHEN {_luhn(d)} % 10 <> 0 AND regexp_like({h}, {_sql(_FIVE)}) THEN {four} ELSE {h} END"
        inner, n = "substr(c.d, 2, length(c.d) - 2)", "(length(c.d) - 2)"
        moved = f"lpad(cast({_network(f'cast({inner} as bigint)', *_digits(n), kind, key)} as string), {n}, '0')"
        body = f"concat(substr(c.d, 1, 1), {moved})"
        checked = f"aggregate(array({body}), '', (t, v) -> concat(v, cast((10 - {_luhn('v', 1)} % 10) % 10 as string)))"
        new = f"CASE WHEN {_luhn('c.d')} % 10 = 0 AND length(c.d) BETWEEN 13 AND 19 THEN concat({_lay('c.h', checked)}, substr({h}, length(c.h) + 1)) END"
        return f"get(transform(transform(array({used}), u -> named_struct('h', u, 'd', regexp_replace(u, '[^0-9]', ''))), c -> {new}), 0)"
    if kind == "ssn":
        valid = lambda x: f"({x} div 1000000 NOT IN (0, 666) AND {x} div 1000000 < 900 AND {x} div 10000 % 100 <> 0 AND {x} % 10000 <> 0)"
        moved = f"lpad(cast({_walk(f'cast({d} as bigint)', *_digits('9'), kind, key, valid)} as string), 9, '0')"
        return f"CASE WHEN {valid(f'cast({d} as bigint)')} THEN {_lay(h, moved)} END"
    if kind == "phone":
        valid = lambda x: f"(int({x} div 1000000000 >= 2) + 2 * int({x} div 1000000 % 10 >= 2))"
        moved = f"lpad(cast({_walk(f'cast(right({d}, 10) as bigint)', *_digits('10'), kind, key, valid)} as string), 10, '0')"
        return _lay(h, f"concat(left({d}, length({d}) - 10), {moved})")
    # dates: parts by layout, then the number of the day
    p = f"transform(regexp_extract_all({h}, '[0-9]+', 0), x -> int(x))"
    iso, dotted = f"{h} LIKE '%-%'", f"{h} LIKE '%.%'"
    part = lambda a, b, c: f"CASE WHEN {iso} THEN get({p}, {a}) WHEN {dotted} THEN get({p}, {b}) ELSE get({p}, {c}) END"
    y, m, day = part(0, 2, 2), part(1, 1, 0), part(2, 0, 1)
    ok = f"({y}) BETWEEN 1900 AND 2099 AND ({m}) BETWEEN 1 AND 12 AND ({day}) BETWEEN 1 AND 28 + CASE WHEN ({m}) = 2 THEN int(({y}) % 4 = 0 AND ({y}) <> 1900) WHEN ({m}) IN (4, 6, 9, 11) THEN 2 ELSE 3 END"
    number = f"cast(datediff(make_date({y}, {m}, {day}), date'{_FIRST_DAY}') as bigint)"
    moved = _walk(number, "270", "271", kind, key, lambda x: f"({x} < {_DAYS})")
    pad = lambda i, x: f"lpad(cast({x} as string), greatest(length(regexp_extract_all({h}, '[0-9]+', 0)[{i}]), length(cast({x} as string))), '0')"
    made = f"aggregate(array(date_add(date'{_FIRST_DAY}', cast({moved} as int))), '', (t, q) -> CASE WHEN {iso} THEN concat_ws('-', year(q), {pad(1, 'month(q)')}, {pad(2, 'day(q)')}) WHEN {dotted} THEN concat_ws('.', {pad(0, 'day(q)')}, {pad(1, 'month(q)')}, year(q)) ELSE concat_ws('/', {pad(0, 'month(q)')}, {pad(1, 'day(q)')}, year(q)) END)"
    return f"CASE WHEN {ok} THEN {made} END"


def _kind(h: str) -> str:
    d = f"regexp_replace({h}, '[^0-9]', '')"
    arms = " ".join(f"WHEN regexp_like({h}, {_sql('^(?:' + PATTERNS[k] + ')$')}) THEN '{k}'" for k in KINDS)
    # 4-6-4 digits that are no card can end in a phone number, whose pseudonym leaves digits before its ten alone
    return f"CASE WHEN regexp_like({h}, {_sql(_DINERS)}) AND {_luhn(d)} % 10 <> 0 THEN 'phone' {arms} END"


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (masked), n_found and n_<kind> for each kind: one row per row of ``docs``."""
    shared.prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    some = "regexp_like(text, '[0-9@]|(?i:password|passwd|secret|token|api)')"
    d = d.withColumn("hits", F.expr(f"CASE WHEN {some} THEN regexp_extract_all(text, {_sql(ALL)}, 0) END"))
    d = d.withColumn("kinds", F.expr(f"transform(hits, v -> {_kind('v')})"))
    arms = " ".join(f"WHEN kind = '{k}' THEN {_replace(k, 'v', key)}" for k in KINDS)
    d = d.withColumn("new", F.expr(f"zip_with(hits, kinds, (v, kind) -> CASE {arms} END)"))
    masked = f"CASE WHEN size(hits) > 0 THEN array_join(zip_with(split(text, {_sql(ALL)}, -1), concat(zip_with(hits, new, (v, n) -> coalesce(n, v)), array('')), (a, b) -> concat(a, b)), '') ELSE text END"
    count = lambda k: F.expr(
        f"cast(coalesce(size(filter(zip_with(kinds, new, (k, n) -> k = '{k}' AND n IS NOT NULL), x -> x)), 0) as "
        f"bigint)"
    ).alias(f"n_{k}")
    found = F.expr("cast(coalesce(size(filter(new, x -> x IS NOT NULL)), 0) as bigint)").alias("n_found")
    return d.select("doc_id", F.expr(masked).alias("text"), found, *[count(k) for k in KINDS])

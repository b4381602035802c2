"""Pseudonyms against a plain Python version of finding, validating and permuting, one candidate at a time."""

import datetime
import hashlib

import pytest
import regex
from compare import DATA

from ponderlake.llm import pii

KEY = "test key"
DAY = datetime.date(1900, 1, 1)
ONE = {k: regex.compile(p, regex.ASCII) for k, p in pii.PATTERNS.items()}
ANY = regex.compile("|".join(f"(?:{pii.PATTERNS[k]})" for k in pii.KINDS), regex.ASCII)


def digest(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def permute(x, left, right, kind):
    a, b = divmod(x, right)
    for i in range(pii.ROUNDS):
        f = lambda half: int(digest(KEY, kind, left, right, i, half)[:15], 16)  # noqa: B023, E731
        if i % 2 == 0:
            a = (a + f(b) % left) % left
        else:
            b = (b + f(a) % right) % right
    return a * right + b


def walk(x, left, right, kind, status):
    y = permute(x, left, right, kind)
    while status(y) != status(x):
        y = permute(y, left, right, kind)
    return y


def luhn_total(d, shift=0):
    return sum(int(c) if (len(d) - p + shift) % 2 == 0 else sum(divmod(2 * int(c), 10)) for p, c in enumerate(d, 1))


def lay(h, new):
    new = iter(new)
    return "".join(next(new) if c in "0123456789" else c for c in h)


def card(h):
    d = "".join(c for c in h if c.isdigit())
    if luhn_total(d) % 10:
        four = regex.fullmatch(r"(\d{4}([ -]\d{4}){3})[ -]\d{1,3}", h, regex.ASCII)
        if not four or luhn_total("".join(c for c in four[1] if c.isdigit())) % 10:
            return None
        return card(four[1]) + h[len(four[1]) :]
    n = len(d) - 2
    body = d[0] + str(permute(int(d[1:-1]), 10 ** (n // 2), 10 ** (n - n // 2), "card")).zfill(n)
    return lay(h, body + str((10 - luhn_total(body, 1) % 10) % 10))


def ssn(h):
    ok = lambda x: x // 10**6 not in (0, 666) and x // 10**6 < 900 and x // 10**4 % 100 != 0 and x % 10**4 != 0
    x = int(h.replace("-", ""))
    return lay(h, str(walk(x, 10**4, 10**5, "ssn", ok)).zfill(9)) if ok(x) else None


def phone(h):
    d = "".join(c for c in h if c.isdigit())
    status = lambda x: (x // 10**9 >= 2, x // 10**6 % 10 >= 2)
    return lay(h, d[:-10] + str(walk(int(d[-10:]), 10**5, 10**5, "phone", status)).zfill(10))


def ip(h):
    parts = [int(x) for x in h.split(".")]
    if max(parts) > 255:
        return None
    x = permute(sum(p << 8 * (3 - i) for i, p in enumerate(parts)), 65536, 65536, "ip")
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def date(h):
    sep = next(c for c in h if not c.isdigit())
    p = h.split(sep)
    order = {"-": (0, 1, 2), ".": (2, 1, 0), "/": (2, 0, 1)}[sep]
    y, m, d = (int(p[i]) for i in order)
    try:
        n = (datetime.date(y, m, d) - DAY).days
    except ValueError:
        return None
    if not 1900 <= y <= 2099:
        return None
    q = DAY + datetime.timedelta(walk(n, 270, 271, "date", lambda x: x < 73049))
    out = [""] * 3
    for i, v in zip(order, (q.year, q.month, q.day), strict=True):
        out[i] = str(v).zfill(len(p[i]) if i != order[0] else 4)
    return sep.join(out)


def email(h):
    return f"u{digest(KEY, 'email', h.lower())[:12]}@masked.invalid"


def secret(h):
    head = regex.match(r'[A-Za-z_-]+[ \t]*[=:][ \t]*"?', h)[0]
    body = h[len(head) :].rstrip('"')
    return f"{head}masked{digest(KEY, 'secret', body)[:12]}" + ('"' if h.endswith('"') else "")


MAKE = {"email": email, "secret": secret, "ip": ip, "card": card, "ssn": ssn, "date": date, "phone": phone}


def kind_of(h):
    if regex.fullmatch(r"\d{4}[ -]\d{6}[ -]\d{4}", h, regex.ASCII) and luhn_total("".join(c for c in h if c.isdigit())) % 10:
        return "phone"
    return next(k for k in pii.KINDS if ONE[k].fullmatch(h))


def mask(text):
    found = dict.fromkeys(pii.KINDS, 0)

    def one(m):
        k = kind_of(m[0])
        new = MAKE[k](m[0])
        found[k] += new is not None
        return m[0] if new is None else new

    return (None if text is None else ANY.sub(one, text)), found


SPECIAL = [
    "0123456789 1700000000 0000000000 9075551190 907-555-1190 (017) 555-7713 +1 (132) 555-1352 907-155-1190 x9075551190",
    "v1.2.3.4 chapter 1.2.3.4 Version 10.0.0.1 10.0.0.1 1.2.3.4.5 256.1.1.1 aé 9.8.7.6",
    "2024-02-29 2023-02-29 1.1.1900 31.12.2099 2/30/1999 12/25/1976 2100-01-01 1899-12-31",
    "000-12-3456 666-12-3456 900-12-3456 123-00-4567 123-45-0000 123-45-6789",
    "4111111111111111 4111111111111112 4111 1111 1111 1111 123 3782-822463-10005 1234 930902 5905",
    "a.b+c@x.example.com A.B+C@x.example.com api_key=abcdefghij Token: \"0123456789abcdef\" password=short",
    "+44 907 555 1190 and 4111 1111 1111 1111 907 555 1190", None, "", " \n\t ", "x" * 50_000 + " 10.1.2.3 " + "é" * 50_000,
]


def test_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    some = spark.createDataFrame([*((10**6 + i, t) for i, t in enumerate(SPECIAL)), (10**6, SPECIAL[0]), (None, SPECIAL[3])], "doc_id long, text string")
    docs = docs.unionByName(some)
    got = {(r.doc_id, r.text): r for r in docs.join(pii.pseudonymise(docs, KEY).withColumnRenamed("text", "masked"), "doc_id").collect()}
    for (_, text), r in got.items():
        want, found = mask(text)
        assert r.masked == want
        assert {k: r[f"n_{k}"] for k in pii.KINDS} == found and r.n_found == sum(found.values())
    assert pii.pseudonymise(docs, KEY).count() == docs.count()


def test_only_valid_numbers_change():
    phones = mask(SPECIAL[0])[0].split()
    assert phones[:3] == ["0123456789", "1700000000", "0000000000"] and phones[-2:] == ["907-155-1190", "x9075551190"]
    assert phones[3] == phones[4].replace("-", "") != "9075551190"
    assert mask(SPECIAL[1])[0].startswith("v1.2.3.4 chapter 1.2.3.4 Version 10.0.0.1 ") and mask(SPECIAL[1])[1]["ip"] == 2


def test_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, SPECIAL[3], "a", "b"), (1, SPECIAL[3], "c", "d")], "doc_id long, text string, hits string, kinds string")
    rows = pii.pseudonymise(df, KEY).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].n_ssn == 1


def test_a_walk_that_does_not_end_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "WALK", 1)
    x = pii._walk("id", "10", "100", "t", "k", lambda v: f"({v} = 5)")
    with pytest.raises(Exception, match="pseudonym was not found"):
        spark.range(1000).selectExpr(f"sum({x})").collect()


def test_no_pattern_ends_an_executor(spark):
    """Long runs of each pattern's inner parts: no recursion in the pattern, whatever the text."""
    many = 1_000_000
    inner = {
        "email": ["a@b" + ".b" * many, "a." * many + "@b.c", "a@" + "b" * many, "a@b." * many], "secret": ["password=" + "x" * many, "token: " * many, "secret=" + '"' * many],
        "ip": ["1.2.3." * many, "1" * many, "1.1.1.1" + ".1" * many], "card": ["4111 " * many, "4" * many, "4111-1111-1111-1111-" * (many // 4)],
        "ssn": ["123-45-" * many, "123-" * many], "date": ["2024-1-" * many, "1.2." * many, "1/2/" * many], "phone": ["+1 " * many, "(212) " * many, "212-" * many, "+" * many],
    }
    assert set(inner) == set(pii.KINDS)
    texts = [t for v in inner.values() for t in v]
    out = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), KEY)
    got = {r.doc_id: r for r in out.selectExpr("doc_id", "n_email", "length(text) AS n").collect()}
    assert len(got) == len(texts) and got[0].n_email == 1 and got[0].n < 100

import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


def text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with every awkward case: nulls, empty, blank, long, equal, near, ties, repeated rows."""
    rng = random.Random(4)
    base, long = text(rng, 120), text(rng, 6000)
    near = base.split(" ")
    near[5] = "changed"
    out = [
        (1, base, "en", "s1"), (2, base, "en", "s2"), (3, "  " + base.replace(" ", "\n"), "en", "s1"), (4, " ".join(near), "de", None), (5, None, None, "s3"), (6, "", "en", "s1"), (7, " \t\n ", "en", "s2"), (8, long, "en", "s1"),
        (9, long + " tail " + text(rng, 40), "en", "s1"), (10, "one", "en", "s4"), (11, "one", "en", "s4"), (12, "One two three", "en", "s4"), (13, text(rng, 13), "en", "s1"), (14, text(rng, 300) + " " + base, "en", "s2"),
        (15, "x" * 3000 + " " + "日本語" * 200, "ja", "s2"), (16, "a a a a a a a a b b b b\nline one here\nline one here\n### $$$", "en", "s1"),
    ]
    out += [(i, text(rng, rng.randint(1, 90)), "en", f"s{i % 5}") for i in range(20, 90)]
    return [*out, out[0], out[10]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names clash with those of results."""
    extra = "keep_id string, kept string, score string, n_words string, size string, component_id string, quality string, turn string"
    n = extra.count(",") + 1
    return spark.createDataFrame([(*r, *["x"] * n) for r in rows], f"doc_id long, text string, lang string, source string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

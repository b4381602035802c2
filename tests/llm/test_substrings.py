"""Levels of substring dedup against brute force; buckets by bytes; the odd cases of tables."""

import random

import numpy as np
import pytest
from test_llm_operators import table, words

from ponderlake.llm import shared, substring_dedup


def brute(rows):
    """The longest of 13, 26, 52, ... words at which a document shares a window with another, by slicing texts."""
    out = {i: 0 for i, _ in rows}
    length = 13
    while True:
        seen = {}
        for i, t in rows:
            w = words(t)
            for k in range(len(w) - length + 1):
                seen.setdefault(tuple(w[k : k + length]), set()).add(i)
        found = {i for ids in seen.values() if len(ids) > 1 for i in ids}
        if not found:
            return out
        out.update(dict.fromkeys(found, length))
        length *= 2


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(12)
    w = [f"w{i}" for i in range(50)]
    some = lambda n: " ".join(rng.choice(w) for _ in range(n))
    rows, base = [], some(700)
    for i, n in enumerate((5, 12, 13, 14, 25, 26, 27, 51, 52, 53, 104, 300, 700)):
        at = rng.randint(0, 700 - n)
        rows.append((i, some(rng.randint(0, 20)) + " " + " ".join(base.split()[at : at + n]) + " " + some(rng.randint(0, 20))))
    rows += [(100, base), (101, base), (102, ""), (103, None), (104, "z " * 60), (105, "z " * 30), (106, "z " * 20_000)]
    return rows


def test_levels_end_where_texts_end(spark, passages):
    df = spark.createDataFrame([*passages, passages[3]], "doc_id long, text string").repartition(5)
    got, want = table(substring_dedup.substring_dedup(df)), brute([r for r in passages if r[0] != 106] + [(106, "z " * 60)])
    got = {i: {r.longest_repeat for r in rs} for i, rs in got.items()}
    assert all(len(x) == 1 and want[i] >= max(x) >= min(13, want[i]) and 2 * max(x) >= want[i] for i, x in got.items())
    assert sorted(max(x) for x in got.values())[-2:] == [208, 208] and set(want.values()) == {0, 13, 26, 52, 104, 208, 416}


def test_chosen_windows():
    """Every stretch has its window of least hash chosen, and only such are."""
    r = np.random.default_rng(3)
    place = np.flatnonzero(r.random(300) < 0.95)
    h = r.integers(0, 2**63, len(place)).astype(np.uint64)
    for span in (1, 2, 5, 8, 13):
        want = set()
        for i in range(len(place) - span + 1):
            if place[i + span - 1] - place[i] == span - 1:
                want.add(i + int(np.argmin(h[i : i + span])))
        assert set(np.flatnonzero(substring_dedup._least(place, h, span)).tolist()) == want


def test_first_of_equal_windows_keeps_them(spark, passages):
    got = table(substring_dedup.substring_dedup(spark.createDataFrame(passages, "doc_id long, text string")))
    assert got[104][0].n_removed == 0 and got[105][0].n_removed == 30 and got[106][0].n_removed == 20_000 and got[101][0].n_removed == 700


def test_buckets_follow_bytes(spark):
    n = lambda size: shared.buckets(spark, size, substring_dedup.PER_BUCKET)
    assert n(0) == 8 and all(size / n(size) <= substring_dedup.PER_BUCKET for size in (10**9, 5 * 10**9, 10**14))


def test_nothing_is_left_behind(spark, passages):
    import os

    before = set(os.listdir(shared.folder(spark)))
    substring_dedup.substring_dedup(spark.createDataFrame(passages, "doc_id long, text string")).count()
    assert {x.split("-")[0] for x in set(os.listdir(shared.folder(spark))) - before} == {"substrings"}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ponderlake")]


def test_more_buckets_than_spark_allows(spark, monkeypatch):
    """Sizes beyond Spark's limit of buckets: larger buckets, no error; rows without id in any number stay where they are."""
    monkeypatch.setattr(shared, "MOST_BUCKETS", 5)
    df = spark.range(100).selectExpr("id AS doc_id", "repeat('some words ', 20) AS text")
    with shared.bucketed(df, "doc_id", 100_001) as t:
        assert t.count() == 100 and "bucketSpec" not in t.columns
    nulls = spark.range(300).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "repeat('some words ', 20) AS text").repartition(7)
    out = substring_dedup.substring_dedup(df.unionByName(nulls))
    got = [(r.n_words, r.n_removed) for r in out.where("doc_id IS NULL").collect()]
    assert got == [(40, 0)] * 300 and out.count() == 400

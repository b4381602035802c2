"""Near dedup on large groups: mutual copies, one passage in documents that aren't linked, similarities about the threshold."""

import os
import random

import pytest
from test_llm_operators import reach, table

from ponderlake.llm import lm_scoring, near_dedup, shared

WORDS = [f"v{i}" for i in range(3000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(21)
    some = lambda n: [rng.choice(WORDS) for _ in range(n)]
    base, rows = some(150), []
    for i in range(2000):  # one word changed in each: all linked with all
        w = base[:]
        w[rng.randrange(150)] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    passage = some(60)
    for i in range(500):  # a third of each union is the passage's
        rows.append((5000 + i, " ".join(some(50) + passage)))
    edge = some(120)
    for i in range(150):  # two to five words changed: similarities on both sides of the threshold
        w = edge[:]
        for k in rng.sample(range(120), rng.randint(2, 5)):
            w[k] = rng.choice(WORDS)
        rows.append((7000 + i, " ".join(w)))
    return rows


def test_groups_of_every_kind(spark, groups):
    got = {i: (r[0].n_shingles, r[0].component_id) for i, r in table(near_dedup.near_dedup(frame(spark, groups))).items()}
    copies = [r for r in groups if r[0] < 5000]
    assert {got[i][1] for i, _ in copies} == {0}
    want = reach([r for r in groups if r[0] >= 5000])
    assert {i: got[i] for i in want} == want
    assert len({want[i][1] for i in want if i < 7000}) == 500 and 1 < len({want[i][1] for i in want if i >= 7000}) < 150


def test_few_pairs_for_large_groups(spark, groups, monkeypatch):
    """Pairs sent to verification are at most one for each class and round; links found by search are fewer than classes."""
    seen = {}
    made = shared.table

    def counted(df, name):
        out = made(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(shared, "table", counted)
    near_dedup.near_dedup(frame(spark, groups))
    assert len(seen["pairs"]) == near_dedup.LEAD_ROUNDS and all(n <= len(groups) for n in seen["pairs"]) and sum(seen["more"]) < len(groups)


def test_small_blocks_find_the_same(spark, groups, monkeypatch):
    part = [r for r in groups if r[0] >= 5300]
    monkeypatch.setattr(near_dedup, "PER_BLOCK", 40)
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    monkeypatch.setattr(near_dedup, "LEAD_ROUNDS", 0)  # all by search
    got = table(near_dedup.near_dedup(frame(spark, part)))
    assert {i: (r[0].n_shingles, r[0].component_id) for i, r in got.items()} == reach(part)


def test_repeated_null_long_and_clashing_rows(spark):
    long = " ".join(WORDS) * 30
    rows = [(1, long, "a"), (1, long, "a"), (2, long + " tail", "b"), (None, long, "c"), (3, None, "d"), (4, " ", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").selectExpr("*", "'x' AS band", "'y' AS node")
    got = near_dedup.near_dedup(df).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == sorted(
        [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (4, 4, True)], key=repr
    )


def test_settings_come_back_and_tables_go(spark, docs, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    shared.prepare(spark)
    before = set(os.listdir(shared.folder(spark)))
    lm_scoring.lm_scores(docs)
    near_dedup.near_dedup(docs)
    assert spark.conf.get(key) == "512"
    assert sorted(x.split("-")[0] for x in set(os.listdir(shared.folder(spark))) - before) == ["near", "scores"]
    monkeypatch.setattr(near_dedup, "_search", lambda *_: 1 / 0)
    monkeypatch.setattr(near_dedup, "LEAD_ROUNDS", 0)
    before = set(os.listdir(shared.folder(spark)))
    with pytest.raises(ZeroDivisionError):
        near_dedup.near_dedup(docs)
    assert set(os.listdir(shared.folder(spark))) == before


def test_a_local_folder_is_refused_on_a_cluster(spark):
    class Context:
        master = "spark://somewhere:7077"
        applicationId = "app"  # noqa: N815

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.folder(Session())

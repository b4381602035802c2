"""Queries with SQL against DuckDB; the pipeline against its own stages' brute force."""

import pytest
from compare import DATA, connection, same

from ponderlake.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, f"{DATA}/sf0.001"), connection(f"{DATA}/sf0.001"), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op11_nearest_neighbours"}))
def test_one_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    out = QUERIES[name](spark, f"{DATA}/sf0.001")
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_pipeline(spark):
    """Each stage on what the one before kept, checked by plain Python."""
    import collections
    import re

    import corpus_pipeline as c
    import sentencepiece
    from test_llm_operators import reach, words

    from ponderlake.llm import queries, shared

    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in c.STAGES[:4]:
        docs = shared.table(stage(spark, docs, sf), "t")
        assert docs.columns == kept[0].columns
        kept.append(docs)
    rows = [[(r.doc_id, r.text, r.lang, r.source) for r in x.collect()] for x in kept]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    have = {i for i, *_ in rows[1]}
    assert all(i in have for i, *_ in rows[0] if labels.get(i) == 1)
    best = {}
    for i, t, *_ in rows[1]:
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[k] = min(best.get(k, (1, 0)), (-len(t or ""), i))
    assert {i for i, *_ in rows[2]} == {i for _, i in best.values()}
    assert {i for i, *_ in rows[3]} == {i for i, (_, m) in reach(rows[2]).items() if m == i}
    before, after = (collections.Counter() for _ in range(2))
    for i, t, *_ in rows[3]:
        before[i] += len(words(t))
    for i, t, *_ in rows[4]:
        after[i] += len(words(t))
    longest = collections.defaultdict(int)
    for _, t, _, s in rows[3]:
        longest[s] = max(longest[s], len(words(t)))
    texts = {i: t for i, t, *_ in rows[3]}
    assert all(texts[i] == t for i, t, *_ in rows[4])  # whole documents
    near = sum(n / 2 + 1 for n in longest.values())
    assert all(after[i] <= 3 * before[i] for i in after) and abs(sum(after.values()) - sum(before.values())) <= near
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    got = sorted((r.doc_id, tuple(r.ids)) for r in c.STAGES[4][1](spark, docs, sf).collect())
    assert got == sorted((i, tuple(lib.encode(t or ""))) for i, t, *_ in rows[4])
    assert c.run(spark, sf).count() == len(got)

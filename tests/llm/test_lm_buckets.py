"""Language-model buckets: their size at any size of input, and counts that are the same for any number of them."""

import numpy as np
import pytest
from test_llm_operators import table

from ponderlake.llm import lm_scoring, shared


def test_buckets_follow_bytes(spark):
    for size in (10**8, 5 * 10**8, 3 * 10**10, 10**14):
        n = shared.buckets(spark, size, lm_scoring.PER_BUCKET)
        assert size / n <= lm_scoring.PER_BUCKET


@pytest.mark.parametrize("n", [1, 3, 103, 6001, 10**7])
def test_buckets_are_ranges_of_whole_keys(n):
    """In order, about equally full, and every key is its bucket's first one and less than 2 ** 64 / n more."""
    key = np.sort(np.random.default_rng(1).integers(0, 2**64, 200_000, np.uint64, endpoint=False))
    key = np.concatenate([[np.uint64(0)], key, [np.uint64(2**64 - 1)]])
    bucket = lm_scoring.bucket_of(key, n)
    assert (np.diff(bucket) >= 0).all() and bucket[0] == 0 and bucket[-1] == n - 1
    first = lm_scoring.first_key(bucket, n)
    assert (first <= key).all() and (lm_scoring.bucket_of(first, n) == bucket).all()
    assert ((key - first).astype(float) <= 2.0**64 / n + 2.0**32).all()


@pytest.mark.parametrize("n", [2, 200, 3000])
def test_scores_do_not_depend_on_buckets(spark, docs, monkeypatch, n):
    few = table(lm_scoring.lm_scores(docs))
    monkeypatch.setattr(shared, "buckets", lambda *_: n)
    many = table(lm_scoring.lm_scores(docs))
    assert few == many

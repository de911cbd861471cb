"""Near duplicates of a large repo by hyperplane buckets: recall, copies, bounded groups."""

import numpy as np
import pandas as pd
import pytest

from quarryline.operators import retrieval as rt

SCHEMA = "chunk_id long, repo_name string, vector array<double>"


def frame(spark, vectors, repo="big", first=0):
    return spark.createDataFrame(pd.DataFrame({"chunk_id": np.arange(first, first + len(vectors)), "repo_name": repo, "vector": list(vectors)}), SCHEMA)


@pytest.fixture(scope="module")
def planted():
    """4 000 vectors, the last 2 000 at a known angle to one of the first."""
    rng = np.random.default_rng(3)
    a = rng.standard_normal((2000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.955, 0.999, (2000, 1))
    return np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * side])


def test_recall_of_planted_pairs(spark, planted):
    got = {r.id: (r.other, r.score) for r in rt.near_duplicates(frame(spark, planted), exact_rows=100, bucket_rows=64).collect()}
    want = {r.id: (r.other, r.score) for r in rt.near_duplicates(frame(spark, planted), exact=True).collect()}
    assert len(want) >= 3990
    met = sum(got.get(k) == v for k, v in want.items())
    assert met >= 0.95 * len(want), met / len(want)
    assert all(v[1] > 0.95 for v in got.values()) and set(got) <= set(want)


def test_equal_vectors_are_each_others_closest(spark, planted):
    many = np.concatenate([planted[:2100], np.repeat(planted[:1], 3000, axis=0)])
    got = {r.id: (r.other, r.score) for r in rt.near_duplicates(frame(spark, many), exact_rows=1000, bucket_rows=256).collect()}
    assert got[0] == (2100, 1.0) and all(got[k] == (0, 1.0) for k in range(2100, 5100))


def test_small_repos_stay_exact_beside_a_large_one(spark, planted):
    small = frame(spark, planted[[0, 2000, 1]], "small", 10_000)
    got = {r.id: r.other for r in rt.near_duplicates(frame(spark, planted).unionByName(small), exact_rows=100, bucket_rows=64).where("id >= 10000").collect()}
    assert got == {10_000: 10_001, 10_001: 10_000}


def test_zero_vectors_and_empty_tables(spark):
    rows = frame(spark, np.zeros((5, 4)))
    assert rt.near_duplicates(rows).count() == 0 and rt.near_duplicates(rows.where("false")).count() == 0
    assert rt.near_duplicates(rows.where("false"), exact_rows=0).count() == 0

"""Approximate join by signs: recall, number of candidates, no false edges."""

import math

import numpy as np
import pytest

from litgraph.operators import signs
from litgraph.operators.similarity import similarity_edges
from litgraph.operators.vectors import hashed_vectors


def clustered(spark, n=2000, groups=100, dims=64, spread=0.55, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    x = centres[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, dims))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_recall_and_candidates_on_clusters(spark, threshold):
    vectors = clustered(spark, spread=0.4 if threshold == 0.8 else 0.25).cache()
    n = vectors.count()
    exact = {(r.src, r.dst): r.similarity for r in similarity_edges(vectors, threshold).collect()}
    found = {(r.src, r.dst): r.similarity for r in signs.similarity_edges_signs(vectors, threshold, recall=0.95).collect()}
    assert len(exact) > 5000
    assert set(found) <= set(exact)
    assert all(abs(exact[p] - s) < 1e-9 for p, s in found.items())
    assert len(found) >= 0.9 * len(exact)
    met, candidates = signs.sign_candidates(vectors, signs.sign_tables(n, threshold, 0.95))
    pairs = n * (n - 1) / 2
    assert candidates.count() <= 0.05 * pairs
    # most pairs are not even met, and most of those met end at the bit count
    assert met.select("src", "dst").distinct().count() <= 0.25 * pairs


def test_tables_keep_the_wished_recall():
    for n in (1000, 10**6, 10**9):
        for t in (0.8, 0.9, 0.95):
            plan = signs.sign_tables(n, t, 0.95)
            assert 1 - (1 - signs.meeting_chance(t, plan.width)) ** plan.tables >= 0.975
            # unrelated vectors met by one vector: few, however large the table
            assert n * plan.tables * (plan.width + 1) / 2**plan.width < 20_000
            assert 0 < plan.distance < signs.FILTER / 2


def test_low_thresholds(spark):
    """Found too, though with most pairs compared."""
    vectors = clustered(spark, 300, 20)
    with pytest.raises(ValueError):
        signs.similarity_edges_signs(vectors, 1.0)
    exact = similarity_edges(vectors, 0.3).count()
    assert signs.similarity_edges_signs(vectors, 0.3, recall=0.9).count() >= 0.85 * exact


def test_zero_null_and_equal_vectors(spark):
    rows = [("a", [1.0, 2.0, 3.0]), ("b", [2.0, 4.0, 6.0]), ("c", [0.0, 0.0, 0.0]), ("d", None), ("e", [-1.0, -2.0, -3.0])]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = signs.similarity_edges_signs(vectors, 0.9).collect()
    assert [(r.src, r.dst) for r in got] == [("a", "b")] and math.isclose(got[0].similarity, 1.0)
    empty = spark.createDataFrame([], "id string, embedding array<float>")
    assert signs.similarity_edges_signs(empty, 0.9).collect() == []


def test_hashed_vectors(spark):
    docs = spark.createDataFrame([(1, "One two two"), (2, "two one TWO"), (3, "!"), (4, None), (5, "three")], "id int, text string")
    got = {r.id: r.embedding for r in hashed_vectors(docs, "id", "text", 16).collect()}
    assert set(got) == {1, 2, 5} and got[1] == got[2] and len(got[5]) == 16
    assert sorted(abs(x) for x in got[5] if x) == [1.0]

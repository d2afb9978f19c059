"""Embeddings (V1), vector sink round trip (S6 / V2), graph sink."""

import tempfile

import numpy as np

from litgraph.operators.vectors import embed, embed_tfidf
from litgraph.sources.sinks import load_graph, load_vectors, place_features, save_graph, save_vectors


def test_tfidf_unit_length_and_near_copies(spark):
    docs = spark.createDataFrame([
        ("1", "drug repositioning for rare disease cohorts"),
        ("2", "drug repositioning for rare disease cohorts"),
        ("3", "Drug repositioning, for rare disease cohorts!"),
        ("4", "unrelated words about ocean tides and waves"),
    ], "uid string, text string")
    v = {r.uid: np.array(r.embedding, dtype=np.float64) for r in embed_tfidf(docs, "text", num_features=256).collect()}
    for x in v.values():
        assert abs(np.linalg.norm(x) - 1.0) < 1e-6
    assert np.allclose(v["1"], v["2"]) and np.allclose(v["1"], v["3"], atol=1e-6)
    assert float(v["1"] @ v["4"]) < 0.2


def test_sparse_join_equals_all_pairs(spark):
    """Exact TF-IDF rows and prefix-filtered pairs against brute force; blocks
    of one vector split every term."""
    import math
    import random

    import pytest

    from litgraph.operators.similarity import sparse_similarity_edges
    from litgraph.operators.vectors import tfidf_rows
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = {i: [rng.choice(words[:rng.choice((4, 30))]) for _ in range(rng.randrange(1, 9))] for i in range(40)}
    texts[40] = []
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()] + [(41, None)], "id long, text string")
    n = len(texts) + 1
    freq = {w: sum(w in t for t in texts.values()) for w in words}
    vec = {}
    for i, t in texts.items():
        raw = {w: t.count(w) * math.log((n + 1) / (freq[w] + 1)) for w in set(t)}
        size = math.sqrt(sum(x * x for x in raw.values()))
        vec[i] = {w: x / size for w, x in raw.items()}
    rows = tfidf_rows(df, "id", "text")
    got = {(r.id, r.term): r.weight for r in rows.collect()}
    assert got.keys() == {(i, w) for i, v in vec.items() for w in v}
    assert all(abs(x - vec[i][w]) < 1e-12 for (i, w), x in got.items())
    for t in (0.15, 0.6):
        want = {(a, b) for a in vec for b in vec if a < b and sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) >= t}
        for block in (1, 2000):
            edges = sparse_similarity_edges(rows, t, block_rows=block).collect()
            assert {(e.src, e.dst) for e in edges} == want and len(edges) == len(want)
    with pytest.raises(ValueError):
        sparse_similarity_edges(rows, 0.0)


def test_user_model_hook(spark):
    df = spark.createDataFrame([("a",), ("bbb",)], "t string")
    out = embed(df, "t", fn=lambda s: [[float(len(x)), 1.0] for x in s]).orderBy("t").collect()
    assert [r.embedding for r in out] == [[1.0, 1.0], [3.0, 1.0]]


def test_vector_and_graph_round_trip(spark):
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, 0.0])], "id string, embedding array<float>")
    path = tempfile.mkdtemp(prefix="litgraph-vec-")
    save_vectors(vec, path + "/v")
    assert sorted(map(tuple, load_vectors(spark, path + "/v").collect())) == sorted(map(tuple, vec.collect()))
    nodes = spark.createDataFrame([(0, "x"), (1, "y")], "node_id long, label string")
    edges = spark.createDataFrame([(0, 1, 0.5)], "src long, dst long, similarity double")
    save_graph(nodes, edges, path + "/g", fmt="json")
    n, e = load_graph(spark, path + "/g", fmt="json")
    assert n.count() == 2 and e.first().similarity == 0.5


def test_place_features_geojson(spark):
    import json
    places = spark.createDataFrame([(1.5, -2.0, "<b>A B</b>: lab", 1)],
                                   "latitude double, longitude double, popup string, n_authors long")
    f = json.loads(place_features(places).first().value)
    assert f["geometry"] == {"type": "Point", "coordinates": [-2.0, 1.5]}
    assert f["properties"]["popup"] == "<b>A B</b>: lab"


def test_results_round_trip(spark):
    from litgraph.sources.sinks import load_results, save_results
    path = tempfile.mkdtemp(prefix="litgraph-res-")
    res = {"a": spark.range(3), "b": spark.range(5)}
    save_results(res, path)
    back = load_results(spark, path, ["a", "b"])
    assert back["a"].count() == 3 and back["b"].count() == 5

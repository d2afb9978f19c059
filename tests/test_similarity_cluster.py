"""Similarity join (J6, J7, LSH) and clustering (A11, A12) against
brute-force numpy / pure-Python versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litgraph.operators import cluster, similarity
from litgraph.session import checkpoint


def _vectors(spark, n=120, d=8, seed=7):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, d))
    x = base[rng.integers(0, 6, n)] + 0.6 * rng.normal(size=(n, d))
    x[5] = 0.0  # zero vector: no direction, left out
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<float>"), x.astype(np.float32).astype(np.float64)


def _brute(x, t):
    norms = np.linalg.norm(x, axis=1)
    out = {}
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            if norms[i] == 0 or norms[j] == 0:
                continue
            s = float(x[i] @ x[j] / (norms[i] * norms[j]))
            if s >= t:
                out[(i, j)] = s
    return out


@pytest.mark.parametrize("block_rows,pivots,t", [(2000, 1, 0.5), (40, 3, 0.5), (10, 8, 0.5), (10, 8, 0.95)])
def test_blocked_equals_brute_force(spark, block_rows, pivots, t):
    df, x = _vectors(spark)
    want = _brute(x, t)
    got = {(r.src, r.dst): r.similarity
           for r in similarity.similarity_edges(df, t, block_rows=block_rows, pivots=pivots).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert all(a < b for a, b in got)


def test_threshold_monotone_and_lsh_subset(spark):
    df, _ = _vectors(spark)
    low = {(r.src, r.dst) for r in similarity.similarity_edges(df, 0.3).collect()}
    high = {(r.src, r.dst) for r in similarity.similarity_edges(df, 0.6).collect()}
    assert high <= low
    lsh = {(r.src, r.dst) for r in similarity.similarity_edges_lsh(df, 0.6).collect()}
    assert lsh <= high


def test_far_blocks_never_meet(spark):
    """Tight clusters at a high threshold: fewer block pairs than all."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 16))
    x = base[np.arange(400) % 8] + 0.02 * rng.normal(size=(400, 16))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, embedding array<double>")
    blocks, sample = similarity.packed_blocks(df, 0.9, block_rows=20, pivots=8)
    n = blocks.count()
    met = similarity.meetings(blocks, 0.9, 8).count()
    assert n > 8 and met < n * (n + 1) // 2 * 0.7
    got = {(r.src, r.dst) for r in similarity.similarity_edges(df, 0.9, block_rows=20).collect()}
    assert got == set(_brute(x, 0.9))


def test_main_directions_save_products(spark):
    """Vectors near a plane of few dimensions: most pairs end after few numbers."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 4)) @ rng.normal(size=(4, 64)) + 0.05 * rng.normal(size=(900, 64))
    directions = similarity.Directions(x[:300], 0.9)
    assert 0 < directions.first <= 8
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = unit @ directions.rotation
    p = directions.first
    rest = np.linalg.norm(turned[:, p:], axis=1)
    multiplied = (turned[:, :p] @ turned[:, :p].T + np.outer(rest, rest) >= 0.9).mean()
    assert p + 64 * multiplied < 64 / 2
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = {(r.src, r.dst): r.similarity for r in similarity.similarity_edges(df, 0.9, block_rows=100).collect()}
    want = _brute(x, 0.9)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # unrelated vectors at a low threshold: multiplied at once
    assert similarity.Directions(rng.normal(size=(300, 64)), 0.3).first == 0


def test_blocks_are_shipped_once_a_row(spark):
    """Far fewer copies of a block than there are blocks."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(f"v{i}", [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(2000, 8)))],
                               "id string, embedding array<float>")
    blocks, sample = similarity.packed_blocks(df, 0.2, block_rows=5, pivots=2)
    n, copies = blocks.count(), similarity.meetings(blocks, 0.2, 2).count()
    assert n >= 400 and copies < n * n / 10
    assert sum(r["n"] for r in blocks.select(F.size("ids").alias("n")).collect()) == 2000


def test_zero_null_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "id long, embedding array<double>")
    assert similarity.similarity_edges(df, 0.1).collect() == []
    assert [tuple(r) for r in similarity.similarity_edges(df, 0.0).collect()] == [(1, 2, 0.0)]
    assert similarity.similarity_edges(df.limit(0), 0.1).collect() == []


def test_components_of_one_long_chain(spark):
    n = 3000
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = cluster.connected_components(edges)
    assert got.count() == n and got.where("component <> 0").count() == 0


def test_equal_to_threshold_is_kept(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, embedding array<float>")
    got = {(r.src, r.dst) for r in similarity.similarity_edges(df, 1.0).collect()}
    assert got == {(1, 2)}
    eps = similarity.eps_neighbors(df, 1.0).collect()
    assert {(r.src, r.dst) for r in eps} == {(1, 2), (1, 3), (2, 3)}  # distance 1 == eps


def _dbscan_brute(n, pairs, m):
    """Scan in index order; a cluster expands fully before the next starts."""
    nb = {i: set() for i in range(n)}
    for a, b in pairs:
        nb[a].add(b)
        nb[b].add(a)
    core = {i for i in range(n) if len(nb[i]) + 1 >= m}
    labels, num = [-1] * n, 0
    for i in range(n):
        if labels[i] != -1 or i not in core:
            continue
        stack = [i]
        while stack:
            v = stack.pop()
            if labels[v] == -1:
                labels[v] = num
                if v in core:
                    stack.extend(u for u in nb[v] if labels[u] == -1)
        num += 1
    return labels


@pytest.mark.parametrize("m", [2, 3, 4])
def test_dbscan_matches_scan(spark, m):
    rng = np.random.default_rng(m)
    n = 60
    pairs = sorted({tuple(sorted(map(int, rng.integers(0, n, 2)))) for _ in range(70)})
    pairs = [p for p in pairs if p[0] != p[1]]
    pdf = spark.createDataFrame(pairs, "src long, dst long")
    pts = spark.range(n).select(F.col("id"))
    got = {r.id: r.cluster for r in cluster.dbscan(pts, pdf, m).collect()}
    assert [got[i] for i in range(n)] == _dbscan_brute(n, pairs, m)


def test_components_chain_and_isolated(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101)]
    edges = spark.createDataFrame(chain[::-1], "src long, dst long")
    verts = spark.createDataFrame([(i,) for i in list(range(41)) + [100, 101, 200]], "id long")
    comp = {r.id: r.component for r in cluster.connected_components(edges, verts).collect()}
    assert all(comp[i] == 0 for i in range(41))
    assert comp[101] == 100 and comp[200] == 200


def test_empty_inputs(spark):
    from litgraph.operators.graph import khop_neighbors
    none = spark.createDataFrame([], "id long, embedding array<float>")
    assert similarity.similarity_edges(none, 0.5).count() == 0
    pts = spark.range(5).select("id")
    no_pairs = spark.createDataFrame([], "src long, dst long")
    assert sorted(r.cluster for r in cluster.dbscan(pts, no_pairs, 2).collect()) == [-1] * 5
    assert sorted(r.cluster for r in cluster.dbscan(pts, no_pairs, 1).collect()) == [0, 1, 2, 3, 4]
    assert cluster.connected_components(no_pairs).count() == 0
    seeds = spark.createDataFrame([(1, 1)], "seed long, node_id long")
    assert [(r.node_id, r.hop) for r in khop_neighbors(no_pairs, seeds, 2).collect()] == [(1, 0)]


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of 100,000 vertices in random order of ids."""
    n, rounds = 100_000, []
    step = cluster._contract
    monkeypatch.setattr(cluster, "_contract", lambda e, r: rounds.append(1) or step(e, r))
    order = spark.range(n).select((F.col("id") * 7919 % n).alias("src"), ((F.col("id") + 1) * 7919 % n).alias("dst"))
    got = cluster.connected_components(order.where(f"src <> {(n - 1) * 7919 % n}"))
    assert got.count() == n and got.where("component <> 0").isEmpty()
    assert len(rounds) <= 20


def test_components_equal_union_find(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(600), rnd.randrange(600)) for _ in range(420)] + [(700, 700), (3, 3)] + [(1, i) for i in range(800, 900)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    for kind in ("long", "string"):
        edges = spark.createDataFrame(pairs * 2, "src long, dst long").select(
            F.lpad(F.col("src").cast("string"), 4, "0").alias("src") if kind == "string" else "src",
            F.lpad(F.col("dst").cast("string"), 4, "0").alias("dst") if kind == "string" else "dst")
        got = {int(r.id): int(r.component) for r in cluster.connected_components(edges).collect()}
        assert got == {v: find(v) for v in root}


def test_a_hub_is_split_by_adaptive_execution(spark):
    """The edges of one vertex end up in several tasks of the renaming join."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        hub = spark.range(1, 60_000, numPartitions=8).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
        edges = checkpoint(hub.union(spark.range(1, 2000).select(F.col("id") + 100_000, F.col("id") + 200_000)))
        moves = checkpoint(edges.select(F.col("dst").alias("id")).union(edges.select("src")).distinct().select("id", F.col("id").alias("to")))
        plan = _final_plan(edges.join(moves.select(F.col("id").alias("src"), "to"), "src"))
        assert "skew=true" in plan
        assert cluster.connected_components(edges).where("component = 0").count() == 60_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

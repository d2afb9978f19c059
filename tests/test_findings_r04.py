"""Round 4: disk and time at size."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from litgraph.operators import authors as au
from litgraph.operators import graph, signs
from litgraph.operators.similarity import similarity_edges
from litgraph.plans import fixtures as fx
from litgraph.plans import pipeline
from litgraph.plans import queries as Q
from litgraph.session import checkpoint, materialize, scratch_path
from litgraph.sources import versions
from tests.conftest import SF_SMALL


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def clustered(n=400, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((20, dims))[rng.integers(0, 20, n)] + 0.3 * rng.standard_normal((n, dims))


@pytest.mark.parametrize("size, group, own", [(1, 1 << 18, 1 << 14), (20_000, 100, 50)])
def test_tables_are_dealt_out_in_rounds(spark, monkeypatch, size, group, own):
    """All tables' keys were shuffled at once, and two vectors for each candidate (F1)."""
    monkeypatch.setattr(signs, "ROUND", size)
    monkeypatch.setattr(signs, "GROUP", group)
    monkeypatch.setattr(signs, "OWN", own)
    written = []
    old = signs.materialize
    monkeypatch.setattr(signs, "materialize", lambda df, name: written.append(name) or old(df, name))
    x = [(f"v{i}", v.tolist()) for i, v in enumerate(clustered())]
    odd = [("z", [0.0] * 16), ("n", None), (None, x[0][1]), ("h", [None] + x[0][1][1:])]
    df = spark.createDataFrame(x + odd, "id string, embedding array<double>").repartition(3)
    got = {(r.src, r.dst): r.similarity for r in signs.similarity_edges_signs(df, 0.85, recall=0.9999).collect()}
    want = {(r.src, r.dst): r.similarity for r in similarity_edges(df.where("id like 'v%'"), 0.85).collect()}
    assert len(want) > 1000 and set(got) <= set(want) and len(got) >= 0.99 * len(want)
    assert all(abs(want[p] - s) < 1e-12 for p, s in got.items())
    assert written.count("pairs") > 2


def test_a_pair_is_found_in_one_round(spark, monkeypatch):
    monkeypatch.setattr(signs, "ROUND", 1)
    kept = []
    old = signs.materialize

    def keep(df, name):
        out = old(df, name)
        kept.extend(map(tuple, out.collect()) if name == "pairs" else [])
        return out
    monkeypatch.setattr(signs, "materialize", keep)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(100))], "id long, embedding array<double>")
    edges = signs.similarity_edges_signs(df, 0.8).count()
    assert edges <= len(kept) == len(set(kept)) < 1.2 * edges


def test_bytes_never_lose_a_pair():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 24)) * np.exp(3 * rng.standard_normal((300, 24)))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    step = np.abs(unit).max(axis=1) / 127
    small = np.rint(unit / step[:, None]).astype(np.int8)
    steps = np.stack([step, np.linalg.norm(unit - small * step[:, None], axis=1)], axis=1)
    a, b = np.triu_indices(300, 1)
    cosine = (unit[a] * unit[b]).sum(axis=1)
    for t in (0.2, 0.5, 0.9):
        may = signs._reach(small, steps, a, b, t)
        assert may[cosine >= t].all() and not may[cosine < t - 0.1].any()


@pytest.mark.parametrize("step", [lambda df: materialize(df, "counts"), checkpoint])
def test_written_steps_leave_no_shuffle_files(spark, step):
    """A job of several written steps kept on disk what all of them shuffled."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in map(str, spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(local.getAllFiles()))
                if os.path.basename(f).startswith("shuffle_") and f.endswith(".data")}
    held = shuffled()
    df = spark.range(100_000).groupBy((F.col("id") % 50_000).alias("k")).agg(F.count("*").alias("n"))
    out = step(df)
    assert not shuffled() - held
    assert out.count() == 50_000 and spark.conf.get(key, None) == before
    df.write.parquet(scratch_path(spark, "plain"))
    assert shuffled() - held


def exchanges(df):
    return len(re.findall(r"(?m)^[^\w]*(?:\(\d+\) )?Exchange hashpartitioning", executed(df)))


def test_whole_nodes_are_not_dealt_out_again(spark):
    """Hover texts were shuffled by paper id, to find numbers and first authors."""
    authors = spark.createDataFrame([("A", "X", "a; b", ["1", "2"]), ("B", "Y", None, ["2", "3"])],
                                    "forename string, lastname string, affiliation string, paper_ids array<string>")
    papers = spark.createDataFrame([("1", "T", "one"), ("2", "T", "two"), ("3", "T", "two")], "uid string, Title string, page_content string")
    mains = spark.createDataFrame([("1", "A X"), ("2", "B Y"), ("2", None)], "uid string, first_author string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        nodes = graph.node_table(graph.fuse_by_research(authors, papers), mains)
        p = executed(nodes.select("node_id", "title"))
    finally:
        spark.conf.set(key, before)
    assert len(re.findall(r"Exchange hashpartitioning\(pubmedid", p)) <= 1
    assert rows(nodes.select("node_id", "pubmedid", "label", "title")) == [
        (0, "1", "A X et al.", "*A X* (First Author): a; b"),
        (1, "2", "B Y et al.", "A X: a; b\n*B Y* (First Author): No affiliation\n*B Y* (First Author): No affiliation")]
    bare = graph.fuse_by_research(authors, papers).drop("_node")
    assert rows(graph.node_table(bare, mains)) == rows(nodes)


@pytest.mark.parametrize("name", ["node_hover", "similarity_network_edges"])
def test_authorship_of_the_graph_is_built_once(spark, monkeypatch, name):
    """Once for the merge and once for the first authors."""
    built, old = [], fx.authorship
    monkeypatch.setattr(fx, "authorship", lambda *a: built.append(a) or old(*a))
    Q.QUERIES[name](spark, SF_SMALL).count()
    assert len(built) == 1


def test_authorship_is_dealt_out_by_name_once(spark):
    """Every row was shuffled as two values, and the distinct ones once more."""
    df = spark.createDataFrame([("A", "X", "u", "1", 1), ("A", "X", "v", "2", 2), ("A", "X", "u", "1", 3), ("A", None, "u", "1", 4),
                                ("B", "Y", None, "2", 5), ("B", "Y", "w", None, 6)],
                               "forename string, lastname string, affiliation string, pubmedid string, s long").withColumn("country", F.col("s"))
    out = au.merge_authors(df, ["s"], ["country"])
    assert exchanges(out) == 1
    assert rows(out) == [("A", "X", "u; v", ["u", "v"], "1, 2", ["1", "2"], 1), ("B", "Y", "w", ["w"], "2", ["2"], 5)]


@pytest.mark.parametrize("name", ["khop_neighbors", "khop_bitmaps"])
def test_khop_edges_are_compared_once(spark, monkeypatch, name):
    """The similarity join ran for each reader of its edges."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        calls.add(1)
        return x
    pairs = [(1, 2), (2, 3), (3, 4), (7, 8)]
    edges = spark.createDataFrame(pairs, "src long, dst long").select(seen("src").alias("src"), "dst", F.lit(1.0).alias("similarity"))
    monkeypatch.setattr(Q, "sim_edges", lambda *a: edges)
    got = rows(Q.QUERIES[name](spark, SF_SMALL))
    assert calls.value == 4
    both = {*pairs, *((b, a) for a, b in pairs)}
    want = {(n, n): 0 for n, _ in both} | {(a, d): 2 for a, b in both for c, d in both if b == c and a != d} | {p: 1 for p in both}
    assert got == sorted(((*k, v) for k, v in want.items()), key=repr)


def test_words_are_spelled_out_in_compiled_code(spark):
    """A list was filtered within each row, which Spark interprets (F2)."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "src long, dst long")
    seeds = edges.select(F.col("src").alias("seed"), F.col("src").alias("node_id"))
    df = graph.khop_bitmaps(edges, seeds, 2)
    assert "lambda" not in executed(df)
    assert rows(df) == rows(graph.khop_neighbors(edges, seeds, 2).select("seed", "node_id", "hop"))


def test_placed_rows_are_written_once_a_version(spark, monkeypatch):
    """Placed rows were written for the merge and again for the version."""
    written, old = [], pipeline.materialize
    monkeypatch.setattr(pipeline, "materialize", lambda df, name: written.append(name) or old(df, name))
    path = scratch_path(spark, "profiles")
    records = fx.records(spark, SF_SMALL).limit(20).cache()
    pipeline.publish_authors(records, fx.iso(spark), fx.gazetteer(spark), path)
    assert "placed" not in written
    pipeline.refresh_authors(records.limit(3), fx.iso(spark), fx.gazetteer(spark), path)
    assert "placed" not in written
    kept = versions.load_version(spark, path)
    assert kept["placed"].count() == versions.load_version(spark, path, 1)["placed"].count() > 0


def test_merge_by_several_columns_is_hash_aggregated(spark):
    """A struct as position made sort aggregates of all rows, and lists were sorted by interpreted code."""
    df = spark.createDataFrame([("A", "X", "v", "2", 1), ("A", "X", "u", None, 2), ("A", "X", "v", "10", 1), ("A", "X", "u", "10", 2),
                                ("A", "X", "w", "x", 1)], "forename string, lastname string, affiliation string, pubmedid string, author_pos long")
    out = au.merge_authors(df, [F.col("pubmedid").try_cast("bigint"), "pubmedid", "author_pos"], ["author_pos"])
    p = executed(out)
    assert "SortAggregate" not in p and "array_sort" not in p and exchanges(out) == 1
    assert rows(out) == [("A", "X", "u; w; v", ["u", "w", "v"], "x, 2, 10", ["x", "2", "10"], 2)]


def test_a_table_of_a_version_may_read_those_before_it(spark):
    path = scratch_path(spark, "kept")
    versions.publish(spark, {"a": spark.range(3), "b": lambda now: now["a"].where("id > 0")}, path)
    assert versions.load_version(spark, path)["b"].count() == 2

"""Round 3: work that grew faster than the tables."""

import re

from pyspark.sql import functions as F

from litgraph.operators import graph, search, textindex
from litgraph.plans import queries as Q
from litgraph.session import scratch_path
from tests.conftest import SF_SMALL
from tests.test_textindex import corpus

TOPICS = [(1, "w0 w250"), (2, "W5, w6"), (3, None), (4, "w0"), (5, "w1 w299 title"), (5, "w7"), (None, "w9")]


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def got(df):
    return sorted((r.topic_id, r.uid, round(r.score, 9), r["rank"]) for r in df.where("topic_id is not null").collect())


def test_topic_pairs_are_not_shuffled(spark, monkeypatch):
    """Postings go by document, and only a topic's best leave a task."""
    monkeypatch.setattr(search, "PAIRS", 500)
    docs = corpus(spark, 400)
    topics = spark.createDataFrame(TOPICS, "topic_id int, topic string")
    path = scratch_path(spark, "index")
    textindex.append_to_index(docs, path)
    full = search.search_bm25_per_topic(docs, topics, 3)
    found = textindex.search_index_per_topic(spark.read.parquet(path), topics, 3)
    for df, key in ((full, "_id"), (found, "id")):
        p = executed(df)
        assert not re.search(r"hashpartitioning\(qid#\d+, _?id#", p)
        assert int(re.search(rf"hashpartitioning\({key}#\d+, (\d+)\), REPARTITION", p)[1]) > 1
    scores = search.bm25_scores(docs, topics.select(F.col("topic_id").alias("qid"), F.explode(search.tokenize("topic")).alias("term")))
    best = search.topk_per_group(scores, ["qid"], search._rank_order("uid"), 3).withColumnRenamed("qid", "topic_id")
    assert got(full) == got(best) == got(found) and len(got(full)) == 12


def test_index_splits_a_text_once(spark):
    """Texts were split by the sampling of the ranges, too."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(x):
        calls.add(1)
        return x
    docs = spark.createDataFrame([(f"d{i}", "T", f"w{i % 7}  w1, Äö {i}") for i in range(50)] + [("e", None, None)],
                                 "uid string, Title string, page_content string").repartition(3)
    path = scratch_path(spark, "index")
    textindex.append_to_index(docs.withColumn("page_content", text("page_content")), path)
    assert calls.value == 51
    index = spark.read.parquet(path)
    assert index.where("term = 'äö'").agg(F.sum("n")).first()[0] == 50 and index.where("term = 'w1'").agg(F.max("max_tf")).first()[0] == 2
    assert index.where("term = ''").agg(F.sum("n"), F.sum("sum_dl")).first() == (51, 250)


def test_pairs_of_seed_and_node_are_spelled_out_last(spark):
    """Spelled-out rows were joined, and so shuffled, to find their seeds."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    seeds = edges.select(F.col("src").alias("seed"), F.col("src").alias("node_id"))
    df = graph.khop_bitmaps(edges, seeds, 2)
    p = executed(df)
    assert p.index("Generate") < p.index("Join")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, graph.khop_neighbors(edges, seeds, 2).select("seed", "node_id", "hop").collect()))


def test_last_round_is_not_written(spark, monkeypatch):
    """The last round holds most rows and is read once."""
    written = []
    for name in ("checkpoint", "materialize"):
        old = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda *a, old=old: written.append(a) or old(*a))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 1)], "seed long, node_id long")
    df = graph.khop_neighbors(edges, seeds, 2)
    assert len(written) == 1 and sorted((r.node_id, r.hop) for r in df.collect()) == [(1, 0), (2, 1), (3, 2)]


def test_records_of_two_arrivals_are_built_once(spark, monkeypatch):
    """Every arrival, and each reader of the second, built all records."""
    from litgraph.plans import fixtures as fx
    files = []
    old = fx.records
    monkeypatch.setattr("litgraph.plans.pipeline.publish_authors",
                        lambda records, *a: files.append(records.inputFiles()) or 1)
    monkeypatch.setattr("litgraph.plans.pipeline.refresh_authors",
                        lambda records, *a: files.append(records.inputFiles()) or 2)
    monkeypatch.setattr("litgraph.sources.versions.load_version", lambda *a: {"authors": spark.range(0)})
    monkeypatch.setattr(Q, "merged_scalar", lambda df: df)
    Q.QUERIES["refreshed_authors"](spark, SF_SMALL)
    assert old is fx.records and len(files) == 2
    assert not any("lineitem" in f for found in files for f in found)

"""Search over the written index: the rows of the full search, from few blocks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from litgraph.operators import textindex as ti
from litgraph.operators.search import search_bm25, search_bm25_per_topic
from litgraph.plans import fixtures as fx
from litgraph.session import scratch_path
from tests.conftest import SF_SMALL


def corpus(spark, n=900, seed=1):
    """Words of very different frequency; some documents repeat one often."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = [rnd.choice(words[:int(300 * rnd.random() ** 3) + 1]) for _ in range(rnd.randint(0, 60))]
        if i % 90 == 7:
            text += ["w0"] * rnd.randint(5, 30) + ["w250"]
        rows.append((f"d{i:04d}", None if i % 50 == 3 else f"title {i % 11}", " ".join(text) if i % 70 else None))
    return spark.createDataFrame(rows + [(f"e{i}", "Same title", "w5 w6 w7") for i in range(40)],
                                 "uid string, Title string, page_content string")


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark).cache()


@pytest.fixture(scope="module")
def path(spark, docs):
    """Written in two parts."""
    path = scratch_path(spark, "index")
    ti.append_to_index(docs.where("uid < 'd0500'"), path)
    ti.append_to_index(docs.where("uid >= 'd0500'"), path)
    return path


def rows(df):
    return [(r.uid, round(r.score, 9), r["rank"]) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("topic", ["w0", "w250 w0", "w5 w6 w7", "w299 w1 nowhere w1", "title W12 3", "w0 w1 w2 w3 w4 w5 w9 w40"])
@pytest.mark.parametrize("k", [1, 3, 30, 2000])
def test_same_rows_as_the_full_search(spark, docs, path, topic, k):
    assert rows(ti.search_index(spark, path, topic, k)) == rows(search_bm25(docs, topic, k))


def test_per_topic(spark, docs, path):
    topics = spark.createDataFrame([(1, "w0 w250"), (2, "W5, w6"), (3, "nowhere"), (4, None), (5, "w0"), (6, "w1 w299 title"), (6, "w7")],
                                   "topic_id int, topic string")
    for k in (1, 4, 50):
        got = ti.search_index_per_topic(spark.read.parquet(path), topics, k)
        want = search_bm25_per_topic(docs, topics, k)
        as_rows = lambda df: sorted((r.topic_id, r.uid, round(r.score, 9), r["rank"]) for r in df.collect())
        assert as_rows(got) == as_rows(want)


def test_blocks_hold_all_postings(spark, docs, path):
    index = spark.read.parquet(path)
    assert index.agg(F.max("n"), F.max(F.size("ids"))).first()[0] <= ti.BLOCK
    got = ti._each(index.select("term", "ids", "tfs", "dls")).where("term <> ''")
    toks = docs.select("uid", F.explode(ti.tokenize(F.concat_ws(" ", "Title", "page_content"))).alias("term"))
    want = toks.groupBy("term", "uid").count()
    assert got.count() == want.count()
    assert got.join(want, [got["term"] == want["term"], got["id"] == want["uid"], got["tf"] == want["count"]]).count() == want.count()
    totals = index.where("term = ''").agg(F.sum("n"), F.sum("sum_dl")).first()
    assert tuple(totals) == (docs.count(), toks.count())
    wrong = index.where((F.col("max_tf") != F.array_max("tfs")) | (F.col("min_dl") != F.array_min("dls")))
    assert wrong.isEmpty()


def test_blocks_are_skipped(spark, docs, path):
    """A frequent term's blocks of low frequency are not read for the best three."""
    search = ti.prepare_search(spark, path, "w0", 3)
    kept, every = search.blocks.where(search.could_matter()).count(), search.blocks.count()
    assert every >= 4 and kept <= every // 2


def test_scan_reads_the_terms_files_only(spark, docs, path):
    df = ti.search_index(spark, path, "w250", 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(term,w250)" in plan or "term,w250" in plan.split("PushedFilters")[1]
    assert re.search(r"max_tf#\d+ >= \d+", plan)
    df.collect()
    scan = [x for x in _nodes(df._jdf.queryExecution().executedPlan()) if "numFiles" in _metrics(x)][0]
    read = _metrics(scan)["numFiles"]
    assert 0 < read < len(spark.read.parquet(path).inputFiles()) / 4
    assert _metrics(scan)["numOutputRows"] < spark.read.parquet(path).count() / 4


def _nodes(plan):
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    plan = plan.plan() if "QueryStage" in plan.nodeName() else plan
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def _metrics(node):
    found = node.metrics()
    keys = found.keySet().toSeq()
    return {keys.apply(i): found.apply(keys.apply(i)).value() for i in range(keys.size())}


def test_bm25_key_equals_index_on_driver_tables(spark):
    papers = fx.papers(spark, SF_SMALL)
    path = scratch_path(spark, "index")
    ti.append_to_index(papers, path)
    topic = "thtion thing erat ertion attion"
    assert rows(ti.search_index(spark, path, topic, 10)) == rows(search_bm25(papers, topic, 10))


def test_empty_index_and_unknown_terms(spark, path):
    assert ti.search_index(spark, path, "nowhere at all!", 3).collect() == []
    assert ti.search_index(spark, path, "", 3).collect() == []
    with pytest.raises(ValueError):
        ti.search_index(spark, path, "w0", 0)

"""Graph: fuse by text (A2), dense ids (W3), labels and hover (J2, N3),
k-hop (J9), filters (J10, P14)."""

from pyspark.sql import functions as F

from litgraph.operators import graph as g

AUTH = "forename string, lastname string, affiliation string, paper_ids array<string>"
PAPERS = "uid string, Title string, page_content string"


def test_fuse_and_nodes(spark):
    authors = spark.createDataFrame([
        ("Ann", "Lee", "A1; A2", ["1", "2"]),
        ("Bo", "Kim", "", ["1"]),
        ("Cy", "Ng", "C", ["3"]),
    ], AUTH)
    papers = spark.createDataFrame([("1", "T", "same text"), ("2", "T", "same text"), ("3", "U", "other")], PAPERS)
    fused = g.fuse_by_research(authors, papers)
    rows = {r.research: r for r in fused.collect()}
    same = rows["T same text"]
    assert same.forename == "Ann, Ann, Bo" and same.n_authors == 3 and same.pubmedid == "1"
    mains = spark.createDataFrame([("1", "Ann Lee")], "uid string, first_author string")
    nodes = {r.research: r for r in g.node_table(fused, mains).collect()}
    assert nodes["T same text"].node_id == 0 and nodes["U other"].node_id == 1
    assert nodes["T same text"].label == "Ann Lee et al."
    assert nodes["U other"].label == "Unknown Author et al."
    assert nodes["T same text"].title.split("\n") == [
        "*ANN LEE* (First Author): A1; A2", "*ANN LEE* (First Author): A1; A2", "BO KIM: No affiliation"]
    assert nodes["U other"].size == 0.0


def test_dense_ids_many_partitions(spark):
    df = spark.range(0, 500).select(F.format_string("k%05d", (F.col("id") * 7919) % 500).alias("k")).repartition(13)
    got = {r.k: r.node_id for r in g.dense_ids(df, "k", partitions=7).collect()}
    assert [got[k] for k in sorted(got)] == list(range(500))


def test_dense_ids_sorts_the_key_alone(spark):
    """Other columns come back by the key; an empty table gives no rows."""
    df = spark.range(0, 40).select(F.format_string("k%02d", "id").alias("k"), F.repeat(F.lit("x"), 100).alias("text"))
    got = {r.k: (r.node_id, r.text) for r in g.dense_ids(df, "k", partitions=3).collect()}
    assert got == {f"k{i:02d}": (i, "x" * 100) for i in range(40)}
    assert g.dense_ids(df.where("false"), "k").count() == 0


def test_khop_and_filters(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.6), (3, 4, 0.7), (5, 6, 0.9)],
                                  "src long, dst long, similarity double")
    seeds = spark.createDataFrame([(1, 1)], "seed long, node_id long")
    hops = {r.node_id: r.hop for r in g.khop_neighbors(edges, seeds, k=2).collect()}
    assert hops == {1: 0, 2: 1, 3: 2}
    picked = sorted(r.node_id for r in g.edge_filter_nodes(edges, "src", [3, 5]).collect())
    assert picked == [3, 4, 5, 6]
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "node_id long, n_authors long")
    assert sorted(r.node_id for r in g.node_filter(nodes, "n_authors", ["2"]).collect()) == [1, 3]


def test_edge_titles(spark):
    nodes = spark.createDataFrame([(0, "a et al."), (1, "b et al.")], "node_id long, label string")
    edges = spark.createDataFrame([(0, 1, 0.456)], "src long, dst long, similarity double")
    r = g.edge_titles(edges, nodes).first()
    assert r.title == "Edge from 'a et al.' to 'b et al.'. Similarity: 0.46"
    assert (r.value, r.color) == (0.1, "#a6a6a6")


def test_compat_rule_loses_multi_paper_authors(spark):
    """Q2: the literal rule joins the ', '-joined id text, so an author with
    two papers meets neither; the default joins every paper."""
    authors = spark.createDataFrame([("Ann", "Lee", "A", ["1", "2"], "1, 2"), ("Bo", "Kim", "B", ["1"], "1")],
                                    AUTH + ", pubmedid string")
    papers = spark.createDataFrame([("1", "T", "x"), ("2", "U", "y")], PAPERS)
    fixed = g.authors_join_papers(authors, papers)
    literal = g.authors_join_papers(authors, papers, compat=True)
    assert sorted((r.forename, r.pubmedid) for r in fixed.collect()) == [("Ann", "1"), ("Ann", "2"), ("Bo", "1")]
    assert sorted((r.forename, r.pubmedid) for r in literal.collect()) == [("Bo", "1")]
    assert g.fuse_by_research(authors, papers, compat=True).count() == 1


def test_bitmaps_equal_khop_neighbors(spark):
    """More than 64 seeds, seeds with several starts and outside the graph."""
    import random
    rnd = random.Random(8)
    pairs = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(190)]
    edges = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "src long, dst long")
    seeds = spark.createDataFrame([(f"s{i:03d}", i) for i in range(150)] + [("s003", 77), ("far", 999), ("s003", 3)],
                                  "seed string, node_id long")
    for k in (0, 1, 3):
        want = {tuple(r) for r in g.khop_neighbors(edges, seeds.distinct(), k).select("seed", "node_id", "hop").collect()}
        got = [tuple(r) for r in g.khop_bitmaps(edges, seeds, k).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_bitmap_rounds_have_a_row_a_node_and_word(spark, monkeypatch):
    n = 128
    edges = spark.range(n).crossJoin(spark.range(4).select((F.col("id") + 1).alias("d"))).select(
        F.col("id").alias("src"), ((F.col("id") + F.col("d")) % n).alias("dst"))
    seeds = spark.range(n).select(F.col("id").alias("seed"), F.col("id").alias("node_id"))
    rows, keep = [], g.materialize
    monkeypatch.setattr(g, "materialize", lambda df, name: (lambda out: rows.append((name, out.count())) or out)(keep(df, name)))
    pairs = g.khop_bitmaps(edges, seeds, 3).groupBy("hop").count().collect()
    most = max(r["count"] for r in pairs)
    assert most > 900 and max(c for name, c in rows if name == "reached") <= 2 * n

"""A table of composed queries at once, against each topic's own filter."""

import random

from pyspark.sql import functions as F

from litgraph.operators.querytable import search_query_table
from litgraph.operators.search import boolean_search, concept_groups

TERMS = "topic string, concept_pos long, term_pos int, term string, kind string"


def docs(spark):
    rnd = random.Random(4)
    words = ["red", "green", "blue", "deep", "sea", "heart", "attack", "x-ray", "c++", "naïve", "1999"]
    rows = [(f"p{i}", " ".join(rnd.choice(words) for _ in range(3)) if i % 9 else None,
             ", ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))), "1999-01-01" if i % 4 else "2001-02-03",
             [rnd.choice(["Heart Attack", "Deep Sea"])] if i % 5 else None) for i in range(300)]
    return spark.createDataFrame(rows, "uid string, Title string, page_content string, Published string, mesh array<string>")


QUERIES = {
    "one": [["red"]], "both": [["red", "blue"], ["deep sea"]], "phrase": [["heart attack", "x-ray"], ["green"]],
    "odd": [["c++"], ["naïve"]], "none": [["red"], ["violet"]], "year": [["1999"]], "three": [["red"], ["green"], ["blue", "sea deep"]],
}


def test_topics_equal_their_own_filters(spark):
    papers = docs(spark).cache()
    rows = [(t, i + 1, j + 1, term, "tiab") for t, groups in QUERIES.items() for i, g in enumerate(groups) for j, term in enumerate(g)]
    terms = spark.createDataFrame(rows, TERMS)
    got = {(r.topic, r.uid) for r in search_query_table(papers, terms).collect()}
    want = {(t, r.uid) for t, groups in QUERIES.items() for r in boolean_search(papers, groups).select("uid").collect()}
    assert got == want and len(want) > 300
    # the groups of R2 are the same queries
    for r in concept_groups(terms).where("topic = 'three' and concept_pos = 3").collect():
        assert r.terms == ["blue", "sea deep"]


def test_kinds_of_terms(spark):
    papers = docs(spark).cache()
    terms = spark.createDataFrame([
        ("tiab", 1, 1, "1999", "tiab"), ("all", 1, 1, "1999", "all"), ("mesh", 1, 1, "deep sea", "mesh"),
        ("mixed", 1, 1, "2001", "all"), ("mixed", 1, 2, "heart attack", "mesh"), ("mixed", 2, 1, "Red", None),
        ("empty", 1, 1, "red", "tiab"), ("empty", 2, 1, "!!", "tiab")], TERMS)
    got = {(r.topic, r.uid) for r in search_query_table(papers, terms).collect()}
    tagged = {"tiab": [["1999"]], "all": [["1999[All Fields]"]], "mesh": [['"deep sea"[Mesh]']],
              "mixed": [["2001[All Fields]", '"heart attack"[Mesh]'], ["red"]]}
    want = {(t, r.uid) for t, groups in tagged.items() for r in boolean_search(papers, groups).select("uid").collect()}
    assert got == want
    plain = search_query_table(papers.drop("mesh"), terms)
    assert plain.where("topic = 'mesh'").isEmpty() and not plain.where("topic = 'mixed'").isEmpty()


def test_only_papers_with_a_key_word_are_matched(spark, monkeypatch):
    from litgraph.operators import querytable as qt
    papers = docs(spark).union(spark.createDataFrame([("rare", "zebra red", "", "1999", None)], docs(spark).schema))
    asked, keep = [], qt.materialize
    monkeypatch.setattr(qt, "materialize", lambda df, name: (lambda out: name == "asked" and asked.append(out.count()) or out)(keep(df, name)))
    terms = spark.createDataFrame([("t", 1, 1, "red", "tiab"), ("t", 2, 1, "zebra", "tiab")], TERMS)
    assert [r.uid for r in search_query_table(papers, terms).collect()] == ["rare"]
    assert asked == [1]


def test_empty_tables(spark):
    papers = docs(spark)
    none = spark.createDataFrame([], TERMS)
    assert search_query_table(papers, none).collect() == []
    assert search_query_table(papers.where(F.lit(False)), spark.createDataFrame([("t", 1, 1, "red", "tiab")], TERMS)).collect() == []

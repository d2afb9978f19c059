"""Pipeline, near copies: texts of documents that stay are not shuffled."""

import corpus_pipeline as P
from litgraph.llm.common import split_by_ids

DOCS = "doc_id long, text string, lang string, source string"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_by_ids(spark):
    rows = spark.createDataFrame([(i, f"t{i}", "en", "a") for i in range(2000)] + [(None, "n", "en", "a"), (7, "x", "en", "b")], DOCS)
    ids = spark.createDataFrame([(7,), (900,), (5000,)], "id long")
    sure, others = split_by_ids(rows, ids)
    assert sorted(map(str, sure.union(others).collect())) == sorted(map(str, rows.collect()))
    assert {7, 900} <= {r.doc_id for r in others.collect()} and others.count() < 20
    assert not {7, 900} & {r.doc_id for r in sure.collect()}
    assert "hashpartitioning" not in executed(sure) and sure.columns == rows.columns
    none, every = split_by_ids(rows, ids.where("id < 0"))
    assert every.isEmpty() and none.count() == 2002


def test_near_copies_go_and_the_others_stay_in_place(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(1, text, "en", "a"), (2, text + " more", "en", "a"), (3, "alone " * 9, "en", "b"), (4, None, "en", "b"),
         (None, text, "en", "c"), (5, "b twice", "en", "a"), (5, "a twice", "en", "a")], DOCS)
    out = P.drop_near_copies(spark, docs, "")
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [
        (1, text), (3, "alone " * 9), (4, None), (None, text), (5, "a twice")]))
    # one branch of the union reads and filters only
    p = executed(out)
    assert "Union" in p and "SortMergeJoin" in p

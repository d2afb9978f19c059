"""Search: term predicates (P10-P13), BM25 top-k against a brute-force
version (T1, W4), query composition (R1, R2)."""

import math
import re
from collections import Counter

import pytest

from litgraph.functions.predicates import parse_term, term_pattern
from litgraph.operators import search as se

DOCS = [
    ("1", "Toxic effects", "Toxicity of drug repositioning in mice."),
    ("2", "Women's health", "A study of women and woman care; drug-repositioning trial."),
    ("3", "Unrelated", "Nothing to see here, de la mer."),
    ("4", "Toxins", "tox tox toxins appear. Drug repositioning again!"),
    ("5", None, "Repositioning drug pipelines."),
]


@pytest.fixture()
def papers(spark):
    return spark.createDataFrame(DOCS, "uid string, Title string, page_content string")


def _ids(df):
    return sorted(r.uid for r in df.select("uid").collect())


def test_term_parsing():
    t = parse_term('"Drug Repositioning"[Title/Abstract]')
    assert t.phrase and t.text == "drug repositioning" and t.tag == "title/abstract"
    assert parse_term("tox*[Mesh]").tag == "mesh"
    assert re.search(term_pattern(parse_term("tox*")).replace(r"\p{L}\p{N}", r"\w"), "the toxins")


def test_boolean_wildcard_phrase_fields(papers):
    assert _ids(se.boolean_search(papers, [["tox*"]])) == ["1", "4"]
    assert _ids(se.boolean_search(papers, [['"drug repositioning"']])) == ["1", "2", "4"]
    assert _ids(se.boolean_search(papers, [["wom?n"]])) == ["2"]
    assert _ids(se.boolean_search(papers, [["tox*"], ["mice", "again"]])) == ["1", "4"]
    assert _ids(se.boolean_search(papers, [['"drug repositioning"']], exclude=["mice"])) == ["2", "4"]
    assert _ids(se.boolean_search(papers, [["toxins[Title]"]])) == ["4"]
    assert _ids(se.boolean_search(papers, [["toxic[Abstract]"]])) == []
    # [Mesh] without a keyword column, or an unknown tag, is an error
    for spec in ("women[Mesh]", "women[Nowhere]"):
        with pytest.raises(ValueError):
            se.boolean_search(papers, [[spec]])


def _bm25_brute(docs, topic, k1=1.2, b=0.75):
    tok = lambda s: [t for t in re.split(r"[^\w]+|_", s.lower()) if t]  # ASCII fixture
    texts = {u: tok(" ".join(x for x in (t, a) if x)) for u, t, a in docs}
    n = len(texts)
    avg = sum(len(v) for v in texts.values()) / n
    q = set(tok(topic))
    df = {t: sum(1 for v in texts.values() if t in v) for t in q}
    scores = {}
    for u, v in texts.items():
        c = Counter(v)
        s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) /
                (c[t] + k1 * (1 - b + b * len(v) / avg)) for t in q if c[t])
        if s:
            scores[u] = s
    return sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))


def test_bm25_matches_brute_force(papers):
    topic = "drug repositioning toxins"
    want = _bm25_brute(DOCS, topic)
    got = se.search_bm25(papers, topic, k=3).orderBy("rank").collect()
    assert [r.uid for r in got] == [u for u, _ in want[:3]]
    for r, (_, s) in zip(got, want):
        assert r.score == pytest.approx(s, rel=1e-12)
    assert [r.rank for r in got] == [1, 2, 3]


def test_bm25_per_topic(spark, papers):
    topics = spark.createDataFrame([(1, "drug repositioning"), (2, "women care"), (3, "absent words")],
                                   "topic_id long, topic string")
    got = se.search_bm25_per_topic(papers, topics, k=2).collect()
    by = {}
    for r in got:
        by.setdefault(r.topic_id, []).append((r.rank, r.uid))
    assert [u for _, u in sorted(by[1])] == [u for u, _ in _bm25_brute(DOCS, "drug repositioning")[:2]]
    assert [u for _, u in sorted(by[2])] == ["2"]
    assert 3 not in by


def test_top_k_bounds():
    with pytest.raises(ValueError):
        se.check_top_k(31, 30)
    with pytest.raises(ValueError):
        se.check_top_k(0)
    assert se.check_top_k(500) == 500


def test_compose_and_expand(spark):
    topics = spark.createDataFrame([("drug repositioning",)], "topic string")
    thes = spark.createDataFrame([("drug", "medicine"), ("drug", "compound"), ("repositioning", "repurposing")],
                                 "term string, synonym string")
    terms = se.expand_synonyms(topics, thes)
    q = se.compose_query(terms).first()
    assert q.query == ("((drug[Title/Abstract] OR compound[All Fields] OR medicine[All Fields]) AND "
                       "(repositioning[Title/Abstract] OR repurposing[All Fields]))")
    mesh = spark.createDataFrame([("t", 1, 1, "Drug Repositioning", "mesh"), ("t", 1, 2, "covid 19", "tiab")],
                                 "topic string, concept_pos int, term_pos int, term string, kind string")
    assert se.compose_query(mesh).first().query == '(("drug repositioning"[Mesh] OR "covid 19"[Title/Abstract]))'


def test_mesh_terms_match_keyword_arrays(spark):
    docs = spark.createDataFrame([
        ("1", "A", "text", ["Drug Repositioning", "Mice"]),
        ("2", "B", "drug repositioning in text only", ["Rats"]),
    ], "uid string, Title string, page_content string, mesh array<string>")
    assert _ids(se.boolean_search(docs, [['"drug repositioning"[Mesh]']])) == ["1"]
    assert _ids(se.boolean_search(docs, [["rat*[Mesh]"]])) == ["2"]
    assert _ids(se.boolean_search(docs, [['"drug repositioning"[Title/Abstract]']])) == ["2"]


def test_bm25_reads_the_documents_once(spark):
    """Statistics and scores share one token shuffle."""
    from litgraph.plans import fixtures as fx
    from tests.conftest import SF_SMALL
    df = se.search_bm25(fx.papers(spark, SF_SMALL), "the of", 5)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")
    # the part before the outer plan's first, not yet adapted version
    assert final[0].count("FileScan parquet") == 1
    assert "ReusedExchange" in final[0] + final[1]


def test_expand_phrases_takes_the_longest_entry_from_the_left(spark):
    from litgraph.operators.search import expand_phrases
    thesaurus = spark.createDataFrame([
        ("Heart attack", "myocardial infarction"), ("heart", "cor"), ("attack rate", "incidence"),
        ("heart-attack risk score", "HARS"), ("drug", "agent"), ("drug", "DRUG"), ("!", "nothing"), ("a b", "x"), ("b c", "y")],
        "term string, synonym string")
    topics = spark.createDataFrame([
        ("Heart attack rate",), ("heart attack risk score drug",), ("the heart, the attack rate; heart",), ("a b c",),
        ("heart attack and heart attack",), ("",), (None,)], "topic string")
    got = {}
    for r in expand_phrases(topics, thesaurus).orderBy("topic", "concept_pos", "term_pos").collect():
        got.setdefault(r.topic, {}).setdefault(r.concept_pos, []).append((r.term, r.kind))
    tiab, all_ = "tiab", "all"
    assert got == {
        "Heart attack rate": {1: [("heart attack", tiab), ("myocardial infarction", all_)], 2: [("rate", tiab)]},
        "heart attack risk score drug": {1: [("heart attack risk score", tiab), ("hars", all_)],
                                         2: [("drug", tiab), ("agent", all_)]},
        "the heart, the attack rate; heart": {1: [("the", tiab)], 2: [("heart", tiab), ("cor", all_)],
                                              3: [("attack rate", tiab), ("incidence", all_)]},
        "a b c": {1: [("a b", tiab), ("x", all_)], 2: [("c", tiab)]},
        "heart attack and heart attack": {1: [("heart attack", tiab), ("myocardial infarction", all_)], 2: [("and", tiab)]},
    }
    empty = thesaurus.where("false")
    assert [r.term for r in expand_phrases(topics.where("topic = 'a b c'"), empty).orderBy("concept_pos").collect()] == ["a", "b", "c"]

"""Author extraction, places and merge."""

import tempfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from litgraph.operators import authors as au
from litgraph.sources.records import (RECORD_SCHEMA, build_records, read_records_xml,
                                      write_records_xml)

ROWS = "pubmedid string, author_pos int, aff_pos int, forename string, lastname string, affiliation string"


def _merge(spark, rows, parts=None):
    df = spark.createDataFrame(rows, ROWS).withColumns(
        {"country": F.lit("C"), "city": F.col("affiliation"), "latitude": F.lit(1.0), "longitude": F.lit(2.0)})
    if parts:
        df = df.repartition(parts)
    order = [F.col("pubmedid").cast("bigint"), "author_pos", "aff_pos"]
    return au.merge_authors(df, order)


def test_merge_two_affiliations_two_papers(spark):
    rows = [("22", 1, 1, "Ann", "Lee", "a2"), ("11", 2, 1, "Ann", "Lee", "a1"),
            ("11", 2, 2, "Ann", "Lee", "a1"), ("33", 1, 1, "Bo", "Kim", "b")]
    got = {(r.forename, r.lastname): r for r in _merge(spark, rows).collect()}
    ann = got[("Ann", "Lee")]
    assert ann.affiliation == "a1; a2" and ann.pubmedid == "11, 22"
    assert ann.paper_ids == ["11", "22"] and ann.city == "a1"  # place of the first row
    assert got[("Bo", "Kim")].affiliation == "b"


def test_merge_drops_null_names_and_is_partition_independent(spark):
    rows = [(str(p), a, 1, f"f{a % 3}", None if a == 5 else f"l{a % 2}", f"aff{(p + a) % 4}")
            for p in range(1, 30) for a in range(1, 7)]
    ref = sorted(map(tuple, _merge(spark, rows, 1).select("forename", "lastname", "affiliation", "pubmedid").collect()))
    for parts in (4, 200):
        got = sorted(map(tuple, _merge(spark, rows, parts).select("forename", "lastname", "affiliation",
                                                                  "pubmedid").collect()))
        assert got == ref
    assert all(r[1] is not None for r in ref)


def test_merge_is_idempotent_on_names(spark):
    rows = [("1", 1, 1, "A", "B", "x"), ("2", 1, 1, "A", "B", "y")]
    once = _merge(spark, rows)
    assert once.count() == once.select("forename", "lastname").distinct().count() == 1


def test_normalize_and_geocode(spark):
    from litgraph.plans import fixtures as fx
    df = spark.createDataFrame([("usa", "City1"), ("UK", "Leeds"), ("Kenya", None), ("DEU", "City0")],
                               "country string, city string")
    out = au.geocode_places(au.normalize_country(df, fx.iso(spark)), fx.gazetteer(spark))
    got = {(r.country, r.city): (r.latitude, r.longitude) for r in out.collect()}
    assert got[("United States", "City1")] == (-55.0, -73.0)
    assert got[("UK", "Leeds")] == (None, None)
    assert got[("Kenya", None)] == (None, None)   # null city never matches a named city
    assert got[("Germany", "City0")] == (-60.0, -80.0)


def _sample_records(spark):
    def author(fore, last, affs):
        return Row(ForeName=fore, LastName=last, AffiliationInfo=[Row(Affiliation=a) for a in affs])
    recs = [
        Row(MedlineCitation=Row(PMID=Row(_VALUE="100", _Version="1"), Article=Row(
            ArticleTitle="A <i>title</i> & more", AuthorList=Row(Author=[
                author("Ann", "Lee", ["Dept A, Hamburg, Germany", "Lab B, Paris, FRA"]),
                author(None, "Solo", []),
                author(None, None, ["Group, Rome, Italy"]),
            ])))),
        Row(MedlineCitation=Row(PMID=Row(_VALUE="200", _Version="1"), Article=Row(
            ArticleTitle="Empty", AuthorList=Row(Author=[])))),
        Row(MedlineCitation=Row(PMID=Row(_VALUE="300", _Version="1"), Article=Row(
            ArticleTitle="One", AuthorList=Row(Author=[author("Jo", "Doe: x", ["U, Bern, CHE"])])))),
    ]
    return spark.createDataFrame(recs, RECORD_SCHEMA)


def test_explode_and_main_authors(spark):
    recs = _sample_records(spark)
    n1 = au.explode_authorship(recs).collect()
    assert [(r.pubmedid, r.author_pos, r.aff_pos) for r in sorted(n1)] == \
        [("100", 1, 1), ("100", 1, 2), ("100", 3, 1), ("300", 1, 1)]
    n2 = au.explode_authorship_outer(recs).collect()
    solo = [r for r in n2 if r.lastname == "Solo"][0]
    assert solo.forename == "" and solo.affiliation is None
    mains = {r.uid: (r.first_author, r.last_author) for r in au.main_authors(recs).collect()}
    assert mains["100"] == ("Ann Lee", "")
    assert mains["200"] == (None, None)
    assert mains["300"] == ("Jo Doe", "Jo Doe")  # one author: first = last, cut at ':'
    rows = au.explode_authorship_outer(recs).filter("pubmedid = '300'")
    assert au.main_authors_from_rows(rows).first().first_author == "Jo Doe"


def test_xml_round_trip(spark):
    recs = _sample_records(spark)
    path = tempfile.mkdtemp(prefix="litgraph-xml-") + "/records"
    write_records_xml(recs, path)
    back = read_records_xml(spark, path)
    a = sorted(map(tuple, au.explode_authorship(recs).collect()))
    b = sorted(map(tuple, au.explode_authorship(back).collect()))
    assert a == b
    title = back.filter("MedlineCitation.PMID._VALUE = '100'").select("MedlineCitation.Article.ArticleTitle").first()[0]
    assert "title" in title


def test_build_records_keeps_papers_without_authors(spark):
    rows = spark.createDataFrame([("1", 1, 1, "A", "B", None), ("1", 2, 1, "C", "D", "x")], ROWS)
    ids = spark.createDataFrame([("1",), ("2",)], "pubmedid string")
    recs = build_records(rows, ids)
    sizes = {r[0]: r[1] for r in recs.select("MedlineCitation.PMID._VALUE",
                                             F.size("MedlineCitation.Article.AuthorList.Author")).collect()}
    assert sizes == {"1": 2, "2": 0}
    assert au.explode_authorship(recs).count() == 1


def test_dedupe_first_non_null(spark):
    df = spark.createDataFrame([("1", 1, 1, "A", "B", None), ("2", 1, 1, "A", "B", "x")], ROWS)
    out = au.dedupe_authors_first(df, [F.col("pubmedid"), "author_pos"], ["affiliation", "pubmedid"]).first()
    assert (out.affiliation, out.pubmedid) == ("x", "1")


def test_empty_search_raises(spark):
    from litgraph.operators.tables import require_rows
    with pytest.raises(ValueError):
        require_rows(spark.range(0), "documents")


def test_merge_with_a_hot_name(spark):
    """One name holds a third of all rows: the result stays whole and exact."""
    rows = [(str(p), 1, 1, "Hot", "Name", f"aff{p % 7}") for p in range(1, 301)]
    rows += [(str(p), a, 1, f"f{p}", f"l{a}", "x") for p in range(1, 301) for a in (2, 3)]
    out = {(r.forename, r.lastname): r for r in _merge(spark, rows, 50).collect()}
    hot = out[("Hot", "Name")]
    assert hot.paper_ids == [str(p) for p in range(1, 301)]
    assert hot.affiliations == [f"aff{i}" for i in [1, 2, 3, 4, 5, 6, 0]]
    assert len(out) == 1 + 300 * 2


def test_merge_packed_order_equals_struct_order(spark):
    """A one-number order key (hash aggregates) gives the same merge as the
    struct of its parts (sort aggregates), places included."""
    rows = [(str(p), a, f, f"f{a % 3}", f"l{(a + p) % 2}", f"aff{(p * a + f) % 5}")
            for p in range(1, 25) for a in range(1, 6) for f in range(1, 3)]
    df = spark.createDataFrame(rows, ROWS).withColumns(
        {"country": F.col("pubmedid"), "city": F.col("affiliation"), "latitude": F.col("author_pos") * 1.0,
         "longitude": F.col("aff_pos") * 1.0}).repartition(7)
    p = F.col("pubmedid").cast("bigint")
    cols = ["forename", "lastname", "affiliation", "pubmedid", "country", "city", "latitude", "longitude"]
    a = au.merge_authors(df, [p, "author_pos", "aff_pos"]).select(*cols).collect()
    b = au.merge_authors(df, [p * 100000 + F.col("author_pos") * 100 + F.col("aff_pos")]).select(*cols).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 6


def test_paper_order_holds_for_large_consortia(spark):
    """The packed order key keeps the order of (paper, author, affiliation)
    for 1,500 authors and 150 affiliations."""
    from pyspark.sql import functions as F

    from litgraph.plans import fixtures as fx
    df = spark.createDataFrame([("1", 1500, 150), ("1", 1500, 1), ("1", 2, 150), ("2", 1, 1), ("10", 1, 1)],
                               "pubmedid string, author_pos int, aff_pos int")
    rows = df.orderBy(*fx.paper_order(None)).collect()
    assert [tuple(r) for r in rows] == [("1", 2, 150), ("1", 1500, 1), ("1", 1500, 150), ("2", 1, 1), ("10", 1, 1)]

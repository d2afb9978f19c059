"""Scalar functions: expected values from FIXTURES.md §4 (read from the
reference code), evaluated by Spark."""

import pytest
from pyspark.sql import functions as F

from litgraph.functions import strings as S

AFFILIATIONS = [
    ("Dept A, Hamburg, Germany. a@b.de", "Germany", "Hamburg"),
    ("Univ X, Paris, FRA", "FRA", "Paris"),
    ("Inst Y, Leeds, UK", "UK", "Leeds"),
    ("Z, Boston, U.S.A.", "U", "Boston"),
    ("Independent Researcher", "Independent Researcher", None),
    ("", "", None),
    ("A, ", "", "A"),
    ("V, St. John's, St. Lucia", "St", "St. John's"),
    ("U, Rome, Italy; W, Bern, Switzerland.", "Switzerland", "Bern"),
    ("X, Lyon,\tFrance\n", "France", "Lyon"),
    ("X, Hamburg\xa0, Germany\xa0", "Germany", "Hamburg"),
    ("X, Oslo　, Norway\x85.", "Norway", "Oslo"),
    ("Lab, Kiel, Germany, mail@x.org", "mail@x", "Germany"),
    (None, None, None),
]


def test_affiliation_country_and_city(spark):
    df = spark.createDataFrame([(a,) for a, _, _ in AFFILIATIONS], "aff string")
    got = df.select("aff", S.affiliation_country("aff").alias("c"), S.affiliation_city("aff").alias("t")).collect()
    by_aff = {r.aff: (r.c, r.t) for r in got}
    for aff, country, city in AFFILIATIONS:
        assert by_aff[aff] == (country, city), aff


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_rgb_to_hex(spark):
    assert _one(spark, S.rgb_to_hex(F.lit(0.5), F.lit(0.0), F.lit(1.0))) == "#7f00ff"
    assert _one(spark, S.rgb_to_hex(F.lit(0.0), F.lit(1.0), F.lit(0.062))) == "#00ff0f"


def test_names_and_labels(spark):
    assert _one(spark, S.full_name(F.lit(None).cast("string"), F.lit("Doe"))) == " Doe"
    assert _one(spark, S.clean_author_name(F.lit("  Jane Doe : extra"))) == "Jane Doe"
    assert _one(spark, S.node_label(F.lit(None).cast("string"))) == "Unknown Author et al."
    assert _one(spark, S.node_label(F.lit("Jane Doe"))) == "Jane Doe et al."
    assert _one(spark, S.node_size(F.lit(1))) == 0.0
    assert _one(spark, S.node_size(F.lit(3))) == pytest.approx(10.986122886681098)


def test_text_helpers(spark):
    assert _one(spark, S.paper_link(F.lit("123"))) == "https://pubmed.ncbi.nlm.nih.gov/123/"
    assert _one(spark, S.popup_text(F.lit("A"), F.lit("B"), F.lit("Lab"))) == "<b>A B</b>: Lab"
    assert _one(spark, S.research_text(F.lit("T"), F.lit("abs"))) == "T abs"
    t = _one(spark, S.edge_title(F.lit("a et al."), F.lit("b et al."), F.lit(0.456)))
    assert t == "Edge from 'a et al.' to 'b et al.'. Similarity: 0.46"


def test_capitalize_header():
    assert [S.capitalize_header(c) for c in ["forename", "page_content", S.LINK_HEADER]] == \
        ["Forename", "Page_content", S.LINK_HEADER]


def test_country_codes_of_any_case_and_shape(spark):
    """J3 maps all codes of a user's table (any case on either side), names
    keep their quotes, and the default table has all countries."""
    from litgraph.operators.authors import normalize_country
    from litgraph.sources.dimensions import _sql_string, country_codes
    iso = spark.createDataFrame([(0, "CIV", "Côte d'Ivoire"), (1, "UK", "United Kingdom"),
                                 (2, "deu", "Germany")], "k int, alpha3 string, name string")
    df = spark.createDataFrame([("civ",), ("uk",), ("Deu",), ("France",), (None,)], "country string")
    got = sorted((r.country or "") for r in normalize_country(df, iso).collect())
    assert got == ["", "Côte d'Ivoire", "France", "Germany", "United Kingdom"]
    assert spark.sql(f"SELECT {_sql_string(chr(39) + 'a' + chr(92))} AS v").first().v == "'a\\"
    codes = {r.alpha3: r.name for r in country_codes(spark).collect()}
    assert len(codes) > 240 and codes["KOR"] == "South Korea" and codes["DEU"] == "Germany"


def test_popups_are_escaped(spark):
    from litgraph.functions.strings import popup_text
    df = spark.createDataFrame([("A<b>", "O&M", "x > y & z"), (None, "B", None)], "f string, l string, a string")
    got = [r.p for r in df.select(popup_text("f", "l", "a").alias("p")).collect()]
    assert got == ["<b>A&lt;b&gt; O&amp;M</b>: x &gt; y &amp; z", "<b>None B</b>: None"]

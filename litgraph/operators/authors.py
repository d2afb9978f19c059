"""Authors: explode records (N1, N2, W1), derive places (F1, F2, J3, J4),
merge by name (A1), first / last author (A4), first row per name (A5),
author strings (A6).

Order semantics.  The reference reads records in order and relies on it for
"first row" and "unique in order of appearance".  Spark rows have no order, so
each operator takes an explicit order key (``order``: list of columns, compared
as a struct) and every "first" is a ``min`` over that key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgraph.functions.strings import (
    affiliation_city, affiliation_country, clean_author_name, full_name)

PLACE_COLS = ["country", "city", "latitude", "longitude"]
NAME_KEY = ["forename", "lastname"]

# ---------------------------------------------------------------- records


def _authors(records: DataFrame) -> Column:
    return F.col("MedlineCitation.Article.AuthorList.Author")


def explode_authorship(records: DataFrame) -> DataFrame:
    """One row per (record, author, affiliation).  An author without an
    affiliation yields no row.  Positions are 1-based."""
    authors = records.select(
        F.col("MedlineCitation.PMID._VALUE").alias("pubmedid"),
        F.posexplode(_authors(records)).alias("_apos", "_a"))
    return authors.select(
        "pubmedid",
        (F.col("_apos") + 1).alias("author_pos"),
        F.col("_a.ForeName").alias("forename"),
        F.col("_a.LastName").alias("lastname"),
        F.posexplode(F.col("_a.AffiliationInfo")).alias("_fpos", "_f"),
    ).select(
        "pubmedid", "author_pos", (F.col("_fpos") + 1).alias("aff_pos"),
        "forename", "lastname", F.col("_f.Affiliation").alias("affiliation"))


def explode_authorship_outer(records: DataFrame) -> DataFrame:
    """Tolerant variant.  Missing names become '', an author without
    affiliations is kept with a null affiliation (and null ``aff_pos``)."""
    authors = records.select(
        F.col("MedlineCitation.PMID._VALUE").alias("pubmedid"),
        F.posexplode(_authors(records)).alias("_apos", "_a"))
    return authors.select(
        "pubmedid",
        (F.col("_apos") + 1).alias("author_pos"),
        F.coalesce(F.col("_a.ForeName"), F.lit("")).alias("forename"),
        F.coalesce(F.col("_a.LastName"), F.lit("")).alias("lastname"),
        F.posexplode_outer(F.col("_a.AffiliationInfo")).alias("_fpos", "_f"),
    ).select(
        "pubmedid", "author_pos", (F.col("_fpos") + 1).alias("aff_pos"),
        "forename", "lastname", F.col("_f.Affiliation").alias("affiliation"))


def author_positions(records: DataFrame) -> DataFrame:
    """Position of every author in its record, with the list size and
    first / last flags (the ends feed A4)."""
    return records.select(
        F.col("MedlineCitation.PMID._VALUE").alias("pubmedid"),
        F.size(_authors(records)).alias("n_authors"),
        F.posexplode(_authors(records)).alias("_apos", "_a"),
    ).select(
        "pubmedid",
        (F.col("_apos") + 1).alias("author_pos"),
        F.col("_a.ForeName").alias("forename"),
        F.col("_a.LastName").alias("lastname"),
        F.col("n_authors").cast("bigint").alias("n_authors"),
        (F.col("_apos") == 0).alias("is_first"),
        (F.col("_apos") == F.col("n_authors") - 1).alias("is_last"),
    )


def main_authors(records: DataFrame) -> DataFrame:
    """A4: first and last author name per record (``uid, first_author,
    last_author``), also when they have no affiliation.  An empty author
    list gives nulls (the reference fails on it)."""
    authors = _authors(records)

    def name_at(i):
        a = F.try_element_at(authors, F.lit(i))
        return F.when(a.isNotNull(), clean_author_name(full_name(a.ForeName, a.LastName)))

    return records.select(
        F.col("MedlineCitation.PMID._VALUE").alias("uid"),
        name_at(1).alias("first_author"),
        name_at(-1).alias("last_author"),
    )


def main_authors_from_rows(rows: DataFrame) -> DataFrame:
    """A4 from authorship rows (``pubmedid, author_pos, forename, lastname``,
    authors without affiliation included): one partial aggregate per paper,
    no nested records needed."""
    name = clean_author_name(full_name(F.col("forename"), F.col("lastname")))
    return rows.groupBy(F.col("pubmedid").alias("uid")).agg(
        F.min_by(name, F.col("author_pos")).alias("first_author"),
        F.max_by(name, F.col("author_pos")).alias("last_author"))


def author_strings(records: DataFrame) -> DataFrame:
    """``"Fore Last: aff1, aff2"`` for every author of every record, one
    row per author (the reference keeps them as a list per record)."""
    return records.select(
        F.col("MedlineCitation.PMID._VALUE").alias("pubmedid"),
        F.posexplode(_authors(records)).alias("_apos", "_a"),
    ).select(
        "pubmedid",
        (F.col("_apos") + 1).alias("author_pos"),
        F.concat(
            full_name(F.col("_a.ForeName"), F.col("_a.LastName")), F.lit(": "),
            F.array_join(F.transform(F.coalesce(F.col("_a.AffiliationInfo"), F.array()),
                                     lambda x: x["Affiliation"]), ", "),
        ).alias("author_string"),
    )


def records_by_id(records: DataFrame, ids: DataFrame, id_col: str = "uid") -> DataFrame:
    """Keep records whose id is in ``ids`` (a DataFrame, never collected)."""
    keys = ids.select(F.col(id_col).cast("string").alias("_rid"))
    return records.join(keys, F.col("MedlineCitation.PMID._VALUE") == F.col("_rid"), "left_semi")


# ---------------------------------------------------------------- places


def add_country_city(df: DataFrame, affiliation: str = "affiliation") -> DataFrame:
    """F1 + F2 on the affiliation text."""
    return df.withColumns({
        "country": affiliation_country(affiliation),
        "city": affiliation_city(affiliation),
    })


def normalize_country(df: DataFrame, iso: DataFrame, col: str = "country") -> DataFrame:
    """Code (any case on either side) -> country name; other values stay.

    The code table is reduced to one row per upper-case code; all its codes
    count.  Spark chooses the join from its real size."""
    codes = iso.filter(F.col("alpha3").isNotNull()).groupBy(
        F.upper("alpha3").alias("_alpha3")).agg(F.max("name").alias("_cname"))
    out = df.join(codes, F.upper(F.col(col)) == F.col("_alpha3"), "left")
    return out.withColumn(col, F.coalesce(F.col("_cname"), F.col(col))).drop("_alpha3", "_cname")


def geocode_places(df: DataFrame, gazetteer: DataFrame, city: str = "city",
                   country: str = "country") -> DataFrame:
    """``(city, country) -> (latitude, longitude)``, nulls when unknown.

    Keys match null-safely: a null city only meets a gazetteer row whose city
    is null (the reference looked up the text 'None').  The gazetteer is
    reduced to one point per place; Spark chooses the join from its real size
    and may split the rows of a place that is too frequent for one task.
    """
    points = gazetteer.groupBy(
        F.col("city").alias("_gcity"), F.col("country").alias("_gcountry")
    ).agg(F.min(F.struct("latitude", "longitude")).alias("_ll"))
    cond = F.col(city).eqNullSafe(F.col("_gcity")) & F.col(country).eqNullSafe(F.col("_gcountry"))
    return (df.join(points, cond, "left")
            .withColumns({"latitude": F.col("_ll.latitude"), "longitude": F.col("_ll.longitude")})
            .drop("_gcity", "_gcountry", "_ll"))


def add_places(df: DataFrame, iso: DataFrame, gazetteer: DataFrame,
               affiliation: str = "affiliation") -> DataFrame:
    """F1, F2, J3, J4 in one plan: country, city, latitude, longitude."""
    return geocode_places(normalize_country(add_country_city(df, affiliation), iso), gazetteer)


# ---------------------------------------------------------------- merge


def merge_authors(df: DataFrame, order: Sequence, keep: Sequence[str] = PLACE_COLS) -> DataFrame:
    """A1: one row per (forename, lastname).

    * ``affiliation``: distinct non-null affiliations in order of appearance,
      joined by '; ' (array form in ``affiliations``)
    * ``pubmedid``: distinct paper ids in order of appearance, joined by ', '
      (array form in ``paper_ids``)
    * ``keep`` columns: taken from the group's first row
    * rows with a null name part are dropped (as grouping drops null keys)

    Homonyms are merged: grouping is by name only, as in the reference.

    Plan: rows are dealt out by name, each once; all else happens in the tasks
    that hold a name.  There every row is split into two tagged values
    (affiliation, paper id), which are de-duplicated on ``(name, tag, value)``
    with the first position, so that lists hold distinct values only.  A paper
    value also carries the row's ``keep`` columns in its key, so the group's
    first row (smallest position of all paper values) brings its place along.  A
    second aggregate on the name orders the distinct values by first position.

    ``order`` of one integral column (e.g. a packed rank) keeps both
    aggregates hash-based: the only aggregation buffer is that number.  Rows of
    a multi-column order get their rank within the name as that number.
    """
    dealt = df.filter(F.col("forename").isNotNull() & F.col("lastname").isNotNull()).select(
        *NAME_KEY, _order_key(order).alias("_seq"), F.col("affiliation").cast("string").alias("_aff"),
        F.col("pubmedid").cast("string").alias("_paper"), F.struct(*keep).alias("_keep")).repartition(*NAME_KEY)
    if len(order) > 1:
        dealt = dealt.withColumn("_seq", F.rank().over(Window.partitionBy(*NAME_KEY).orderBy("_seq")))
    keyed = dealt.select(*NAME_KEY, "_seq", F.explode(F.array(
        F.struct(F.lit("a").alias("tag"), F.col("_aff").alias("value"),
                 F.lit(None).cast(dealt.schema["_keep"].dataType).alias("keep")),
        F.struct(F.lit("p").alias("tag"), F.col("_paper").alias("value"), F.col("_keep").alias("keep")),
    )).alias("_tv"))
    distinct_values = keyed.groupBy(*NAME_KEY, "_tv").agg(F.min("_seq").alias("_s"))
    # Second aggregate: only collect_list (object hash aggregate, no lambdas):
    # affiliations and paper ids in separate lists; the paper list carries the
    # place, and its first element after sorting is the group's first row.
    tag, value = F.col("_tv.tag"), F.col("_tv.value")
    grouped = distinct_values.groupBy(*NAME_KEY).agg(
        F.collect_list(F.when((tag == "a") & value.isNotNull(),
                              F.struct(F.col("_s").alias("s"), value.alias("v")))).alias("_a"),
        F.collect_list(F.when(tag == "p", F.struct(F.col("_s").alias("s"), value.alias("v"),
                                                   F.col("_tv.keep").alias("k")))).alias("_p"))
    out = grouped.select(
        *NAME_KEY,
        F.sort_array("_a")["v"].alias("affiliations"),
        F.sort_array("_p").alias("_p"),
    ).select(
        *NAME_KEY, "affiliations",
        # one entry per (paper, place): keep each paper at its first position
        F.array_distinct(F.array_compact(F.col("_p")["v"])).alias("paper_ids"),
        *[F.element_at("_p", 1)["k"][c].alias(c) for c in keep],
    )
    return out.select(
        *NAME_KEY,
        F.array_join("affiliations", "; ").alias("affiliation"),
        "affiliations",
        F.array_join("paper_ids", ", ").alias("pubmedid"),
        "paper_ids",
        *keep,
    )


def _order_key(order: Sequence) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return cols[0] if len(cols) == 1 else F.struct(*cols)


def dedupe_authors_first(df: DataFrame, order: Sequence,
                         cols: Sequence[str] | None = None) -> DataFrame:
    """A5: per (forename, lastname), the first non-null value of every other
    column in order of appearance."""
    seq = _order_key(order)
    cols = [c for c in (cols or df.columns) if c not in NAME_KEY]
    keyed = df.filter(F.col("forename").isNotNull() & F.col("lastname").isNotNull()).withColumn("_seq", seq)
    return keyed.groupBy(*NAME_KEY).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in cols])


def author_profiles(authorship: DataFrame, iso: DataFrame, gazetteer: DataFrame,
                    order: Sequence) -> DataFrame:
    """M5 core: places for every authorship row, then the merge by name.
    Places are derived before the merge, as the reference does; the merge
    then keeps the first row's place."""
    return merge_authors(add_places(authorship, iso, gazetteer), order)

"""Map side: authors with coordinates (P4) grouped by place (A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgraph.functions.strings import popup_text

POPUP_SEPARATOR = "<br>"


def located_authors(df: DataFrame) -> DataFrame:
    """Keep rows that have both coordinates."""
    return df.na.drop(subset=["latitude", "longitude"])


def popups(authors: DataFrame) -> DataFrame:
    """One row ``(latitude, longitude, forename, lastname, popup)`` per located
    author: A3 without the joined text, for places of any size."""
    return located_authors(authors).select(
        "latitude", "longitude", "forename", "lastname",
        popup_text("forename", "lastname", "affiliation").alias("popup"))


def authors_by_location(authors: DataFrame, salt_buckets: int = 16) -> DataFrame:
    """A3: one row per ``(latitude, longitude)``: the popups of all authors at
    that place, in (forename, lastname) order, joined by ``<br>``, and their
    count.  Rows without coordinates are dropped first (P4).

    A display table: a place's text is one value, so one task sorts and joins
    it.  The salted first step only bounds what each earlier task gathers.  Jobs
    over places that hold a large share of all authors should read ``popups``.
    """
    rows = popups(authors).select(
        "latitude", "longitude", F.struct("forename", "lastname", "popup").alias("_p"),
        F.pmod(F.xxhash64("forename", "lastname"), F.lit(salt_buckets)).alias("_salt"))
    parts = rows.groupBy("latitude", "longitude", "_salt").agg(
        F.collect_list("_p").alias("_ps"), F.count(F.lit(1)).alias("_n"))
    places = parts.groupBy("latitude", "longitude").agg(
        F.flatten(F.collect_list("_ps")).alias("_ps"), F.sum("_n").alias("n_authors"))
    return places.select(
        "latitude", "longitude",
        F.array_join(F.array_sort("_ps")["popup"], POPUP_SEPARATOR).alias("popup"),
        "n_authors",
    )

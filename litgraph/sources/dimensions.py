"""Dimension tables: country codes (S4) and the gazetteer.

The country-code table has a row per country.  A gazetteer can be large (every
populated place of the world is a few million rows).  Operators join both
without hints; Spark broadcasts what its sizes allow.
"""

from __future__ import annotations

import csv
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISO_SCHEMA = "k int, alpha3 string, name string"
GAZETTEER_SCHEMA = "city string, country string, latitude double, longitude double"


def country_codes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``alpha3 -> name`` table.  ``path`` is a CSV with header ``k,alpha3,name``
    on shared storage; without it all ISO 3166 countries as the JVM's locale
    data has them."""
    if path:
        return spark.read.option("header", True).schema(ISO_SCHEMA).csv(path)
    rows = ", ".join(f"({_sql_string(a)}, {_sql_string(n)})" for a, n in _locale_countries(spark))
    return spark.sql(f"SELECT alpha3, name FROM VALUES {rows} AS t(alpha3, name)")


_countries: list[tuple[str, str]] = []


def _locale_countries(spark: SparkSession) -> list[tuple[str, str]]:
    if not _countries:
        locale = spark.sparkContext._jvm.java.util.Locale
        english = locale.ENGLISH
        for code in locale.getISOCountries():
            country = locale("", code)
            _countries.append((country.getISO3Country(), country.getDisplayCountry(english)))
    return _countries


def sample_codes(spark: SparkSession) -> DataFrame:
    """The 25 numbered countries of the test views."""
    text = resources.files("litgraph.resources").joinpath("iso3166_alpha3.csv").read_text()
    rows = [(int(r["k"]), r["alpha3"], r["name"]) for r in csv.DictReader(text.splitlines())]
    # A VALUES literal: one call builds a JVM-local relation (no Python worker
    # reads it, no per-cell gateway round trips while building it).
    values = ", ".join(f"({k}, {_sql_string(a)}, {_sql_string(n)})" for k, a, n in rows)
    return spark.sql(f"SELECT CAST(k AS INT) AS k, alpha3, name FROM VALUES {values} AS t(k, alpha3, name)")


def _sql_string(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def gazetteer(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(city, country) -> (latitude, longitude)`` table from shared storage."""
    reader = spark.read.schema(GAZETTEER_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def gazetteer_from_codes(iso: DataFrame) -> DataFrame:
    """The synthetic gazetteer used by the test views: one city per country,
    ``City<k>`` at ``(5k - 60, 7k - 80)``; the last code (k = 24) is left out
    so that some places stay unmatched."""
    return iso.filter(F.col("k") < 24).select(
        F.concat(F.lit("City"), F.col("k").cast("string")).alias("city"),
        F.col("name").alias("country"),
        (F.col("k") * 5 - 60).cast("double").alias("latitude"),
        (F.col("k") * 7 - 80).cast("double").alias("longitude"),
    )

"""Input views derived from the driver tables (FIXTURES.md §3).

``papers``      one row per document: uid, Title (first line), page_content, Published
``authorship``  one row per (paper, author, affiliation); a null affiliation
                marks an author without one.  Papers are orders, authors are
                line items, names come from parts.
``vectors``     ``embeddings`` with a string id
``iso`` / ``gazetteer``  dimensions (``litgraph.sources.dimensions``)

Each view exists twice: as Spark DataFrame code (used by the queries) and as
SQL text (``ORACLE_VIEWS``) that the DuckDB oracle prepends to every check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litgraph.sources.dimensions import gazetteer_from_codes, sample_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read as it is."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def iso(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    return sample_codes(spark)


def gazetteer(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    return gazetteer_from_codes(sample_codes(spark))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("uid"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("Title"),
        F.col("text").alias("page_content"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 8000).cast("int"))
        .cast("string").alias("Published"),
    )


def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All authorship rows, authors without affiliation included (null)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    codes = F.broadcast(iso(spark))  # bounded: one row per country code
    known = (li.l_suppkey % 25) == codes.k
    pos = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    # Position first (on the narrow joined rows), country and text columns after
    # the shuffle: the string work then runs in the shuffle's parallel tasks, not
    # in the scan task(s).
    joined = li.join(codes, known, "left_semi").join(part, li.l_partkey == part.p_partkey).withColumn(
        "author_pos", F.row_number().over(pos)).join(codes, known)
    affiliation = (
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
        .when(F.col("l_linenumber") == 6, F.lit("Independent Researcher"))
        .otherwise(F.concat(
            F.lit("Dept "), F.col("l_returnflag"), F.lit(", City"),
            (F.col("l_suppkey") % 25).cast("string"), F.lit(", "),
            F.when(F.col("l_suppkey") % 2 == 0, F.col("alpha3")).otherwise(F.col("name")),
            F.lit(". mail@x.org")))
    )
    return joined.select(
        F.col("l_orderkey").cast("string").alias("pubmedid"),
        "author_pos",
        F.lit(1).alias("aff_pos"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("forename"),
        F.concat(F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)), F.lit("_"),
                 (F.col("l_partkey") % 500).cast("string")).alias("lastname"),
        affiliation.alias("affiliation"),
    )


def affiliated(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Authorship rows with an affiliation: what record explosion (N1) yields.
    ``rows``: the authorship rows, where they are written already."""
    rows = authorship(spark, sf_dir) if rows is None else rows
    return rows.filter(F.col("affiliation").isNotNull())


def paper_order(df: DataFrame) -> list:
    """Order of appearance used by 'first' / 'unique' semantics: records in id
    order, then author position, then affiliation position, packed into one
    bigint (the oracle's ``SEQ_SQL``): 31 bits of the id, 20 of the author (a
    million authors a paper), 12 of the affiliation.  One number keeps the
    merge's aggregates hash-based."""
    return [F.col("pubmedid").cast("bigint") * 4294967296 + F.col("author_pos") * 4096 + F.col("aff_pos")]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records: one per order (= paper), authors from ``authorship``,
    title from ``papers`` when the ids meet.  Orders without lines give
    records with an empty author list."""
    from litgraph.sources.records import build_records
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("pubmedid"))
    titles = papers(spark, sf_dir).select(F.col("uid").alias("pubmedid"), F.col("Title").alias("title"))
    return build_records(authorship(spark, sf_dir), ids, titles)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), "embedding")


# DuckDB text of the same views, prepended to oracle queries as CTEs.
ORACLE_VIEWS = {
    "iso": """SELECT * FROM (VALUES
 (0,'DEU','Germany'),(1,'USA','United States'),(2,'FRA','France'),(3,'GBR','United Kingdom'),(4,'ESP','Spain'),
 (5,'ITA','Italy'),(6,'NLD','Netherlands'),(7,'BEL','Belgium'),(8,'CHE','Switzerland'),(9,'AUT','Austria'),
 (10,'POL','Poland'),(11,'SWE','Sweden'),(12,'NOR','Norway'),(13,'DNK','Denmark'),(14,'FIN','Finland'),
 (15,'CAN','Canada'),(16,'BRA','Brazil'),(17,'CHN','China'),(18,'JPN','Japan'),(19,'IND','India'),
 (20,'AUS','Australia'),(21,'ZAF','South Africa'),(22,'EGY','Egypt'),(23,'KEN','Kenya'),(24,'MEX','Mexico')
) AS t(k, alpha3, name)""",
    "gazetteer": """SELECT 'City' || CAST(k AS VARCHAR) AS city, name AS country,
       CAST(k*5-60 AS DOUBLE) AS latitude, CAST(k*7-80 AS DOUBLE) AS longitude
FROM iso WHERE k < 24""",
    "papers": """SELECT CAST(doc_id AS VARCHAR) AS uid, split_part(text, chr(10), 1) AS Title, text AS page_content,
       CAST(DATE '2000-01-01' + CAST(doc_id % 8000 AS INT) AS VARCHAR) AS Published
FROM documents""",
    "authorship": """SELECT CAST(l_orderkey AS VARCHAR) AS pubmedid,
       row_number() OVER (PARTITION BY l_orderkey
                          ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS author_pos,
       1 AS aff_pos,
       split_part(p_name, ' ', 1) AS forename,
       split_part(p_name, ' ', 2) || '_' || CAST(l_partkey % 500 AS VARCHAR) AS lastname,
       CASE WHEN l_linenumber = 7 THEN NULL
            WHEN l_linenumber = 6 THEN 'Independent Researcher'
            ELSE 'Dept ' || l_returnflag || ', City' || CAST(l_suppkey % 25 AS VARCHAR) || ', ' ||
                 CASE WHEN l_suppkey % 2 = 0 THEN alpha3 ELSE name END || '. mail@x.org' END AS affiliation
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN iso ON l_suppkey % 25 = k""",
    "affiliated": "SELECT * FROM authorship WHERE affiliation IS NOT NULL",
    "vectors": "SELECT CAST(vec_id AS VARCHAR) AS id, embedding FROM embeddings",
}

ORACLE_ORDER = ["iso", "gazetteer", "papers", "authorship", "affiliated", "vectors"]


def with_views(sql: str, extra: list[tuple[str, str]] | None = None, recursive: bool = False) -> str:
    """Prefix ``sql`` with the fixture views (plus ``extra`` named CTEs)."""
    ctes = [(n, ORACLE_VIEWS[n]) for n in ORACLE_ORDER] + list(extra or [])
    head = ",\n".join(f"{name} AS (\n{body}\n)" for name, body in ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{sql}"

"""Nested bibliographic records (S1) and documents.

A record is one ``PubmedArticle`` element: id, title and the ordered author
list, each author with an ordered affiliation list.  Records are read from XML
with Spark's built-in XML source and an explicit schema (inference would read
the id as a number).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AFFILIATION = T.StructType([T.StructField("Affiliation", T.StringType())])
AUTHOR = T.StructType([
    T.StructField("ForeName", T.StringType()),
    T.StructField("LastName", T.StringType()),
    T.StructField("AffiliationInfo", T.ArrayType(AFFILIATION)),
])
RECORD_SCHEMA = T.StructType([
    T.StructField("MedlineCitation", T.StructType([
        T.StructField("PMID", T.StructType([
            T.StructField("_VALUE", T.StringType()),
            T.StructField("_Version", T.StringType()),
        ])),
        T.StructField("Article", T.StructType([
            T.StructField("ArticleTitle", T.StringType()),
            T.StructField("AuthorList", T.StructType([
                T.StructField("Author", T.ArrayType(AUTHOR)),
            ])),
        ])),
    ])),
])

ROW_TAG = "PubmedArticle"
ROOT_TAG = "PubmedArticleSet"


def read_records_xml(spark: SparkSession, path: str) -> DataFrame:
    """Records from XML files (one ``PubmedArticle`` element per record),
    read in parallel per file with the declared schema."""
    return (spark.read.format("xml").option("rowTag", ROW_TAG)
            .schema(RECORD_SCHEMA).load(path))


def write_records_xml(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write records back as XML (the shape the reader expects), compressed: tags
    and indentation are most of the text."""
    (records.write.format("xml").option("rowTag", ROW_TAG).option("rootTag", ROOT_TAG)
     .option("compression", "gzip").mode(mode).save(path))


def build_records(authorship: DataFrame, paper_ids: DataFrame,
                  titles: DataFrame | None = None) -> DataFrame:
    """Nest authorship rows (``pubmedid, author_pos, aff_pos, forename,
    lastname, affiliation``; a null affiliation marks an author without one)
    into records.  ``paper_ids`` (column ``pubmedid``) lists every record, so
    papers without authors get an empty author list.  ``titles`` is an
    optional ``(pubmedid, title)`` table.

    One shuffle on the paper id; both aggregates below (per author, then per
    paper) reuse that partitioning.  Lists are ordered by sorting structs
    whose first field is the position, and fields are picked from the
    sorted arrays directly (no per-element lambdas).
    """
    by_paper = authorship.repartition("pubmedid")
    info = F.when(F.col("affiliation").isNotNull(), F.struct(F.col("affiliation").alias("Affiliation")))
    per_author = by_paper.groupBy("pubmedid", "author_pos").agg(F.sort_array(F.collect_list(
        F.struct("aff_pos", "forename", "lastname", info.alias("info")))).alias("_r"))
    head = F.element_at("_r", 1)
    author = F.struct(head["forename"].alias("ForeName"), head["lastname"].alias("LastName"),
                      F.array_compact(F.col("_r")["info"]).alias("AffiliationInfo"))
    nested = per_author.groupBy("pubmedid").agg(
        F.sort_array(F.collect_list(F.struct("author_pos", author.alias("a")))).alias("_s"))
    nested = nested.select("pubmedid", F.col("_s")["a"].alias("_authors"))
    ids = paper_ids.select(F.col("pubmedid").cast("string").alias("pubmedid")).distinct()
    out = ids.join(nested, "pubmedid", "left")
    if titles is not None:
        out = out.join(titles.select("pubmedid", F.col("title").alias("_title")), "pubmedid", "left")
    else:
        out = out.withColumn("_title", F.lit(None).cast("string"))
    empty = F.array().cast(T.ArrayType(AUTHOR))
    return out.select(F.struct(
        F.struct(F.col("pubmedid").alias("_VALUE"), F.lit("1").alias("_Version")).alias("PMID"),
        F.struct(
            F.col("_title").alias("ArticleTitle"),
            F.struct(F.coalesce(F.col("_authors"), empty).alias("Author")).alias("AuthorList"),
        ).alias("Article"),
    ).alias("MedlineCitation"))


# ---------------------------------------------------------------- documents

def to_documents(papers: DataFrame, page_content_column: str = "page_content",
                 doc_type: str = "Document") -> DataFrame:
    """Documents as the search step returns them: text, metadata, type."""
    others = [c for c in papers.columns if c != page_content_column]
    return papers.select(
        F.col(page_content_column).alias("page_content"),
        F.struct(*others).alias("metadata"),
        F.lit(doc_type).alias("type"))


def flatten_documents(docs: DataFrame) -> DataFrame:
    """One row per document, metadata fields lifted to the top level,
    ``metadata`` and ``type`` dropped."""
    return docs.select("page_content", "metadata.*")


def table_to_documents(df: DataFrame, page_content_column: str) -> DataFrame:
    """S3: one column becomes the text, every other column the metadata."""
    others = [c for c in df.columns if c != page_content_column]
    return df.select(F.col(page_content_column).alias("page_content"),
                     F.struct(*others).alias("metadata"))

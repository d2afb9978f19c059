"""A training-data pipeline: toxic documents go, one document of each group of
near copies stays, secrets are blotted out, sources are mixed to their target
weights, and what is left is packed into bins.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litgraph.llm import mixing, near_dedup, packing, secrets, toxicity
from litgraph.llm.common import documents, materialize, split_by_ids


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score (operator 3) is below the threshold."""
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, "__score")
    return scored.where(F.col("__score") < toxicity.THRESHOLD).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (operator 1 on five words): the one of the
    smallest id.  Of rows that repeat an id one stays, the one of the smallest
    text; rows without an id cannot be named and stay.  Texts are shuffled only
    of documents that may go, at any size of the tables."""
    found = near_dedup.near_duplicates(docs, k=5, percent=80)
    known = materialize(found.where("doc_id is not null").groupBy("doc_id").agg(
        F.max("kept").alias("__kept"), F.count("*").alias("__rows")), "kept")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    drop = known.where("not __kept or __rows > 1").select(F.col("doc_id").alias("__id"), "__kept", "__rows")
    stay, others = split_by_ids(docs, drop.select(F.col("__id").alias("id")))
    keyed = others.join(drop.hint("merge"), F.col("doc_id").cast("long") == F.col("__id"), "left")
    out = keyed.where(F.coalesce(F.col("__kept"), F.lit(True)) & (F.coalesce(F.col("__rows"), F.lit(1)) == 1))
    if known.where("__rows > 1").isEmpty():
        return stay.union(out.select(cols))
    order = Window.partitionBy("doc_id").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    many = keyed.where("__kept and __rows > 1").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return stay.union(out.select(cols)).union(many.select(cols))


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets (operator 10) replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix (operator 6) takes them."""
    return mixing.mixed_documents(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins (operator 2): one row per piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", blot_secrets),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: Hashing, label models and packing have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

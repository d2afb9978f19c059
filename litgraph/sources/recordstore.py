"""A store of records that is read by id (S1 + J5).

``save_records`` writes records with their id beside them, in folders by a hash
of the id (``shard``) and sorted by it, with a Bloom filter for each row group.
``records_of`` reads those of an id table: a short list, up to ``LISTED`` ids,
becomes filters at the scan (folders, then row groups by range and Bloom
filter); a longer one is joined by folder and id, and Spark prunes the folders
that the ids do not need.  Added records are written beside the others; their
ids must be new.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
LISTED = 64
ID = "pmid"


def _shard(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SHARDS)).cast("int")


def save_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """Write or add records; those without an id are left out."""
    key = F.col("MedlineCitation.PMID._VALUE")
    rows = records.select("*", key.alias(ID)).where(F.col(ID).isNotNull()).withColumn("shard", _shard(F.col(ID)))
    (rows.repartitionByRange("shard", ID).sortWithinPartitions("shard", ID).write.mode(mode)
     .option(f"parquet.bloom.filter.enabled#{ID}", "true").option("parquet.block.size", str(16 << 20))
     .partitionBy("shard").parquet(path))


def records_of(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "uid") -> DataFrame:
    """The stored records whose id is in ``ids``, as ``records_by_id`` over the
    records that were saved."""
    stored = spark.read.parquet(path)
    columns = [c for c in stored.columns if c not in (ID, "shard")]
    wanted = ids.select(F.col(id_col).cast("string").alias(ID)).where(F.col(ID).isNotNull()).withColumn("shard", _shard(F.col(ID))).distinct()
    few = wanted.limit(LISTED + 1).collect()  # a fixed number of rows
    if len(few) > LISTED:
        return stored.join(wanted, ["shard", ID], "left_semi").select(columns)
    if not few:
        return stored.where(F.lit(False)).select(columns)
    # one equality an id: these reach the Bloom filters, a long IN list does not
    named = reduce(lambda a, b: a | b, [F.col(ID) == r[ID] for r in few])
    return stored.where(F.col("shard").isin(sorted({r["shard"] for r in few})) & named).select(columns)

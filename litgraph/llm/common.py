"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litgraph.session import scratch_path

#: Rows per Arrow batch: bounds a Python worker's memory also for long texts.
ARROW_ROWS = 1000
#: 64-bit words of the bitmap of ``split_by_ids``: a fixed size, so what is
#: broadcast never grows; a fuller bitmap only lets more rows be looked up.
FILTER_WORDS = 1 << 18


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A given table, read as it is."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small; texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back: later
    steps neither compute it again nor depend on the executors that did."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_by_ids(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``doc_id`` is surely not in ``ids`` (column ``id``, long),
    and the others.  A bitmap of fixed size, with a bit set for each id, goes to
    all tasks, so neither part is shuffled."""
    def place(doc_id: Column) -> tuple[Column, Column]:
        h = F.xxhash64(F.lit("split"), doc_id)
        return F.pmod(h, F.lit(FILTER_WORDS)), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")

    word, bit = place(F.col("id"))
    own = ids.select(word.alias("__w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__x"))
    every = ids.sparkSession.range(FILTER_WORDS).select(F.col("id").alias("__w"), F.lit(0).cast("long").alias("__x"))
    bits = materialize(own.union(every).groupBy("__w").agg(F.bit_or("__x").alias("__bits")), "filter")
    word, bit = place(F.col("doc_id").cast("long"))
    placed = rows.withColumns({"__w": word, "__b": bit}).join(F.broadcast(bits), "__w")
    maybe = F.getbit("__bits", F.col("__b")) == 1
    cols = [F.col(f"`{c}`") for c in rows.columns]
    return placed.where(~maybe).select(cols), placed.where(maybe).select(cols)


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0), without Python."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), ""))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 modulo 4 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``n``, its row number from 1 in the given order, without
    one task that sees all rows: ranges are numbered apart, then shifted by
    the counts of the ranges before (one row per range)."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    here = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__here", here).join(F.broadcast(shift), "__range").withColumn(
        "n", F.col("__here") + F.col("__before")).drop("__range", "__here", "__before")

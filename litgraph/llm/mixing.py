"""Operator 6: mixing sources to target weights.

Sources get weights by their rank in code-point order (1, 2, 3, repeating,
null last) and share the total size in proportion; a target stops at
``most`` times its source's size and the excess is shared again by weight
until no target is above its bound.

Within a source, documents are ordered by a hash-random key (md5 of seed and
id).  The key's first digits deal each source into 4096 cells, so a source
that holds a third of all rows is spread like any other: running sums are
taken within cells, and cell offsets (at most 4096 rows a source) give
distributed prefix sums.  Each source is cut at its exact budget, the whole
part of its target: all documents as often as the budget holds whole epochs,
then the documents up to the cut once more; the document at the cut gives the
words before it.

Defined results: null or empty texts have size 0 and nothing is taken of
them.  A null source is a source of its own.  Null or repeated ids are
ordered by size after their key, so reruns agree; equal rows are
interchangeable.  If all sizes are 0, so are all targets.  Other columns are
ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litgraph.llm import textnum
from litgraph.llm.common import bounded_batches, materialize, numbered

CELL_DIGITS = 3  # hexadecimal: 4096 cells a source
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix"


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, text_hash`` of every row; size in words."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(textnum.count_words(batch.column(2)), pa.int64())],
                names=["doc_id", "source", "text_hash", "size"])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    ).mapInArrow(run, "doc_id long, source string, text_hash long, size long")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``(skey, source_size, target)`` from ``(skey, source, source_size)``.

    Only a few totals reach the driver in each round; a round bounds at least
    one more source or is the last."""
    ranked = numbered(sources, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("n") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight.cast("long")), "sources")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = None  # words for each unit of weight; sources at or below it are bounded
    while True:
        bound = F.lit(False) if level is None else most * F.col("source_size") < F.col("weight") * F.lit(level)
        full, free, n = ranked.agg(
            F.sum(F.when(bound, most * F.col("source_size")).otherwise(0)),
            F.sum(F.when(bound, 0).otherwise(F.col("weight"))),
            F.sum(F.when(bound, 1).otherwise(0))).first()
        if not free:
            break
        new = (total - full) / free
        if level is not None and new <= level:
            break
        level = new
    level = 0.0 if level is None else float(level)
    return ranked.select("skey", "source_size", F.least(
        F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double")).alias("target"))


def mix(docs: DataFrame, most: int = MOST) -> DataFrame:
    """``doc_id, text_hash, size, source_size, target, taken, copies`` for every
    row: ``taken`` words, of which ``copies`` times the whole document."""
    base = materialize(sized(docs).select(
        "doc_id", "source", "size", "text_hash",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"),
        F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("key"),
    ).withColumn("cell", F.conv(F.substring("key", 1, CELL_DIGITS), 16, 10).cast("int")), "mix")
    cells = base.groupBy("skey", "cell").agg(F.sum("size").alias("cell_size"), F.max("source").alias("source"))
    goal = targets(cells.groupBy("skey").agg(F.max("source").alias("source"), F.sum("cell_size").alias("source_size")),
                   most)
    before = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("skey", "cell", F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("offset")).join(
        goal, "skey")
    within = Window.partitionBy("skey", "cell").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = base.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(cells, ["skey", "cell"])
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as long) div source_size")).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.least(rest - F.col("before") - F.col("offset"), F.col("size")), F.lit(0))
    return placed.select(
        "doc_id", "text_hash", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"),
        (whole + F.when((F.col("size") > 0) & (2 * part >= F.col("size")), 1).otherwise(0)).cast("int").alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it whole; the document
    at a source's cut counts if half of it at least is before the cut.  Rows
    of equal id and text get the copies of one of them; those with null ids
    stay out of the join only in so far as their text hash tells them apart."""
    plan = mix(docs).groupBy("doc_id", "text_hash").agg(F.max("copies").alias("copies")).where("copies > 0")
    cols = docs.columns
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn(
        "__hash", F.xxhash64(F.col("text").cast("string")))
    plan = plan.select(F.col("doc_id").alias("__i"), F.col("text_hash").alias("__h"), F.col("copies").alias("__copies"))
    joined = keyed.join(plan, (F.col("__hash") == F.col("__h")) & F.col("__id").eqNullSafe(F.col("__i")))
    return joined.select(*[F.col(f"`{c}`") for c in cols],
                         F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__epoch")).select(*cols)

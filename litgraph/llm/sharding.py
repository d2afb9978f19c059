"""Operator 4: minimax contiguous partition, with DataFrame functions only.

Rows of equal texts are one atomic group.  Groups are ordered by a 128-bit
hash of their text, and the ordered groups are cut into ``shards`` contiguous
stretches so that the largest stretch is as small as possible (law
``bytes``).  Its size, the shard capacity, is found by bisection: a capacity is
feasible if the greedy walk, which gives each shard as many groups as fit,
needs no more than ``shards`` shards.

Many cuts can meet that capacity; the greedy ones leave the last shards small,
or empty if one large group sets the capacity.  So of the places where a shard
may end (neither it nor those after it above the capacity) the one nearest to
an equal share of the rest is taken.

The groups' sizes never leave Spark.  Their running sums are distributed prefix
sums over 4096 cells (the hash's first bits); a step of the greedy walk is an
aggregate that finds the largest running sum below a limit.  ``PROBES``
capacities are walked at once, so each round of walks does the work of several
bisection steps, and a step only reads the part of the (sorted) running sums
between the smallest and the largest limit.  The cuts are group keys, so every
row finds its shard by comparing its own hash with a few constants, without a
join, however large its group is.

Slots number a shard's rows without gaps: rows are dealt to 4096 cells by
their id and text, numbered there, and shifted by the counts of the cells
before.

Defined results: a null text counts no bytes (size 1) and all null texts are
one group, other than the empty text's.  Null and repeated ids are numbered
like others.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgraph.llm.common import materialize

SHARDS = 8
CELLS = 4096
PROBES = 16


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    none = text.isNull()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(none, F.lit(0)).otherwise(F.xxhash64(text)).cast("long").alias("k1"),
        F.when(none, F.lit(0)).otherwise(F.xxhash64(F.lit("b"), text)).cast("long").alias("k2"))


def _cell(k: Column) -> Column:
    return (F.shiftright(k, 52) + CELLS // 2).cast("int")


def running_sums(rows: DataFrame) -> DataFrame:
    """``(k1, k2, upto)`` per group in the order of (k1, k2): the size of all
    groups up to and with it.  Written in order, so that reads by ``upto``
    touch few row groups."""
    groups = rows.groupBy("k1", "k2").agg(F.sum("size").alias("size")).withColumn("cell", _cell(F.col("k1")))
    groups = materialize(groups, "groups")
    totals = groups.groupBy("cell").agg(F.sum("size").alias("total"))  # CELLS rows at most
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("cell", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shift"))
    here = Window.partitionBy("cell").orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, 0)
    return materialize(
        groups.withColumn("here", F.sum("size").over(here)).join(F.broadcast(shift), "cell")
        .select("k1", "k2", (F.col("here") + F.col("shift")).alias("upto")), "running")


def _walk(sums: DataFrame, total: int, largest: int, capacities: list[int], shards: int) -> list[list[int]]:
    """For each capacity the ends of the greedy shards, ``shards`` at most."""
    ends: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        limits = [(e[-1] if e else 0) + c for c, e in zip(capacities, ends, strict=True)]
        if min(limits) >= total:
            found = [total] * len(limits)
        else:
            # a group fits in any capacity, so the answer is above limit - largest
            near = sums.where((F.col("upto") > min(limits) - largest) & (F.col("upto") <= max(limits)))
            got = near.agg(*[F.max(F.when(F.col("upto") <= x, F.col("upto"))).alias(f"m{i}")
                             for i, x in enumerate(limits)]).first()
            found = [total if x >= total else int(g) for g, x in zip(got, limits, strict=True)]
        for e, f in zip(ends, found, strict=True):
            e.append(f)
    return ends


def capacity_and_cuts(sums: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and where its greedy shards end."""
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest  # high is feasible
    ends: list[int] = []
    while True:
        step = max(1, -(-(high - low + 1) // PROBES))
        tried = list(range(low, high, step))[:PROBES] + [high]
        walked = _walk(sums, total, largest, tried, shards)
        good = next(i for i, e in enumerate(walked) if e[-1] >= total)
        ends = walked[good]
        if good == 0 or tried[good] - tried[good - 1] == 1:
            return tried[good], ends
        low, high = tried[good - 1] + 1, tried[good]
        if low == high:
            return high, ends


def even_ends(sums: DataFrame, total: int, capacity: int, shards: int) -> list[int]:
    """Where the shards end: none is above ``capacity``, and each is as near to
    an equal share of what is left as that allows."""
    least = [total]  # the earliest end of a shard, by the number of shards after it
    for _ in range(shards - 1):
        x = least[-1] - capacity
        least.append(0 if x <= 0 else int(sums.where(F.col("upto") >= x).agg(F.min("upto")).first()[0]))
    ends: list[int] = []
    at = 0
    for after in range(shards - 1, -1, -1):
        want = at + -(-(total - at) // (after + 1))
        below, above = sums.where((F.col("upto") > at) & (F.col("upto") <= at + capacity)).agg(
            F.max(F.when(F.col("upto") <= want, F.col("upto"))),
            F.min(F.when(F.col("upto") > want, F.col("upto")))).first()
        near = [int(x) for x in (below, above) if x is not None] or [total]  # no group is left
        at = max(min(near, key=lambda x: (abs(x - want), x)), least[after])
        ends.append(at)
    return ends


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row."""
    rows = materialize(_rows(docs), "rows")
    sums = running_sums(rows)
    total = sums.agg(F.max("upto")).first()[0] or 0
    cuts: list[tuple[int, int]] = []
    if total:
        largest = rows.groupBy("k1", "k2").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0]
        capacity, _ = capacity_and_cuts(sums, total, largest, shards)
        inner = [e for e in even_ends(sums, total, capacity, shards)[:-1] if e < total]
        at = {r["upto"]: (r["k1"], r["k2"]) for r in sums.where(F.col("upto").isin(inner)).collect()} if inner else {}
        cuts = [at[e] for e in inner]
    k = F.struct("k1", "k2")
    shard = F.lit(0)
    for a, b in cuts:  # the cut is the last group of its shard
        shard = shard + (k > F.struct(F.lit(a).cast("long").alias("k1"), F.lit(b).cast("long").alias("k2"))).cast("int")
    placed = rows.withColumn("shard", shard).withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(CELLS)).cast("int"))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("rows"))  # shards * CELLS rows at most
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("shard", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift"))
    here = Window.partitionBy("shard", "cell").orderBy("doc_id", "k1", "k2", "size")
    return placed.withColumn("here", F.row_number().over(here)).join(F.broadcast(shift), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("here") - 1 + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""Operator 2: conflict-constrained best-fit packing.

Documents are packed into bins of ``capacity`` words.  Two documents conflict
when they have the same source or belong to the same duplicate cluster; a bin
never holds a conflict.  A document longer than a bin is cut into pieces; its
full pieces fill bins of their own, the rest is packed like a short document.

Documents are dealt by a hash of their id to groups of about ``GROUP`` items,
whatever their source, and each group is packed apart: a group's bins are kept
in the order of their residual space with a bitmap of the sources and one of
the duplicate clusters they hold.  Items come by falling size; the search
starts at the first bin whose residual holds the item and goes on through its
successors until the bitmaps meet no conflict: that is the tightest compatible
bin.  If there is none, a bin is opened.  Groups are so large that packing
them apart costs next to nothing, and small enough for any task.

Defined results: documents without words (null or empty text too) take one
row with 0 words and no bin.  A null source conflicts with nothing.  Rows
with null or repeated ids are packed like others, ties in the order of size
are broken by id, source and text hash.  An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgraph.llm import textnum
from litgraph.llm.common import bounded_batches, materialize

CAPACITY = 2048
GROUP = 2048
RESULT = ("doc_id long, piece int, first_word long, n_words long, bin_id long, bin_start long, bin_words long, "
          "source string, cluster long")


def items(docs: DataFrame) -> DataFrame:
    """``doc_id, source, cluster, n_words``: the cluster is a hash of the
    text's words in lower case."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul = np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            sizes, clusters = [], []
            for b in textnum.blocks(batch.column(2)):
                h, first = textnum.word_hashes(b)
                n = np.diff(first)
                # position-dependent sum of the words' hashes
                place = np.arange(len(h)) - np.repeat(first[:-1], n)
                mixed = textnum.mix(h + place.astype(np.uint64) * mul)
                sums = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(mixed, dtype=np.uint64, out=sums[1:])
                clusters.append(textnum.mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64)).view(np.int64))
                sizes.append(n)
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate(clusters or none), pa.int64()),
                 pa.array(np.concatenate(sizes or none), pa.int64())], names=["doc_id", "source", "cluster", "n_words"])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, source string, cluster long, n_words long")


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each item, items given by falling size.  Sources and
    clusters are numbered from 0; -1 conflicts with nothing."""
    order: list[tuple[int, int]] = []   # (residual, bin), ascending
    held: list[list[int]] = []          # bitmaps of sources and clusters by bin
    out = []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        s_bit, c_bit = (1 << s) if s >= 0 else 0, (1 << c) if c >= 0 else 0
        at = bisect_left(order, (size, -1))
        while at < len(order):
            bits = held[order[at][1]]
            if not (bits[0] & s_bit or bits[1] & c_bit):
                break
            at += 1
        if at < len(order):
            left, k = order.pop(at)
        else:
            left, k = capacity, len(held)
            held.append([0, 0])
        held[k][0] |= s_bit
        held[k][1] |= c_bit
        if left > size:  # full bins leave the search
            insort(order, (left - size, k))
        out.append(k)
    return out


def _codes(values: pd.Series, single: bool) -> list[int]:
    """Numbers from 0 by value; -1 for null and, if asked for, single values."""
    codes, _ = pd.factorize(values)
    if single:
        n = np.bincount(codes[codes >= 0], minlength=1)
        codes = np.where((codes >= 0) & (n[np.maximum(codes, 0)] > 1), codes, -1)
        codes = np.where(codes >= 0, pd.factorize(codes)[0], -1)
    return [int(c) for c in codes]


def _pack_group(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["doc_id", "source", "cluster", "n_words"], na_position="last").reset_index(drop=True)
        n = g["n_words"].to_numpy(np.int64)
        full, rest = n // capacity, n % capacity
        base = int(g["grp"].iloc[0]) << 32
        todo = g[rest > 0].assign(rest=rest[rest > 0]).sort_values("rest", ascending=False, kind="stable")
        bins = best_fit(todo["rest"].tolist(), _codes(todo["source"], False), _codes(todo["cluster"], True), capacity)
        todo = todo.assign(local=bins)
        todo["bin_start"] = todo.groupby("local")["rest"].cumsum() - todo["rest"]
        packed = pd.DataFrame({
            "row": todo.index, "piece": full[todo.index], "first_word": full[todo.index] * capacity,
            "n_words": todo["rest"], "bin_id": base + todo["local"], "bin_start": todo["bin_start"],
            "bin_words": todo.groupby("local")["rest"].transform("sum")})
        k = np.repeat(np.arange(len(g)), full)
        piece = np.arange(len(k)) - np.repeat(np.cumsum(full) - full, full)
        whole = pd.DataFrame({
            "row": k, "piece": piece, "first_word": piece * capacity, "n_words": capacity,
            "bin_id": base + (max(bins, default=-1) + 1) + np.arange(len(k)), "bin_start": 0, "bin_words": capacity})
        none = np.flatnonzero(n == 0)
        empty = pd.DataFrame({"row": none, "piece": 0, "first_word": 0, "n_words": 0,
                              "bin_id": pd.NA, "bin_start": pd.NA, "bin_words": pd.NA})
        out = pd.concat([x.astype("Int64") for x in (packed, whole, empty)])
        at = out["row"].to_numpy(np.int64)
        for c in ("doc_id", "source", "cluster"):
            out[c] = g[c].to_numpy()[at]
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out[[c.split()[0] for c in RESULT.split(", ")]]
    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row per piece of a document: its bin and its place in it."""
    found = materialize(items(docs), "items")
    groups = max(1, -(-found.count() // group))
    dealt = found.withColumn("grp", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(_pack_group(capacity), RESULT)

"""Operator 8: document fingerprints by winnowing.

A text's k-grams of bytes get rolling hashes; in every window of ``WINDOW``
consecutive k-grams the smallest hash is marked, the rightmost one on ties.
The fingerprint is the list of marked (hash, position) pairs.  Two texts that
share ``GRAM + WINDOW - 1`` bytes share a mark (the match guarantee), and its
positions tell where.  A text with fewer k-grams than a window marks the
smallest of those it has; one shorter than a k-gram marks itself as a whole.

The likeness of two fingerprints is the Jaccard similarity of their hashes.

``fingerprints`` also fingerprints an edited text, which ends with the
beginning of the next document's text.  Rows are dealt into ranges of the id
(bounds from approximate quantiles; as many as the session's shuffle partitions,
or one for each ``RANGE_BYTES`` of texts if that is more), a task each; the
first row of every range is also sent to the end of the range before.  So a
range, read in the order of the ids, holds all it needs, and each text is
shuffled once.  ``marks`` gives the marks themselves.

Defined results: a null text is an empty one; it has no marks.  Fingerprints
without marks are alike (1.0) if both texts are empty, else 0.0.  Rows with
null ids stand before all others; rows of equal ids stand in the order of
their texts.  A single row is its own next one.  Other columns are ignored.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgraph.llm import textnum
from litgraph.llm.common import bounded_batches

GRAM, WINDOW = 24, 32
#: Bytes of texts in a range at least, where the session's shuffle partitions are more.
RANGE_BYTES = 64 << 20
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, n_marks long")


def winnow(data: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Marked hashes (32 bits) and their positions in a text's bytes."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k = min(gram, n)
    sums = textnum.prefix_sums(data)
    starts = np.arange(n - k + 1)
    h = textnum.stretch_hash(sums, starts, starts + k) >> np.uint64(32)
    # hash first, then the later place first: one minimum gives the rightmost
    key = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - starts.astype(np.uint64))
    w = min(window, len(key))
    least, width = key, 1
    while 2 * width <= w:       # minima of 2, 4, 8, ... neighbours
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < w:
        least = np.minimum(least[:len(least) - (w - width)], least[w - width:])
    marks = least[np.flatnonzero(np.r_[True, least[1:] != least[:-1]])]
    return (marks >> np.uint64(32)).astype(np.uint32), 0xFFFFFFFF - (marks & np.uint64(0xFFFFFFFF)).astype(np.int64)


def digest(marks: tuple[np.ndarray, np.ndarray]) -> str:
    """A short name of a fingerprint: equal for equal lists of marks only."""
    return hashlib.sha256(marks[0].astype("<u4").tobytes() + marks[1].astype("<i8").tobytes()).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray, both_empty: bool = False) -> float:
    """Jaccard similarity of two arrays of hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0 if both_empty else 0.0
    z = np.concatenate((a, b))
    z.sort()
    same = int(np.count_nonzero(z[1:] == z[:-1]))
    return same / (len(a) + len(b) - same)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _row(doc_id: int | None, text: str, marks: tuple, following: str, next_marks: tuple) -> tuple:
    new = edited(text, following)
    own = winnow(_bytes(new))
    return (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), digest(marks), digest(own),
            likeness(marks[0], own[0], not text and not new), likeness(marks[0], next_marks[0], not text and not following),
            len(marks[0]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, extra, doc_id, text) in order; an extra row only ends its range."""
    held = None
    for batch in batches:
        out = []
        for rng, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None and held[0] != rng:
                held = None  # its range has ended with an extra row
            if held is None and extra:
                continue     # ranges can have several; the first one counts
            marks = winnow(_bytes(text))
            if held is not None:
                out.append(_row(*held[1:], text, marks))
            held = None if extra else (rng, doc_id, text, marks)
        yield _batch(out)


def marks(docs: DataFrame) -> DataFrame:
    """The fingerprints themselves: ``doc_id`` and two arrays of equal length,
    ``hashes`` and ``positions`` (in the text's UTF-8 bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(_bytes(x or "")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())),
                 pa.array([p for _, p in found], pa.list_(pa.int64()))], names=["doc_id", "hashes", "positions"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def _places(bounds: np.ndarray, kept: np.ndarray, first: np.ndarray, nulls: bool = False) -> Column:
    """Range of the id among the ranges that have rows, and the range before if
    the id is the first of its own (the last one is before the first); null ids,
    if there are any, are the first of all."""
    @F.pandas_udf("rng int, before int")
    def place(doc_id: pd.Series, known: pd.Series) -> pd.DataFrame:
        ids = doc_id.to_numpy()
        rng = np.searchsorted(kept, np.where(known, np.searchsorted(bounds, ids, "left"), 0))
        starts = np.where(nulls & (rng == 0), ~known, known & (ids == first[rng]))
        before = np.where(starts, (rng - 1) % len(kept), -1)
        return pd.DataFrame({"rng": rng.astype(np.int32), "before": before.astype(np.int32)})
    return place(F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNotNull())


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every row's text and edited text, and their likeness."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    q = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", q, max(10_000, 2 * ranges))).first()[0] if q else None
    bounds = np.array(sorted(set(found or [])), np.int64)
    # ranges that have rows, and the first id of each: one row per range
    every = np.arange(len(bounds) + 1)
    rng = _places(bounds, every, np.zeros(len(every), np.int64))["rng"]
    known = docs.select(rng.alias("rng"), "doc_id").groupBy("rng").agg(
        F.min("doc_id").alias("doc_id"), (F.count("*") > F.count("doc_id")).alias("nulls")).orderBy("rng").collect()
    kept = np.array([r["rng"] for r in known], np.int64)
    first = np.array([r["doc_id"] or 0 for r in known], np.int64)
    # the first id of each range (and so its rows) also ends the range before
    placed = docs.withColumn("at", _places(bounds, kept, first, bool(known and known[0]["nulls"])))
    sent = placed.select("doc_id", "text", F.explode(F.filter(F.array(
        F.struct(F.col("at.rng").alias("rng"), F.lit(0).alias("extra")),
        F.struct(F.col("at.before").alias("rng"), F.lit(1).alias("extra"))), lambda x: x["rng"] >= 0)).alias("to"))
    ranged = sent.select("to.rng", "to.extra", "doc_id", "text")
    return ranged.repartitionById(max(1, len(kept)), F.col("rng")).sortWithinPartitions(
        "rng", "extra", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(_in_order, RESULT)

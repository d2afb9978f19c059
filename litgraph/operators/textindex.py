"""Ranked search over a written inverted index (T1, W4 without a full pass).

``append_to_index`` splits documents once and adds their postings to a Parquet
table: a row is a *block*, up to ``BLOCK`` postings of one term as arrays of
document id, term frequency and document length, with the block's largest
frequency and smallest length beside them.  Blocks are made within batches of
documents and joined with their neighbours after the shuffle.  Rows are ranged and sorted by term
and frequency, so a hot term is spread over many tasks and files, and lie in
folders by a hash of the term (``shard``).  The empty term has a posting for
every document; the number of documents and the mean length come from it.

A search for the ``k`` best documents by BM25 reads blocks three times, each
time only those of its terms:

1. the numbers beside the arrays give document frequencies and, by the largest
   frequency and the smallest length, a bound for the score part of any posting
   of a block;
2. the arrays of the best blocks of each term give partial scores; the k-th
   largest is a bound that the k-th score cannot fall below;
3. a block is read if its bound, with the largest bounds of the other terms,
   reaches that.  A document in a skipped block cannot be among the k best,
   whatever its other terms give; what is left of its score stays below, too.

The result is the same as ``search_bm25`` over the indexed documents, ties
included.  For one topic, terms and bounds are literals that reach the scan
(shards, terms and frequencies); what the driver collects is a few rows a query
term.  A topic table is joined instead, with bounds per topic.

Documents must be new to the index when they are appended.  An append is one
write, so a failed one leaves the index as it was.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litgraph.operators.search import (
    B, DEFAULT_TOP_K, K1, _doc_text, _rank_order, check_top_k, scores_by_document, spaced_tokens, tokenize,
    topk_per_group)
from litgraph.session import materialize

BLOCK = 128
SHARDS = 64
_SLACK = 1e-7   # far above the rounding of scores, which ties depend on


def _shard(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHARDS)).cast("int")


_BLOCK_COLUMNS = ["n", "max_tf", "min_dl", "sum_dl", "ids", "tfs", "dls"]


def _blocks(group: np.ndarray, ids: pa.Array, tf: np.ndarray, dl: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Postings to blocks, each group (a term) by frequency: the group of each
    block, and its columns."""
    order = np.lexsort((dl, -tf, group))
    group, tf, dl = group[order], tf[order].astype(np.int32), dl[order].astype(np.int32)
    n = len(group)
    at = np.arange(n)
    into = at - np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], at, 0))
    cut = np.flatnonzero(into % BLOCK == 0)
    offsets = pa.array(np.append(cut, n), pa.int32())
    return group[cut], [
        pa.array(np.diff(np.append(cut, n)), pa.int64()), pa.array(np.maximum.reduceat(tf, cut)),
        pa.array(np.minimum.reduceat(dl, cut)), pa.array(np.add.reduceat(dl.astype(np.int64), cut)),
        *(pa.ListArray.from_arrays(offsets, x) for x in (ids.take(pa.array(order)), pa.array(tf), pa.array(dl)))]


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, spaced tokens) to the blocks of each batch of documents."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        split = pa.compute.split_pattern(batch.column(1), " ")
        flat, of = split.flatten(), pa.compute.list_parent_indices(split).to_numpy(zero_copy_only=False)
        full = pa.compute.not_equal(flat, "")
        words, of = flat.filter(full).dictionary_encode(), of[full.to_numpy(zero_copy_only=False)]
        dl = np.bincount(of, minlength=n)
        key = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + of
        key.sort()
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
        tf = np.diff(np.append(at, len(key)))
        word, row = np.divmod(key[at], n)
        # the empty term stands for the document itself
        word, row = np.append(word, np.full(n, len(words.dictionary))), np.append(row, np.arange(n))
        terms = pa.concat_arrays([words.dictionary, pa.array([""], words.dictionary.type)])
        of, columns = _blocks(word, batch.column(0).take(pa.array(row)), np.append(tf, np.ones(n, tf.dtype)), dl[row])
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(of)), *columns], names=["term", *_BLOCK_COLUMNS])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (shard, term, ...), sorted by term: those of one term are joined
    and cut anew, so that rare terms get few blocks."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        term = batch.column(1)
        new = np.ones(rows, bool)
        new[1:] = pa.compute.not_equal(term.slice(1), term.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        group = np.repeat(np.cumsum(new) - 1, batch.column(2).to_numpy(zero_copy_only=False))
        tf, dl = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (7, 8))
        of, columns = _blocks(group, batch.column(6).flatten(), tf, dl)
        heads = pa.array(first[of])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(heads), term.take(heads), *columns],
                                         names=["shard", "term", *_BLOCK_COLUMNS])


def append_to_index(docs: DataFrame, path: str, id_col: str = "uid",
                    text_cols: Sequence[str] = ("Title", "page_content")) -> None:
    """Write the documents' postings to the index at ``path``, beside those
    that are there.  Ids must be unique and new; null texts have no words.

    Texts are split once: each batch of documents becomes blocks, which are
    written, ranged and sorted by term, and joined with their neighbours."""
    toks = docs.select(F.col(id_col).alias("id"), spaced_tokens(_doc_text(docs, text_cols)).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    columns = ("term string, n long, max_tf int, min_dl int, sum_dl long, "
               f"ids array<{kind}>, tfs array<int>, dls array<int>")
    order = ["shard", "term", F.col("max_tf").desc(), "min_dl"]
    parts = materialize(toks.mapInArrow(_invert, columns).select(_shard(F.col("term")).alias("shard"), "*"), "blocks")
    blocks = parts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_merge, f"shard int, {columns}")
    # the order is stated again, for the writer to see that shards are in order
    blocks.sortWithinPartitions(*order).write.mode("append").partitionBy("shard").parquet(path)


def _part(tf: Column, dl: Column, avgdl: Column | float, k1: float, b: float) -> Column:
    """BM25 score part without the term's rarity; grows with tf, falls with dl."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def _each(blocks: DataFrame) -> DataFrame:
    """Postings of blocks; keeps the other columns."""
    others = [c for c in blocks.columns if c not in ("ids", "tfs", "dls")]
    return blocks.select(*others, F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select(
        *others, F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))


@dataclass
class TopicSearch:
    """What one topic's search needs, found from its terms' blocks."""

    blocks: DataFrame            # the index, blocks of the topic's terms only
    avgdl: float
    idf: dict[str, float]        # of the terms that occur
    most: dict[str, float]       # largest score part of each
    needed: float                # the k-th score is this at least
    k1: float
    b: float

    def could_matter(self) -> Column:
        """Whether a block can hold one of the k best documents."""
        total = sum(self.most.values())
        tests = []
        for term, idf in self.idf.items():
            part = (self.needed - _SLACK - (total - self.most[term])) / idf
            test = F.col("term") == term
            if part > 0:
                # no length makes up for a frequency below this one
                low = part * self.k1 * (1 - self.b) / (self.k1 + 1 - part) if part < self.k1 + 1 else math.inf
                bound = _part(F.col("max_tf"), F.col("min_dl"), self.avgdl, self.k1, self.b)
                test = test & (F.col("max_tf") >= math.ceil(min(low - 1e-9, 2**31 - 1))) & (bound >= part)
            tests.append(test)
        return reduce(lambda x, y: x | y, tests)

    def scores(self, blocks: DataFrame) -> DataFrame:
        """``(id, score)`` summed over the postings of some of the blocks."""
        rarity = F.create_map(*[F.lit(x) for pair in self.idf.items() for x in pair])
        part = rarity[F.col("term")] * _part(F.col("tf"), F.col("dl"), self.avgdl, self.k1, self.b)
        return _each(blocks.select("term", "ids", "tfs", "dls")).groupBy("id").agg(F.sum(part).alias("score"))


def prepare_search(spark: SparkSession, path: str, topic: str, k: int = DEFAULT_TOP_K,
                   k1: float = K1, b: float = B) -> TopicSearch | None:
    """Steps 1 and 2 for one topic; None if no term of it occurs."""
    check_top_k(k)
    terms = spark.range(1).select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(tokenize(F.lit(topic))))).alias("term"))
    known = [(r["term"], r["shard"]) for r in terms.select("term", _shard(F.col("term")).alias("shard")).collect()]
    blocks = spark.read.parquet(path).where(
        F.col("shard").isin(sorted({s for _, s in known})) & F.col("term").isin([t for t, _ in known]))
    totals = {r["term"]: r for r in blocks.groupBy("term").agg(F.sum("n").alias("n"), F.sum("sum_dl").alias("dl")).collect()}
    if len(totals) < 2:
        return None
    own = totals.pop("")
    avgdl = own["dl"] / own["n"]
    idf = {t: math.log(1 + (own["n"] - r["n"] + 0.5) / (r["n"] + 0.5)) for t, r in totals.items()}
    # the k best blocks of each term: at most k rows a term
    bound = _part(F.col("max_tf"), F.col("min_dl"), avgdl, k1, b)
    best = topk_per_group(blocks.where("term <> ''").select("term", "n", bound.alias("part")), ["term"],
                          [F.col("part").desc()], k).orderBy("rank").collect()
    most, floor, held = {}, {}, {}
    for r in best:
        t = r["term"]
        most.setdefault(t, idf[t] * r["part"])
        if held.get(t, 0) < k:
            held[t] = held.get(t, 0) + r["n"]
            floor[t] = r["part"]
    search = TopicSearch(blocks.where("term <> ''"), avgdl, idf, most, -math.inf, k1, b)
    first = reduce(lambda x, y: x | y, [(F.col("term") == t) & (bound >= f - 1e-12) for t, f in floor.items()])
    top = search.scores(blocks.where(first)).orderBy(F.col("score").desc()).limit(k).select("score").collect()
    if len(top) == k:
        search.needed = min(r["score"] for r in top)
    return search


def search_index(spark: SparkSession, path: str, topic: str, k: int = DEFAULT_TOP_K, id_col: str = "uid",
                 k1: float = K1, b: float = B) -> DataFrame:
    """T1 over the index: ``(<id_col>, score, rank)`` of the ``k`` best."""
    search = prepare_search(spark, path, topic, k, k1, b)
    if search is None:
        kind = spark.read.parquet(path).schema["ids"].dataType.elementType
        return spark.createDataFrame([], T.StructType([
            T.StructField(id_col, kind), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    scores = search.scores(search.blocks.where(search.could_matter())).withColumnRenamed("id", id_col)
    top = scores.orderBy(*_rank_order(id_col)).limit(k)
    return top.select(id_col, "score", F.row_number().over(Window.orderBy(*_rank_order(id_col))).alias("rank"))


def search_index_per_topic(index: DataFrame, topics: DataFrame, k: int = DEFAULT_TOP_K, topic_id: str = "topic_id",
                           topic_text: str = "topic", id_col: str = "uid", k1: float = K1, b: float = B) -> DataFrame:
    """W4 over the index (the table that was written): the ``k`` best documents
    for every topic of a table, by joins with its terms."""
    check_top_k(k)
    own = index.where((F.col("shard") == _shard(F.lit(""))) & (F.col("term") == ""))
    stats = own.select(F.struct(F.sum("n").cast("double").alias("n"), (F.sum("sum_dl") / F.sum("n")).alias("avgdl"))).scalar()
    bound = _part(F.col("max_tf"), F.col("min_dl"), stats.getField("avgdl"), k1, b)
    wanted = topics.select(F.col(topic_id).alias("qid"), F.explode(F.array_distinct(tokenize(F.col(topic_text)))).alias("term"))
    wanted = materialize(wanted.distinct().withColumn("shard", _shard(F.col("term"))), "wanted")
    vocab = wanted.select("shard", "term").distinct()
    # 1: a row a term
    heads = materialize(index.join(vocab, ["shard", "term"], "left_semi").select("shard", "term", "n", bound.alias("part")), "heads")
    terms = heads.groupBy("shard", "term").agg(F.sum("n").alias("df"), F.max("part").alias("most"))
    before = F.sum("n").over(Window.partitionBy("shard", "term").orderBy(F.col("part").desc())
                             .rowsBetween(Window.unboundedPreceding, -1))
    floors = (topk_per_group(heads, ["shard", "term"], [F.col("part").desc()], k).withColumn("held", F.coalesce(before, F.lit(0)))
              .where(F.col("held") < k).groupBy("shard", "term").agg(F.min("part").alias("floor")))
    idf = _idf(stats.getField("n"), F.col("df"))
    rest = F.sum(F.col("idf") * F.col("most")).over(Window.partitionBy("qid")) - F.col("idf") * F.col("most")
    asked = materialize(wanted.join(terms, ["shard", "term"]).join(floors, ["shard", "term"])
                        .select("qid", "shard", "term", "most", "floor", idf.alias("idf")).withColumn("rest", rest), "asked")
    part = F.col("idf") * _part(F.col("tf"), F.col("dl"), stats.getField("avgdl"), k1, b)

    def scored(asked: DataFrame, least: Column, keep: Column) -> DataFrame:
        """Scores by the blocks whose bound is ``least`` for a topic; a block's
        postings are dealt out once, whatever the number of its topics."""
        limits = materialize(asked.groupBy("shard", "term").agg(F.min(least).alias("least"), F.count("*").alias("topics")), "limits")
        pairs = heads.join(limits, ["shard", "term"]).where("part >= least").agg(F.sum(F.col("n") * F.col("topics"))).first()[0]
        blocks = index.join(limits, ["shard", "term"]).withColumn("bound", bound).where("bound >= least")
        postings = _each(blocks.select("term", "bound", "ids", "tfs", "dls"))
        return scores_by_document(postings, asked.drop("shard"), part, pairs or 0, "id", keep)
    # 2: a bound a topic
    some = scored(asked, F.col("floor") - 1e-12, F.lit(True))
    partial = topk_per_group(some, ["qid"], [F.col("score").desc()], k)
    needed = materialize(partial.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("needed")), "needed")
    # 3
    asked = materialize(asked.join(needed, "qid"), "asked")
    found = scored(asked, (F.col("needed") - _SLACK - F.col("rest")) / F.col("idf") - _SLACK,
                   F.col("idf") * F.col("bound") + F.col("rest") >= F.col("needed") - _SLACK).withColumnRenamed("id", id_col)
    ranked = topk_per_group(found, ["qid"], _rank_order(id_col), k)
    return ranked.select(F.col("qid").alias(topic_id), id_col, "score", "rank")

"""Ranked and boolean literature search (T1, W4, P10-P13) and query
composition (R1, R2).

BM25 (Okapi, k1 = 1.2, b = 0.75) is computed relationally:

    tokens  = "" + split(lower(text), non-word)       per document, map side
    tf      = explode(tokens) ⋈ query vocabulary, ""  semi join, map side
              groupBy(doc, term).count()              partial agg, one shuffle
    df      = groupBy(term).count() over tf           tiny
    N, avgdl= aggregate over the rows of "" in tf     scalar subquery
    score   = Σ idf · tf·(k1+1) / (tf + k1·(1 − b + b·dl/avgdl))

The empty term stands for the document itself, so all statistics come from the
one ``tf`` shuffle, which Spark reuses: the documents are read and split once.
Only it and tokens that are query terms leave the scan stage, so the shuffle
grows with documents and matches, not with the texts.  Ranks order by score rounded to
9 decimals (so that equal documents tie exactly whatever the summation order)
and then by id.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgraph.functions.predicates import DEFAULT_FIELDS, boolean_predicate, parse_term
from litgraph.session import materialize

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
K1 = 1.2
B = 0.75
RANK_DIGITS = 9
DEFAULT_TOP_K = 3          # the reference's default; its UI allows 3-30
PAIRS = 1_000_000          # (posting, topic) pairs of a task, about


def tokenize(text) -> Column:
    """Lower-cased word tokens (letters and digits), empty ones dropped."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(c), TOKEN_SPLIT), "")


def spaced_tokens(text: Column) -> Column:
    """The tokens of ``tokenize`` as one text, a blank between them (one may
    also stand at either end): half the work of an array of them."""
    return F.regexp_replace(F.lower(text), TOKEN_SPLIT, " ")


def check_top_k(k: int, upper: int | None = None) -> int:
    """The UI allows 3-30.  The library keeps the lower bound and lets
    callers lift the upper one (``upper=None``)."""
    if k < 1 or (upper is not None and k > upper):
        raise ValueError(f"top_k must be in [1, {upper}]" if upper else "top_k must be >= 1")
    return k


def _doc_text(docs: DataFrame, text_cols: Sequence[str]) -> Column:
    return F.concat_ws(" ", *[F.col(c) for c in text_cols])


def term_counts(docs: DataFrame, terms: DataFrame, id_col: str, text_cols: Sequence[str]) -> DataFrame:
    """``(_id, dl, term, tf)`` of the documents' words that are in ``terms``,
    and of one empty term per document."""
    toks = docs.select(F.col(id_col).alias("_id"), tokenize(_doc_text(docs, text_cols)).alias("_t"))
    own = docs.sparkSession.range(1).select(F.lit("").alias("term"))
    vocab = terms.select("term").union(own).distinct()
    return (toks.select("_id", F.size("_t").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "_t")).alias("term"))
            .join(vocab, "term", "left_semi")
            .groupBy("_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))


def _weights(tf: DataFrame, k1: float, b: float) -> tuple[DataFrame, Column]:
    """``(term, df, idf)``, and the score part of a row of ``tf`` with its idf."""
    rows = F.when(F.col("term") == "", F.col("tf"))
    stats = tf.select(F.struct(F.sum(rows).cast("double").alias("n"),
                               (F.sum(rows * F.col("dl")) / F.sum(rows)).alias("avgdl"))).scalar()
    n_docs, avgdl = stats.getField("n"), stats.getField("avgdl")
    idf = tf.groupBy("term").agg(F.count(F.when(F.col("tf") > 0, F.lit(1))).alias("df")).select(
        "term", "df", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (
        F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return idf, weight


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str = "uid",
                text_cols: Sequence[str] = ("Title", "page_content"),
                k1: float = K1, b: float = B) -> DataFrame:
    """Score every (query, document) pair that shares at least one term.

    ``queries``: ``(qid, term)`` rows, one per distinct query term.
    Returns ``(qid, <id_col>, score)``.
    """
    tf = term_counts(docs, queries, id_col, text_cols)
    # Each reader of tf uses all its columns and filters none of them, so that
    # the plans below stay equal and the shuffle is reused.
    idf, weight = _weights(tf, k1, b)
    scored = tf.join(idf.drop("df"), "term").join(queries.select("qid", "term").distinct(), "term")
    return scored.groupBy("qid", "_id").agg(F.sum(weight).alias("score")).withColumnRenamed("_id", id_col)


def topk_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
                   rank_col: str = "rank") -> DataFrame:
    """Top-k rows per group.  Spark limits each group to k rows in every map
    task before the shuffle (WindowGroupLimit), so a hot group's task gets k
    rows from each of them."""
    rank = F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order))
    return df.withColumn(rank_col, rank).filter(F.col(rank_col) <= k)


def scores_by_document(postings: DataFrame, asked: DataFrame, part: Column, pairs: int, id_col: str,
                       keep: Column | None = None) -> DataFrame:
    """``(qid, <id_col>, score)``: the sums of ``part`` over the rows of
    ``postings`` (``<id_col>, term``, ...) joined to ``asked`` (``qid, term``,
    ...) on the term.

    Postings are dealt out by document, each once, to as many tasks as ``pairs``
    (the number of joined rows, about) needs.  Where Spark can broadcast the
    topics' terms, pairs are made and summed within a task and never shuffled,
    and a limit per topic leaves few rows of each task."""
    placed = postings.repartition(max(1, math.ceil(pairs / PAIRS)), id_col)
    both = placed.join(asked, "term")
    both = both if keep is None else both.where(keep)
    return both.groupBy("qid", id_col).agg(F.sum(part).alias("score"))


def _rank_order(id_col: str) -> list[Column]:
    return [F.round("score", RANK_DIGITS).desc(), F.col(id_col).asc()]


def search_bm25(docs: DataFrame, topic: str, k: int = DEFAULT_TOP_K, id_col: str = "uid",
                text_cols: Sequence[str] = ("Title", "page_content")) -> DataFrame:
    """The ``k`` best documents for one topic text (rank 1 = best).
    Planned as TakeOrderedAndProject: per-partition top-k, then a merge."""
    check_top_k(k)
    spark = docs.sparkSession
    q = spark.range(1).select(F.lit(0).alias("qid"), F.explode(F.array_distinct(tokenize(F.lit(topic)))).alias("term"))
    scores = bm25_scores(docs, q, id_col, text_cols)
    top = scores.orderBy(*_rank_order(id_col)).limit(k)
    return top.select(id_col, "score", F.row_number().over(Window.orderBy(*_rank_order(id_col))).alias("rank"))


def search_bm25_per_topic(docs: DataFrame, topics: DataFrame, k: int = DEFAULT_TOP_K,
                          topic_id: str = "topic_id", topic_text: str = "topic",
                          id_col: str = "uid", text_cols: Sequence[str] = ("Title", "page_content")) -> DataFrame:
    """Top-k documents for every topic of a topic table (whole topic
    texts are the queries)."""
    check_top_k(k)
    q = materialize(topics.select(F.col(topic_id).alias("qid"),
                                  F.explode(F.array_distinct(tokenize(F.col(topic_text)))).alias("term")).distinct(), "asked")
    tf = materialize(term_counts(docs, q, id_col, text_cols), "tf")
    idf, weight = _weights(tf, K1, B)
    asked = materialize(q.join(idf, "term"), "weights")
    pairs = asked.agg(F.sum("df")).first()[0] or 0
    scores = scores_by_document(tf.where("term <> ''"), asked, weight, pairs, "_id").withColumnRenamed("_id", id_col)
    ranked = topk_per_group(scores, ["qid"], _rank_order(id_col), k)
    return ranked.select(F.col("qid").alias(topic_id), id_col, "score", "rank")


def boolean_search(docs: DataFrame, groups: Sequence[Sequence[str]], exclude: Sequence[str] = (),
                   fields: Mapping[str, Sequence[str]] = DEFAULT_FIELDS) -> DataFrame:
    """Documents matching ``(g1 OR ...) AND (g2 OR ...) NOT (x ...)``.
    Array columns (keyword lists such as MeSH headings) match per element."""
    from pyspark.sql.types import ArrayType
    arrays = [f.name for f in docs.schema.fields if isinstance(f.dataType, ArrayType)]
    return docs.filter(boolean_predicate(groups, exclude, fields, available=docs.columns, array_cols=arrays))


def search_composed(docs: DataFrame, groups: Sequence[Sequence[str]], exclude: Sequence[str] = (),
                    k: int = DEFAULT_TOP_K, id_col: str = "uid",
                    text_cols: Sequence[str] = ("Title", "page_content"),
                    fields: Mapping[str, Sequence[str]] = DEFAULT_FIELDS) -> DataFrame:
    """A composed query (R1) run as a search: documents that match its term
    groups (P10-P13), the ``k`` best by BM25 over the words of its terms.
    Operators, field tags and excluded terms are not scored, nor are truncated
    or wildcard terms, which only filter.  Returns ``(<id_col>, score, rank)``."""
    check_top_k(k)
    specs = [parse_term(t).text for g in groups for t in g]
    words = " ".join(s for s in specs if not set("*?") & set(s))
    q = docs.sparkSession.range(1).select(
        F.lit(0).alias("qid"), F.explode(F.array_distinct(tokenize(F.lit(words)))).alias("term"))
    scores = bm25_scores(docs, q, id_col, text_cols).select(id_col, "score")
    found = boolean_search(docs, groups, exclude, fields).select(id_col).join(scores, id_col, "left")
    top = found.fillna(0.0, ["score"]).orderBy(*_rank_order(id_col)).limit(k)
    return top.select(id_col, "score", F.row_number().over(Window.orderBy(*_rank_order(id_col))).alias("rank"))


# ---------------------------------------------------------------- query composition

# Term kinds of the composed query: tiab -> term[Title/Abstract],
# mesh -> "term"[Mesh] (lower case), all -> term[All Fields].
def _formatted_term(term: Column, kind: Column) -> Column:
    quoted = F.when(F.contains(term, F.lit(" ")), F.concat(F.lit('"'), term, F.lit('"'))).otherwise(term)
    return (F.when(kind == "mesh", F.concat(F.lit('"'), F.lower(term), F.lit('"[Mesh]')))
            .when(kind == "all", F.concat(quoted, F.lit("[All Fields]")))
            .otherwise(F.concat(quoted, F.lit("[Title/Abstract]"))))


def compose_query(terms: DataFrame) -> DataFrame:
    """``(topic, concept_pos, term_pos, term, kind)`` -> one boolean query
    text per topic: terms of a concept OR-ed in parentheses, concepts AND-ed,
    the whole in one more pair of parentheses.  ``kind``: tiab | mesh | all."""
    concept = terms.groupBy("topic", "concept_pos").agg(
        F.array_sort(F.collect_list(F.struct("term_pos", _formatted_term(F.col("term"), F.col("kind")).alias("t"))))
        .alias("_ts"))
    concept = concept.select("topic", "concept_pos", F.concat(
        F.lit("("), F.array_join(F.transform("_ts", lambda x: x["t"]), " OR "), F.lit(")")).alias("_c"))
    return concept.groupBy("topic").agg(
        F.array_sort(F.collect_list(F.struct("concept_pos", "_c"))).alias("_cs"),
        F.count(F.lit(1)).alias("n_concepts"),
    ).select("topic", F.concat(F.lit("("), F.array_join(F.transform("_cs", lambda x: x["_c"]), " AND "),
                               F.lit(")")).alias("query"), "n_concepts")


def expand_synonyms(topics: DataFrame, thesaurus: DataFrame, topic_col: str = "topic") -> DataFrame:
    """R2: every distinct word of a topic is a concept; its terms are the word
    itself (``tiab``) and its thesaurus synonyms (``all``).  Output rows
    ``(topic, concept_pos, term_pos, term, kind)`` feed ``compose_query``.

    The thesaurus is joined, not broadcast blindly: Spark / AQE picks the
    strategy from its size.
    """
    words = topics.select(F.col(topic_col).alias("topic"),
                          F.posexplode(F.array_distinct(tokenize(F.col(topic_col)))).alias("_p", "word"))
    words = words.select("topic", (F.col("_p") + 1).alias("concept_pos"), "word")
    syn = thesaurus.select(F.lower("term").alias("word"), F.lower("synonym").alias("term")).distinct()
    expanded = words.join(syn, "word", "left").filter(F.col("term").isNotNull() & (F.col("term") != F.col("word")))
    own = words.select("topic", "concept_pos", F.col("word").alias("term"), F.lit("tiab").alias("kind"),
                       F.lit(0).alias("_o"))
    others = expanded.select("topic", "concept_pos", "term", F.lit("all").alias("kind"), F.lit(1).alias("_o"))
    both = own.unionByName(others)
    w = Window.partitionBy("topic", "concept_pos").orderBy("_o", "term")
    return both.select("topic", "concept_pos", F.row_number().over(w).alias("term_pos"), "term", "kind")


def expand_phrases(topics: DataFrame, thesaurus: DataFrame, topic_col: str = "topic") -> DataFrame:
    """R2 with thesaurus entries of several words: a topic is covered from left
    to right by the longest entry that begins at each place, or the word there;
    what covers it are its concepts (each once), with their synonyms.  Output as
    ``expand_synonyms``.

    Entries and topics are compared by their words.  Every run of words of a
    topic, up to the longest entry's number, is joined to the entries; the cover
    is folded over a topic's matches in order.  Topics are dealt out once: the
    entries are a written table, a row a phrase, so where Spark can broadcast it
    all later steps stay in the tasks that hold the topic.
    """
    def phrase(words: Column) -> Column:
        return F.array_join(words, " ")
    entries = thesaurus.select(phrase(tokenize("term")).alias("phrase"), F.size(tokenize("term")).alias("_n"),
                               F.lower("synonym").alias("synonym")).where("_n > 0")
    entries = materialize(entries.groupBy("phrase").agg(
        F.max("_n").alias("_n"), F.array_sort(F.collect_set("synonym")).alias("_s")), "entries")
    longest = entries.agg(F.max("_n")).first()[0] or 1
    words = topics.select(F.col(topic_col).alias("topic")).distinct().select("topic", tokenize("topic").alias("_t")).where(F.size("_t") > 0)
    starts = words.select("topic", "_t", F.explode(F.sequence(F.lit(0), F.size("_t") - 1)).alias("start"))
    runs = starts.select("topic", "start", "_t", F.explode(F.sequence(
        F.lit(1), F.least(F.lit(longest), F.size("_t") - F.col("start")))).alias("len"))
    runs = runs.select("topic", "start", "len", phrase(F.slice("_t", F.col("start") + 1, F.col("len"))).alias("phrase"))
    known = entries.select("phrase", F.lit(True).alias("_known"))
    hits = runs.join(known, "phrase", "left").where(F.col("_known") | (F.col("len") == 1))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,phrase:string>>").alias("kept"))

    def cover(done: Column, hit: Column) -> Column:
        longer = F.struct((hit["start"] - hit["shorter"]).alias("end"),
                          F.array_append(done["kept"], F.struct(hit["start"].alias("start"), hit["phrase"].alias("phrase"))).alias("kept"))
        return F.when(hit["start"] >= done["end"], longer).otherwise(done)
    # longest first among those that begin at one place
    found = hits.groupBy("topic").agg(F.array_sort(F.collect_list(
        F.struct("start", (-F.col("len")).alias("shorter"), "phrase"))).alias("_h"))
    covered = found.select("topic", F.explode(F.aggregate("_h", none, cover)["kept"]).alias("c"))
    first = covered.groupBy("topic", F.col("c.phrase").alias("phrase")).agg(F.min("c.start").alias("start"))
    concepts = first.withColumn("concept_pos", F.row_number().over(Window.partitionBy("topic").orderBy("start")))
    named = concepts.join(entries.select("phrase", "_s"), "phrase", "left")
    term = lambda t, kind: F.struct(t.alias("term"), F.lit(kind).alias("kind"))
    others = F.filter(F.coalesce("_s", F.array().cast("array<string>")), lambda s: s != F.col("phrase"))
    terms = F.concat(F.array(term(F.col("phrase"), "tiab")), F.transform(others, lambda s: term(s, "all")))
    return named.select("topic", "concept_pos", F.posexplode(terms).alias("_i", "x")).select(
        "topic", "concept_pos", (F.col("_i") + 1).alias("term_pos"), "x.term", "x.kind")


def concept_groups(terms: DataFrame) -> DataFrame:
    """R2 -> P10: ``(topic, concept_pos, terms array)`` for boolean search."""
    return terms.groupBy("topic", "concept_pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("term_pos", "term"))), lambda x: x["term"]).alias("terms"))


__all__ = ["tokenize", "bm25_scores", "search_bm25", "search_bm25_per_topic", "boolean_search", "search_composed",
           "compose_query", "expand_synonyms", "expand_phrases", "concept_groups", "topk_per_group", "parse_term",
           "check_top_k"]

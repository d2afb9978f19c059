"""Operator 9: quality rules, with DataFrame functions only.

The verdict is a hashed n-gram log-likelihood ratio.  N-grams are the lower-
case words (n = 1) and the pairs of neighbouring word endings of three
characters (n = 2), each hashed into ``BUCKETS`` buckets.  Two multinomials
are counted: the raw corpus, over all documents, and the trusted target, over
all documents labelled good but those held out.  A document's score is the
mean over its n-grams of log P(target) - log P(raw), so length does not
matter.

Every document is kept or dropped by one threshold: the score that
``KEEP`` of the trusted documents reach which were held out of the target
counts.  It depends on the data alone.

Base measures (see ``measure``) fail documents that are very short or repeat
themselves.

Defined results: null or empty texts have 0 words and fail the base rules.
Without trusted documents the verdict is given by the base rules alone.  Rows
with null ids are raw corpus only; repeated rows count as often as they
stand.  Null labels are ignored.  Other columns are ignored.  An empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgraph.llm.common import materialize, numbered

BUCKETS = 1 << 13
#: Words of 64 bits of the filter of trusted ids: 2 MB, whatever the input.
FILTER_WORDS = 1 << 18
KEEP = 0.995
SMOOTH = 1.0
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c))
    return text


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


def with_words(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "words", words_of(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))


NONE = "cast(array() as array<bigint>)"


def measure(rows: DataFrame) -> DataFrame:
    """Rows of ``with_words`` with the base measures.

    Repeated words: the hashes of a text's 3-word windows are compared as an
    array.  Only if some are equal, they are sorted together with their places
    (hash bits above, place below); the places of equal neighbours, in order,
    tell how many words they cover.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(_without(x, SPACES)) > 0)
    steps = {
        "word_chars": F.length(_without(F.col("text"), SPACES)).cast("long"),
        "n_symbols": (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long"),
        "lines": lines,
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "windows": F.expr(f"""CASE WHEN n_words >= 3 THEN transform(sequence(0, size(words) - 3),
            i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE {NONE} END"""),
        "bits": F.expr("cast(ceil(log2(n_words + 1)) as int)"),
        "placed": F.expr(f"""CASE WHEN size(array_distinct(windows)) < size(windows) THEN
            sort_array(transform(windows, (h, i) -> shiftleft(h, bits) | cast(i as bigint))) ELSE {NONE} END"""),
        "places": F.expr("""sort_array(transform(filter(placed, (x, i) ->
            (i > 0 AND shiftright(x, bits) = shiftright(placed[i - 1], bits)) OR
            (i < size(placed) - 1 AND shiftright(x, bits) = shiftright(placed[i + 1], bits))),
            x -> x & (shiftleft(1L, bits) - 1)))"""),
        "n_repeat_words": F.expr("""CASE WHEN size(placed) = 0 THEN 0L ELSE aggregate(places,
            struct(-3L AS last, 0L AS n), (a, x) -> struct(x AS last, a.n + least(3L, x - a.last) AS n), a -> a.n)
            END"""),
    }
    for name, column in steps.items():
        rows = rows.withColumn(name, column)
    return rows


def _grams(words: str) -> str:
    """Buckets of a text's words, then of its pairs of neighbouring word endings."""
    return f"""concat(
        transform({words}, w -> pmod(xxhash64(lower(w)), {BUCKETS}L)),
        CASE WHEN size({words}) >= 2 THEN transform(sequence(0, size({words}) - 2), i -> {BUCKETS}L + pmod(xxhash64(
            substring({words}[i], -3, 3), substring({words}[i + 1], -3, 3)), {BUCKETS}L)) ELSE {NONE} END)"""


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``(doc_id, held)`` of all trusted documents; a quarter is held out of the
    target counts."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
            .where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
            .where("q = 1").select("doc_id", (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0).alias("held")))


def _place(doc_id: Column) -> tuple[Column, Column]:
    """Word and bit of an id in the filter."""
    h = F.xxhash64(F.lit("filter"), doc_id)
    return F.pmod(h, F.lit(FILTER_WORDS)), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")


def marked(rows: DataFrame, target: DataFrame) -> DataFrame:
    """``(t, text)`` per row: t is 1 for the ids in ``target`` (each once), else 0.

    A bitmap of fixed size, with a bit set for each id, goes to all tasks.  Rows
    whose bit is not set are surely not in the target and stay where they are;
    the texts of the others are dealt out by id and joined, at any size."""
    word, bit = _place(F.col("doc_id"))
    own = target.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("x"))
    every = target.sparkSession.range(FILTER_WORDS).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("x"))
    bits = materialize(own.union(every).groupBy("w").agg(F.bit_or("x").alias("bits")), "filter")
    placed = rows.select("doc_id", "text", word.alias("w"), bit.alias("b")).join(F.broadcast(bits), "w")
    maybe = F.getbit("bits", F.col("b")) == 1
    found = placed.where(maybe).select("doc_id", "text").join(
        target.select("doc_id", F.lit(1).alias("t")).hint("merge"), "doc_id", "left")
    return placed.where(~maybe).select(F.lit(0).alias("t"), "text").union(
        found.select(F.coalesce("t", F.lit(0)).alias("t"), "text"))


def weights(rows: DataFrame, trusted: DataFrame) -> list[float] | None:
    """log P(target) - log P(raw) of each bucket; None without a target."""
    each = marked(rows, trusted.where("not held").select("doc_id")).withColumn("words", words_of(F.col("text")))
    grams = each.select("t", F.explode(F.expr(_grams("words"))).alias("b"))
    got = grams.groupBy("b").agg(F.count("*").alias("r"), F.sum("t").alias("t")).collect()  # 2 * BUCKETS at most
    raw, good = [0] * (2 * BUCKETS), [0] * (2 * BUCKETS)
    for x in got:
        raw[x["b"]], good[x["b"]] = x["r"], x["t"]
    if not sum(good):
        return None
    out = []
    for half in (0, BUCKETS):
        r, t = raw[half:half + BUCKETS], good[half:half + BUCKETS]
        n, m = sum(r) + SMOOTH * BUCKETS, sum(t) + SMOOTH * BUCKETS
        out += [round(math.log((b + SMOOTH) / m) - math.log((a + SMOOTH) / n), 4) for a, b in zip(r, t, strict=True)]
    return out


def with_score(rows: DataFrame, table: list[float] | None) -> DataFrame:
    """Rows with ``score``, the mean weight of their n-grams (null: no target)."""
    if table is None:
        return rows.withColumn("score", F.lit(None).cast("double"))
    # one constant array, folded before the plan runs
    text = ",".join(f"{x:g}" for x in table)
    total = F.expr(f"""aggregate({_grams('words')}, 0D, (a, b) -> a
        + element_at(cast(split('{text}', ',') as array<double>), cast(b + 1 as int)))""")
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    return rows.withColumn("score", F.round(total / n, 9))


def exact_percentile(scores: DataFrame, share: float) -> float | None:
    """The percentile of all ``score`` values, between neighbours by their
    distance; values are ranged over tasks, two of them reach the driver."""
    ranked = numbered(scores, F.col("score"))
    n = ranked.count()
    if not n:
        return None
    at = share * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    ends = {r["n"]: r["score"] for r in ranked.where(F.col("n").isin(low + 1, high + 1)).select("n", "score").collect()}
    return ends[low + 1] if low == high else (high - at) * ends[low + 1] + (at - low) * ends[high + 1]


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_words``, base measures, ``base_failed, kept, score`` per row."""
    rows = with_words(docs)
    trusted = materialize(trusted_ids(labels), "trusted")
    scored = materialize(with_score(measure(rows), weights(rows, trusted)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"), "quality")
    held = scored.join(trusted.where("held"), "doc_id").where("score is not null and n_words > 0")
    limit = exact_percentile(held.select("score"), 1 - KEEP)
    good = F.lit(True) if limit is None else F.coalesce(F.col("score") >= F.lit(float(limit)), F.lit(True))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & good).alias("kept"), "score")

"""Many composed queries run at once (R1, M2 as a search).

The queries are a table of terms ``(topic, concept_pos, term_pos, term, kind)``,
what ``expand_synonyms`` and ``expand_phrases`` give and ``compose_query`` writes
as text: terms of a concept are alternatives, all concepts must be met.  A
paper is found for a topic if ``boolean_search`` with the topic's term groups
would find it.

A pass over the documents per topic is not needed.  Every term is keyed by its
rarest word, and every topic by its concept of the fewest papers: only papers
that hold a key word of that concept are looked at, once for each topic, and
only they are matched with the patterns of all concepts.  Topics go by a number;
papers asked for are joined to their texts first and to the patterns, of which
there is a row a topic, last, so nothing that is broadcast holds patterns or
topic texts once for every paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgraph.functions.predicates import NON_WORD
from litgraph.operators.graph import dense_ids
from litgraph.operators.search import tokenize
from litgraph.session import materialize

# Columns that the kinds of terms are looked up in; ``mesh`` is an array of keywords.
FIELDS = {"tiab": ("Title", "page_content"), "all": ("Title", "page_content", "Published")}


def _pattern(term: Column) -> Column:
    """Words of the term in this order, with anything but words between."""
    words = F.filter(F.split(F.lower(term), r"\s+"), lambda w: w != "")
    escaped = F.transform(words, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1"))
    return F.array_join(escaped, f"{NON_WORD}+")


def _alternatives(kind: str) -> Column:
    """One pattern of a concept's terms of a kind; null if it has none."""
    found = F.array_sort(F.collect_set(F.when(F.col("kind") == kind, _pattern(F.col("term")))))
    return F.when(F.size(found) > 0, F.concat(
        F.lit(f"(^|{NON_WORD})("), F.array_join(found, "|"), F.lit(f")({NON_WORD}|$)")))


def search_query_table(docs: DataFrame, terms: DataFrame, id_col: str = "uid") -> DataFrame:
    """``(topic, <id_col>)`` of the papers that each topic's query finds.

    ``kind``: ``tiab`` (also null or unknown ones), ``all``, or ``mesh`` (whole
    words of an element of the array column ``mesh``; without that column such
    a term finds nothing).  Terms without a letter or digit are left out; a
    concept that has no other finds nothing.  Ids must be unique.
    """
    has_mesh = "mesh" in docs.columns
    kind = F.when(F.col("kind").isin("all", "mesh"), F.col("kind")).otherwise("tiab")
    terms = materialize(terms.select("topic", "concept_pos", "term", kind.alias("kind"), F.array_distinct(tokenize("term")).alias("words"))
                        .where("topic is not null").distinct(), "terms")
    topics = materialize(dense_ids(terms.select("topic").distinct(), "topic", "n"), "topics")
    terms = materialize(terms.join(topics, "topic").drop("topic"), "numbered")
    usable = terms.where(F.size("words") > 0)
    usable = usable if has_mesh else usable.where("kind <> 'mesh'")
    parts = [F.col(c).cast("string") for c in FIELDS["all"] if c in docs.columns]
    parts += [F.array_join("mesh", " ")] if has_mesh else []
    vocab = usable.select(F.explode("words").alias("word")).distinct()
    # the only pass over the texts: words of queries and the papers that hold them
    held = materialize(docs.select(id_col, F.explode(F.array_distinct(tokenize(F.concat_ws(" ", *parts)))).alias("word"))
                       .join(vocab, "word", "left_semi"), "held")
    df = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    worded = usable.select("n", "concept_pos", "term", "kind", F.explode("words").alias("word")).join(df, "word", "left").select(
        "n", "concept_pos", "term", "kind", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word").alias("key"))
    keyed = worded.groupBy("n", "concept_pos", "term", "kind").agg(F.min("key").alias("key"))
    # a topic with a concept that has no usable term finds nothing
    concepts = terms.select("n", "concept_pos").distinct().join(
        keyed.groupBy("n", "concept_pos").agg(F.sum("key.df").alias("papers"), F.collect_set("key.word").alias("keys")),
        ["n", "concept_pos"], "left").fillna(0, ["papers"])
    first = F.row_number().over(Window.partitionBy("n").orderBy("papers", "concept_pos"))
    rarest = concepts.withColumn("_first", first).where("_first = 1 and papers > 0").select("n", F.explode("keys").alias("word"))
    asked = materialize(rarest.join(held, "word").select("n", id_col).distinct(), "asked")
    patterns = (usable.groupBy("n", "concept_pos").agg(*[_alternatives(k).alias(k) for k in ("tiab", "all", "mesh")])
                .groupBy("n").agg(F.collect_list(F.struct("tiab", "all", "mesh")).alias("concepts")))
    texts = docs.select(id_col, *[F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols if c in docs.columns])).alias(f"_{k}")
                                  for k, cols in FIELDS.items()], *([F.col("mesh").alias("_mesh")] if has_mesh else []))

    def met(c: Column) -> Column:
        hits = [c[k].isNotNull() & F.rlike(F.col(f"_{k}"), c[k]) for k in FIELDS]
        if has_mesh:
            hits.append(c["mesh"].isNotNull() & F.coalesce(F.exists("_mesh", lambda x: F.rlike(F.lower(x), c["mesh"])), F.lit(False)))
        out = hits[0]
        for h in hits[1:]:
            out = out | h
        return out
    found = asked.join(texts, id_col).join(patterns, "n").where(F.forall("concepts", met)).select("n", id_col)
    return found.join(topics, "n").select("topic", id_col)

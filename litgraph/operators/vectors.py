"""Text embeddings (V1).

The default is exact sparse TF-IDF: one row per document and term, no limit on
the number of terms (``tfidf_rows``).  Any other model can be plugged in as a
function ``pandas.Series[str] -> pandas.Series[list]``; it then runs as an
Arrow-batched pandas UDF, one batch of texts at a time.  ``embed_tfidf`` folds
TF-IDF into dense vectors of a width that the caller names.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litgraph.operators.search import TOKEN_SPLIT, tokenize
from litgraph.session import materialize


def _dealt_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, _t)``: tokens of texts dealt out by id, so that whatever is then
    grouped by the id (and more) needs no other shuffle."""
    dealt = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).repartition("_id")
    return dealt.select("_id", tokenize("_t").alias("_t"))


def tfidf_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Exact TF-IDF vectors of unit length as rows ``(<id_col>, term, weight)``;
    tokens as in search, ``idf = ln((n + 1) / (df + 1))``.

    Terms that stand in every document have weight 0 and no row, so a document
    of such terms only, or without a token, has none either.  Ids are unique.

    Texts are dealt out by id, to count terms and to weigh them.  Rarities are a written table, a
    row a term: where Spark can broadcast it, terms are weighed and lengths
    added up in the tasks that hold the document.
    """
    tf = (_dealt_tokens(df, id_col, text_col).select("_id", F.explode("_t").alias("term"))
          .groupBy("_id", "term").agg(F.count(F.lit(1)).alias("_tf")))
    n_docs = df.select(F.count(F.lit(1)).cast("double")).scalar()
    idf = materialize(tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).select(
        "term", F.log((n_docs + 1) / (F.col("_df") + 1)).alias("_idf")), "idf")
    raw = tf.join(idf, "term").withColumn("_w", F.col("_tf") * F.col("_idf")).where(F.col("_w") > 0)
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("_id")))
    return raw.select(F.col("_id").alias(id_col), "term", (F.col("_w") / length).alias("weight"))


def embed_tfidf(df: DataFrame, text_col: str, out_col: str = "embedding", *,
                num_features: int, min_doc_freq: int = 0) -> DataFrame:
    """TF-IDF folded by hash into ``num_features`` dense places (unit length,
    ``array<float>``): terms that meet in a place are added, so similarities
    are approximate.  ``tfidf_rows`` is the exact form."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_SPLIT, gaps=True, toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=min_doc_freq),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ]
    model = Pipeline(stages=stages).fit(df)
    out = model.transform(df)
    return out.withColumn(out_col, vector_to_array("_unit", "float32")).drop("_tok", "_tf", "_tfidf", "_unit")


def embed_with(df: DataFrame, text_col: str, fn: Callable, out_col: str = "embedding") -> DataFrame:
    """Embed with a user model: ``fn(pandas.Series of text) -> sequence of
    float lists``.  Runs per Arrow batch on the executors."""
    @F.pandas_udf("array<float>")
    def _embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(fn(texts)))

    return df.withColumn(out_col, _embed(F.col(text_col)))


def embed(df: DataFrame, text_col: str, fn: Callable | None = None, out_col: str = "embedding", **kw) -> DataFrame:
    """V1 as dense vectors: ``fn`` when given, else folded TF-IDF (``num_features``)."""
    return embed_with(df, text_col, fn, out_col) if fn is not None else embed_tfidf(df, text_col, out_col, **kw)


def hashed_vectors(df: DataFrame, id_col: str, text_col: str, dims: int = 128) -> DataFrame:
    """Dense vectors ``(<id_col>, embedding)`` of ``dims`` numbers without a
    vocabulary: a term adds ``1 + ln(tf)`` at a place and with a sign that its
    MD5 names.  Documents without tokens have no row."""
    tf = (_dealt_tokens(df, id_col, text_col).select("_id", F.explode("_t").alias("_t"))
          .groupBy("_id", "_t").agg(F.count(F.lit(1)).alias("_tf")))
    name = F.md5(F.col("_t").cast("binary"))
    place = F.conv(F.substring(name, 1, 4), 16, 10).cast("int") % dims
    sign = F.when(F.substring(name, 5, 1) < "8", 1.0).otherwise(-1.0)
    parts = tf.groupBy("_id", place.alias("_d")).agg(F.sum(sign * (1 + F.log("_tf"))).alias("_v"))
    each = parts.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_d", "_v"))).alias("_m"))  # dims entries at most
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.try_element_at("_m", d), F.lit(0.0)))
    return each.select(F.col("_id").alias(id_col), dense.alias("embedding"))

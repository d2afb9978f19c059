"""Display tables and row filters: P1, P2, P3, P8, P9, P15."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgraph.functions.strings import LINK_HEADER, capitalize_header, paper_link


def require_rows(df: DataFrame, what: str = "documents") -> DataFrame:
    """An empty result is an error, not an empty table (one-row probe)."""
    if df.isEmpty():
        raise ValueError(f"the result has no {what}")
    return df


def _capitalized(df: DataFrame) -> DataFrame:
    return df.toDF(*[capitalize_header(c) for c in df.columns])


def paper_table(papers: DataFrame) -> DataFrame:
    """``Title, Abstract, Published, Link to Paper in Database``."""
    return _capitalized(papers.select(
        "Title", F.col("page_content").alias("Abstract"), "Published",
        paper_link(F.col("uid")).alias(LINK_HEADER)))


def author_table(authors: DataFrame, one_link_per_paper: bool = True, ordered: bool = False) -> DataFrame:
    """``Forename, Lastname, Affiliation, Country, City, Link to Paper in
    Database``, columns picked by name.  ``ordered`` sorts by name, the
    order the reference's group-by gives (T3; a range-partitioned sort).

    With ``one_link_per_paper`` (default) a merged author with several papers
    gets one link per paper, joined by ', '.  ``False`` keeps the reference's
    literal rule: one link built from the joined id text.
    """
    if one_link_per_paper and "paper_ids" in authors.columns:
        link = F.array_join(F.transform("paper_ids", paper_link), ", ")
    else:
        link = paper_link(F.col("pubmedid"))
    out = authors.select("forename", "lastname", "affiliation", "country", "city", link.alias(LINK_HEADER))
    if ordered:
        out = out.orderBy("forename", "lastname")
    return _capitalized(out)


def filter_in(df: DataFrame, col: str, values) -> DataFrame:
    """Keep rows whose ``col`` is in ``values`` (a small list)."""
    return df.filter(F.col(col).isin(list(values)))


_OPS = {
    "equals": lambda c, v: c == F.lit(v),
    "contains": lambda c, v: F.contains(F.lower(c), F.lower(F.lit(v))),
    "starts_with": lambda c, v: F.startswith(F.lower(c), F.lower(F.lit(v))),
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
    ">=": lambda c, v: c >= F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
}


def table_condition(conditions: dict) -> Column:
    """``{column: {op: value, ...}, ...}`` -> one conjunction.
    Ops: equals, contains, starts_with (case-insensitive text), in, not_in,
    >=, <=."""
    preds = []
    for col, ops in conditions.items():
        for op, value in ops.items():
            if op not in _OPS:
                raise ValueError(f"unknown filter op {op!r}; use one of {sorted(_OPS)}")
            preds.append(_OPS[op](F.col(col), value))
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def filter_table(df: DataFrame, conditions: dict) -> DataFrame:
    """Filter by several columns at once; pushed down where Spark can."""
    return df.filter(table_condition(conditions))

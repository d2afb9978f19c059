"""The end-to-end pipeline (M1-M9): plain functions over DataFrames.

    papers   = search(documents, topic, k)                    M1 (+ P15)
    query, groups = rephrase(topics, thesaurus)               M2
    flat     = flatten_documents(docs)                        M3
    shown    = paper_table(papers)                            M4
    authors  = author_profiles(records, papers, iso, gaz)     M5
    table    = author_table(authors)                          M6
    places   = authors_on_map(authors)                        M7
    mains    = main_authors(records, papers)                  M8
    nodes, edges = similarity_network(authors, papers, mains) M9

Every step returns a lazy DataFrame except where a materialisation is part
of the design (checkpointed node table, edges reused by the clustering).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgraph.operators import authors as au
from litgraph.operators import cluster, graph, places, search, similarity, tables, vectors
from litgraph.sources import records as rec
from litgraph.session import checkpoint, materialize
from litgraph.sources import versions
from litgraph.sources.records import flatten_documents  # noqa: F401  (M3)

DEFAULT_THRESHOLD = 0.4
DEFAULT_EPS = 0.1
DEFAULT_MIN_SAMPLES = 2


def search_papers(papers: DataFrame, topic: str, k: int = search.DEFAULT_TOP_K, upper: int | None = None) -> DataFrame:
    """M1: the ``k`` best papers for ``topic`` with their ``rank``; an empty
    result raises ``ValueError`` (P15)."""
    search.check_top_k(k, upper)
    top = search.search_bm25(papers, topic, k)
    found = papers.join(top.select("uid", "rank", "score"), "uid")
    return tables.require_rows(found, "documents")


def rephrase(topics: DataFrame, thesaurus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M2: the composed query text of each topic (R1, R2), and its concepts as
    term groups, which ``search_composed_papers`` takes."""
    terms = search.expand_synonyms(topics, thesaurus)
    return search.compose_query(terms), search.concept_groups(terms)


def search_composed_papers(papers: DataFrame, groups: Sequence[Sequence[str]], exclude: Sequence[str] = (),
                           k: int = search.DEFAULT_TOP_K) -> DataFrame:
    """M1 on a composed query: papers that match the term groups, the ``k``
    best by their terms; an empty result raises ``ValueError`` (P15)."""
    top = search.search_composed(papers, groups, exclude, k)
    return tables.require_rows(papers.join(top.select("uid", "rank", "score"), "uid"), "documents")


def paper_order(papers: DataFrame) -> list:
    """Order of appearance: search rank when present, packed with the author's
    and the affiliation's place into one number (2^20 authors a paper, 2^12
    affiliations an author), which keeps the merge hash-based.  Without a rank
    the id, as a number where it is one."""
    if "rank" in papers.columns:
        return [F.col("rank").cast("bigint") * 4294967296 + F.col("author_pos") * 4096 + F.col("aff_pos")]
    return [F.col("pubmedid").try_cast("bigint"), F.col("pubmedid"), F.col("author_pos"), F.col("aff_pos")]


def author_profiles(records: DataFrame, papers: DataFrame, iso: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """M5: records of the papers (J5) -> authorship rows (N1) -> places
    (F1, F2, J3, J4) -> merged by name (A1)."""
    rows = au.explode_authorship(au.records_by_id(records, papers, "uid"))
    if "rank" in papers.columns:
        rows = rows.join(papers.select(F.col("uid").alias("pubmedid"), "rank"), "pubmedid")
    placed = au.add_places(rows, iso, gazetteer)
    return au.merge_authors(placed, paper_order(rows))


def publish_authors(records: DataFrame, iso: DataFrame, gazetteer: DataFrame, path: str) -> int:
    """Author profiles of all records, kept as a version (S9): the tables
    ``placed`` (authorship rows with places) and ``authors``."""
    spark = records.sparkSession
    placed = au.add_places(au.explode_authorship(records), iso, gazetteer)
    return versions.publish(spark, {
        "placed": placed, "authors": lambda now: au.merge_authors(now["placed"], paper_order(now["placed"]))}, path)


def refresh_authors(changed: DataFrame, iso: DataFrame, gazetteer: DataFrame, path: str,
                    removed: DataFrame | None = None) -> int:
    """The next version after some records were added or changed, or removed
    (``removed``: column ``uid``).  Only names that an old or a new row of those
    records carries are merged again; the result is that of ``publish_authors``
    over all records as they are now."""
    spark = changed.sparkSession
    old = versions.load_version(spark, path)
    fresh = materialize(au.add_places(au.explode_authorship(changed), iso, gazetteer), "fresh")
    ids = changed.select(F.col("MedlineCitation.PMID._VALUE").alias("pubmedid"))
    if removed is not None:
        ids = ids.union(removed.select(F.col("uid").cast("string")))
    ids = materialize(ids.distinct(), "ids")
    gone = old["placed"].join(ids, "pubmedid", "left_semi")
    names = materialize(gone.select("forename", "lastname").union(fresh.select("forename", "lastname"))
                        .where("forename is not null and lastname is not null").distinct(), "names")
    placed = old["placed"].join(ids, "pubmedid", "left_anti").unionByName(fresh)

    def authors(now: dict[str, DataFrame]) -> DataFrame:
        touched = now["placed"].join(names, ["forename", "lastname"], "left_semi")
        return old["authors"].join(names, ["forename", "lastname"], "left_anti").unionByName(
            au.merge_authors(touched, paper_order(touched)))
    return versions.publish(spark, {"placed": placed, "authors": authors}, path)


def author_table(authors: DataFrame) -> DataFrame:
    """M6."""
    return tables.author_table(authors)


def authors_on_map(authors: DataFrame) -> DataFrame:
    """M7: P4 + A3 (marker rows; ``sources.sinks.place_features`` for GeoJSON)."""
    return places.authors_by_location(authors)


def main_authors(records: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """M8: first / last author per paper (records of ``papers`` when given)."""
    if papers is not None:
        records = au.records_by_id(records, papers, "uid")
    return au.main_authors(records)


def similarity_network(authors: DataFrame, papers: DataFrame, mains: DataFrame,
                       threshold: float = DEFAULT_THRESHOLD, vectors_df: DataFrame | None = None,
                       eps: float = DEFAULT_EPS, min_samples: int = DEFAULT_MIN_SAMPLES,
                       embed_fn: Callable | None = None, compat: bool = False,
                       missing: str = "error") -> tuple[DataFrame, DataFrame]:
    """M9: fused paper nodes with labels, hover text, size and DBSCAN cluster;
    edges with similarity ``>= threshold`` and their titles.

    Vectors: ``vectors_df`` (``id, embedding`` keyed by paper id) when given;
    a node without one raises an error, or stays without edges with
    ``missing="drop"``.  Else the text of each node is embedded by
    ``embed_fn``, or as exact sparse TF-IDF (thresholds above 0).
    The similarity join runs once at ``min(threshold, 1 - eps)``; the graph
    edges and the eps-neighbourhoods are filters of that one result.
    """
    nodes = graph.node_table(graph.fuse_by_research(authors, papers, compat), mains)
    low = min(threshold, 1.0 - eps)
    if vectors_df is None and embed_fn is None:
        pairs = similarity.sparse_similarity_edges(vectors.tfidf_rows(nodes, "node_id", "research"), low, "node_id")
    else:
        if vectors_df is not None:
            node_vecs = similarity.attach_vectors(nodes.select("node_id", "pubmedid"), vectors_df, missing=missing)
        else:
            node_vecs = vectors.embed_with(nodes.select("node_id", "research"), "research", embed_fn)
        pairs = similarity.similarity_edges(node_vecs.select("node_id", "embedding"), low, id_col="node_id")
    pairs = checkpoint(pairs)  # reused by the graph edges and the clustering
    graph_edges = pairs.filter(F.col("similarity") >= threshold)
    near = pairs.filter(F.lit(1.0) - F.col("similarity") <= eps)
    clusters = cluster.dbscan(nodes.select(F.col("node_id").alias("id")), near, min_samples)
    n_nodes = nodes.select(F.count(F.lit(1)).cast("double")).scalar()
    out_nodes = (nodes.join(clusters.withColumnRenamed("id", "node_id"), "node_id", "left")
                 .withColumn("color", graph.gradient_color(F.col("node_id"), n_nodes)))
    return out_nodes, graph.edge_titles(graph_edges, nodes)


def run_all(documents_papers: DataFrame, records: DataFrame, iso: DataFrame, gazetteer: DataFrame,
            topic: str, k: int = search.DEFAULT_TOP_K, threshold: float = DEFAULT_THRESHOLD,
            vectors_df: DataFrame | None = None) -> dict[str, DataFrame]:
    """Entry A + B + C of the reference in one call."""
    # found once, read by every later step
    papers = checkpoint(search_papers(documents_papers, topic, k))
    records = checkpoint(au.records_by_id(records, papers, "uid"))
    authors = author_profiles(records, papers, iso, gazetteer)
    mains = main_authors(records, papers)
    nodes, edges = similarity_network(authors, papers, mains, threshold, vectors_df)
    return {
        "papers": tables.paper_table(papers),
        "authors": author_table(authors),
        "places": authors_on_map(authors),
        "main_authors": mains,
        "nodes": nodes,
        "edges": edges,
    }


__all__ = ["search_papers", "rephrase", "search_composed_papers","author_profiles", "author_table", "authors_on_map", "main_authors",
           "similarity_network", "run_all", "flatten_documents", "rec"]

"""Connected components (A12) and density clustering.

Components are found by contraction: in every round each vertex moves to the
smallest of its neighbours (in an order drawn anew for the round), and to that
one's own choice; the edges are then renamed and thinned out.  About a third of
the vertices of a chain remain, fewer elsewhere, so the rounds grow with the
logarithm of the longest path and each reads only what the last one left.  At
the end the moves are followed back.

A hub's offers are combined in the map tasks (``min_by``).  What is joined to
the edges or to the moves is always a written table: adaptive execution splits
the other side where a hub makes it skewed, which it cannot do for a join whose
side is an aggregate.  Every round's tables are written to the shared folder,
which cuts the lineage; the driver learns only whether edges are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgraph.operators.graph import dense_ids, undirected
from litgraph.session import checkpoint, materialize


def _contract(edges: DataFrame, rank) -> tuple[DataFrame, DataFrame]:
    """One round over ``(src, dst)``: the moves ``(id, to)`` of all vertices and
    the edges between where they moved."""
    near = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    best = near.groupBy(F.col("src").alias("id")).agg(
        F.min(rank(F.col("dst"))).alias("_r"), F.min_by("dst", rank(F.col("dst"))).alias("_n"))
    step = materialize(best.select("id", F.when(F.col("_r") < rank(F.col("id")), F.col("_n")).otherwise(F.col("id")).alias("to")), "step")
    moves = materialize(step.alias("a").join(step.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to"), "moves")
    left = moves.select(F.col("id").alias("src"), F.col("to").alias("_a"))
    right = moves.select(F.col("id").alias("dst"), F.col("to").alias("_b"))
    renamed = edges.join(left, "src").join(right, "dst").where(F.col("_a") != F.col("_b"))
    return moves, materialize(renamed.select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst")).distinct(), "edges")


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(id, component)``, component = smallest id in the component.

    Edges ``(src, dst)`` may be given in any direction and repeatedly; a vertex
    of loops only, and one of ``vertices`` (column ``id``) without an edge, is
    its own component.  Rounds go on until no edge is left (no cap).
    """
    # written as given: repeated edges cost less than a shuffle to find them
    ends = materialize(edges.select("src", "dst"), "edges")
    verts = ends.select(F.col("src").alias("id")).unionByName(ends.select(F.col("dst").alias("id")))
    if vertices is not None:
        verts = verts.unionByName(vertices.select("id"))
    left = ends.where("src <> dst")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        n = len(rounds)

        def rank(v: Column, n: int = n) -> Column:
            return F.xxhash64(v, F.lit(n))
        moves, left = _contract(left, rank)
        rounds.append(moves)
    verts = verts.distinct()
    if not rounds:
        return verts.select("id", F.col("id").alias("component"))
    ended = rounds[-1]
    for moves in reversed(rounds[:-1]):
        later = ended.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
        ended = materialize(moves.join(later, moves["to"] == later["_id"], "left").select("id", F.coalesce("_to", "to").alias("to")), "ended")
    least = materialize(ended.groupBy("to").agg(F.min("id").alias("component")), "least")
    named = ended.join(least, "to").select("id", "component")
    return verts.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def dbscan(points: DataFrame, neighbor_pairs: DataFrame, min_samples: int = 2) -> DataFrame:
    """Density clusters over a precomputed neighbourhood graph.

    ``points``: column ``id`` (every point); ``neighbor_pairs``: ``(src, dst)``
    pairs within eps (each pair once).  Returns ``(id, cluster)``, -1 = noise.

    1. a point is core when ``neighbours + 1 >= min_samples`` (it counts itself)
    2. clusters = connected components of the core-core graph
    3. a non-core point next to a core point joins the smallest cluster number
       among its core neighbours
    4. clusters are numbered 0, 1, ... in order of their smallest core id
    """
    sym = checkpoint(undirected(neighbor_pairs))  # read four times below
    degree = sym.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_deg"))
    pts = points.select("id").distinct().join(degree, "id", "left").fillna(0, ["_deg"])
    core = pts.filter(F.col("_deg") + 1 >= min_samples).select("id")
    core_edges = (sym.join(core.withColumnRenamed("id", "src"), "src", "left_semi")
                  .join(core.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    comp = connected_components(core_edges.where("src < dst"), core)  # each edge is there both ways
    numbers = dense_ids(comp.select("component").distinct(), "component", "cluster")
    core_cluster = comp.join(numbers, "component").select("id", "cluster")
    border = (sym.join(core.withColumnRenamed("id", "src"), "src", "left_anti")
              .join(core_cluster.withColumnRenamed("id", "dst"), "dst")
              .groupBy(F.col("src").alias("id")).agg(F.min("cluster").alias("cluster")))
    labelled = core_cluster.unionByName(border)
    return (points.select("id").distinct().join(labelled, "id", "left")
            .select("id", F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster")))

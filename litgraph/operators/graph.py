"""Paper graph: authors joined to papers (J1), fused by paper text (A2),
dense node ids (W3), labels and hover text (J2, F10-F12, N3), edge titles
(J8), k-hop neighbourhoods (J9), edge / node filters (J10, P14).

Nodes and edges are two DataFrames:

    nodes  node_id bigint, pubmedid, label, title, size, n_authors, research, ...
    edges  src bigint, dst bigint, similarity double (+ title, value, color)
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litgraph.session import checkpoint, materialize

from litgraph.functions.strings import (
    EDGE_COLOR, EDGE_VALUE, NO_AFFILIATION, edge_title, full_name, node_label, node_size,
    research_text)

def authors_join_papers(authors: DataFrame, papers: DataFrame, compat: bool = False) -> DataFrame:
    """One row per (merged author, paper) with the paper's columns.

    By default every id of ``paper_ids`` is joined, so an author with several
    papers meets all of them.  ``compat=True`` keeps the reference's literal
    rule (join on the ', '-joined id text, which misses such authors).
    """
    if compat or "paper_ids" not in authors.columns:
        rows = authors.select(*[c for c in authors.columns if c not in ("paper_ids", "affiliations")],
                              F.lit(1).alias("paper_idx"))
    else:
        rows = authors.select(
            *[c for c in authors.columns if c not in ("paper_ids", "affiliations", "pubmedid")],
            F.posexplode("paper_ids").alias("paper_idx", "pubmedid"))
        rows = rows.withColumn("paper_idx", F.col("paper_idx") + 1)
    return rows.join(papers, rows.pubmedid == papers.uid, "inner").drop("uid")


def fuse_by_research(authors: DataFrame, papers: DataFrame, compat: bool = False) -> DataFrame:
    """A2: one row per distinct paper text (``research`` = title + ' ' +
    abstract), listing all (author, paper) members in (forename, lastname,
    paper position) order:

        research, forename (', '), lastname (', '), affiliation ('; '),
        pubmedid (first), n_authors (row count), members array<struct>,
        _node (digest of the text, the node's key)

    Names are not de-duplicated, as in the reference.  Plan: what is joined and
    grouped are names, paper ids and digests of the texts; these narrow nodes
    are written.  An author's affiliations (one long text for all papers) are
    told apart by their order within the name, so members sort without them.
    Texts and affiliations are joined by the digest at the end, each crossing
    the network once, an author's affiliations one after the other, which
    compresses them; as these joins are left ones to unique keys, Spark leaves
    out those whose columns are not asked for.
    """
    whole = compat or "paper_ids" not in authors.columns
    nth = F.row_number().over(Window.partitionBy("forename", "lastname").orderBy("affiliation"))
    rows = materialize(authors.select("forename", "lastname", "affiliation", nth.alias("_nth"),
                                      (F.array("pubmedid") if whole else F.col("paper_ids")).alias("_ids")), "authors")
    links = rows.select("forename", "lastname", "_nth", F.posexplode("_ids").alias("paper_idx", "pubmedid"))
    if whole:
        links = links.withColumn("paper_idx", F.lit(1))
    texts = papers.select(F.col("uid").alias("pubmedid"),
                          research_text(F.col("Title"), F.col("page_content")).alias("research"))
    texts = texts.withColumn("_text", F.unhex(F.sha2("research", 256)))
    member = F.struct("forename", "lastname", "paper_idx", "_nth", "pubmedid")
    nodes = materialize(links.join(texts.select("pubmedid", "_text"), "pubmedid").groupBy("_text").agg(
        F.sort_array(F.collect_list(member)).alias("_m")), "fused")
    each = nodes.select("_text", F.posexplode("_m").alias("_pos", "_x"))
    # sorted and merged: in memory this table is many times its files
    own = rows.select(F.col("forename").alias("_f"), F.col("lastname").alias("_l"), F.col("_nth").alias("_n"),
                      "affiliation").hint("merge")
    x = F.col("_x")
    same = x["forename"].eqNullSafe(F.col("_f")) & x["lastname"].eqNullSafe(F.col("_l")) & (x["_nth"] == F.col("_n"))
    told = each.join(own, same).select("_text", "_pos", "affiliation").repartition("_text")
    affiliations = told.groupBy("_text").agg(
        F.sort_array(F.collect_list(F.struct("_pos", "affiliation")))["affiliation"].alias("_a"))
    text = texts.groupBy("_text").agg(F.first("research").alias("research"))
    m = F.col("_m")
    return nodes.join(text, "_text", "left").join(affiliations, "_text", "left").select(
        "research",
        F.array_join(m["forename"], ", ").alias("forename"),
        F.array_join(m["lastname"], ", ").alias("lastname"),
        F.array_join("_a", "; ").alias("affiliation"),
        F.element_at(F.array_compact(m["pubmedid"]), 1).alias("pubmedid"),
        F.size(m).cast("bigint").alias("n_authors"),
        F.zip_with("_m", "_a", lambda x, a: F.struct(
            x["forename"].alias("forename"), x["lastname"].alias("lastname"), x["paper_idx"].alias("paper_idx"),
            a.alias("affiliation"), x["pubmedid"].alias("pubmedid"))).alias("members"),
        F.col("_text").alias("_node"),
    )


def dense_ids(df: DataFrame, order_col: str, id_col: str = "node_id", partitions: int | None = None) -> DataFrame:
    """``id_col`` = 0-based rank of ``order_col`` in sort order.

    ``order_col`` is a key: unique, never null, and short, because only this
    column is sampled for range bounds and travels through the sort; the other
    columns are joined back by it.

    No single-partition window: keys are range-partitioned and sorted inside
    each partition; a per-partition count (one row per partition) gives each
    partition its offset, which is added to the local position.
    """
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = checkpoint(df)  # read by the range sampler, the sort and the join
    ranged = (rows.select(order_col).repartitionByRange(n_parts, F.col(order_col)).sortWithinPartitions(order_col)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    # Materialise once (reliable checkpoint): the count and the numbering then
    # read the same rows in the same partitions, whatever AQE or a lost
    # executor does to a recomputation.
    ranged = checkpoint(ranged)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    offsets = counts.select(
        "_pid", "_first",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    offsets = F.broadcast(offsets.fillna(0, ["_off"]))  # one row per partition
    numbers = ranged.join(offsets, "_pid").select(
        order_col, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint").alias(id_col))
    return numbers if df.columns == [order_col] else rows.join(numbers, order_col)


def hover_text(members, first_author) -> F.Column:
    """One line per member, ``FORE LAST: affiliation``; the paper's
    first author as ``*FORE LAST* (First Author): affiliation``; lines joined
    by newline.  Members are carried as structs (no re-splitting of joined
    text), so names and affiliations stay aligned."""
    def line(x):
        fore, last = F.upper(x["forename"]), F.upper(x["lastname"])
        aff = F.when(F.coalesce(x["affiliation"], F.lit("")) == "", F.lit(NO_AFFILIATION)).otherwise(x["affiliation"])
        is_first = full_name(x["forename"], x["lastname"]) == F.coalesce(first_author, F.lit(""))
        return F.when(is_first, F.concat(F.lit("*"), fore, F.lit(" "), last, F.lit("* (First Author): "), aff)) \
            .otherwise(F.concat(fore, F.lit(" "), last, F.lit(": "), aff))
    return F.array_join(F.transform(members, line), "\n")


def node_table(fused: DataFrame, main_authors: DataFrame) -> DataFrame:
    """Nodes (J2, W3, F10-F12, N3): dense id in the order of the node's first
    paper id (whole texts are no sort key), label from the first author of
    that paper (``Unknown Author`` when absent), hover text, size
    ``ln(n_authors) * 10``.

    ``main_authors`` grows with the corpus, so it is joined, not broadcast;
    it is reduced to one row per id first (a dict keeps one value per key).
    """
    firsts = main_authors.groupBy(F.col("uid").alias("_uid")).agg(F.max("first_author").alias("_fa"))
    # only keys are numbered; what else a caller asks for is joined to them, by
    # the key that texts and affiliations are already dealt out by
    key = "_node" if "_node" in fused.columns else "pubmedid"
    ids = materialize(dense_ids(fused.select(*{key: 0, "pubmedid": 0}), "pubmedid"), "ids")
    heads = ids.join(firsts, F.col("pubmedid") == firsts._uid, "left").select(key, "node_id", "_fa")
    nodes = fused.join(heads, key)
    return nodes.select(
        "node_id", "pubmedid",
        node_label(F.col("_fa")).alias("label"),
        hover_text(F.col("members"), F.col("_fa")).alias("title"),
        node_size("n_authors").alias("size"),
        "n_authors", "research", "forename", "lastname", "affiliation", "members",
    )


def gradient_color(node_id, n_nodes, start=(0.85, 0.93, 0.80), end=(0.16, 0.20, 0.40)) -> F.Column:
    """Node colour on a two-point gradient over the node index (the reference
    colours by index from a named palette; that palette is not reproduced)."""
    from litgraph.functions.strings import rgb_to_hex
    t = F.when(n_nodes > 1, node_id.cast("double") / (n_nodes - 1)).otherwise(F.lit(0.0))
    ch = [F.lit(a) + (F.lit(b) - F.lit(a)) * t for a, b in zip(start, end)]
    return rgb_to_hex(*ch)


def edge_titles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """J8 + F16 + P16: attach both end labels, the hover title, and the
    constant edge value and colour."""
    labels = materialize(nodes.select("node_id", "label"), "labels")
    s = labels.select(F.col("node_id").alias("src"), F.col("label").alias("src_label"))
    d = labels.select(F.col("node_id").alias("dst"), F.col("label").alias("dst_label"))
    out = edges.join(s, "src", "left").join(d, "dst", "left")
    return out.select(
        "src", "dst", "similarity", "src_label", "dst_label",
        edge_title(F.col("src_label"), F.col("dst_label"), F.col("similarity")).alias("title"),
        F.lit(EDGE_VALUE).alias("value"), F.lit(EDGE_COLOR).alias("color"))


# ---------------------------------------------------------------- neighbourhoods and filters

def undirected(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def khop_neighbors(edges: DataFrame, seeds: DataFrame, k: int = 2, checkpoint_every: int = 2) -> DataFrame:
    """Nodes within ``k`` hops of each seed, with the smallest hop count.

    ``seeds``: ``(seed, node_id)`` rows (a seed may start from itself, hop 0).
    Each round joins the frontier with the undirected edge list, keeps only
    nodes not seen before (anti join) and stops early when nothing is new.
    Rounds that others follow are written to the shared folder; the last one,
    which holds most rows, is not.
    """
    sym = materialize(undirected(edges), "sym")  # read once per round
    seen = seeds.select("seed", "node_id", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, k + 1):
        step = (frontier.join(sym, frontier.node_id == sym.src)
                .select("seed", F.col("dst").alias("node_id")).distinct())
        new = step.join(seen, ["seed", "node_id"], "left_anti").withColumn("hop", F.lit(hop))
        if hop < k:
            if hop % checkpoint_every == 0:
                new = materialize(new, "new")
            if new.isEmpty():
                break
        seen = seen.unionByName(new)
        frontier = new
    return seen


def khop_bitmaps(edges: DataFrame, seeds: DataFrame, k: int = 2) -> DataFrame:
    """``khop_neighbors`` for many seeds at once: the same rows.

    Seeds are numbered and 64 of them share a word: a round carries one row for
    each node and word with the bits of the seeds that have just reached it.
    Bits that meet at a node are or-ed, in the map tasks first, and those seen
    before are taken out.  So a round's rows grow with nodes and words of seeds,
    not with pairs of node and seed.  Seeds with a common smallest neighbour are
    numbered together, so that a word holds seeds that reach the same nodes.
    ``(seed, node_id, hop)`` rows are spelled out at the end, from words that
    bring their seeds along, and are not shuffled.
    """
    sym = materialize(undirected(edges), "sym")
    near = sym.groupBy("src").agg(F.least("src", F.min("dst")).alias("near"))
    near = near.union(sym.join(near.withColumnRenamed("src", "dst"), "dst").select("src", "near")).groupBy("src").agg(F.min("near").alias("near"))
    placed = seeds.join(near, seeds["node_id"] == near["src"], "left").where("seed is not null").groupBy("seed").agg(F.min("near").alias("near"))
    numbered = materialize(dense_ids(placed.select(F.struct("near", "seed").alias("at")), "at", "n").select(
        "at.seed", F.shiftright("n", 6).alias("word"), (F.col("n") % 64).cast("int").alias("bit")), "seeds")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    reached = materialize(seeds.join(numbered, "seed").groupBy("node_id", "word").agg(F.bit_or(bit).alias("bits")), "reached")
    seen, rounds = reached, [reached.withColumn("hop", F.lit(0))]
    for hop in range(1, k + 1):
        step = (reached.join(sym, reached["node_id"] == sym["src"]).groupBy(F.col("dst").alias("node_id"), "word")
                .agg(F.bit_or("bits").alias("_b")))
        fresh = F.col("_b").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long"))))
        reached = materialize(step.join(seen, ["node_id", "word"], "left").select("node_id", "word", fresh.alias("bits"))
                              .where("bits <> 0"), "reached")
        if reached.isEmpty():
            break
        rounds.append(reached.withColumn("hop", F.lit(hop)))
        if hop < k:
            seen = materialize(seen.unionByName(reached).groupBy("node_id", "word").agg(F.bit_or("bits").alias("bits")), "seen")
    words = reduce(DataFrame.unionByName, rounds)
    owners = materialize(numbered.groupBy("word").agg(F.collect_list(F.struct("bit", "seed")).alias("owners")), "owners")
    # unfolded and then picked: a filter of the list within the row is not compiled
    held = words.join(owners, "word").select("node_id", "hop", "bits", F.explode("owners").alias("x"))
    return held.where(F.getbit("bits", F.col("x.bit")) == 1).select("x.seed", "node_id", "hop")


def edge_filter_nodes(edges: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Nodes at either end of the edges whose ``column`` is in ``values``."""
    picked = edges.filter(F.col(column).isin(list(values)))
    return picked.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()


def node_filter(nodes: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Nodes whose property (as text) is in ``values``."""
    return nodes.filter(F.col(column).cast("string").isin([str(v) for v in values]))

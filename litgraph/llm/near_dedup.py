"""Operator 1: near-duplicate detection by MinHash with tensored banding.

Two documents are linked when the Jaccard similarity of their shingle sets is
at least the threshold.  A plain LSH scheme with T tables of four MinHashes
needs 4T of them.  Here two collections of ``HALVES`` hash blocks (two
MinHashes each) are drawn, and every pair (block i of the first, block j of
the second) is a table: ``HALVES**2`` tables from ``4 * HALVES`` MinHashes.
A pair of similarity s shares a table unless no block of one collection
matches: it is missed with probability at most ``2 * (1 - s*s)**HALVES``,
7e-5 at s = 0.8 and 5e-8 at s = 0.9 with ten blocks.  All candidates are
verified on the full shingle sets.

Steps, all partitioned:

1. every row: shingle set, its size, a 64-bit fingerprint of the set (the
   node) and 40 MinHashes;
2. equal sets collapse into one node, so groups of copies cost one row;
3. nodes are dealt by table key; within a key every node is paired with the
   key's smallest node only (a star), so no group emits all its pairs;
4. candidates pass two filters (set sizes; number of equal MinHashes, whose
   chance to lose a link at the threshold is below 1e-5) and are then verified
   on full sets; links make components;
5. keys that still hold nodes of several components are open: their nodes are
   packed into blocks of bounded size, a row each, and compared block by block,
   on full sets; only links between components are given out.  So no link that joins two components is left
   out, and no group emits its pairs.

Defined results: rows with a null id take part, but cannot name a component
(``component_id`` is the smallest non-null id; a document linked with nothing
gets its own id).  A null or empty text, or one without words, has no
shingles, is linked with nothing and is kept.  Repeated rows share their
component.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgraph.llm import textnum
from litgraph.llm.common import bounded_batches, materialize
from litgraph.llm.components import components

#: MinHash blocks in each of the two collections, and MinHashes per block.
HALVES, PER_BLOCK = 10, 2
HASHES = 2 * HALVES * PER_BLOCK
#: Bits of the filter that says which rows' sets are needed: a fixed size, so
#: what is broadcast never grows; a fuller filter only prunes less.
FILTER_BITS = 1 << 24
#: Nodes in a block of the comparison of open keys.
BLOCK = 128

_rng = np.random.default_rng(11)
_MUL = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """MinHashes (32 bits each) of non-empty sets, one row per set."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    flat ^= flat >> np.uint64(31)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(flat * _MUL[k] + _ADD[k], at) >> np.uint64(32)
    return out


def _set_print(s: np.ndarray) -> int:
    """64-bit fingerprint of a set of 64-bit hashes, as a signed number."""
    x = textnum.mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
    return int(textnum.mix(np.array([x + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, sketches = [], [], []
            held: list[np.ndarray] = []

            def flush() -> None:
                if held:
                    sketches.extend(r.tobytes() for r in min_hashes(held))
                    held.clear()

            total = 0
            for s in textnum.shingle_sets(batch.column(1), k):
                sizes.append(len(s))
                if len(s):
                    nodes.append(_set_print(s))
                    held.append(s)
                    total += len(s)
                    if total > 200_000:
                        flush()
                        total = 0
                else:
                    flush()
                    nodes.append(None)
                    sketches.append(None)
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "node", "sketch"])
    return run


def _sketch_array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _table_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sketch) -> a row (key, node) for each of the HALVES**2 tables."""
    mul = np.uint64(0x9FB21C651E98DF25)
    for batch in batches:
        if not batch.num_rows:
            continue
        sk = _sketch_array(batch.column(1)).astype(np.uint64)
        blocks = textnum.mix((sk[:, 0::2] << np.uint64(32)) | sk[:, 1::2])
        table = np.arange(HALVES * HALVES, dtype=np.uint64)
        pairs = blocks[:, :HALVES].repeat(HALVES, axis=1) * mul + np.tile(blocks[:, HALVES:], (1, HALVES))
        keys = textnum.mix(pairs + table[None, :] * np.uint64(0xA24BAED4963EE407))
        node = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.reshape(-1).view(np.int64)), pa.array(node.repeat(HALVES * HALVES))],
            names=["key", "node"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, node): those of keys that hold two nodes at least,
    with the key's smallest node.  Only the open key is carried on."""
    hub_key = hub = None
    told = False
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        node = batch.column(1).to_numpy(zero_copy_only=False)
        if hub_key is not None and not told and key[0] == hub_key:
            # the open key's first row stands in an earlier batch
            key, node = np.r_[hub_key, key], np.r_[hub, node]
            led = True
        else:
            led = hub_key is not None and key[0] == hub_key
        new = np.r_[True, key[1:] != key[:-1]]
        at = np.flatnonzero(new)
        length = np.diff(np.r_[at, len(key)])
        first = node[at]
        keep = length > 1
        if led and told:
            first = first.copy()
            first[0] = hub
            keep[0] = True
        rows = keep.repeat(length)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[rows]), pa.array(node[rows]), pa.array(first.repeat(length)[rows])],
            names=["key", "node", "hub"])
        hub_key, hub, told = key[-1], first[-1], bool(keep[-1])


def _filter_place(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of the fixed-size filter for each document id."""
    x = textnum.mix(ids.cast(pa.int64()).fill_null(-2**63).to_numpy(zero_copy_only=False).view(np.uint64))
    return ((x >> np.uint64(6)) % np.uint64(FILTER_BITS // 64)).astype(np.int64), x & np.uint64(63)


def _filter_bits(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits with a bit set for each id; only its words
    (a fixed number) reach the driver."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, bit = _filter_place(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(w), pa.array((np.uint64(1) << bit).view(np.int64))], names=["w", "x"])

    words = ids.mapInArrow(place, "w long, x long").groupBy("w").agg(F.bit_or("x").alias("x")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["x"].to_numpy(np.int64).view(np.uint64)
    return bits


def _full_sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """``(node, items)``: sorted hashes of the full shingle sets of the rows
    whose ids stand in ``needed``, one row a node.  The fixed-size filter lets
    other rows through: those of other nodes are dropped by joins on ``node``,
    copies of a node here, by tags, so sets are not shuffled for it."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(needed.select("rep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, bit = _filter_place(batch.column(0))
            batch = batch.filter(pa.array(((bits.value[w] >> bit) & np.uint64(1)).astype(bool)))
            sets = [s for s in textnum.shingle_sets(batch.column(1), k) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_print(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "items"])

    rows = materialize(docs.mapInArrow(run, "node long, items binary").withColumn(
        "tag", F.monotonically_increasing_id()), "sets")
    tags = rows.select("node", "tag")
    first = tags.groupBy("node").agg(F.min("tag").alias("tag"))
    copies = materialize(tags.join(first, ["node", "tag"], "left_anti").select("tag"), "copies")
    return rows.join(copies, "tag", "left_anti").select("node", "items")


def _alike(percent: int):
    """Batches (a, b, items of a, items of b) -> the pairs that are linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                z = np.concatenate((x, y))
                z.sort()
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(ok))
    return run


def _likely(percent: int, least: int):
    """Batches (a, b, sizes, MinHashes) -> pairs that may be linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            same = (_sketch_array(batch.column(4)) == _sketch_array(batch.column(5))).sum(axis=1)
            ok = (same >= least) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield batch.select([0, 1]).filter(pa.array(ok))
    return run


def least_equal(percent: int, loss: float = 1e-5) -> int:
    """The most equal MinHashes of HASHES that can be asked for while a pair at
    the threshold passes with probability 1 - loss at least."""
    from math import comb
    p, below = percent / 100, 0.0
    for c in range(HASHES + 1):
        below += comb(HASHES, c) * p**c * (1 - p) ** (HASHES - c)
        if below > loss:
            return c
    return HASHES


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``
    (columns ``doc_id`` and ``text``; others are ignored).

    ``k`` words per shingle; linked from ``percent`` / 100 Jaccard similarity.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = materialize(docs.mapInArrow(
        _signatures(k), "doc_id long, n_shingles long, node long, sketch binary"), "signatures")
    classes = materialize(
        sigs.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")),
        "classes")
    keyed = classes.select("node", "sketch").mapInArrow(_table_keys, "key long, node long")
    hits = materialize(
        keyed.repartition("key").sortWithinPartitions("key", "node")
        .mapInArrow(_stars, "key long, node long, hub long"), "hits")

    sketches = classes.select("node", "n", "sketch")
    likely = _likely(percent, least_equal(percent))

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs of nodes (a, b) that are linked by their full sets."""
        a = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        some = materialize(pairs.join(b, "b").join(a, "a").select("a", "b", "na", "nb", "sa", "sb")
                           .mapInArrow(likely, "a long, b long"), "candidates")
        x = sets.select(F.col("node").alias("a"), F.col("items").alias("xa"))
        y = sets.select(F.col("node").alias("b"), F.col("items").alias("xb"))
        return materialize(some.join(y, "b").join(x, "a").select("a", "b", "xa", "xb")
                           .mapInArrow(_alike(percent), "a long, b long").distinct(), "links")

    needed = hits.select("node").distinct().join(classes.select("node", "rep"), "node")
    sets = _full_sets(docs, needed, k)

    # first stars: every node with the smallest node that shares a table with it
    links = verified(hits.where("node <> hub").groupBy("node").agg(F.min("hub").alias("a"))
                     .withColumnRenamed("node", "b"))
    comps = components(links)
    open_pairs = _open_pairs(hits, comps)
    if not open_pairs.isEmpty():
        more = _block_links(open_pairs, sketches.select("node", "n"), sets, percent)
        if not more.isEmpty():
            comps = components(links.union(more))

    named = classes.select("node", "rep").join(comps, "node", "left").select(
        "node", "rep", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "comp").select("node", "component_id")
    return sigs.join(named, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def _open_pairs(hits: DataFrame, comps: DataFrame) -> DataFrame:
    """``(node, comp, hub, hub_comp)``: all nodes that share a key with its
    smallest node (hub), for hubs that have such a node in another component.
    A key whose nodes lie in several components has one."""
    pairs = hits.where("node <> hub").select("node", "hub").distinct()
    pairs = pairs.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "hub")
    far = comps.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
    pairs = materialize(pairs.join(far, "hub", "left").select(
        "node", "comp", "hub", F.coalesce("hub_comp", "hub").alias("hub_comp")), "pairs")
    several = pairs.where("comp <> hub_comp").select("hub").distinct()
    return materialize(pairs.join(several, "hub", "left_semi"), "open")


def _pack_block(table: pa.Table) -> pa.Table:
    """The nodes of one block as one row: their numbers, components, set sizes
    and sets, one after the other."""
    sets = [v.as_buffer() for v in table.column("items")]
    comp = table.column("comp").to_numpy()
    return pa.table({
        "family": table.column("family").slice(0, 1), "class": table.column("class").slice(0, 1),
        "block": table.column("block").slice(0, 1), "low": pa.array([comp.min()], pa.int64()),
        "high": pa.array([comp.max()], pa.int64()), "nodes": pa.array([table.column("node").to_numpy().tobytes()], pa.binary()),
        "comps": pa.array([comp.tobytes()], pa.binary()),
        "sizes": pa.array([np.array([len(b) // 8 for b in sets], np.int64).tobytes()], pa.binary()),
        "items": pa.array([b"".join(sets)], pa.binary())})


def _dense_links(percent: int):
    """A block pair (one or two packed blocks) -> links that join what belongs
    together, as stars: fewer than the block pair has nodes."""
    def whole(table: pa.Table, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    def run(table: pa.Table) -> pa.Table:
        node, comp, size = (whole(table, name, np.int64) for name in ("nodes", "comps", "sizes"))
        flat = whole(table, "items", np.uint64)
        n = len(node)
        row = np.repeat(np.arange(n), size)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        new = np.r_[True, flat[1:] != flat[:-1]]
        shared = np.diff(np.r_[np.flatnonzero(new), len(flat)]) > 1
        item = np.cumsum(new) - 1
        ok = shared[item]
        item, row = (np.cumsum(shared) - 1)[item[ok]], row[ok]
        both = np.zeros((n, n), np.float32)
        width = max(1, 4_000_000 // n)  # items per slice: bounds the dense matrix
        for lo in range(0, int(item[-1]) + 1 if len(item) else 0, width):
            i, j = np.searchsorted(item, (lo, lo + width))
            x = np.zeros((n, width), np.float32)
            x[row[i:j], item[i:j] - lo] = 1
            both += x @ x.T
        union = size[:, None] + size[None, :] - both
        joined = (100 * both >= percent * union) | (comp[:, None] == comp[None, :])
        label = np.arange(n)
        while True:  # smallest row that can be reached
            low = np.where(joined, label[None, :], n).min(axis=1)
            low = np.minimum(low, label)
            if (low == label).all():
                break
            label = low[low]
        i = np.flatnonzero(label != np.arange(n))
        return pa.table({"a": pa.array(node[label[i]], pa.int64()), "b": pa.array(node[i], pa.int64())})
    return run


def _block_links(open_pairs: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components among nodes that share keys.

    Nodes that hang together by open pairs are a family.  A family's nodes are
    dealt into classes of set size, such that linked nodes are of the same or of
    neighbouring classes, and large classes into blocks of about BLOCK nodes,
    each packed into one row.  A pair of blocks that can hold links is one
    group of two rows at most, whose sets are compared at once; only links
    leave it."""
    family = components(open_pairs, "node", "hub")
    base = F.log(F.lit(100.0 / percent)) * 1.001  # a little wider, so neighbours suffice in spite of rounding
    nodes = open_pairs.select("node", "comp").union(open_pairs.select("hub", "hub_comp")).distinct().join(sizes, "node").join(
        family.withColumnRenamed("comp", "family"), "node")
    nodes = nodes.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / base).cast("int"))
    counts = nodes.groupBy("family", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    nodes = materialize(nodes.join(counts, ["family", "class"]).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")), "nodes")
    packed = materialize(
        nodes.join(sets, "node").select("family", "class", "block", "node", "comp", "items")
        .groupBy("family", "class", "block").applyInArrow(
            _pack_block, "family long, class int, block int, low long, high long, "
                         "nodes binary, comps binary, sizes binary, items binary"), "packed")
    heads = packed.select("family", F.struct("class", "block").alias("at"), "low", "high")
    x = heads.select("family", F.col("at").alias("x"), F.col("low").alias("low_x"), F.col("high").alias("high_x"))
    y = heads.select("family", F.col("at").alias("y"), F.col("low").alias("low_y"), F.col("high").alias("high_y"))
    pairs = x.join(y, "family").where(
        (F.col("x") <= F.col("y")) & (F.col("y.class") - F.col("x.class") <= 1)
        & (F.least("low_x", "low_y") < F.greatest("high_x", "high_y")))
    sides = pairs.select("family", F.xxhash64("family", "x", "y").alias("pair"),
                         F.explode(F.array_distinct(F.array("x", "y"))).alias("at")).select(
        "family", "pair", F.col("at.class").alias("class"), F.col("at.block").alias("block"))
    return materialize(
        sides.join(packed, ["family", "class", "block"]).select("pair", "nodes", "comps", "sizes", "items")
        .groupBy("pair").applyInArrow(_dense_links(percent), "a long, b long").distinct(), "links")

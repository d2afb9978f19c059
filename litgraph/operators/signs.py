"""Approximate cosine join by signs of random projections (J6, approximate).

The sign of a random projection differs for two vectors with probability
``angle / pi``.  Every vector gets a signature of many such bits:

* ``tables`` groups of ``width`` bits are keys.  Vectors meet if they have a key
  in common, or one that differs in a single bit: each key is looked up with
  each of its bits flipped, too (multi-probe), so few tables are needed;
* pairs that meet are compared on ``FILTER`` bits, as a bit count of four
  numbers; only those within the distance that pairs at the threshold keep, but
  for a stated loss, are candidates;
* candidates are checked by their exact cosine, so there are no false edges.

Keys are not looked up row by row.  The vectors of a table with the same first
bits of their keys are packed, a row for each batch of vectors, and compared in
one task: sorted by the other bits, which are flipped there.  Only for the flips
of a first bit a vector is sent to a second place, and the number of first bits
keeps a place at about ``GROUP`` vectors.

The tables are taken some at a time, so that what is dealt out at once is
bounded by the vectors and not by the number of tables.  Vectors go along as
bytes, whose cosine is right but for a known error, so that most candidates end
in the place where they meet; a pair counts in the first table of a round, and
in the first round, where it meets.  The exact check sends a vector once to each
place where it has partners.

``sign_tables`` chooses width and number from the threshold, the number of
vectors and the wished recall, so that the rows shuffled and the pairs met are
fewest.  A width grows with the logarithm of the number of vectors: at high
thresholds a vector meets few others however many there are.  At thresholds
near those of unrelated vectors no signature helps; the exact join is cheaper
there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgraph.functions.vectors import as_double
from litgraph.operators.graph import dense_ids
from litgraph.session import materialize, setting

FILTER = 256            # bits compared for every pair that meets
WORDS = FILTER // 64
MAX_TABLES = 2000
GROUP = 1 << 18         # vectors compared in one place, about
ROUND = 1 << 28         # bytes of keys dealt out at once, at least
OWN = 1 << 14           # vectors of one place of the exact check
BATCH = 10_000          # vectors signed at once
_CHUNK = 1 << 17        # pairs whose bits are counted at once


class SignTables(NamedTuple):
    """Bits of a key, number of keys, largest number of different bits."""

    width: int
    tables: int
    distance: int


def meeting_chance(threshold: float, width: int) -> float:
    """That two vectors at the threshold meet in one table."""
    same = 1 - math.acos(threshold) / math.pi
    return same**width + width * same ** (width - 1) * (1 - same)


def sign_tables(n: int, threshold: float, recall: float) -> SignTables:
    """The cheapest tables by which a pair at the threshold is found with
    probability ``recall``, half of the loss being the filter's."""
    loss = (1 - recall) / 2
    best = (math.inf, 0, 0)
    for width in range(4, 41):
        chance = meeting_chance(threshold, width)
        tables = 1 if chance >= 1 else max(1, math.ceil(math.log(loss) / math.log1p(-chance)))
        cost = tables * (width + 2) + n * tables * (width + 1) / 2**width
        if width == 4 or tables <= MAX_TABLES:
            best = min(best, (cost, width, tables))
    differ = math.acos(threshold) / math.pi
    total, distance = 0.0, -1
    while total < 1 - loss and distance < FILTER:
        distance += 1
        total += math.comb(FILTER, distance) * differ**distance * (1 - differ) ** (FILTER - distance)
    return SignTables(best[1], best[2], distance)


def _kind(plan: SignTables) -> np.dtype:
    return np.dtype(np.uint32 if plan.width <= 32 else np.uint64)


def _slices(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each value of ``place``."""
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(place[rows[0]]), rows


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``BATCH`` rows at least, but for the last, whatever the session's setting."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.stack(vectors.to_numpy(zero_copy_only=False)).astype(np.float64)


def _bits(plan: SignTables, seed: int):
    """A function of a matrix: the filter bits of its rows, as bytes, and their key in each table."""
    directions, place = None, np.int64(1) << np.arange(plan.width, dtype=np.int64)

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nonlocal directions
        if directions is None:
            rng = np.random.default_rng(seed)
            directions = rng.standard_normal((x.shape[1], FILTER + plan.width * plan.tables))
        words, keys = [], []
        for lo in range(0, len(x), 1024):  # a row has thousands of projections
            bits = x[lo:lo + 1024] @ directions > 0
            words.append(np.packbits(bits[:, :FILTER], axis=1))
            keys.append(bits[:, FILTER:].reshape(len(bits), plan.tables, plan.width) @ place)
        return np.concatenate(words), np.concatenate(keys)
    return run


def _places(keys: np.ndarray, rest: int, first: int) -> tuple[np.ndarray, list[tuple[int, bool, np.ndarray]]]:
    """The other bits of the keys, and the rows of each value of their first
    bits.  Rows that are not ``own`` have one of the first bits flipped (to 1,
    so a pair meets once)."""
    high = keys >> rest
    at = [(part, True, rows) for part, rows in _slices(high)]
    flips = [np.flatnonzero(high >> i & 1 == 0) for i in range(first)]
    sent = np.concatenate([np.zeros(0, np.int64), *flips])
    to = np.concatenate([np.zeros(0, np.int64), *(high[f] | 1 << i for i, f in enumerate(flips))])
    return keys & ((1 << rest) - 1), at + [(part, False, sent[rows]) for part, rows in _slices(to)]


def _row_lists(values: pa.Array, at: list[tuple[int, bool, np.ndarray]]) -> pa.Array:
    offsets = pa.array(np.cumsum([0, *(len(rows) for _, _, rows in at)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values.take(pa.array(np.concatenate([rows for _, _, rows in at]))))


def _packed_keys(plan: SignTables, first: int, seed: int):
    """Batches (id, vector) -> a row for each table and value of the keys'
    first bits: ids, other bits, filter bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = _bits(plan, seed)
        for batch in _full(batches):
            words, keys = signs(_matrix(batch.column(1)))
            for table in range(plan.tables):
                low, at = _places(keys[:, table], plan.width - first, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([table] * len(at), pa.int32()), pa.array([p for p, _, _ in at], pa.int64()), pa.array([o for _, o, _ in at]),
                     _row_lists(batch.column(0), at),
                     pa.array([low[rows].tobytes() for _, _, rows in at], pa.binary()),
                     pa.array([words[rows].tobytes() for _, _, rows in at], pa.binary())],
                    names=["table", "part", "own", "ids", "keys", "words"])
    return run


def _signed(plan: SignTables, seed: int):
    """Batches (id, vector) -> a row for each: ids, filter bits, a row of keys
    for each table, and the vectors of unit length in a byte a number, with what
    a byte stands for and the length of what is lost."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = _bits(plan, seed)
        for batch in _full(batches):
            x = _matrix(batch.column(1))
            words, keys = signs(x)
            with np.errstate(all="ignore"):
                unit = x / np.linalg.norm(x, axis=1)[:, None]
                step = np.abs(unit).max(axis=1) / 127
                small = np.rint(unit / step[:, None])
                lost = np.linalg.norm(unit - small * step[:, None], axis=1)
                small = small.astype(np.int8)
            offsets = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(offsets, batch.column(0)), pa.array([words.tobytes()], pa.binary()),
                 pa.array([[k.astype(_kind(plan)).tobytes() for k in keys.T]], pa.list_(pa.binary())), pa.array([small.tobytes()], pa.binary()),
                 pa.array([np.stack([step, lost], axis=1).tobytes()], pa.binary())],
                names=["ids", "words", "keys", "small", "steps"])
    return run


def _dealt(plan: SignTables, first: int, tables: range):
    """``_signed`` rows with the keys of ``tables`` only -> as ``_packed_keys``,
    for these, with all these tables' keys and the vectors in bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(0)[r].values
                n = len(ids)
                words, small, steps = (np.frombuffer(batch.column(i)[r].as_buffer(), np.uint8).reshape(n, -1) for i in (1, 3, 4))
                keys = np.stack([np.frombuffer(k.as_buffer(), _kind(plan)) for k in batch.column(2)[r].values], axis=1)
                for i, table in enumerate(tables):
                    low, at = _places(keys[:, i].astype(np.int64), plan.width - first, first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([table] * len(at), pa.int32()), pa.array([p for p, _, _ in at], pa.int64()),
                         pa.array([o for _, o, _ in at]), _row_lists(ids, at),
                         *(pa.array([v[rows].tobytes() for _, _, rows in at], pa.binary()) for v in (low, words, keys, small, steps))],
                        names=["table", "part", "own", "ids", "keys", "words", "others", "small", "steps"])
    return run


def _ranges(left: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``left[i]`` and the numbers from ``lo[i]`` to before ``hi[i]``, some at a time."""
    counts = hi - lo
    left, lo, counts = left[counts > 0], lo[counts > 0], counts[counts > 0]
    total = np.cumsum(counts)
    start = 0
    while start < len(left):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _CHUNK, "right")))
        n = counts[start:end]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(left[start:end], n), np.repeat(lo[start:end], n) + inside
        start = end


def _first_meeting(others: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs meet in none of these tables."""
    new = np.ones(len(a), bool)
    for keys in others.T:
        new[new] = np.bitwise_count(keys[a[new]] ^ keys[b[new]]) > 1
    return new


def _reach(small: np.ndarray, steps: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may have a cosine of ``threshold``, as far as bytes tell."""
    step, lost = steps.T
    out = np.empty(len(a), bool)
    for lo in range(0, len(a), _CHUNK >> 4):
        i, j = a[lo:lo + (_CHUNK >> 4)], b[lo:lo + (_CHUNK >> 4)]
        cosine = np.einsum("ij,ij->i", small[i].astype(np.float64), small[j].astype(np.float64)) * step[i] * step[j]
        out[lo:lo + len(i)] = ~(cosine + lost[i] + lost[j] + 3 * lost[i] * lost[j] + 1e-9 < threshold)
    return out


def _met(plan: SignTables, first: int, limit: int, tables: range | None = None, threshold: float = -1.0):
    """Rows of one table and part after the other, own ones first -> pairs that
    meet there and differ in ``limit`` bits at most; with ``tables`` (rows of
    ``_dealt``) only those that meet in no table before, and may reach the
    threshold."""
    rest = plan.width - first

    def pairs(table: int, ids: pa.Array, own: int, keys: np.ndarray, words: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keys[:own], kind="stable")
        k, probes = keys[order], np.arange(own, len(keys))
        here = np.arange(own)
        meetings = [(order, here + 1, np.searchsorted(k, k, "right")),
                    (probes, np.searchsorted(k, keys[probes], "left"), np.searchsorted(k, keys[probes], "right"))]
        for i in range(rest):
            low = here[k >> i & 1 == 0]
            other = k[low] | 1 << i
            meetings.append((order[low], np.searchsorted(k, other, "left"), np.searchsorted(k, other, "right")))
        for left, lo, hi in meetings:
            for a, b in _ranges(left, lo, hi):
                b = order[b]
                differ = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int32)
                near = differ <= limit
                a, b, differ = a[near], b[near], differ[near]
                if tables is not None:
                    others, small, steps = more
                    near = np.flatnonzero(_first_meeting(others[:, :table - tables.start], a, b))
                    near = near[_reach(small, steps, a[near], b[near], threshold)]
                    a, b, differ = a[near], b[near], differ[near]
                x, y = ids.take(pa.array(a)), ids.take(pa.array(b))
                before = pa.compute.less(x, y)
                out = pa.RecordBatch.from_arrays(
                    [pa.compute.if_else(before, x, y), pa.compute.if_else(before, y, x), pa.array(differ)],
                    names=["src", "dst", "differ"])
                yield out.filter(pa.compute.not_equal(x, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def column(r: int, i: int, n: int, kind: type) -> np.ndarray:
            return np.frombuffer(batch.column(i)[r].as_buffer(), kind).reshape(n, -1)

        def ended() -> Iterator[pa.RecordBatch]:
            if any(own for own, *_ in held):
                own = sum(len(ids) for is_own, ids, *_ in held if is_own)
                ids = pa.concat_arrays([x[1] for x in held])
                keys, *more = (np.concatenate(x) for x in list(zip(*held, strict=True))[2:])
                held.clear()
                yield from pairs(at[0], ids, own, keys[:, 0], *more)
                del ids, keys, more
                pa.default_memory_pool().release_unused()
        for batch in batches:
            for r in range(batch.num_rows):
                here = (batch.column(0)[r].as_py(), batch.column(1)[r].as_py())
                if here != at:
                    yield from ended()
                    at, held = here, []
                ids = batch.column(3)[r].values
                n = len(ids)
                row = [column(r, 4, n, np.int64), column(r, 5, n, np.uint64)]
                if tables is not None:
                    row += [column(r, 6, n, _kind(plan)), column(r, 7, n, np.int8), column(r, 8, n, np.float64)]
                held.append((batch.column(2)[r].as_py(), ids, *row))
        yield from ended()
    return run


def _runs(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Equal neighbours."""
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1), len(values)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield int(values[lo]), slice(lo, hi)


def _cosines(threshold: float):
    """Rows (place, asks, number, id, vector, numbers) of one place after the
    other, its own vectors in order before those that ask for some of them ->
    pairs with a cosine of ``threshold``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, own = None, [], ()
        for batch in batches:
            for here, rows in _runs(batch.column(0).to_numpy()):
                if here != at:
                    at, held, own = here, [], ()
                part = batch.slice(rows.start, rows.stop - rows.start)
                given = part.filter(pa.compute.invert(part.column(1)))
                if given.num_rows:
                    held.append(given)
                part = part.filter(part.column(1))
                if not part.num_rows:
                    continue
                if not own:
                    all_own = pa.concat_batches(held)
                    x = _matrix(all_own.column(4))
                    own, held = (all_own.column(2).to_numpy(), all_own.column(3), x, np.linalg.norm(x, axis=1)), []
                numbers, ids, x, lengths = own
                y, asked = _matrix(part.column(4)), part.column(5)
                to = np.searchsorted(numbers, asked.flatten().to_numpy())
                by = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy())
                y_lengths = np.linalg.norm(y, axis=1)
                for lo in range(0, len(to), _CHUNK >> 4):
                    i, j = to[lo:lo + (_CHUNK >> 4)], by[lo:lo + (_CHUNK >> 4)]
                    cosine = np.einsum("ij,ij->i", x[i], y[j]) / (lengths[i] * y_lengths[j])
                    near = ~(cosine < threshold)
                    a, b, cosine = ids.take(pa.array(i[near])), part.column(3).take(pa.array(j[near])), cosine[near]
                    before = pa.compute.less(a, b)
                    out = pa.RecordBatch.from_arrays(
                        [pa.compute.if_else(before, a, b), pa.compute.if_else(before, b, a), pa.array(cosine)],
                        names=["src", "dst", "similarity"])
                    yield out.filter(pa.compute.not_equal(a, b))
    return run


def _checked(pairs: DataFrame, numbered: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Pairs of numbers with their exact cosine, of ``threshold`` at least.  A
    vector belongs to one place of ``OWN``, with others that have the same nearest
    partner, and is sent to each place where it has partners once, however many
    they are."""
    each = pairs.unionByName(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src")))
    near = each.groupBy("src").agg(F.least("src", F.min("dst")).alias("near"), F.max(F.col("src") < F.col("dst")).alias("owner"))
    order = dense_ids(near.where("owner").select(F.struct("near", "src").alias("at")), "at", "n")
    owners = materialize(order.select("at.src", F.floor(F.col("n") / OWN).cast("long").alias("place")), "owners")
    asked = pairs.join(owners, "src").groupBy("place", "dst").agg(F.collect_list("src").alias("others"))  # OWN at most
    sent = owners.select("place", F.lit(False).alias("asks"), F.col("src").alias("num"), F.lit(None).cast("array<long>").alias("others"))
    sent = sent.unionByName(asked.select("place", F.lit(True).alias("asks"), F.col("dst").alias("num"), "others"))
    placed = sent.join(numbered, "num").repartition("place").sortWithinPartitions("place", "asks", "num")
    return placed.select("place", "asks", "num", "id", "v", "others").mapInArrow(
        _cosines(threshold), f"src {kind}, dst {kind}, similarity double")


def sign_candidates(vectors: DataFrame, plan: SignTables, id_col: str = "id", vec_col: str = "embedding",
                    seed: int = 42, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(met, candidates)``: pairs ``src < dst`` in the tables where they meet
    with their number of different bits, and the distinct ones within the
    distance.  Vectors must be of one length and not zero.  ``first``: bits of a
    key that name the place where it is compared."""
    kind = vectors.schema[id_col].dataType.simpleString()
    packed = vectors.select(F.col(id_col).alias("id"), as_double(vec_col).alias("v")).mapInArrow(
        _packed_keys(plan, first, seed), f"table int, part long, own boolean, ids array<{kind}>, keys binary, words binary")
    placed = packed.repartition("table", "part").sortWithinPartitions("table", "part", F.col("own").desc())

    def met(limit: int) -> DataFrame:
        return placed.mapInArrow(_met(plan, first, limit), f"src {kind}, dst {kind}, differ int")
    return met(FILTER), met(plan.distance).select("src", "dst").distinct()


def _round_tables(plan: SignTables, n: int, dims: int, first: int) -> int:
    """Tables whose keys are dealt out at once: as many as take ``ROUND`` bytes,
    or twice those of the vectors."""
    most = max(ROUND, 16 * n * dims)
    tables = 1
    while tables < plan.tables and n * (1 + first / 2) * (tables + 1) * (dims + 72 + _kind(plan).itemsize * (tables + 1)) <= most:
        tables += 1
    return tables


def similarity_edges_signs(vectors: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "embedding",
                           recall: float = 0.95, seed: int = 42) -> DataFrame:
    """Approximate J6: ``(src, dst, similarity)`` of pairs with cosine
    ``>= threshold``; a pair is found with probability ``recall`` at least (more
    if it is nearer), and none that is below the threshold is given out.

    Null and zero vectors are similar to nothing.  Ids must be unique, the
    threshold within 0 and 1, both excluded.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold must be between 0 and 1")
    kind = vectors.schema[id_col].dataType.simpleString()
    usable = vectors.select(F.col(id_col).alias("id"), as_double(vec_col).alias("v")).where(
        F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull()) & F.col("id").isNotNull())
    numbered = materialize(usable.select(F.monotonically_increasing_id().alias("num"), "id", "v"), "vectors")
    n, dims = numbered.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], f"src {kind}, dst {kind}, similarity double")
    plan = sign_tables(n, threshold, recall)
    first = min(plan.width, max(0, math.ceil(math.log2(n / GROUP))))
    size = _round_tables(plan, n, dims, first)
    rounds = [range(lo, min(lo + size, plan.tables)) for lo in range(0, plan.tables, size)]
    signed = materialize(numbered.select("num", "v").mapInArrow(
        _signed(plan, seed), "ids array<long>, words binary, keys array<binary>, small binary, steps binary").select(
        "ids", "words", "small", "steps", *[F.slice("keys", x.start + 1, len(x)).alias(f"keys{x.start}") for x in rounds]), "signed")
    found: list[DataFrame] = []
    for tables in rounds:
        placed = signed.select("ids", "words", f"keys{tables.start}", "small", "steps").mapInArrow(
            _dealt(plan, first, tables), "table int, part long, own boolean, ids array<long>, keys binary, words binary, "
                                         "others binary, small binary, steps binary"
        ).repartition("table", "part").sortWithinPartitions("table", "part", F.col("own").desc())
        pairs = placed.mapInArrow(_met(plan, first, plan.distance, tables, threshold), "src long, dst long, differ int").select("src", "dst")
        if found:
            pairs = pairs.join(reduce(DataFrame.unionByName, found), ["src", "dst"], "left_anti")
        with setting(vectors.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "4"):  # rows of many vectors
            found.append(materialize(pairs, "pairs"))
    return _checked(reduce(DataFrame.unionByName, found), numbered, threshold, kind)

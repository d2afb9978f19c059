"""Conversation structure repair by iterative-deepening A* (operator 12).

A conversation is sound if its role initials spell ``(s?(ua)+)?``.  Repairing it
is a cheapest path: its rows are read in order and each is kept (0), given the
role that must come next (``R``, 3) or deleted (``D``, 4); rows may be inserted
before any (``I``, 3).  Blank and repeated rows must be deleted; a row that
stays though its text is cut off costs 3 more.

The path is found by depth-first search in the ASCII order of the edits, under
a cost bound that grows to the least sum by which the last search was stopped.
The estimate of what is still to come counts the costs no path avoids, and for
every pair of rows that cannot be neighbours half the least cost of an edit that
touches it.  A table holds for each place and state the largest budget that
failed there.  The first path found is a cheapest one, and of those the least.

Long conversations are searched in segments of ``SEGMENT`` rows, from the last
to the first: a segment's search ends at a price for each state, the cost of the
rest from there.  Paths of a segment end with an edit that reads a row, so none
is the beginning of another, and the least path of the whole is made of the
least of the segments.  Rows that must be deleted need no search: their ``D``
come before any insertion.

As Spark work: rows become digests, equal rows of a turn are counted before the
shuffle, and the table is ranged by conversation and turn, so that a
conversation of any share of all rows is spread over many tasks.  A task solves
the conversations that lie within its range; of those that reach over its ends,
or beyond ``PART`` rows, it solves parts, for all states before and after, which
are then put together.  Texts are shuffled once, behind the edits of their
conversation, and stream through (a SHA-256 is made in one place, in order).

Defined results: null roles and texts are one space; rows of one turn (null
turns first) are ordered by role and digest of the text; rows without a
``conv_id`` are one conversation; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgraph.llm.common import materialize

SEGMENT = 16
PART = 4096

# States: nothing yet, after system, after user, after assistant.
# Classes of role initials: s, u, a, any other.
_KEEP = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
_MADE = (2, 2, 3, 2)                       # state after an inserted or changed row
_CLASS = {"s": 0, "u": 1, "a": 2}
_ROLE = {2: "user", 3: "assistant"}
# Costs are counted twice, so that halves stay whole.
_DELETE, _OTHER = 8, 6
_END = (0, 2 * _OTHER, _OTHER, 0)          # rows to insert behind the last one
_NEVER = 1 << 60


def _estimates(rows: bytes, ends: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """What is to come at least, for each place and state."""
    def base(row: int) -> int:             # no edit of the row costs less
        other, cut = row >> 1 == 3, row & 1
        return _DELETE if other and cut else _OTHER if other or cut else 0

    def half(row: int) -> int:             # half of what a changing edit costs beyond that
        return 0 if row >> 1 == 3 else 1 if row & 1 else 3
    out = [tuple(ends)]
    rest, after = min(ends), None
    for row in reversed(rows):
        rest += base(row)
        if after is not None and _KEEP[(row >> 1) + 1 if row >> 1 < 3 else 0][after >> 1] < 0:
            rest += min(half(row), half(after))
        kind, own = row >> 1, half(row)
        out.append(tuple(rest + (own if _KEEP[state][kind] < 0 else 0) for state in range(4)))
        after = row
    return out[::-1]


def cheapest(rows: bytes, start: int, ends: Sequence[int]) -> tuple[int, str, int]:
    """Twice the cost (with the price of the end), the edits and the state
    reached, of the least cheapest path over rows of class * 2 + cut-off."""
    n = len(rows)
    reachable = {start} | ({2, 3} if n else set()) | ({1} if start == 0 and any(r < 2 for r in rows) else set())
    if all(ends[s] >= _NEVER for s in reachable):
        return _NEVER, "", start
    need = _estimates(rows, ends)
    failed = [list(x) for x in need]       # grows where a budget has failed
    path: list[str] = []
    over, reached = 0, start

    def go(i: int, state: int, left: int) -> bool:
        nonlocal over, reached
        lower = failed[i][state]
        if lower > left:
            over = min(over, lower - left)
            return False
        if i == n:
            reached = state
            return True
        row = rows[i]
        cut = _OTHER * (row & 1)
        kept = _KEEP[state][row >> 1]
        path.append("D")
        if go(i + 1, state, left - _DELETE):
            return True
        path[-1] = "I"
        if go(i, _MADE[state], left - _OTHER):
            return True
        if kept >= 0:
            path[-1] = "K"
            if go(i + 1, kept, left - cut):
                return True
        path[-1] = "R"
        if go(i + 1, _MADE[state], left - _OTHER - cut):
            return True
        path.pop()
        failed[i][state] = max(failed[i][state], left + 2)
        return False

    bound = need[0][start]
    while True:
        bound += bound & 1
        over = _NEVER
        if go(0, start, bound):
            return bound, "".join(path), reached
        bound += over


def solve(rows: bytes, starts: Sequence[int], ends: Sequence[int]) -> dict[int, tuple[int, str, int]]:
    """``cheapest`` for rows of any number, by segments from the last one on."""
    cuts = list(range(0, len(rows), SEGMENT)) or [0]
    price, found = list(ends), []
    for k, lo in enumerate(reversed(cuts)):
        seg = rows[lo:lo + SEGMENT]
        at = {s: cheapest(seg, s, price) for s in (starts if k == len(cuts) - 1 else range(4))}
        found.append(at)
        price = [at[s][0] if s in at else _NEVER for s in range(4)]
    out = {}
    for s in starts:
        edits, state = [], s
        for at in reversed(found):
            _, part, state = at[state]
            edits.append(part)
        out[s] = (found[-1][s][0], "".join(edits), state)
    return out


@dataclass
class Part:
    """Some neighbouring rows of one conversation, and what is known of them."""

    conv_id: object
    rows: bytearray = field(default_factory=bytearray)     # those that need not be deleted
    deleted: array = field(default_factory=lambda: array("q", [0]))  # rows to delete before each, and behind
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])  # blank, duplicate, truncated, illegal
    turns: list = field(default_factory=lambda: [0, None, None])     # distinct, least, greatest
    ends: list = field(default_factory=lambda: [None, None])         # first and last role class

    def add(self, turn: int | None, role: str, fault: int, earlier: bool, n: int) -> None:
        """``n`` equal rows; fault: 0 none, 1 truncated, 2 blank."""
        if not n:
            return
        kind = _CLASS.get(role[:1], 3)
        if turn is not None and turn != self.turns[2]:
            self.turns = [self.turns[0] + 1, turn if self.turns[1] is None else self.turns[1], turn]
        self.counts[3] += n - 1 + (self.ends[1] is not None and not _neighbours(self.ends[1], kind))
        self.ends = [kind if self.ends[0] is None else self.ends[0], kind]
        if fault == 2 or earlier:
            self.counts[0 if fault == 2 else 1] += n
            self.deleted[-1] += n
            return
        self.counts[1] += n - 1
        self.counts[2] += fault
        self.rows.append(kind * 2 + fault)
        self.deleted.append(n - 1)

    def edits(self, searched: str) -> str:
        """The search's edits with the deletions that needed none."""
        out, at = ["D" * self.deleted[0]], 0
        for c in searched:
            out.append(c)
            if c != "I":
                at += 1
                out.append("D" * self.deleted[at])
        return "".join(out)

    def row(self, order: int, whole: bool) -> tuple:
        """One output row; a whole conversation has one solution, a part 16."""
        must = _DELETE * sum(self.deleted)
        if whole:
            found = [solve(bytes(self.rows), [0], _END)[0]]
        else:
            found = []
            for end in range(4):
                ends = [0 if s == end else _NEVER for s in range(4)]
                got = solve(bytes(self.rows), range(4), ends)
                found += [got[s] for s in range(4)]
        edits = [(self.edits(e) if c < _NEVER else "") for c, e, _ in found]
        if whole:
            edits[0] += "I" * (_END[found[0][2]] // _OTHER)
        return (self.conv_id, order, whole, *self.counts, *self.turns, *self.ends,
                [min(c + must, _NEVER) for c, _, _ in found], edits)


def _neighbours(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


_PART_COLUMNS = ("part long, whole boolean, blank long, duplicate long, truncated long, illegal long, "
                 "turns long, low long, high long, first int, last int, costs array<long>, edits array<string>")
_PART_TYPES = [pa.int64(), pa.bool_(), *[pa.int64()] * 7, pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string())]
_SOLVED_COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_SOLVED_TYPES = [*[pa.int64()] * 6, pa.string()]


def _names(columns: str) -> list[str]:
    return ["conv_id", *(c.split()[0] for c in columns.split(", "))]


def _batch(rows: list[tuple], kind: pa.DataType, types: list, columns: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate([kind, *types])], names=_names(columns))


def _solve_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of a range of sorted rows (conv_id, turn, role, fault, earlier, n)."""
    order = TaskContext.get().partitionId() << 32
    part: Part | None = None
    first, out, kind = True, [], None
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv_id, turn, role, fault, earlier, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part is not None and (part.conv_id != conv_id or len(part.rows) >= PART):
                whole = part.conv_id != conv_id and not first
                out.append(part.row(order, whole))
                # what follows a part of the same conversation is a part too
                first = part.conv_id == conv_id
                part, order = None, order + 1
                if len(out) >= 256:
                    yield _batch(out, kind, _PART_TYPES, _PART_COLUMNS)
                    out = []
            part = part or Part(conv_id)
            part.add(turn, role, fault, earlier, n)
    if part is not None:
        out.append(part.row(order, False))
    if out:
        yield _batch(out, kind, _PART_TYPES, _PART_COLUMNS)


def _least(parts: list[tuple]) -> tuple[int, str]:
    """Cost and edits of the parts (costs, edits) one after the other."""
    price, best = list(_END), []
    for costs, _ in reversed(parts):
        best.append(price)
        price = [min(costs[4 * e + s] + price[e] for e in range(4)) for s in range(4)]
    total, state, out = price[0], 0, []
    for (costs, edits), price in zip(parts, reversed(best), strict=True):
        cost = min(costs[4 * e + state] + price[e] for e in range(4))
        text, state = min((edits[4 * e + state], e) for e in range(4) if costs[4 * e + state] + price[e] == cost)
        out.append(text)
    return total // 2, "".join(out) + "I" * (_END[state] // _OTHER)


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solutions of conversations from their sorted parts."""
    held: list[tuple] = []

    def done() -> pa.RecordBatch:
        counts, distinct, low, high, last = [0, 0, 0, 0], 0, None, None, None
        for p in held:
            counts = [a + b for a, b in zip(counts, p[3:7], strict=True)]
            if p[10] is not None and last is not None and not _neighbours(last, p[10]):
                counts[3] += 1
            last = last if p[11] is None else p[11]
            if p[8] is not None:
                distinct += p[7] - (p[8] == high)
                low, high = p[8] if low is None else low, p[9]
        gaps = 0 if low is None else high - low + 1 - distinct
        cost, audit = _least([p[12:14] for p in held])
        return _batch([(held[0][0], gaps, *counts, cost, audit)], kind, _SOLVED_TYPES, _SOLVED_COLUMNS)
    for batch in batches:
        kind = batch.schema.field(0).type
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield done()
                held = []
            held.append(row)
    if held:
        yield done()


def _plain(rows: DataFrame) -> DataFrame:
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text"), F.lit(" ")).alias("text"), copies.alias("copies"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


_ORDER = ("conv_id", "turn", "role", "digest")   # ascending, nulls first


def audits(rows: DataFrame) -> DataFrame:
    """For each ``conv_id``: ``gaps, blank, duplicate, truncated, illegal, cost,
    audit``.  ``rows``: ``conv_id, turn, role, text`` and, if there is such a
    column, ``copies``, how often the row stands there (0: not at all)."""
    plain = _plain(rows)
    stripped = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(stripped == "", 2).when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    counted = materialize(plain.select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"),
                                       fault.alias("fault"), "copies")
                          .groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("n")), "turns")
    seen = (counted.where("n > 0").groupBy("conv_id", "role", "digest")
            .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count("*").alias("times"))
            .where("times > 1"))
    seen = materialize(seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"),
                                   F.col("first.turn").alias("first_turn"), F.lit(True).alias("again")), "seen")
    again = F.col("again").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    marked = counted.join(
        seen, counted["conv_id"].eqNullSafe(seen["c"]) & (counted["role"] == seen["r"]) & (counted["digest"] == seen["d"]),
        "left").select("conv_id", "turn", "role", "digest", "fault", again.alias("earlier"), "n")
    kind = counted.schema["conv_id"].dataType.simpleString()
    parts = materialize(
        marked.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
        .select("conv_id", "turn", "role", "fault", "earlier", "n")
        .mapInArrow(_solve_range, f"conv_id {kind}, {_PART_COLUMNS}"), "parts")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    whole = parts.where("whole").select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.expr("costs[0] div 2").alias("cost"), F.col("edits")[0].alias("audit"))
    pieces = parts.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.unionByName(pieces.mapInArrow(_join_parts, f"conv_id {kind}, {_SOLVED_COLUMNS}"))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """Each conversation's solution and its repaired rows, from a sorted stream
    of solutions, each before its rows."""
    def stream():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
    ahead = stream()
    row = next(ahead, None)

    def rows_of(audit: str) -> Iterator[tuple[str, str]]:
        nonlocal row
        at, state, left = 0, 0, 0
        while True:
            if left == 0:
                row = next(ahead, None)
                if row is None or row[1] == 0:
                    break
                left = row[4]
                continue
            left -= 1
            while audit[at] == "I":
                state = _MADE[state]
                yield _ROLE[state], ""
                at += 1
            edit, role, text = audit[at], row[2], row[3]
            at += 1
            if edit == "R":
                state = _MADE[state]
                yield _ROLE[state], text
            elif edit == "K":
                state = _KEEP[state][_CLASS[role[:1]]]
                yield role, text
        for _ in audit[at:]:
            state = _MADE[state]
            yield _ROLE[state], ""
    while row is not None:
        solution = row
        rows = rows_of(solution[-1])
        yield solution, rows
        for _ in rows:  # in case the caller did not read them all
            pass


def _stream(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Solutions, each followed by the rows of its conversation in order."""
    none = lambda kind: F.lit(None).cast(kind)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    heads = solved.select("conv_id", F.lit(0).alias("kind"), none("string").alias("role"), none("string").alias("text"),
                          none("long").alias("copies"), none("long").alias("turn"), none("binary").alias("digest"), *numbers, "audit")
    texts = _plain(rows).where("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), "role", "text", "copies", "turn", _digest(F.col("text")).alias("digest"),
        *[none("long").alias(c) for c in numbers], none("string").alias("audit"))
    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return both.select("conv_id", "kind", "role", "text", "copies", *numbers, "audit")


def repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place`` (from 0), ``role, text``.
    ``solved`` is the written result of ``audits`` over the same rows."""
    kind = solved.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None

        def typed():
            nonlocal key
            for batch in batches:
                key = batch.schema.field(0).type
                yield batch

        def flush(out: list[tuple]) -> pa.RecordBatch:
            return _batch(out, key, [pa.int64(), pa.string(), pa.string()], "place, role, text")
        out: list[tuple] = []
        for solution, found in _edited(typed()):
            for place, (role, text) in enumerate(found):
                out.append((solution[0], place, role, text))
                if len(out) >= 1000:
                    yield flush(out)
                    out = []
        if out:
            yield flush(out)
    return _stream(rows, solved).mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def digests(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """``solved`` with ``repaired_sha256``, the hash of the repaired rows as
    ``role:text``, joined by newlines."""
    kind = solved.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None

        def typed():
            nonlocal key
            for batch in batches:
                key = batch.schema.field(0).type
                yield batch
        out: list[tuple] = []
        columns = _SOLVED_COLUMNS + ", repaired_sha256"
        for solution, found in _edited(typed()):
            sha, gap = hashlib.sha256(), ""
            for role, text in found:
                sha.update(f"{gap}{role}:{text}".encode())
                gap = "\n"
            out.append((solution[0], *solution[5:], sha.hexdigest()))
            if len(out) >= 1000:
                yield _batch(out, key, [*_SOLVED_TYPES, pa.string()], columns)
                out = []
        if out:
            yield _batch(out, key, [*_SOLVED_TYPES, pa.string()], columns)
    return _stream(rows, solved).mapInArrow(run, f"conv_id {kind}, {_SOLVED_COLUMNS}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by the CRC-32 of ``conv_id:turn`` modulo 20: 0
    drops a row, 1 empties its text, 2 takes its ``.!?``, 3 doubles it, 4 makes
    its role user.  Nulls are one space."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = shown("text")
    return conversations.select(
        "conv_id", "turn", F.when(fate == 4, F.lit("user")).otherwise(shown("role")).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Damage, repair, and a row of figures and digests per conversation."""
    rows = damaged(conversations)
    return digests(rows, materialize(audits(rows), "audits"))

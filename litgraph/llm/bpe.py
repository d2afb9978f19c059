"""Byte-level BPE encoding by replay of the merges, and decoding (operator 13).

Texts are split into pieces by a pattern, and the distinct pieces of a stretch
of the corpus (``BLOCK`` bytes of texts) are its words: each is encoded once,
however often it occurs.  Words that are tokens are done.  The others lie one
after the other as a chain of byte tokens, and an inverted index leads from
every pair of neighbouring tokens (by the rank of the token they make) to its
places in the words.  A heap gives the present ranks in rising order; a rank's
merge is applied at all its places in all words at once as array work, and only
the pairs with the two touched neighbours are looked up and indexed anew.

Applying a rank everywhere equals merging word by word (lowest rank first,
leftmost on ties) as long as no merge makes a pair of a lower rank.  Ranks that
may do so are known from the vocabulary.  For them the pairs that would arise
are looked up first; in a word where one is lower, the places after it wait
until the lower rank has had its turn.

Texts stay where they are scanned: nothing is shuffled, a task holds one block,
and a lost task is computed again from its input.

Defined results: a null or empty text has no ids; null or repeated doc ids give
one row each; other columns are not looked at.  Long texts are matched in
stretches of ``STRETCH`` pieces and hashed in parts; a piece is not split.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 24      # bytes of texts whose words are encoded together
REPLAY = 1 << 22     # bytes of words that one index covers (one word at least)
STRETCH = 1 << 18    # pieces or ids handled at a time
_NONE = -1


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Vocabulary:
    """A rank file: every line has a token in base64 and its rank, the id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        get, left, right, made = self.ranks.get, [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        a, b, c = (np.array(x, np.int64) for x in (left, right, made))
        keys = a << 32 | b
        order = np.argsort(keys)
        # a key above all others ends the table, so that every search has a hit
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.made = np.append(c[order], _NONE)
        #: Ranks whose token makes a token of a lower rank with some neighbour.
        self.may_sink = set(a[c < a].tolist()) | set(b[c < b].tolist())

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or -1."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], _NONE)


class Replay:
    """All merges over some words, in rank order."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]) -> None:
        self.v = vocabulary
        sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        self.token = vocabulary.bytes[np.frombuffer(b"".join(words), np.uint8)]
        self.next, self.prev = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.next[self.starts + sizes - 1] = _NONE
        self.prev[self.starts] = _NONE
        self.rank = np.full(n, _NONE, np.int64)        # of the pair that begins here
        pairs = np.flatnonzero(self.next != _NONE)
        self.rank[pairs] = vocabulary.pair_ranks(self.token[pairs], self.token[pairs + 1])
        # the inverted index: first the pairs of bytes, then what merges add
        pairs = pairs[self.rank[pairs] != _NONE]
        pairs = pairs[np.argsort(self.rank[pairs], kind="stable")]
        present, cut = np.unique(self.rank[pairs], return_index=True)
        self.places: dict[int, list] = {
            r: [p] for r, p in zip(present.tolist(), np.split(pairs, cut[1:]), strict=True)} if len(present) else {}
        self.heap = present.tolist()
        heapify(self.heap)

    def _take(self, rank: int) -> tuple[np.ndarray, np.ndarray]:
        """The rank's places, and of those that share a token the leftmost."""
        listed = self.places.pop(rank)
        first = listed[0] if isinstance(listed[0], np.ndarray) else np.array(listed, np.int64)
        if isinstance(listed[0], np.ndarray) and len(listed) > 1:
            first = np.append(first, np.array(listed[1:], np.int64))
        every = at = _distinct(first[self.rank[first] == rank])
        meets = self.next[at[:-1]] == at[1:]
        if meets.any():
            i = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.append(False, meets), 0, i))
            at = at[(i - run) & 1 == 0]
        return every, at

    def _waiting(self, rank: int, at: np.ndarray) -> np.ndarray:
        """Which places must wait: those that follow in their word a place
        whose merge makes a pair of a lower rank."""
        own = np.int64(rank)

        def lower(left, right, there):
            made = self.v.pair_ranks(left, right)
            return there & (made != _NONE) & (made < own)
        before, after = self.prev[at], self.next[self.next[at]]
        has_before, has_after = before != _NONE, after != _NONE
        same = np.full(len(at), own)
        sinks = (lower(self.token[before], same, has_before) | lower(same, self.token[after], has_after)
                 | lower(same, same, has_before | has_after))
        if not sinks.any():
            return np.zeros(len(at), bool)
        word = np.searchsorted(self.starts, at, "right")
        seen = np.cumsum(sinks) - sinks
        new_word = np.append(True, word[1:] != word[:-1])
        return seen > np.maximum.accumulate(np.where(new_word, seen, 0))

    def _list(self, at: np.ndarray) -> None:
        ranks = self.rank[at]
        known = ranks != _NONE
        for r, p in zip(ranks[known].tolist(), at[known].tolist(), strict=True):
            listed = self.places.get(r)
            if listed is None:
                self.places[r] = [p]
                heappush(self.heap, r)
            else:
                listed.append(p)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's ids begin (and the end)."""
        token, nxt, prev = self.token, self.next, self.prev
        while self.heap:
            rank = heappop(self.heap)
            every, at = self._take(rank)
            if not len(at):
                continue
            if rank in self.v.may_sink:
                wait = self._waiting(rank, at)
                if wait.any():
                    self.places[rank] = [every]  # those merged now drop out by their rank
                    heappush(self.heap, rank)
                    at = at[~wait]
            gone = nxt[at]
            after = nxt[gone]
            token[at], token[gone] = rank, _NONE
            self.rank[at] = self.rank[gone] = _NONE
            nxt[at] = after
            inner = after != _NONE
            prev[after[inner]] = at[inner]
            before = prev[at]
            touched = np.append(at[inner], before[before != _NONE])
            if len(touched):
                touched = _distinct(touched)
                self.rank[touched] = self.v.pair_ranks(token[touched], token[nxt[touched]])
                self._list(touched)
        alive = np.flatnonzero(token != _NONE)
        return token[alive], np.append(np.searchsorted(alive, self.starts), len(alive))


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after the other, and each word's number of ids."""
    known = [vocabulary.ranks.get(w, _NONE) for w in words]
    sizes = np.ones(len(words), np.int64)
    rest = [i for i, k in enumerate(known) if k == _NONE]
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(rest):
        hi, held = lo, 0
        while hi < len(rest) and (hi == lo or held + len(words[rest[hi]]) <= REPLAY):
            held += len(words[rest[hi]])
            hi += 1
        ids, begin = Replay(vocabulary, [words[i] for i in rest[lo:hi]]).run()
        which = np.array(rest[lo:hi], np.int64)
        sizes[which] = np.diff(begin)
        parts.append((which, ids, begin))
        lo = hi
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    direct = np.flatnonzero(np.array(known, np.int64) != _NONE)
    out[ends[direct] - 1] = np.array(known, np.int64)[direct]
    for which, ids, begin in parts:
        size = np.diff(begin)
        out[np.repeat(ends[which] - size - begin[:-1], size) + np.arange(len(ids))] = ids
    return out, sizes


class _Numbers(dict):
    """Numbers new keys in order of appearance."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def _encode_block(vocabulary: Vocabulary, pattern, texts: list[str]) -> pa.Array:
    """A list of ids for every text."""
    numbers, parts, lengths = _Numbers(), [], []
    for text in texts:
        before = len(parts)
        if len(text) <= 4 * STRETCH:
            found = pattern.findall(text)
            parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
        else:
            matches = pattern.finditer(text)
            while found := [m.group() for m in islice(matches, STRETCH)]:
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
        lengths.append(sum(map(len, parts[before:])))
    ids, sizes = encode_words(vocabulary, [w.encode() for w in numbers])
    begin = np.cumsum(sizes) - sizes
    flat, per_piece = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for words in parts:
        for i in range(0, len(words), STRETCH):
            w = words[i:i + STRETCH]
            size = sizes[w]
            shift = begin[w] - (np.cumsum(size) - size)
            flat.append(ids[np.repeat(shift, size) + np.arange(int(size.sum()))])
            per_piece.append(size)
    upto = np.append(0, np.cumsum(np.concatenate(per_piece)))[np.append(0, np.cumsum(lengths, dtype=np.int64))]
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))


_held: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file, read once in a process."""
    if path not in _held:
        _held[path] = Vocabulary(path)
    return _held[path]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every text.  ``ranks`` is the path of
    the rank file on every machine; ids of a text are below 2^31 in number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        compiled, v = regex.compile(pattern), vocabulary(ranks)
        doc_ids, texts, held = [], [], 0

        def done() -> pa.RecordBatch:
            out = _encode_block(v, compiled, texts)
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), out], names=["doc_id", "ids"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= BLOCK:
                    yield done()
                    doc_ids, texts, held = [], [], 0
        if doc_ids:
            yield done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, ids array<int>")


def _parts(ids: np.ndarray) -> Iterator[list[int]]:
    for i in range(0, len(ids), STRETCH):
        yield ids[i:i + STRETCH].tolist()


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, decoded`` (binary) of ``doc_id, ids``; an id that the
    vocabulary lacks is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(ranks).tokens.__getitem__
        for batch in batches:
            for row in range(batch.num_rows):
                found = batch.column(1)[row].values
                ids = np.zeros(0, np.int32) if found is None else found.to_numpy()
                raw = b"".join(b"".join(map(token, part)) for part in _parts(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1), pa.array([raw], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(encoded: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the hashes of the ids
    as decimal text and of the bytes that the ids decode to, part by part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(ranks).tokens.__getitem__
        for batch in batches:
            n, texts, raws = [], [], []
            lists = batch.column(1)
            values, upto = lists.values.to_numpy(), lists.offsets.to_numpy()
            for lo, hi in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                text, raw, space = hashlib.sha256(), hashlib.sha256(), ""
                for part in _parts(values[lo:hi]):
                    text.update((space + " ".join(map(str, part))).encode())
                    raw.update(b"".join(map(token, part)))
                    space = " "
                n.append(hi - lo)
                texts.append(text.hexdigest())
                raws.append(raw.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(texts, pa.string()), pa.array(raws, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

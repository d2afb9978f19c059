"""Words and their hashes over Arrow text columns, as numpy array work.

A word is ``[^\\x20\\x09-\\x0D]+``, i.e. what ``bytes.split()`` gives on UTF-8.
Texts are processed whole, several per block; a block is at least one text
and otherwise about ``BLOCK`` bytes, which bounds a worker's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
#: A random 64-bit number per byte, and one odd base whose powers place it.
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes that one sum covers, and the factor that chains several.
PIECE = 64
CHAIN = np.uint64(0xC2B2AE3D27D4EB4F)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse (modulo 2**64) for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK)
        out = []
        for b in (BASE, BASE_INV):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Block:
    first: int             # row of the batch that the block begins with
    data: np.ndarray       # UTF-8 bytes of its texts, one after the other
    offsets: np.ndarray    # of each text in data, and the end

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, block: int = BLOCK) -> Iterator[Block]:
    """The texts of an Arrow string column (null as empty) in bounded blocks."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + block, "right")) - 1)
        j = min(j, len(column))
        yield Block(i, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
        i = j


def word_bounds(b: Block, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first
    word (with the number of all words at the end)."""
    inside = ~separators[b.data]
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(b.rows + 1, np.int64)
    edge = np.zeros(n + 1, bool)          # a text begins here
    edge[b.offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, b.offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any stretch of bytes follows."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * p[:len(data)], dtype=np.uint64, out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal stretches of bytes have equal hashes, wherever they stand.

    Long stretches are hashed by pieces of ``PIECE`` bytes, whose mixed hashes
    are chained: sums modulo 2**64 alone would make some long words of
    regular structure (Thue-Morse words of 1024 bytes) collide.
    """
    _, inv = powers(len(sums))

    def piece(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((sums[hi] - sums[lo]) * inv[lo])
    out = piece(starts, np.minimum(ends, starts + PIECE))
    rest = np.flatnonzero(ends - starts > PIECE)
    at = starts[rest] + PIECE
    while len(rest):
        stop = np.minimum(at + PIECE, ends[rest])
        out[rest] = mix(out[rest] * CHAIN + piece(at, stop))
        more = stop < ends[rest]
        rest, at = rest[more], stop[more]
    return out


def word_hashes(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) and each text's first word."""
    low = LOWER[b.data]
    starts, ends, first = word_bounds(b)
    return stretch_hash(prefix_sums(low), starts, ends), first


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``k``-word
    shingles; fewer words make one shingle, no words make none."""
    mul = np.uint64(0xD6E8FEB86659FD93)
    for b in blocks(column):
        h, first = word_hashes(b)
        n = len(h) - k + 1
        s = np.zeros(max(n, 0), np.uint64)
        for i in range(k):
            if n > 0:
                s = mix(s * mul + h[i:i + n])
        for r in range(b.rows):
            lo, hi = int(first[r]), int(first[r + 1])
            if hi - lo >= k:
                yield np.unique(s[lo:hi - k + 1])
            elif hi > lo:
                x = np.zeros(1, np.uint64)
                for w in h[lo:hi]:
                    x = mix(x * mul + w + np.uint64(hi - lo))
                yield x
            else:
                yield np.zeros(0, np.uint64)


def count_words(column: pa.Array) -> np.ndarray:
    """Number of words of each text."""
    out = [np.diff(word_bounds(b)[2]) for b in blocks(column)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)

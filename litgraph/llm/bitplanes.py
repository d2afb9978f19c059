"""Operator 7: token ids in bit-plane files.

Format of a file (all numbers little-endian): the magic ``BPLANES1``; blocks of
``BLOCK_IDS`` ids (the last one shorter), each transposed into planes (plane i
holds byte i, or bit i, of all ids of the block) that are compressed apart with
zstandard; the index, compressed; and a footer ``<QQ8s`` with the index's place
and length and the magic.  The index holds, per block, its number of ids and the
length of each plane, and, per document, its id and number of ids.  So any block
can be read without the others.

Texts are dealt into ranges of ascending id, and one task encodes a range and
writes its file into the shared folder; the file's name holds the task attempt,
and only the files of successful attempts stand in the manifest, which is a
written table: lost executors leave unused files at worst.  A file's first token
number is the sum over the files before it.

Encoding uses the library's own byte-level BPE model.  A text splits before
every space that surely begins a token of the pre-tokenizer; the ids of such
stretches do not depend on their neighbours, so each distinct stretch is encoded
once per block and kept in a bounded cache.  Texts in which a special token is
spelled out go through the library's ``encode`` as a whole.

Defined results: a null or empty text has the end id only.  Rows with null ids
come first, rows of equal ids in the order of their texts.  Other columns are
ignored.  An empty table writes no files and gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litgraph.llm import textnum
from litgraph.llm.common import bounded_batches, materialize
from litgraph.session import scratch_path

MAGIC = b"BPLANES1"
BLOCK_IDS = 1 << 16
FOOTER = struct.Struct("<QQ8s")
CACHE = 1 << 20       # stretches kept by a worker
ENCODE_BLOCK = 2 * textnum.BLOCK
NULL_ID = -2**63


# ---- planes ---------------------------------------------------------------

def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of a block: byte i (or bit i) of every id."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [rows[:, i].tobytes() for i in range(4)]
    each = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(each[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The block's ids again (4 planes: bytes, 32: bits)."""
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1).copy().view("<u4").reshape(-1)
    each = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(each, axis=1, bitorder="little").view("<u4").reshape(-1)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, and its path there."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file; ids are kept for one block at most."""

    def __init__(self, out, bits: bool = False) -> None:
        self.out, self.bits, self.pending, self.held = out, bits, [], 0
        self.blocks: list[list[int]] = []
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.squeeze = zstandard.ZstdCompressor(level=1)
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            flat = np.concatenate(self.pending)
            cut = len(flat) // BLOCK_IDS * BLOCK_IDS
            for i in range(0, cut, BLOCK_IDS):
                self._block(flat[i:i + BLOCK_IDS])
            self.pending, self.held = [flat[cut:]], len(flat) - cut

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.squeeze.compress(p) for p in to_planes(ids, self.bits)]
        for p in packed:
            self.out.write(p)
        self.blocks.append([len(ids), *map(len, packed)])

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.pending))
        planes = 32 if self.bits else 4
        head = np.array([planes, len(self.blocks), len(self.docs)], "<i8")
        index = self.squeeze.compress(b"".join((
            head.tobytes(), np.array(self.blocks, "<i8").tobytes(), np.array(self.docs, "<i8").tobytes(),
            np.array(self.lengths, "<i8").tobytes())))
        place = self.out.tell()
        self.out.write(index)
        self.out.write(FOOTER.pack(place, len(index), MAGIC))
        self.out.close()


class Reader:
    """Reads a file: its index at once, blocks when asked for."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        place, length, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a bit-plane file")
        source.seek(place)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(length)), "<i8")
        planes, blocks, docs = (int(x) for x in raw[:3])
        at = 3 + blocks * (planes + 1)
        self.blocks = raw[3:at].reshape(blocks, planes + 1)
        self.docs, self.lengths = raw[at:at + docs], raw[at + docs:at + 2 * docs]
        used = self.blocks[:, 1:].sum(axis=1)
        self.places = len(MAGIC) + np.cumsum(used) - used

    def block(self, i: int) -> np.ndarray:
        self.source.seek(int(self.places[i]))
        data = self.source.read(int(self.blocks[i, 1:].sum()))
        unpack, planes, at = zstandard.ZstdDecompressor(), [], 0
        for n in self.blocks[i, 1:]:
            planes.append(unpack.decompress(data[at:at + n]))
            at += int(n)
        return from_planes(planes, int(self.blocks[i, 0]))

    def documents(self) -> Iterator[tuple[int, int, int]]:
        """(document id, number of ids, crc32 of the ids), block by block."""
        ids, at, b = np.zeros(0, "<u4"), 0, 0
        for doc, n in zip(self.docs.tolist(), self.lengths.tolist(), strict=True):
            crc, left = 0, n
            while left:
                if at == len(ids):
                    ids, at, b = self.block(b), 0, b + 1
                part = ids[at:at + left]
                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                at += len(part)
                left -= len(part)
            yield doc, n, crc


# ---- encoding -------------------------------------------------------------

# the pre-tokenizer's pattern over ASCII and the Latin letters up to U+024F
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PIECE = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+", re.ASCII)
_OTHER = re.compile(rf"[^\x00-\x1b\x20-\x7f{_LATIN}]")
#: Printable characters stand for themselves, other bytes for characters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHAR = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: First bytes of the characters that are white space beyond ASCII.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
# the separators 0x1C to 0x1F are white space for some pattern engines
_ASCII_SPACE = textnum.SPACE.copy()
_ASCII_SPACE[0x1C:0x20] = True


def _distinct_stretches(data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches that tile ``data``: the first of each kind, and the kind of
    each.  Hashes propose the kinds; bytes decide."""
    h = textnum.stretch_hash(textnum.prefix_sums(data), starts, ends)
    _, first, where = np.unique(h, return_index=True, return_inverse=True)
    size, twin = ends - starts, first[where]
    if np.array_equal(size, size[twin]):
        shift = np.repeat(starts[twin] - starts, size)
        shift += np.arange(len(data))
        if np.array_equal(data[shift], data):
            return first, where
    kinds: dict[bytes, int] = {}
    firsts: list[int] = []
    kind = np.empty(len(starts), np.int64)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        kind[i] = kinds.setdefault(raw[s:e], len(kinds))
        if kind[i] == len(firsts):
            firsts.append(i)
    return np.array(firsts, np.int64), kind


class Encoder:
    """Ids of whole texts, equal to those of ``tokenizer.encode``."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.pre = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[bytes, bytes] = {}

    def _stretch(self, raw: bytes) -> bytes:
        text = raw.decode()
        if _OTHER.search(text):
            return b"".join(self._piece(w) for w, _ in self.pre.pre_tokenize_str(text))
        pieces = _PIECE.findall(text)
        if len(pieces) == 1:
            return self._piece(raw.decode("latin-1").translate(_BYTE_CHAR))
        out = []
        for w in pieces:  # a piece is a stretch that can stand elsewhere too
            key = w.encode()
            ids = self.cache.get(key)
            if ids is None:
                ids = self.cache[key] = self._piece(key.decode("latin-1").translate(_BYTE_CHAR))
            out.append(ids)
        return b"".join(out)

    def _piece(self, mapped: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _block(self, b: textnum.Block) -> Iterator[np.ndarray]:
        data = b.data
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n > 1:
            space = _ASCII_SPACE[data]
            # a space begins a token if what follows is no white space, or
            # what comes before is none
            after = ~space[1:] & ~_MAYBE_SPACE[data[1:]]
            before = ~space[:-1] & (data[:-1] < 128)
            is_space = data == 0x20
            cut[:n - 1] |= is_space[:-1] & after
            cut[1:n] |= is_space[1:] & before
        cut[b.offsets] = True
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        if not len(starts):
            for _ in range(b.rows):
                yield np.zeros(0, "<u4")
            return
        raw = data.tobytes()
        first, where = _distinct_stretches(data, raw, starts, ends)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        got = []
        for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
            w = raw[s:e]
            ids = cache.get(w)
            if ids is None:
                ids = cache[w] = self._stretch(w)
            got.append(ids)
        flat = np.frombuffer(b"".join(got), "<u4")
        size = np.array([len(g) for g in got], np.int64) // 4
        begin = np.cumsum(size) - size
        size, begin = size[where], begin[where]
        total = np.cumsum(size)
        ids = flat[np.repeat(begin - (total - size), size) + np.arange(total[-1])]
        upto = np.r_[0, total][np.searchsorted(starts, b.offsets)]
        for i in range(b.rows):
            yield ids[upto[i]:upto[i + 1]]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        for b in textnum.blocks(column, ENCODE_BLOCK):
            raw = b.data.tobytes()
            if any(s in raw for s in self.special):
                whole = [raw[s:e].decode() for s, e in zip(b.offsets[:-1], b.offsets[1:], strict=True)]
                for e in self.tokenizer.encode_batch(whole, add_special_tokens=False):
                    yield np.array(e.ids, "<u4")
            else:
                yield from self._block(b)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---- files ----------------------------------------------------------------

def write_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, bits: bool = False) -> DataFrame:
    """Write the ids of all texts; gives the manifest ``(file, part, n_docs,
    n_ids, start)``, a row per file."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer, name, ids_written = None, None, 0
        end = np.array([end_id], "<u4")
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).texts(batch.column(1)), strict=True):
                if writer is None:
                    name = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.bpl"
                    system, path = open_fs(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    writer = Writer(system.open_output_stream(path), bits)
                writer.add(doc, np.concatenate((ids, end)))
                ids_written += len(ids) + 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([context.partitionId()], pa.int32()), pa.array([len(writer.docs)], pa.int64()),
                 pa.array([ids_written], pa.int64())], names=["file", "part", "n_docs", "n_ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files = materialize(
        docs.repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(run, "file string, part int, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents in the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = open_fs(name)
                with system.open_input_file(path) as source:
                    rows: list[tuple[int, int, int, int]] = []
                    for doc, n, crc in Reader(source).documents():
                        rows.append((doc, start, n, crc))
                        start += n
                        if len(rows) == 50_000:
                            yield _digest_batch(rows)
                            rows = []
                    yield _digest_batch(rows)

    n = max(1, manifest.count())
    return manifest.select("file", "start").repartition(n, "file").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digest_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    doc = pa.array([None if r[0] == NULL_ID else r[0] for r in rows], pa.int64())
    return pa.RecordBatch.from_arrays(
        [doc, *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3))],
        names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Encode, write, and read back: one row per document."""
    folder = folder or scratch_path(docs.sparkSession, "bitplanes")
    return read_files(write_files(docs, tokenizer, folder))

"""Fill-in-middle transformation with a sparse exception index (operator 11).

A text is cut at two random borders of units (a run of ASCII letters, or any
other single character) and its parts are put out of order, each behind its
mark.  Cuts are drawn as unit numbers and needed as code points (for the
lengths) and as bytes (for the parts).  Two sparse indexes convert them:

* of the multibyte characters the code-point position and the excess bytes;
* of the letter runs the unit number and the excess characters.

A position moves from one numbering to the other by a ``searchsorted`` among
the exceptions and an addition of the excess before it; stretches without
exceptions are plain arithmetic.  No text is decoded.  A long text is indexed
in chunks of about ``CHUNK`` bytes: of each only its numbers of bytes,
characters and units are kept, and a chunk is indexed again where a cut falls
into it, so memory stays a few chunks beside the text itself.

Defined results: a null or empty text is ``plain`` with no units; a null id
draws as the empty string; repeated rows draw alike; other columns are not
looked at.  Every row is computed apart, from its id and text alone: no
shuffle, and a lost task gives the same rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgraph.llm import textnum

CHUNK = 1 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = ("plain", "psm", "spm")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Exceptions:
    """Items wider than one among items of width one: ``at`` are their
    positions with every width taken as one, ``extra`` what they have more."""

    def __init__(self, at: np.ndarray, extra: np.ndarray) -> None:
        self.at = at
        self.before = np.zeros(len(at) + 1, np.int64)
        np.cumsum(extra, out=self.before[1:])

    @classmethod
    def from_wide(cls, places: np.ndarray, extra: np.ndarray) -> Exceptions:
        """From positions that count the widths."""
        return cls(places - (np.cumsum(extra) - extra), extra)

    def widen(self, x: np.ndarray) -> np.ndarray:
        return x + self.before[np.searchsorted(self.at, x, "left")]

    def narrow(self, x: np.ndarray) -> np.ndarray:
        return x - self.before[np.searchsorted(self.at + self.before[:-1], x, "left")]


def _exceptions(b: textnum.Block) -> tuple[Exceptions, Exceptions]:
    """Multibyte characters and letter runs of a stretch of whole characters."""
    lead = np.flatnonzero(b.data >= 0xC0)
    first = b.data[lead]
    chars = Exceptions.from_wide(lead, 1 + (first >= 0xE0) + (first >= 0xF0).astype(np.int64))
    starts, ends, _ = textnum.word_bounds(b, ~_LETTER)
    long = ends - starts > 1
    starts, extra = starts[long], (ends - starts - 1)[long]
    return chars, Exceptions.from_wide(chars.narrow(starts), extra)


def _border(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that splits no character and no run."""
    step = 4096
    while at < len(data):
        here, left = data[at:at + step], data[at - 1:at - 1 + step][:len(data) - at]
        ok = ((here & 0xC0) != 0x80) & ~(_LETTER[here] & _LETTER[left])
        if ok.any():
            return at + int(ok.argmax())
        at, step = at + len(here), step * 2
    return len(data)


class CutIndex:
    """Unit, code-point and byte numbers of the borders in a block of texts."""

    def __init__(self, b: textnum.Block, chunk: int = CHUNK) -> None:
        self.b = b
        edges = [0]
        while edges[-1] < len(b.data):
            at = edges[-1] + chunk
            edges.append(len(b.data) if at >= len(b.data) else _border(b.data, at))
        self.bytes = np.array(edges, np.int64)
        self.chars, self.units = np.zeros_like(self.bytes), np.zeros_like(self.bytes)
        self.held: tuple[int, tuple[Exceptions, Exceptions]] | None = None
        for c in range(len(edges) - 1):
            chars, units = self._of(c)
            n = chars.narrow(self.bytes[c + 1] - self.bytes[c])
            self.chars[c + 1] = self.chars[c] + n
            self.units[c + 1] = self.units[c] + units.narrow(n)

    def _of(self, c: int) -> tuple[Exceptions, Exceptions]:
        if self.held is None or self.held[0] != c:
            lo, hi = self.bytes[c], self.bytes[c + 1]
            offsets = self.b.offsets
            inner = offsets[(offsets > lo) & (offsets < hi)] - lo
            part = textnum.Block(0, self.b.data[lo:hi], np.r_[0, inner, hi - lo])
            self.held = (c, _exceptions(part))
        return self.held[1]

    def _chunks(self, known: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        which = np.searchsorted(known, x, "right") - 1
        for c in np.unique(which).tolist():
            yield c, which == c

    def from_bytes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code-point and unit numbers of byte positions."""
        cp, unit = np.zeros_like(x), np.zeros_like(x)
        for c, here in self._chunks(self.bytes, x):
            at = x[here] - self.bytes[c]
            if c + 1 < len(self.bytes):
                chars, units = self._of(c)
                at = chars.narrow(at)
                unit[here] = self.units[c] + units.narrow(at)
            else:
                unit[here] = self.units[c]
            cp[here] = self.chars[c] + at
        return cp, unit

    def from_units(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and code-point numbers of unit borders."""
        byte, cp = np.zeros_like(x), np.zeros_like(x)
        for c, here in self._chunks(self.units, x):
            at = x[here] - self.units[c]
            if c + 1 < len(self.units):
                chars, units = self._of(c)
                at = units.widen(at)
                byte[here] = self.bytes[c] + chars.widen(at)
            else:
                byte[here] = self.bytes[c]
            cp[here] = self.chars[c] + at
        return byte, cp


def _rows(doc_ids: pa.Array, texts: pa.Array, draws: np.ndarray, plain_from: int, spm_below: int,
          ) -> Iterator[pa.RecordBatch]:
    for b in textnum.blocks(texts):
        index = CutIndex(b)
        cp0, unit0 = index.from_bytes(b.offsets)
        n = np.diff(unit0)
        h = draws[b.first:b.first + b.rows]
        one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
        byte1, cp1 = index.from_units(unit0[:-1] + np.minimum(one, two))
        byte2, cp2 = index.from_units(unit0[:-1] + np.maximum(one, two))
        form = np.where((n == 0) | (h[:, 2] % 100 >= plain_from), 0, np.where(h[:, 3] % 100 < spm_below, 2, 1))
        out = []
        for i in range(b.rows):
            lo, mid, end, hi = (int(x) for x in (b.offsets[i], byte1[i], byte2[i], b.offsets[i + 1]))
            text = b.data[lo:hi].tobytes()
            if PREFIX in text or SUFFIX in text or MIDDLE in text:
                form[i] = 0
            if form[i]:
                first, last = (PREFIX, text[:mid - lo]), (SUFFIX, text[end - lo:])
                if form[i] == 2:
                    first, last = last, first
                text = b"".join((*first, *last, MIDDLE, text[mid - lo:end - lo]))
            out.append(text)
        plain = form == 0
        yield pa.RecordBatch.from_arrays(
            [doc_ids.slice(b.first, b.rows), pa.array(n, pa.int64()),
             pa.array([FORMS[f] for f in form], pa.string()), pa.array(cp1 - cp0[:-1], pa.int64(), mask=plain),
             pa.array(cp2 - cp1, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, epoch: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every text.

    The draws are four 32-bit numbers of the SHA-256 of ``epoch:doc_id``: two
    cuts, and percentages for staying ``plain`` (from ``plain_from`` on) and
    for the order ``spm`` (below ``spm_below``; else ``psm``).  Texts that hold
    a mark stay plain, so ``restore`` is exact.
    """
    key = F.sha2(F.concat(F.lit(f"{epoch}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(key, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            yield from _rows(batch.column(0), batch.column(1), h, plain_from, spm_below)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *draws).mapInArrow(run, SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text of which ``transform`` made ``output``."""
    parts = F.split(output, "<[PSM]>")
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def digests(docs: DataFrame) -> DataFrame:
    """The transformation as ``doc_id, n, form, prefix_chars, middle_chars,
    output_sha256, restored_sha256``."""
    return transform(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))

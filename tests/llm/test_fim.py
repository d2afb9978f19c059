"""Fill-in-middle: cuts against a plain split into units, edge cases, round trip."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from litgraph.llm import fim, textnum

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.DOTALL)
ALPHABET = "abcXYZ .,\n0éЖ漢😀 "


def brute(doc_id, text):
    text = text or ""
    w = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    a, z = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:z]), "".join(w[z:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(w), "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(w), form, len(p), len(m), sha(out), sha(text)


def some_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) * rnd.choice((1, 1, 1, 7)) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 2, 5, 64, 1 << 20])
def test_every_border_converts(chunk):
    texts = ["", *some_texts(30, chunk), "", "a" * 300, "é" * 100 + "b", "x"]
    b = next(textnum.blocks(pa.array(texts)))
    index = fim.CutIndex(b, chunk)
    cp0, unit0 = index.from_bytes(b.offsets)
    assert cp0.tolist() == np.cumsum([0, *map(len, texts)]).tolist()
    for i, t in enumerate(texts):
        ends = [0]
        for w in UNIT.findall(t):
            ends.append(ends[-1] + len(w))
        assert unit0[i + 1] - unit0[i] == len(ends) - 1
        byte, cp = index.from_units(unit0[i] + np.arange(len(ends)))
        assert (cp - cp0[i]).tolist() == ends
        assert (byte - b.offsets[i]).tolist() == [len(t[:e].encode()) for e in ends]


def test_digests_equal_brute_force(spark):
    rows = list(enumerate(some_texts(300, 3)))
    rows += [(None, "null id, text"), (400, None), (401, ""), (402, "has <M> inside"), (403, "<"), (404, "<P"), (405, "a<S"),
             (406, "S>"), (407, "P>é"), (408, "word " * 5), (408, "word " * 5), (2**62, "long id"), (-3, "negative id"),
             (500, "long é " * 300_000), (501, "x" * 3_000_000), (502, "é" * 1_500_000), (503, "\x00 nul")]
    docs = spark.createDataFrame([(d, t, 9, "plain", 1) for d, t in rows],
                                 "doc_id long, text string, n long, form string, h1 int").repartition(4)
    got = fim.digests(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(d, t) for d, t in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_output_restores_and_rates_are_parameters(spark):
    rows = list(enumerate(t for t in some_texts(120, 8) if t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fim.transform(docs, epoch=7, plain_from=100, spm_below=50)
    got = out.withColumn("back", fim.restore(out["output"], out["form"])).collect()
    texts = dict(rows)
    assert all(r.back == texts[r.doc_id] and r.form != "plain" for r in got)
    assert 20 < sum(r.form == "spm" for r in got) < 100
    assert all(r.output.count("<M>") == 1 and len(r.output) == len(texts[r.doc_id]) + 9 for r in got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digests(empty).collect() == []

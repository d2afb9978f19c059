"""Byte-level BPE: ids against the library, vocabularies whose merges sink, round trip."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from litgraph.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(path).ranks,
                             special_tokens={})


def words(n, seed):
    rnd = random.Random(seed)
    tokens = sorted(bpe.vocabulary(RANKS).ranks)
    out = [bytes(rnd.choice(b"abcdeinorst ") for _ in range(rnd.randint(1, 40))) for _ in range(n)]
    out += [bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 30))) for _ in range(n // 4)]
    out += [rnd.choice([b"a", b" ", b"=", b"ab", b"the"]) * rnd.randint(1, 300) for _ in range(n // 10)]
    out += [b"".join(rnd.choice(tokens) for _ in range(rnd.randint(2, 8))) for _ in range(n)]
    return list(dict.fromkeys(out))


def per_word(vocabulary, found):
    ids, sizes = bpe.encode_words(vocabulary, found)
    out, at = [], 0
    for n in sizes.tolist():
        out.append(ids[at:at + n].tolist())
        at += n
    return out


@pytest.mark.parametrize("path", [RANKS, MULTI])
def test_words_equal_the_library(path):
    found, core = words(2000, 4), library(path)._core_bpe
    assert per_word(bpe.vocabulary(path), found) == [core.encode_single_piece(w) for w in found]


@pytest.mark.parametrize("seed", range(6))
def test_ranks_in_any_order(tmp_path, seed):
    """Tokens ranked at random: merges that make a pair of a lower rank are common."""
    rnd = random.Random(seed)
    tokens = {bytes(rnd.choice(b"ab") for _ in range(rnd.randint(2, 5))) for _ in range(40)}
    ranked = rnd.sample(sorted({bytes([i]) for i in range(256)} | tokens), 256 + len(tokens))
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(ranked)))
    v = bpe.Vocabulary(str(path))
    core = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=v.ranks, special_tokens={})._core_bpe
    found = list({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 60))) for _ in range(800)})
    assert v.may_sink and per_word(v, found) == [core.encode_single_piece(w) for w in found]


def test_documents_equal_the_library(spark, monkeypatch):
    rnd = random.Random(9)
    parts = ["The quick", " brown fox's", "\n\n", "   ", "naïve café", " Жизнь", "漢字かな", "12345", "😀🎉", "\t", "don't", " =====",
             "\x1c\x1f", " ", " x", "\x00", "<|endoftext|>", "é", "é"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 80)))) for i in range(150)]
    rows += [(None, "no id"), (200, None), (201, ""), (7, rows[7][1]), (202, "x" * 200_000 + " " * 100_000),
             (203, "word and more words " * 120_000), (2**60, "long id")]
    docs = spark.createDataFrame([(d, t, [1], "x") for d, t in rows], "doc_id long, text string, ids array<int>, decoded string")
    encoded = bpe.encode(docs.repartition(3), RANKS, public_tokenizers.PATTERN)
    own = library(RANKS)
    want = [(d, own.encode_ordinary(t or "")) for d, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr) == sorted(want, key=repr)
    back = bpe.decode(encoded, RANKS).collect()
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in back), key=repr) == sorted(
        ((d, (t or "").encode()) for d, t in rows), key=repr)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    digests = [(d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))
               for (d, t), (_, ids) in zip(rows, want, strict=True)]
    assert sorted(map(tuple, bpe.digests(encoded, RANKS).collect()), key=repr) == sorted(digests, key=repr)


def test_small_blocks_give_the_same_ids(monkeypatch):
    import regex
    pattern, own = regex.compile(public_tokenizers.PATTERN), library(RANKS)
    texts = ["", "some words, and some more words " * 40, "é" * 500, "a  b\n c" * 99]
    monkeypatch.setattr(bpe, "REPLAY", 16)
    monkeypatch.setattr(bpe, "STRETCH", 10)
    assert bpe._encode_block(bpe.vocabulary(RANKS), pattern, texts).to_pylist() == [own.encode_ordinary(t) for t in texts]


def test_unknown_ids_are_an_error_and_empty_tables_are_empty(spark):
    with pytest.raises(Exception, match="KeyError"):
        bpe.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id long, ids array<int>"), RANKS).collect()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).collect() == []
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(none, RANKS).collect()] == [b"", b""]

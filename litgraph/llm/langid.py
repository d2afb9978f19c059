"""Operator 5: language identification of web pages by Bayesian evidence fusion.

For every page, four kinds of evidence are combined:

- **text**: the likelihood of the page's visible text under each language's
  multinomial over hashed byte 4-grams of words, fitted on a bounded sample of
  documents of known language.  As neighbouring n-grams depend on each other,
  the mean log-likelihood counts like ``EFFECTIVE`` independent n-grams at most;
- **declared language** of the markup (``<html lang=...>``), with
  P(declared | language) counted over all pages;
- **address suffix** and **host**: priors smoothed hierarchically, host towards
  suffix towards the whole: a host with few pages takes its suffix's shares, one
  with many its own.

All tables are grouped aggregations of the text-only posteriors (soft counts)
over all pages; a page's own share is taken out of its host's and suffix's
counts again, so it is not counted twice.  Tables of hosts grow with the pages
and are joined by key, never broadcast or collected.

Defined results: a null or empty page, or one without words, has no text
evidence and goes by its address and markup; without those by the overall
shares.  A missing declaration, suffix or host is a value of its own.  Rows with
null or repeated ids are classified one by one; other columns are ignored.
Ties go to the first language by code point.  An empty table gives no rows;
without documents of known language the language is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgraph.llm import textnum
from litgraph.llm.common import bounded_batches, materialize

#: Bound on the documents that the text model is fitted on, and its hash buckets.
SAMPLE = 20_000
BUCKETS = 1 << 14
EFFECTIVE = 40
#: Pages that a suffix's or host's prior is worth before its own pages count more.
STRENGTH = 5.0

_HIDING = re.compile(r"<(script|style|noscript)\b|<!--", re.I)
_HIDDEN_ENDS = {kind: re.compile(rf"</{kind}\s*>", re.I) for kind in ("script", "style", "noscript")} | {"": re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")
_ENTITY = re.compile(r"&#?\w+;")
_ROOT = re.compile(r"<html\b", re.I)
_DECLARED = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def _shown(html: str) -> str:
    """A page without scripts, styles and comments.  An element that is never
    closed hides nothing; its kind's end is looked for only once more."""
    out, at, open_kinds = [], 0, set()
    for m in _HIDING.finditer(html):
        kind = (m[1] or "").lower()
        if m.start() < at or kind in open_kinds:
            continue
        end = _HIDDEN_ENDS[kind].search(html, m.end())
        if end is None:
            open_kinds.add(kind)
        else:
            out += [html[at:m.start()], " "]
            at = end.end()
    return "".join([*out, html[at:]])


def visible(html: str) -> str:
    """Text of a page without markup, scripts and styles, in linear time."""
    text = _shown(html)
    tags = text.rfind(">") + 1      # behind it no tag can end
    return _ENTITY.sub(" ", _TAG.sub(" ", text[:tags]) + text[tags:])


def declared_language(html: str) -> str | None:
    """The language that an ``html`` tag declares."""
    at = 0
    while m := _ROOT.search(html, at):
        at = html.find(">", m.end())
        at = len(html) if at < 0 else at
        if found := _DECLARED.search(html, m.end(), at):
            return found[1]
    return None


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each block: buckets of the 4-grams at every byte of the words (shorter
    at their ends; the first ones marked), the texts they belong to, and the
    number of texts."""
    separate = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])
    for b in textnum.blocks(column):
        low = textnum.LOWER[b.data]
        starts, ends, first = textnum.word_bounds(b, separate)
        sums = textnum.prefix_sums(low)
        rows = np.repeat(np.arange(b.rows), np.diff(first))
        long = ends - starts
        # every byte of every word, in order; the last grams of a word are its end
        at = np.arange(long.sum()) + np.repeat(starts - (np.cumsum(long) - long), long)
        begins = (at == np.repeat(starts, long)).astype(np.uint64)
        h = textnum.stretch_hash(sums, at, np.minimum(at + 4, np.repeat(ends, long))) ^ begins
        yield (h % np.uint64(BUCKETS)).astype(np.int64), np.repeat(rows, long), b.rows


def fit_text(docs: DataFrame, bound: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (languages x BUCKETS)."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"),
                        F.lower(F.col("lang").cast("string")).alias("lang")).where("lang is not null and text is not null")
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not langs:
        return [], np.zeros((0, BUCKETS))
    number = {x: i for i, x in enumerate(langs)}
    ids = known.select("doc_id").where("doc_id is not null").distinct().orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(bound)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            first = 0
            for bucket, row, n in grams(batch.column(0)):
                of = lang[first:first + n][row]
                first += n
                u, c = np.unique(of[of >= 0] * BUCKETS + bucket[of >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c.astype(np.int64))], names=["k", "n"])

    got = known.join(F.broadcast(ids), "doc_id").select("text", "lang").mapInArrow(counts, "k long, n long").groupBy(
        "k").agg(F.sum("n").alias("n")).toPandas()  # languages * BUCKETS at most
    table = np.full(len(langs) * BUCKETS, 0.5)
    table[got["k"].to_numpy(np.int64)] += got["n"].to_numpy(np.float64)
    table = table.reshape(len(langs), BUCKETS)
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def page_evidence(pages: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """``page_id, host, suffix, declared`` and, as arrays over the languages, the
    tempered log-likelihoods ``l`` and the text-only posteriors ``r``."""
    shipped = pages.sparkSession.sparkContext.broadcast(logs)
    k = len(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = ["" if h is None else h for h in batch.column(2).to_pylist()]
            declared = [(declared_language(h) or "").lower() for h in html]
            hosts = [m[1].lower() if u and (m := _HOST.match(u)) else "" for u in batch.column(1).to_pylist()]
            ll = []
            for bucket, row, n in grams(pa.array([visible(h) for h in html], pa.large_string())):
                size = np.bincount(row, minlength=n)
                sums = np.stack([np.bincount(row, weights=shipped.value[i][bucket], minlength=n) for i in range(k)], axis=1)
                ll.append(sums * (np.minimum(size, EFFECTIVE) / np.maximum(size, 1))[:, None])
            ll = np.concatenate(ll) if ll else np.zeros((0, k))
            p = np.exp(ll - ll.max(axis=1, keepdims=True)) if len(ll) else ll
            p = p / p.sum(axis=1, keepdims=True) if len(ll) else p
            at = pa.array(np.arange(len(html) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hosts, pa.string()), pa.array([h.rpartition(".")[2] for h in hosts], pa.string()),
                 pa.array(declared, pa.string()), *(pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in (ll, p))],
                names=["page_id", "host", "suffix", "declared", "l", "r"])

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    ).mapInArrow(run, "page_id long, host string, suffix string, declared string, l array<double>, r array<double>")


def _sums(e: DataFrame, key: str, tag: str) -> DataFrame:
    """``key`` and the sums of ``r`` over its pages, as an array ``tag``."""
    parts = e.select(key, F.posexplode("r").alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("x"))
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("a")).select(
        key, F.col("a.x").alias(tag))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id, lang, confidence, text_lang, declared, suffix, host`` per page."""
    bounded_batches(pages.sparkSession)
    langs, logs = fit_text(docs)
    if not langs:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), *[
            F.lit(None).cast(t).alias(c) for c, t in (
                ("lang", "string"), ("confidence", "double"), ("text_lang", "string"), ("declared", "string"),
                ("suffix", "string"), ("host", "string"))])
    e = materialize(page_evidence(pages, langs, logs), "evidence")
    n = float(e.count())
    got = {x["i"]: x["x"] for x in e.select(F.posexplode("r").alias("i", "x")).groupBy("i").agg(
        F.sum("x").alias("x")).collect()}  # a row per language
    whole = [got.get(i, 0.0) for i in range(len(langs))]
    declared = materialize(_sums(e, "declared", "d"), "declared")
    kinds = max(1, declared.count())
    suffix = _sums(e, "suffix", "s").join(e.groupBy("suffix").agg(F.count("*").alias("ns")), "suffix")
    host = _sums(e, "host", "h").join(e.groupBy("host").agg(F.count("*").alias("nh")), "host")
    text = lambda a: f"cast(split('{','.join(map(repr, a))}', ',') as array<double>)"
    share = text([(x + 1.0) / (n + len(langs)) for x in whole])
    marked = text([x + kinds for x in whole])
    # the page's own share is taken out of the counts
    by_suffix = f"(s[i] - x + {STRENGTH}D * {share}[i]) / (ns - 1 + {STRENGTH}D)"
    by_host = f"(h[i] - x + {STRENGTH}D * {by_suffix}) / (nh - 1 + {STRENGTH}D)"
    by_markup = f"(greatest(d[i] - x, 0D) + 1) / {marked}[i]"
    posterior = f"transform(r, (x, i) -> l[i] + ln({by_markup}) + ln(greatest({by_host}, 1e-12D)))"
    names = F.array(*[F.lit(x) for x in langs])
    name_of = lambda a, top: F.element_at(names, F.array_position(a, top).cast("int"))
    j = e.join(declared, "declared").join(suffix, "suffix").join(host, "host").withColumn(
        "p", F.expr(posterior)).withColumn("top", F.array_max("p"))
    total = F.expr("aggregate(p, 0D, (a, x) -> a + exp(x - top))")
    return j.select("page_id", name_of("p", F.col("top")).alias("lang"), F.round(1.0 / total, 6).alias("confidence"),
                    name_of("r", F.array_max("r")).alias("text_lang"), "declared", "suffix", "host")

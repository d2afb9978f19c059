"""Operator 3: toxicity scores by weak supervision.

1. **Lexicons.**  From a bounded sample of the labelled training rows (the
   ``SAMPLE`` rows of the lowest hash, each text once), terms are mined that
   occur in toxic rows and hardly ever in others: words, and word beginnings of 4, 5 and
   6 bytes, which reach inflected and compound forms.  A term is taken when its
   toxic share is improbable under independence even after correcting for
   the number of candidate terms.
2. **Voters.**  The terms are split into lexicons by kind and strength; with a
   few patterns (shouting, symbol noise, junk separators) they vote on every
   document: 2 toxic, 1 clean, 0 abstain.
3. **Label model.**  Vote patterns are counted over *all* documents.  A
   generative model with one latent class and a dependency tree over the
   voters is fitted to the counts by expectation-maximisation, anchored by the votes on
   the labelled sample: the class-wise
   tables hold each voter's accuracy, the tree (maximum class-conditional
   mutual information) its correlation with another voter.
4. **Classifier.**  A logistic regression on the mined terms, their number and
   the voters is trained on the model's posterior labels of the sample; its
   probability is the score.

Labels are learnt only from rows that are not held out; label, language,
source and id are never inputs of a score.

Defined results: null or empty texts get the score of a document without any
evidence.  Rows with a null id are scored (not held out).  Repeated labels of
an id count as toxic if one of them is; null labels are ignored.  Without
usable labels (none, or of one class only) no term is mined: every score is
then the smoothed toxic share of the sample.  Extra columns are ignored (or
kept, in the pipeline stage).  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litgraph.llm import textnum
from litgraph.llm.common import bounded_batches, held_out, materialize

#: Bound on the labelled rows that the classifier is fitted on, and on the
#: rows shipped to every executor to find them.
SAMPLE = 20_000
#: Bound on mined terms.
TERMS = 4096
#: Bytes of a word's beginning that make a term; 0 is the whole word.
KINDS = (0, 4, 5, 6)
#: Scores from here on are predicted toxic.
THRESHOLD = 0.3

#: Bytes that separate words here: ASCII but letters and digits.
SEPARATE = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[ord("!"), ord("?")]] = True

#: Lexicon voters: (kind, strong).  Pattern voters follow them.
LEXICONS = [(k, s) for k in range(len(KINDS)) for s in (True, False)]
PATTERNS = ("symbols", "capitals", "marks")
VOTERS = len(LEXICONS) + len(PATTERNS)


def term_hashes(b: textnum.Block) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each kind: hashes of its terms in the block, and their text rows."""
    low = textnum.LOWER[b.data]
    starts, ends, first = textnum.word_bounds(b, SEPARATE)
    sums = textnum.prefix_sums(low)
    row = np.repeat(np.arange(b.rows), np.diff(first))
    hashes, rows = [], []
    for i, size in enumerate(KINDS):
        if size:
            ok = ends - starts >= size
            h, r = textnum.stretch_hash(sums, starts[ok], starts[ok] + size), row[ok]
        else:
            ok = ends - starts >= 3
            h, r = textnum.stretch_hash(sums, starts[ok], ends[ok]), row[ok]
        hashes.append(h ^ np.uint64(i))
        rows.append(r)
    return hashes, rows


def _per_text(b: textnum.Block, flags: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[b.offsets])


def pattern_votes(b: textnum.Block) -> np.ndarray:
    """Votes of the pattern voters: 2 if the share of such bytes is high, 1 if
    there is none, else 0 (texts without bytes: 0)."""
    n = np.maximum(np.diff(b.offsets), 1)
    out = np.zeros((b.rows, len(PATTERNS)), np.uint8)
    for j, (table, high) in enumerate(((_SYMBOL, 0.05), (_UPPER, 0.3), (_MARK, 0.05))):
        got = _per_text(b, table[b.data])
        out[:, j] = np.where(got > high * n, 2, np.where((got == 0) & (np.diff(b.offsets) > 0), 1, 0))
    return out


@dataclass
class Lexicon:
    """Mined terms, sorted by hash, each with its voter."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    voters: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self) -> None:
        bits = np.zeros(1 << 16, bool)  # most words are ruled out by 16 bits of their hash
        bits[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        self.bits = bits

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` whose term is in the lexicon, and the term's index."""
        at = np.flatnonzero(self.bits[(h >> np.uint64(48)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        ok = self.hashes[i] == h[at]
        return at[ok], i[ok]


def evidence(column: pa.Array, lex: Lexicon) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For each block: votes (texts x VOTERS) and the terms found in each text."""
    for b in textnum.blocks(column):
        votes = np.zeros((b.rows, VOTERS), np.uint8)
        votes[:, len(LEXICONS):] = pattern_votes(b)
        rows, terms = [], []
        hashes, text_rows = term_hashes(b)
        for h, r in zip(hashes, text_rows, strict=True):
            at, i = lex.found(h)
            rows.append(r[at])
            terms.append(i)
        rows, terms = np.concatenate(rows), np.concatenate(terms)
        if len(rows):
            pair = np.unique(rows * len(lex.hashes) + terms)
            rows, terms = pair // len(lex.hashes), pair % len(lex.hashes)
            votes[rows, lex.voters[terms]] = 2
        # a lexicon whose terms are missing from a text that has words votes clean
        some = np.diff(b.offsets) > 0
        lexical = votes[:, :len(LEXICONS)]
        lexical[(lexical == 0) & some[:, None]] = 1
        votes[:, :len(LEXICONS)] = lexical
        cuts = np.searchsorted(rows, np.arange(1, b.rows))
        yield votes, np.split(terms, cuts)


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """``(text, toxic)`` of the training rows, ``bound`` at most: those whose
    ids have the lowest hashes.  The ids are at most ``bound``, so they are
    broadcast and the texts need no shuffle."""
    ids = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy(
        F.xxhash64("text").alias("hash")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).select(
        "text", "toxic")  # copies would make their chance words look like evidence


def mine(sample: DataFrame) -> tuple[Lexicon, float]:
    """The lexicon, and the toxic share of the sample."""
    total = sample.groupBy("toxic").count().collect()
    n_tox = sum(r["count"] for r in total if r["toxic"])
    n = sum(r["count"] for r in total)
    share = (n_tox + 0.5) / (n + 10)
    if n_tox < 3 or n_tox == n:
        return Lexicon(), share

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tox = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for b in textnum.blocks(batch.column(0)):
                hashes, rows = term_hashes(b)
                for kind, (h, r) in enumerate(zip(hashes, rows, strict=True)):
                    order = np.lexsort((r, h))
                    h, r = h[order], r[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                    h, bad = h[new], tox[b.first + r[new]]
                    u, at = np.unique(h, return_index=True)
                    p = np.add.reduceat(bad.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u.view(np.int64)), pa.array(np.full(len(u), kind, np.int32)), pa.array(p),
                         pa.array(np.diff(np.r_[at, len(h)]).astype(np.int64))], names=["h", "kind", "p", "n"])

    share_tox = n_tox / n
    terms = sample.mapInArrow(counts, "h long, kind int, p long, n long").groupBy("h", "kind").agg(
        F.sum("p").alias("p"), F.sum("n").alias("n"))
    # Chernoff bound of the chance that p of n rows are toxic at the base rate
    q = F.least(F.col("p") / F.col("n"), F.lit(1 - 1e-9))
    div = F.col("n") * (q * F.log(q / share_tox) + (1 - q) * F.log((1 - q) / (1 - share_tox)))
    # 13.8: a chance below one in a million for each candidate term
    got = (terms.where("p >= 3 and 10 * (n - p) <= p").withColumn("w", div).where("w > 13.8")
           .orderBy(F.desc("w"), "h").limit(TERMS).toPandas())
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    kind = got["kind"].to_numpy(np.int64)
    strong = (got["n"] - got["p"]).to_numpy() * 50 <= got["p"].to_numpy()
    voter = kind * 2 + np.where(strong, 0, 1)
    order = np.argsort(h)
    return Lexicon(h[order], voter[order].astype(np.int64)), share


@dataclass
class LabelModel:
    """P(class) and, for each voter, P(vote | class, vote of its parent)."""

    prior: np.ndarray
    parent: np.ndarray
    tables: np.ndarray  # voter, class, vote of the parent, vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = votes.astype(np.int64)
        log = np.log(self.prior)[None, :].repeat(len(v), 0)
        for j in range(v.shape[1]):
            up = v[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(v), np.int64)
            for c in (0, 1):
                log[:, c] += np.log(self.tables[j, c, up, v[:, j]])
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(axis=1)


def _tables(v: np.ndarray, w: np.ndarray, parent: np.ndarray) -> np.ndarray:
    out = np.empty((v.shape[1], 2, 3, 3))
    for j in range(v.shape[1]):
        up = v[:, parent[j]] if parent[j] >= 0 else np.zeros(len(v), np.int64)
        for c in (0, 1):
            flat = np.bincount(v[:, j], weights=w[:, c], minlength=3) + 1e-3
            flat /= flat.sum()
            t = np.bincount(up * 3 + v[:, j], weights=w[:, c], minlength=9).reshape(3, 3)
            t = t + 5 * flat[None, :]     # smoothed towards the voter's own table
            out[j, c] = t / t.sum(axis=1, keepdims=True)
    return out


def _tree(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Parents of a maximum spanning tree by class-conditional mutual information."""
    k = v.shape[1]
    info = np.zeros((k, k))
    for a in range(k):
        for b in range(a):
            for c in (0, 1):
                t = np.bincount(v[:, a] * 3 + v[:, b], weights=w[:, c], minlength=9).reshape(3, 3) + 1e-6
                p = t / w.sum()
                q = t / t.sum()
                e = q.sum(1, keepdims=True) * q.sum(0, keepdims=True)
                info[a, b] += (p * np.log(q / e)).sum()
            info[b, a] = info[a, b]
    parent = np.full(k, -1)
    inside = [0]
    while len(inside) < k:
        rest = [j for j in range(k) if j not in inside]
        j, up = max(((j, i) for j in rest for i in inside), key=lambda x: (info[x], -x[0], -x[1]))
        parent[j] = up
        inside.append(j)
    return parent


def fit_label_model(votes: np.ndarray, counts: np.ndarray, share: float, known: np.ndarray, toxic: np.ndarray,
                    rounds: int = 30) -> LabelModel:
    """EM over vote patterns and how many documents have each.  The votes on
    the labelled sample (``known``, with classes ``toxic``) begin it and anchor
    it: they weigh as much as all documents together, so that the class found
    is the labelled one."""
    v = np.concatenate((known, votes)).astype(np.int64)
    weight = np.concatenate((np.full(len(known), counts.sum() / max(1, len(known))), counts))
    sure = toxic.astype(np.float64)
    w = np.stack((1 - sure, sure), axis=1)
    k = known.astype(np.int64)
    parent = _tree(k, w)
    model = LabelModel(np.array([1 - share, share]), parent, _tables(k, w, parent))
    p1 = np.concatenate((sure, model.posterior(votes)))
    for _ in range(rounds):
        w = np.stack((1 - p1, p1), axis=1) * weight[:, None]
        prior = (w.sum(axis=0) + np.array([1 - share, share]) * 10) / (w.sum() + 10)
        parent = _tree(v, w)
        model = LabelModel(prior, parent, _tables(v, w, parent))
        new = np.concatenate((sure, model.posterior(votes)))
        if np.abs(new - p1).max() < 1e-6:
            break
        p1 = new
    return model


def _features(votes: np.ndarray, terms: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features as (row, column, value): terms, their number, voters."""
    n = np.array([len(t) for t in terms], np.int64)
    row = np.repeat(np.arange(len(terms)), n)
    col = np.concatenate(terms) if len(terms) else np.zeros(0, np.int64)
    vr, vc = np.nonzero(votes == 2)
    base = np.arange(len(terms))
    return (np.concatenate((row, base, vr, base)),
            np.concatenate((col, np.full(len(base), width), width + 1 + vc, np.full(len(base), width + 1 + VOTERS))),
            np.concatenate((np.ones(len(row)), np.log1p(n), np.ones(len(vr)), np.ones(len(base)))))


def _linear(f: tuple[np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(f[0], weights=f[2] * weights[f[1]], minlength=rows)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(votes: np.ndarray, terms: list[np.ndarray], target: np.ndarray, width: int,
               rounds: int = 300, penalty: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft labels, by gradient steps of decaying size."""
    f = _features(votes, terms, width)
    size = width + 2 + VOTERS
    w = np.zeros(size)
    share = np.clip(target.mean(), 1e-4, 1 - 1e-4)
    w[-1] = np.log(share / (1 - share))
    g2 = np.full(size, 1e-8)
    for _ in range(rounds):
        err = _sigmoid(_linear(f, w, len(target))) - target
        g = np.bincount(f[1], weights=f[2] * err[f[0]], minlength=size) / len(target) + penalty * w / len(target)
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray | None
    share: float

    def scores(self, votes: np.ndarray, terms: list[np.ndarray]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(terms), self.share)
        return _sigmoid(_linear(_features(votes, terms, len(self.lexicon.hashes)), self.weights, len(terms)))


def _clean(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """Lexicons, label model and classifier from ``docs`` and ``labels``."""
    bounded_batches(docs.sparkSession)
    docs = _clean(docs)
    sample = materialize(labelled_sample(docs, labels, bound), "toxic-sample")
    lex, share = mine(sample)
    if not len(lex.hashes):
        return Model(lex, None, share)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for votes, _ in evidence(batch.column(0), lex):
                u, n = np.unique(votes, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in u], pa.binary()), pa.array(n.astype(np.int64))],
                    names=["votes", "n"])

    # the number of vote patterns is bounded by the voters, not by the documents
    got = docs.select("text").mapInArrow(patterns, "votes binary, n long").groupBy("votes").agg(
        F.sum("n").alias("n")).orderBy("votes").toPandas()
    patterns_seen = np.frombuffer(b"".join(map(bytes, got["votes"])), np.uint8).reshape(-1, VOTERS)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for votes, terms in evidence(batch.column(0), lex):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v.tobytes() for v in votes], pa.binary()),
                     pa.array([t.astype(np.int32).tobytes() for t in terms], pa.binary()),
                     batch.column(1).slice(first, len(terms))], names=["votes", "terms", "toxic"])
                first += len(terms)

    # the sample is bounded; sorted here, so that reruns sum in the same order
    rows = sample.select("text", "toxic").mapInArrow(features, "votes binary, terms binary, toxic int").toPandas()
    rows = rows.assign(votes=rows["votes"].map(bytes), terms=rows["terms"].map(bytes)).sort_values(
        ["votes", "terms", "toxic"], kind="stable")
    votes = np.frombuffer(b"".join(map(bytes, rows["votes"])), np.uint8).reshape(-1, VOTERS)
    terms = [np.frombuffer(bytes(t), np.int32).astype(np.int64) for t in rows["terms"]]
    label_model = fit_label_model(patterns_seen, got["n"].to_numpy(np.float64), share, votes,
                                  rows["toxic"].to_numpy(bool))
    weights = fit_linear(votes, terms, label_model.posterior(votes), len(lex.hashes))
    return Model(lex, weights, share)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores (map side only, all columns kept)."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shipped.value.scores(*e) for e in evidence(batch.column(place), shipped.value.lexicon)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))],
                names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    docs = _clean(docs)
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Search predicates over text columns.

A term is text with optional markers:

* ``"exact phrase"``  words in this order, separated by non-word characters
* ``tox*``            truncation: any word starting with ``tox``
* ``wom?n``           one letter or digit in place of ``?``
* ``term[Field]``     field tag: ``[Title/Abstract]`` (default), ``[Title]``,
                      ``[Abstract]``, ``[All Fields]``, ``[Mesh]``

Matching is case-insensitive and on whole words: a word character is a
Unicode letter or digit, the same rule the BM25 tokenizer uses.  Each term
becomes one ``rlike`` over ``lower(concat_ws(' ', fields))``; groups are
OR-ed inside and AND-ed across, and excluded terms are AND-NOT-ed, so a whole
query is one filter expression that runs in codegen next to the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]"
NON_WORD = r"[^\p{L}\p{N}]"

# Fixed field tags and the columns they read by default.
DEFAULT_FIELDS: dict[str, tuple[str, ...]] = {
    "title/abstract": ("Title", "page_content"),
    "title": ("Title",),
    "abstract": ("page_content",),
    "all fields": ("Title", "page_content", "Published"),
    "mesh": ("mesh",),
}

_TAG = re.compile(r"^(?P<body>.*?)\s*\[(?P<tag>[^\]]+)\]\s*$")


@dataclass(frozen=True)
class Term:
    text: str
    tag: str = "title/abstract"
    phrase: bool = False
    fields: tuple[str, ...] = field(default_factory=tuple)


def parse_term(spec: str | Term) -> Term:
    """``'"drug repositioning"[Title/Abstract]'`` -> Term(...)."""
    if isinstance(spec, Term):
        return spec
    s = spec.strip()
    tag = "title/abstract"
    m = _TAG.match(s)
    if m:
        s, tag = m.group("body").strip(), m.group("tag").strip().lower()
    phrase = len(s) >= 2 and s[0] == s[-1] == '"'
    if phrase:
        s = s[1:-1]
    return Term(text=s.lower(), tag=tag, phrase=phrase)


def term_pattern(term: Term) -> str:
    """Word-bounded regular expression for one term (Java and RE2 syntax)."""
    words = [w for w in re.split(r"\s+", term.text.strip()) if w]
    parts = []
    for w in words:
        out = []
        for ch in w:
            if ch == "*":
                out.append(WORD + "*")
            elif ch == "?":
                out.append(WORD)
            elif ch.isalnum():
                out.append(ch)
            else:
                out.append("\\" + ch)
        parts.append("".join(out))
    body = (NON_WORD + "+").join(parts)
    return f"(^|{NON_WORD}){body}({NON_WORD}|$)"


def _columns(term: Term, fields: Mapping[str, Sequence[str]], available: Iterable[str] | None):
    if not term.fields and term.tag not in fields:
        raise ValueError(f"unknown field tag [{term.tag}]; known: {sorted(fields)}")
    cols = list(term.fields or fields[term.tag])
    if available is not None:
        have = set(available)
        cols = [c for c in cols if c in have]
        if not cols:
            raise ValueError(f"no column for field tag [{term.tag}]")
    return cols


def term_predicate(spec: str | Term, fields: Mapping[str, Sequence[str]] = DEFAULT_FIELDS,
                   available: Iterable[str] | None = None,
                   array_cols: Iterable[str] = ()) -> Column:
    """One term over its fields.  Text columns are joined and matched with
    one ``rlike``; a keyword array column (e.g. MeSH headings) matches when
    one of its elements matches the term as a whole word."""
    term = parse_term(spec)
    cols = _columns(term, fields, available)
    pattern = term_pattern(term)
    arrays = [c for c in cols if c in set(array_cols)]
    texts = [c for c in cols if c not in set(arrays)]
    preds = [F.exists(F.col(c), lambda x: F.lower(x).rlike(pattern)) for c in arrays]
    if texts:
        preds.append(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in texts])).rlike(pattern))
    return reduce(lambda a, b: a | b, preds)


def boolean_predicate(groups: Sequence[Sequence[str | Term]],
                      exclude: Sequence[str | Term] = (),
                      fields: Mapping[str, Sequence[str]] = DEFAULT_FIELDS,
                      available: Iterable[str] | None = None,
                      array_cols: Iterable[str] = ()) -> Column:
    """P10 + P11: AND over groups of OR-ed terms, minus any excluded term."""
    def any_of(terms):
        return reduce(lambda a, b: a | b, [term_predicate(t, fields, available, array_cols) for t in terms])
    pred = reduce(lambda a, b: a & b, [any_of(g) for g in groups if g], F.lit(True))
    if exclude:
        pred = pred & ~any_of(exclude)
    return pred

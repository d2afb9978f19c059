"""Page cleaning: the same text as by plain patterns, in linear time."""

import random
import re
import time

import pytest

from litgraph.llm import langid

HIDDEN = re.compile(r"<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)


def test_same_as_plain_patterns():
    rnd = random.Random(6)
    parts = ["<script>", "</script>", "</SCRIPT >", "<style a>", "</style>", "<noscript", "</noscript>", "<!--", "-->", "<!-->", "<", ">",
             "<p>", " word ", "&amp;", "&x", "<html ", "<HTML lang='de'>", "<html><x lang=fr>", " lang = en", "lang=\"it", "\n", "<scripts>"]
    for _ in range(20_000):
        page = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        plain = re.sub(r"&#?\w+;", " ", re.sub(r"<[^>]*>", " ", HIDDEN.sub(" ", page)))
        assert langid.visible(page) == plain, page
        m = DECLARED.search(page)
        assert langid.declared_language(page) == (m[1] if m else None), page


@pytest.mark.parametrize("piece", ["<html ", "<", "<script>", "<!--", "<style> <", "<html lang", "&", "</script", "<noscript><script>"])
def test_long_pages_take_linear_time(piece):
    page = piece * (2_000_000 // len(piece))
    began = time.perf_counter()
    langid.visible(page), langid.declared_language(page)
    assert time.perf_counter() - began < 10

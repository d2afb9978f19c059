"""Column expressions for names, affiliations and display text.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; none needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that outputs must reproduce exactly.
PAPER_LINK_PREFIX = "https://pubmed.ncbi.nlm.nih.gov/"
LINK_HEADER = "Link to Paper in Database"
UNKNOWN_AUTHOR = "Unknown Author"
NO_AFFILIATION = "No affiliation"
EDGE_COLOR = "#a6a6a6"
EDGE_VALUE = 0.1

# The white space that Python's str.strip() removes.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading / trailing whitespace (not only
    spaces).  ``btrim`` with a character set is code-generated (no regex)."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def affiliation_country(aff) -> Column:
    """last comma field, stripped, cut at the first '.', stripped.
    No comma gives the whole text; null gives null."""
    last = F.element_at(F.split(_c(aff), ","), -1)
    return strip(F.split_part(strip(last), F.lit("."), F.lit(1)))


def affiliation_city(aff) -> Column:
    """second-last comma field, stripped; null with fewer than two fields."""
    return strip(F.try_element_at(F.split(_c(aff), ","), F.lit(-2)))


def full_name(fore, last) -> Column:
    """``"{fore} {last}"`` with missing parts as empty text."""
    return F.concat(F.coalesce(_c(fore), F.lit("")), F.lit(" "), F.coalesce(_c(last), F.lit("")))


def clean_author_name(name) -> Column:
    """text before the first ':', stripped."""
    return strip(F.split_part(_c(name), F.lit(":"), F.lit(1)))


def paper_link(uid) -> Column:
    """link to the paper's page."""
    return F.concat(F.lit(PAPER_LINK_PREFIX), _c(uid), F.lit("/"))


def escape_html(text) -> Column:
    """Text that shows as it is inside markup."""
    out = _c(text)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def popup_text(fore, last, affiliation) -> Column:
    """F8: ``<b>fore last</b>: affiliation`` (null parts print as 'None', as
    Python formatting does).  The parts' own ``& < >`` are escaped."""
    def txt(c):
        return escape_html(F.coalesce(_c(c).cast("string"), F.lit("None")))
    return F.concat(F.lit("<b>"), txt(fore), F.lit(" "), txt(last), F.lit("</b>: "), txt(affiliation))


def research_text(title, abstract) -> Column:
    """title and abstract joined by one space.  Nulls are skipped (the
    reference prints them as 'None'; see README deviations)."""
    return F.concat_ws(" ", _c(title), _c(abstract))


def node_label(first_author) -> Column:
    """``"{first author} et al."`` with a default for unknown papers."""
    return F.concat(F.coalesce(_c(first_author), F.lit(UNKNOWN_AUTHOR)), F.lit(" et al."))


def node_size(count) -> Column:
    """``ln(count) * 10``."""
    return F.log(_c(count).cast("double")) * F.lit(10.0)


def edge_title(src_label, dst_label, similarity) -> Column:
    """F16: hover text of an edge, similarity with two decimals."""
    return F.format_string("Edge from '%s' to '%s'. Similarity: %.2f",
                           _c(src_label), _c(dst_label), _c(similarity))


def _hex2(channel) -> Column:
    return F.lpad(F.lower(F.hex((_c(channel) * 255).cast("int"))), 2, "0")


def rgb_to_hex(r, g, b) -> Column:
    """channels in [0, 1] -> ``#rrggbb`` (each channel * 255, truncated)."""
    return F.concat(F.lit("#"), _hex2(r), _hex2(g), _hex2(b))


def capitalize_header(name: str) -> str:
    """First letter upper, the rest lower; the link header is exempt."""
    return name if name == LINK_HEADER else name[:1].upper() + name[1:].lower()

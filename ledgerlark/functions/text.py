"""Text helpers as column expressions."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CJK_GROUP, CJK_RUN, PLACEHOLDER_FORM


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space (Unicode's) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def single_spaced(c: Column) -> Column:
    """Every run of white space (Unicode's) as one space. A lone space matches nothing, so most texts stay untouched."""
    return F.regexp_replace(c, r"(?U)\s{2,}|[^\S ]", " ")


def stripped(c: Column) -> Column:
    """:func:`strip` of a column that costs nothing: most texts have visible ASCII at both ends and take no pattern."""
    first, last = F.substring(c, 1, 1), F.substring(c, -1, 1)
    return F.when(first.between("!", "~") & last.between("!", "~"), c).otherwise(strip(c))


def bare(c: Column) -> Column:
    """:func:`strip` of any column: spaces go first, and few texts take the pattern after that."""
    return let(F.trim(c), stripped)


def tidy(c: Column) -> Column:
    """:func:`single_spaced` and :func:`strip` of a column that costs nothing: ASCII texts without control characters take no pattern."""
    plain = F.octet_length(c) == F.length(c)
    for control in "\t\n\x0b\f\r":
        plain = plain & ~c.contains(control)
    once = F.trim(F.replace(F.replace(c, F.lit("  "), F.lit(" ")), F.lit("  "), F.lit(" ")))
    return F.when(plain & ~once.contains("  "), once).otherwise(strip(single_spaced(c)))


def split_lines(c: Column) -> Column:
    """Lines as text editors count them: every kind of line break, and no empty last line after one."""
    lines = F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def strip_cjk(c: Column) -> Column:
    """Without bracketed groups that hold CJK characters, and without runs of CJK or of missing-glyph boxes."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(F.regexp_replace(c, CJK_GROUP, ""), CJK_RUN, ""))


def is_placeholder(c: Column) -> Column:
    # What such a form begins with is looked at first, as few texts have it.
    first = F.substring(F.ltrim(c), 1, 1).isin(*"nNtT-_?.xXuU\t\n\x0b\f\r")
    return F.when(first, c.rlike(PLACEHOLDER_FORM) | c.contains("___") | c.contains("???")).otherwise(c.contains("___") | c.contains("???"))


def squash(c: Column) -> Column:
    """Capital letters A-Z and digits alone."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def spaced(c: Column) -> Column:
    """Capital letters A-Z and digits, with one space for anything between them."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", " "))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot, in lower case; the whole name without one."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def escape_html(c: Column) -> Column:
    """Null and empty become a dash."""
    out = c
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return F.when(F.coalesce(c, F.lit("")) == "", "—").otherwise(out)


def strip_tags(c: Column) -> Column:
    """Without scripts, styles and tags; block ends are line breaks. Entities stay. The patterns are fixed values."""
    out = F.regexp_replace(c, r"(?is)<(script|style).*?</\1>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</p>|</div>|</tr>", "\n")
    return F.regexp_replace(out, "<[^>]+>", " ")


def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed_unescaped(texts: pd.Series) -> pd.Series:
    said = lambda m: html.unescape(m[0]) if m[1][0] == "#" else html5.get(f"{m[1]};", m[0])
    return texts.map(lambda t: _CLOSED.sub(said, t), na_action="ignore")


def unescape_html(c: Column, closed: bool = False) -> Column:
    """Named and numeric entities as characters; with ``closed`` those alone that a semicolon ends, so a cut ``&amp`` stays as it is."""
    return F.pandas_udf(_closed_unescaped if closed else _unescaped, "string")(c)


def html_to_text(c: Column, closed: bool = False) -> Column:
    return strip(F.regexp_replace(unescape_html(strip_tags(c), closed), "[ \t]+", " "))


def reply_subject(c: Column) -> Column:
    """``RE: `` before the subject, whatever reply marks it had; pattern and default are fixed values."""
    plain = F.when(F.coalesce(c, F.lit("")) == "", "Shipping document check").otherwise(c)
    return F.concat(F.lit("RE: "), F.regexp_replace(plain, r"(?i)^\s*((re|fw|fwd)\s*[:_]\s*)+", ""))


def percent_encoded(c: Column) -> Column:
    """As in a mail link: spaces as %20, slashes and tildes as they are."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def general(x: Column) -> Column:
    """A number with six significant digits and no trailing zeros."""
    whole = F.when(F.abs(x) >= 100000, F.bround(x, 0)).otherwise(x)
    text = F.format_string("%.6g", whole.cast("double"))
    text = F.regexp_replace(text, r"(\.[0-9]*?)0+(e|$)", "$1$2")
    return F.when(x.isNotNull(), F.regexp_replace(text, r"\.(e|$)", "$1"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))

"""String expressions: boundary regex, HTML escaping and the one-line hit display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: display format of a hit ---------------------------------------------------
DISPLAY_HEADER = "Shard: %d, Sample: %d, Offset: %d"
DISPLAY_CONTEXT = "Context: ...%s**%s**%s..."
DISPLAY_RULE = "-" * 40

# HTML escaping of & < > " ' (ampersand first)
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]


def default_regex(query: Column, literal: bool = False) -> Column:
    """Word-boundary pattern around the query, the query *not* escaped (``literal=True``
    quotes it). ``(?U)`` pins Unicode word characters for ``\\b`` on every JDK."""
    q = F.concat(F.lit("\\Q"), query, F.lit("\\E")) if literal else query
    return F.concat(F.lit("(?U)\\b"), q, F.lit("\\b"))


def regex_search(text: Column, pattern: Column) -> Column:
    """``re.search`` semantics: true when the pattern matches anywhere (Java regex)."""
    return F.regexp(text, pattern)


def html_escape(c: Column) -> Column:
    out = c
    for a, b in HTML_ESCAPES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def display_line(shard: Column, sample: Column, offset: Column, before: Column, match: Column, after: Column) -> Column:
    """The three-line display of a hit."""
    return F.concat_ws("\n",
                       F.format_string(DISPLAY_HEADER, shard, sample, offset),
                       F.when(match.isNotNull(), F.format_string(DISPLAY_CONTEXT, before, match, after)).otherwise(F.lit("Context: none")),
                       F.lit(DISPLAY_RULE))


HTML_CARD = (
    "<div class=\"hit\"><table><tr><th>Shard</th><th>Sample Index</th><th>Token Offset</th></tr>"
    "<tr><td>%d</td><td>%d</td><td>%d</td></tr></table>"
    "<p><span class=\"ellipsis\">...</span>%s<mark>%s</mark>%s<span class=\"ellipsis\">...</span></p></div>"
)


def html_card(shard: Column, sample: Column, offset: Column, before: Column, match: Column, after: Column) -> Column:
    """An HTML card for a hit with escaped context text."""
    return F.format_string(HTML_CARD, shard, sample, offset, html_escape(before), html_escape(match), html_escape(after))

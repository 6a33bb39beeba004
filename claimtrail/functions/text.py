"""Text helpers as Catalyst expressions (JVM side, whole-stage codegen).

The patterns use the ``\\x{HHHH}`` escape that both Java regex and RE2 read, so
the same strings serve the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() / str.strip() treat as
# whitespace, and the ones str.splitlines() breaks on.
WHITESPACE_CLASS = (
    r"[\x{9}\x{a}\x{b}\x{c}\x{d}\x{1c}\x{1d}\x{1e}\x{1f}\x{20}\x{85}\x{a0}"
    r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
LINE_BREAK = r"\x{d}\x{a}|[\x{a}\x{b}\x{c}\x{d}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"

BLANK_PATTERN = f"^{WHITESPACE_CLASS}*$"
STRIP_PATTERN = f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$"
WS_RUN_PATTERN = f"{WHITESPACE_CLASS}+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_blank(x) -> Column:
    """``not s.strip()``: null counts as blank."""
    c = _c(x)
    return c.isNull() | c.rlike(BLANK_PATTERN)


def py_strip(x) -> Column:
    """``s.strip()`` with Python's notion of whitespace (plain ``trim`` strips
    only spaces)."""
    return F.regexp_replace(_c(x), STRIP_PATTERN, "")


def collapse_ws(x) -> Column:
    """``" ".join(s.split())``."""
    return py_strip(F.regexp_replace(_c(x), WS_RUN_PATTERN, " "))


def first_line(x, max_chars: int = 240) -> Column:
    """``s.splitlines()[0][:max_chars]`` (code points, as Python counts)."""
    line = F.get(F.split(_c(x), LINE_BREAK, 2), 0)
    return F.substring(line, 1, max_chars)


def json_string(x) -> Column:
    """A JSON string literal for ``x`` (quotes included)."""
    body = F.to_json(F.array(_c(x)))
    return F.regexp_replace(F.regexp_replace(body, r"^\[", ""), r"\]$", "")


# Characters that HTML text and attributes escape, the ampersand first.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def html_escape(x) -> Column:
    """``html.escape(s)``: null stays null."""
    c = _c(x)
    for raw, escaped in HTML_ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c

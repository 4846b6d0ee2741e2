"""Text predicates and cleanup shared by the operators (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide a result, in Java regex syntax.
PLACEHOLDER_ALT = (
    r"(?iu)^(\[Figure on page .+ — alt text requires review\]$|\[Placeholder|placeholder$|image$|figure$|photo$"
    r"|.*\.(jpg|jpeg|png|gif|bmp|svg|tiff?|webp)$"
    r"|(image|figure|picture|photo|img|fig)\s*\d+$"
    r"|graphic$|icon$|logo$|screenshot$|picture$|photograph$|illustration$|\d+$)"
)
DECORATIVE_WORDS = r"(?i)\b(decorative|spacer|separator|border|divider|background)\b"
# The first letters come first: most places of a text are settled by one of them, before any word is tried.
SENSORY = (
    r"(?i)(?=[abcopst])\b(?:(click|tap|press)\s+the\s+(red|green|blue|yellow|orange|purple|round|square|triangle|circular|rectangular)\s+\w+"
    r"|(on\s+the\s+(left|right|top|bottom))\b"
    r"|the\s+(round|square|triangle|circular|rectangular)\s+(icon|button|shape|symbol)\b"
    r"|see\s+(the\s+)?(red|blue|green|yellow|orange|colored|colour)\b"
    r"|(above|below)\s+(chart|image|figure|table)\b)"
)
GENERIC_LINK = r"(?i)\b(click here|here|read more|more info|learn more|more|details|link)\b"
URL = r"(?i)https?://\S+"
BCP47 = r"^[a-zA-Z]{2,3}(-[a-zA-Z0-9]{2,8})*$"
CHART_WORDS = r"(?i)\b(chart|graph|figure|diagram|plot|pie|bar|line)\b"
FOREIGN_SCRIPT = (
    "[一-鿿Ѐ-ӿ؀-ۿऀ-ॿ]"
    "|[àáâãäåæçèéêëìíîïðñòóôõöùúûüýþÿ]{3,}"
)
WHITESPACE = r"[\s\u0085   -     　\u001c-\u001f]"
INK = WHITESPACE.replace("[", "[^", 1)


def strip(c: Column) -> Column:
    """Remove every kind of white space at both ends, not spaces only."""
    return F.regexp_replace(c, rf"^{WHITESPACE}+|{WHITESPACE}+$", "")


def blank(c: Column) -> Column:
    """Null, empty or white space: no other character is found, which the first one mostly settles."""
    return F.coalesce(~c.rlike(INK), F.lit(True))


def filled(c: Column) -> Column:
    return ~blank(c)


def nonempty(c: Column) -> Column:
    """Null when the text is empty, so that ``coalesce`` acts like a truth test."""
    return F.nullif(c, F.lit(""))


def first_nonempty(*cs: Column) -> Column:
    return F.coalesce(*[nonempty(c) for c in cs], F.lit(""))


def no_items(c: Column) -> Column:
    """Null or empty array."""
    return F.coalesce(F.size(c) == 0, F.lit(True))


def half_even(c: Column, step: float) -> Column:
    """Nearest multiple of ``step``, ties to even."""
    return F.bround(c / F.lit(float(step)), 0) * F.lit(float(step))


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def criterion_key(c: Column) -> Column:
    """Sort key that puts 1.4.3 before 1.4.10."""
    return F.transform(F.split(c, r"\."), lambda p: p.try_cast("int"))


# --- SQL text forms, for expression lists too long to build call by call ------


def q(value) -> str:
    """SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def q_strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WHITESPACE}+|{WHITESPACE}+$')}, '')"


def q_blank(x: str) -> str:
    return f"coalesce(NOT {q_like(x, INK)}, true)"


def q_first(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"


def q_empty(x: str) -> str:
    return f"coalesce(size({x}) = 0, true)"


def q_like(x: str, pattern: str) -> str:
    return f"({x} rlike {q(pattern)})"


def q_url(x: str) -> str:
    """Has an address; texts without the marks of one are told without a pattern."""
    return f"(contains({x}, '://') AND {q_like(x, URL)})"


def q_foreign(x: str) -> str:
    """Has a passage in a foreign script, which needs more than one byte for a character."""
    return f"(octet_length({x}) > length({x}) AND {q_like(x, FOREIGN_SCRIPT)})"

"""Text and time expressions, all JVM-side columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hesitation tokens that carry no content.
FILLERS = ("е", "ее", "еее", "ееее", "эм", "ем", "мм", "ммм", "хм", "ну")

#: What Python's str.split() splits on: (?U)\s and the four ASCII separators.
_SPACE = r"(?U)[\s\x{1c}-\x{1f}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once for a row: as a lambda's variable, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def flatten_space(text: Column) -> Column:
    """Every run of white space made one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def normalize_text(text: Column) -> Column:
    """Lower-cased letters, digits and underscores of any script, one space between runs. Not `\\w`: in Java
    that drops other scripts, and with (?U) it keeps combining marks."""
    return flatten_space(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_\s]", " "))


def tokens(text: Column) -> Column:
    """Normalised tokens without fillers, in order."""
    return tokens_of(normalize_text(text))


def tokens_of(norm: Column) -> Column:
    """tokens() of a text that is normalised already."""
    return F.filter(F.split(norm, " "), lambda t: (t != "") & ~t.isin(*FILLERS))


def containment_of(a: Column, b: Column) -> Column:
    """Share of the distinct tokens of array a that are in array b; 1 if a has none. Not symmetric."""
    return let(F.array_distinct(a), lambda own: F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(own, b)) / F.size(own)))


def token_containment(a: Column, b: Column) -> Column:
    return containment_of(tokens(a), tokens(b))


def parse_timestamp(text: Column) -> Column:
    """`[HH:]MM:SS.mmm` to seconds; null where a part is no number."""
    parts = F.reverse(F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("double")))
    at = lambda i: F.when(F.size(parts) > i, F.get(parts, F.lit(i))).otherwise(F.lit(0.0))
    return F.when(F.size(parts) <= 3, at(2) * 3600 + at(1) * 60 + at(0))


def format_timestamp(seconds: Column) -> Column:
    """Seconds to `HH:MM:SS.mmm`, halves of a millisecond to even."""
    ms = F.bround(seconds * 1000, 0).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def clock(seconds: Column) -> Column:
    """Seconds to `[HH:MM:SS]`, cut, not rounded."""
    s = seconds.cast("bigint")
    return F.format_string("[%02d:%02d:%02d]", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def escape_html(text: Column) -> Column:
    """&, <, > and both quotes as references; & first."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def strip_marks(fragment: Column) -> Column:
    return F.replace(F.replace(fragment, F.lit("<mark>"), F.lit("")), F.lit("</mark>"), F.lit(""))


def ordered_join(rows: Column, text: str, sep: str = " ", skip_empty: bool = True, distinct: bool = False) -> Column:
    """Texts of an array of structs, in the array's order, joined."""
    texts = F.transform(rows, lambda x: x[text])
    if skip_empty:
        texts = F.filter(texts, lambda t: t != "")
    return F.array_join(F.array_distinct(texts) if distinct else texts, sep)

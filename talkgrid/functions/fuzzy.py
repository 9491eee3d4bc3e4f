"""Name matching and text comparison that need Python's difflib, casefold or NFC: Arrow pandas UDFs."""

from __future__ import annotations

import html
import re
import unicodedata
from difflib import SequenceMatcher
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least similarity that binds a reading to a candidate; fewest characters of a lead that can.
MATCH_FROM, LEAD = 0.80, 4

_DOTS = re.compile(r"(?:…|\.{2,})\s*$")

MATCH = "name string, score double, matched boolean"


class Match(NamedTuple):
    name: str
    score: float
    matched: bool


def clean_name(name: str) -> str:
    """NFC, one trailing ellipsis off, white space collapsed."""
    return " ".join(_DOTS.sub("", unicodedata.normalize("NFC", name)).split())


def lead_similarity(reading: str, candidate: str) -> float:
    """difflib's ratio over as many leading characters as the shorter has; 0 under LEAD characters. What
    follows a name, or was cut off it, does not count."""
    n = min(len(reading), len(candidate))
    return SequenceMatcher(None, reading[:n], candidate[:n]).ratio() if n >= LEAD else 0.0


def ranked(reading: str, candidates: list[str]) -> list[tuple[str, float]]:
    """Candidates with scores, best first, earlier candidates first among equals."""
    own = clean_name(reading).casefold()
    return sorted(((c, lead_similarity(own, clean_name(c).casefold())) for c in candidates), key=lambda x: -x[1])


def match(reading: str, candidates: list[str], least: float = MATCH_FROM) -> Match:
    """The best candidate, matched if it scores `least` or more; else the reading itself, cleaned."""
    best = next(iter(ranked(reading, candidates)), ("", 0.0))
    return Match(best[0], best[1], True) if best[0] and best[1] >= least else Match(clean_name(reading), best[1], False)


def resolve(reading: Column, candidates: Column, least: float = MATCH_FROM) -> Column:
    """Struct (name, score, matched) of a reading against an array of candidates; null for a null reading."""

    @F.pandas_udf(MATCH)
    def run(text: pd.Series, names: pd.Series) -> pd.DataFrame:
        known: dict[tuple, Match] = {}
        out = []
        for t, c in zip(text, names, strict=True):
            key = (t, tuple(c) if c is not None else ())
            if t is not None and key not in known:
                known[key] = match(t, list(key[1]), least)
            out.append(known[key] if t is not None else (None, None, None))
        return pd.DataFrame(out, columns=["name", "score", "matched"])

    return run(reading, candidates)


def top_candidates(reading: Column, candidates: Column, n: int = 3) -> Column:
    """The n best candidates as an array of (name, score)."""

    @F.pandas_udf("array<struct<name:string,score:double>>")
    def run(text: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"name": a, "score": s} for a, s in ranked(t, list(c if c is not None else []))[:n]] for t, c in zip(text, names, strict=True)])

    return run(reading, candidates)


def cleaned(name: Column) -> Column:
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(clean_name, na_action="ignore")

    return run(name)


def marked(left: str, right: str) -> tuple[str, str]:
    """Both texts' tokens, HTML-escaped, those that differ (case aside) in <mark>."""
    a, b = left.split(), right.split()
    differs: tuple[set[int], set[int]] = (set(), set())
    for kind, a0, a1, b0, b1 in SequenceMatcher(a=[t.lower() for t in a], b=[t.lower() for t in b]).get_opcodes():
        if kind != "equal":
            differs[0].update(range(a0, a1))
            differs[1].update(range(b0, b1))
    show = lambda words, own: " ".join(f"<mark>{html.escape(w)}</mark>" if i in own else html.escape(w) for i, w in enumerate(words))
    return show(a, differs[0]), show(b, differs[1])


def token_diff(left: Column, right: Column) -> Column:
    """Struct (left, right) of two texts with their differences marked; nulls are empty."""

    @F.pandas_udf("left string, right string")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([marked(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["left", "right"])

    return run(left, right)

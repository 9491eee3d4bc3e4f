"""Glossary merge: corrections from a review into a glossary file."""

from __future__ import annotations

from pathlib import Path

from talkgrid.operators.glossary import Merged, merge
from talkgrid.sources.readers import load_corrections, load_glossary
from talkgrid.sources.writers import write_back


def merge_file(glossary: str | Path, corrections: str | Path) -> Merged:
    """Nothing is written unless all corrections fit together and into the glossary."""
    before = load_glossary(glossary)
    after, done = merge(before, load_corrections(corrections))
    write_back(glossary, before, after, done)
    return done

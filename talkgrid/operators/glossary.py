"""Glossaries: checks, ordered union, ordered merge of corrections."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.errors import DictionaryError

CATEGORIES = ("term", "person", "company", "product")


@dataclass
class Entry:
    canonical: str
    category: str
    note: str | None = None
    misheard: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Correction:
    canonical: str
    heard: str
    category: str = "term"


@dataclass
class Merged:
    added_entries: list[str] = field(default_factory=list)
    added_misheard: list[tuple[str, str]] = field(default_factory=list)
    unchanged: int = 0


def check(entries: list[Entry]) -> None:
    """Canonical forms are unique, mishearings belong to one of them; case doesn't matter."""
    seen: set[str] = set()
    owner: dict[str, str] = {}
    for e in entries:
        if e.category not in CATEGORIES:
            raise DictionaryError(f"{e.canonical!r}: category {e.category!r} is not one of {', '.join(CATEGORIES)}")
        if e.canonical.lower() in seen:
            raise DictionaryError(f"{e.canonical!r} is listed twice")
        seen.add(e.canonical.lower())
        for heard in e.misheard:
            if owner.setdefault(heard.lower(), e.canonical) != e.canonical:
                raise DictionaryError(f"{heard!r} is a mishearing of both {owner[heard.lower()]!r} and {e.canonical!r}")


def conflicts(glossary: DataFrame) -> DataFrame:
    """(kind, key): the same checks as a query, for glossaries too large for the driver."""
    twice = glossary.groupBy(F.lower("canonical").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("canonical").alias("kind"), "key")
    heard = glossary.select("canonical", F.explode("misheard").alias("h")).groupBy(F.lower("h").alias("key")).agg(F.countDistinct("canonical").alias("n"))
    return twice.unionByName(heard.where("n > 1").select(F.lit("misheard").alias("kind"), "key"))


def union(parts: list[DataFrame]) -> DataFrame:
    """Glossaries one after another: entry_idx counts through, file_idx tells the file."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("file_idx", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out.withColumn("entry_idx", F.row_number().over(Window.orderBy("file_idx", "entry_idx")) - 1)


def merge(entries: list[Entry], corrections: list[Correction]) -> tuple[list[Entry], Merged]:
    """Corrections applied in order, later ones seeing earlier ones. A mishearing that another entry owns raises
    before anything changes; an unknown canonical form becomes an entry; a known mishearing is left alone."""
    out = [Entry(e.canonical, e.category, e.note, list(e.misheard or [])) for e in entries]
    by_name = {e.canonical: e for e in out}
    owner = {h.lower(): e.canonical for e in out for h in e.misheard}
    done = Merged()
    for c in corrections:
        if owner.get(c.heard.lower(), c.canonical) != c.canonical:
            raise DictionaryError(f"{c.heard!r} is already a mishearing of {owner[c.heard.lower()]!r}, not of {c.canonical!r}")
        owner[c.heard.lower()] = c.canonical
        entry = by_name.get(c.canonical)
        if entry is None:
            entry = by_name[c.canonical] = Entry(c.canonical, c.category, None, [c.heard])
            out.append(entry)
            done.added_entries.append(c.canonical)
        elif c.heard.lower() in {h.lower() for h in entry.misheard}:
            done.unchanged += 1
        else:
            entry.misheard.append(c.heard)
            done.added_misheard.append((c.canonical, c.heard))
    return out, done


def merge_at_scale(glossary: DataFrame, corrections: DataFrame) -> DataFrame:
    """The same upsert as a set: (canonical, category, note, misheard), old entries first, for conflict-free
    corrections (corr_idx, canonical, heard, category). A mishearing counts once, whatever its case."""
    old = glossary.select("canonical", "category", "note", F.col("entry_idx").alias("_e"), F.posexplode_outer("misheard").alias("_j", "heard")).withColumn("_new", F.lit(0))
    new = corrections.select("canonical", "category", F.lit(None).cast("string").alias("note"), F.lit(None).cast("long").alias("_e"), F.col("corr_idx").alias("_j"), "heard").withColumn("_new", F.lit(1))
    rows = old.withColumn("_e", F.col("_e").cast("long")).withColumn("_j", F.col("_j").cast("long")).unionByName(new.withColumn("_j", F.col("_j").cast("long")))
    once = Window.partitionBy("canonical", F.lower("heard")).orderBy("_new", "_j")
    kept = rows.withColumn("_r", F.row_number().over(once)).withColumn("heard", F.when((F.col("_new") == 0) | (F.col("_r") == 1), F.col("heard")))
    first = F.struct("_new", "_j")
    out = kept.groupBy("canonical").agg(
        F.min_by("category", first).alias("category"), F.max("note").alias("note"), F.min("_e").alias("_e"), F.min("_j").alias("_c"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("heard").isNotNull(), F.struct("_new", "_j", "heard")))), lambda x: x["heard"]).alias("misheard"),
    )
    return out.orderBy(F.col("_e").asc_nulls_last(), "_c").drop("_e", "_c")


def candidates(roster: list[str], guests: list[str]) -> list[str]:
    """Who may speak: the roster, then the guests, in order, repetitions kept."""
    return [*roster, *guests]

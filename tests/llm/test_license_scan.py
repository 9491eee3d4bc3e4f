import random
import re
from re import _parser

import duckdb
import pytest
from helpers import DOCS, words
from pyspark.sql import functions as F

from talkgrid.llm import license_scan as ls
from talkgrid.llm import oracles

SNIPPETS = [
    "MIT License", "mit license, MIT LICENSE", "Licensed under the Apache License, Version 2.0", "GNU General Public License v3", "SPDX-License-Identifier: GPL-3.0-or-later", "CC BY-SA 4.0", "CC-BY",
    "BSD 3-Clause License", "Permission is hereby granted, free of charge, to any person obtaining a copy", "Copyright (c) 2020 Foo Bar", "All rights reserved.", "see the LICENSE file for details",
    "released under the Mozilla Public License 2.0", "Creative Commons Attribution NonCommercial 3.0", "gnu general public license gnu general public license", "smit licenses", "the licence",
]


def brute(text):
    w = words(text)
    line = " ".join(w)
    base = sorted((i, label) for phrase, label in ls.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    hits = []
    for n, r in enumerate(ls.RULES):
        if r.keyword in line:
            for m in re.finditer(r.regex, line):
                first = line[: m.start()].count(" ")
                hits.append((first, first + m[0].count(" ") + 1, r.priority, n, r.label))
    kept = [h for h in hits if not any(e is not h and e[0] <= h[0] and e[1] >= h[1] and e[2] <= h[2] and (e[:2] != h[:2] or e[2:4] < h[2:4]) for e in hits)]
    labels = {h[4] for h in kept} | {x for _, x in base}
    return (len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels))), sorted(h[:2] + (h[4],) for h in kept)


def test_scan_matches_brute_force(spark):
    rng = random.Random(2)
    docs = [(1, None), (2, ""), (3, "---"), (None, "MIT License")]
    for i in range(10, 150):
        parts = [rng.choice(SNIPPETS) if rng.random() < 0.3 else f"wörd{rng.randrange(50)}" for _ in range(rng.randrange(1, 25))]
        docs.append((i, rng.choice([" ", "\n", ", "]).join(parts)))
    docs += [docs[10], (500, "mit license " * 700)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS).withColumns({"labels": F.lit(1), "found": F.lit("f"), "_w": F.lit("w")})
    got = ls.license_scan(df).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels), sorted((x.first, x.past, x.label) for x in r.found)) for r in got) == sorted(
        ((i is None, i or 0), *brute(t)) for i, t in docs
    )
    assert all(0 <= r.score <= 1 for r in got) and {r.score > 0 for r in got if r.found} == {True}
    assert ls.license_scan(df.limit(0)).count() == 0


def test_there_are_hundreds_of_distinct_rules():
    assert len({r.regex for r in ls.RULES}) > 200
    for r in ls.RULES:
        re.compile(r.regex)


def made(tree, high):
    """A string that a parsed expression matches."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            out += "1" if "CATEGORY" in str(arg) else "x" if str(arg[0][0]) == "NEGATE" else chr(arg[-1 if high else 0][1])
        elif name == "BRANCH":
            out += made(arg[1][-1 if high else 0], high)
        elif name == "SUBPATTERN":
            out += made(arg[3], high)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += made(arg[2], high) * (max(arg[0], 1) if high else arg[0])
    return out


def sample(rule, high):
    return made(_parser.parse(re.sub(r"^\(\?<!\[\^ \]\)|\(\?!\[\^ \]\)$", "", rule.regex)), high)


@pytest.mark.parametrize("rule", range(len(ls.RULES)))
def test_every_match_holds_a_root_and_its_keyword(rule):
    """The prefilter loses nothing: strings made from a rule's expression hold its keyword and a root."""
    r = ls.RULES[rule]
    for high in (False, True):
        text = sample(r, high)
        assert r.keyword in text and any(root in text for root in ls.ROOTS), (r, text)


def test_long_texts_of_matches(spark):
    """No rule nests or slows down on a long run of its own matches, nor on what its repeats match."""
    texts = [(i, " ".join([sample(r, True)] * (4000 // len(sample(r, True).split())))) for i, r in enumerate(ls.RULES)]
    texts += [(1000, "copyright " + "1999 " * 100_000), (1001, "mit license " * 50_000), (1002, "copyright " * 100_000), (1003, "licen" * 100_000), (1004, "copyright c 2001 " + "x" * 300_000)]
    got = {r.doc_id: r for r in ls.license_scan(spark.createDataFrame(texts, "doc_id long, text string").repartition(8)).select("doc_id", "n_words", "n_base", F.size("found").alias("n")).collect()}
    assert all(got[i].n > 0 for i in range(len(ls.RULES)))
    assert (got[1000].n_words, got[1000].n) == (100_001, 1)
    assert (got[1001].n_base, got[1001].n) == (50_000, 50_000)


def test_only_ascii_letters_are_lower_cased(spark):
    got = ls.license_scan(spark.createDataFrame([(1, "M\u0130T license"), (2, "MIT LICENSE \u212aB")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_base for r in got] == [0, 1] and [r.n_words for r in got] == [2, 3]


def test_base_columns_equal_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    lower = oracles.LOWER.format("text")
    parts = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS place, '{x}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE array_to_string(w[i:i + {len(p.split()) - 1}], ' ') = '{p}'" for p, x in ls.BASE.items())
    want = con.execute(
        f"WITH d AS (SELECT doc_id, regexp_extract_all({lower}, '{oracles.WORD}') AS w FROM documents), h AS ({parts}) "
        "SELECT d.doc_id, len(w), count(place), min(place), max(place), coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (label IS NOT NULL))), ','), '') FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id, w"
    ).fetchall()
    got = ls.license_scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))

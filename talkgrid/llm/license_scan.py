"""License scans with ordered signature rules, in DataFrame functions only.

A text is lower-cased and reduced to words one space apart. Cheap `contains` tests on a few roots pass most
texts by. For the rest, each rule whose keyword the text holds runs its regular expression, a literal that is
compiled once, which puts marks around its matches; the pieces between marks give each match's place in words.
No expression repeats a group without bound, so no text, however long, nests matches deeply. Detections are then swept in order of place: one that
lies within another of equal or better priority goes (of two on the same words, the better priority, then
the earlier rule, stays). Everything is a narrow expression over one row: no shuffle, no explosion.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases that are always looked for, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Hand-written signatures: label; keyword; names as regular expressions over spaced lower-case words;
# SPDX identifier as words. A rule for the SPDX tag, one for each name and one for a grant in the name's
# words come of each line.
_LICENSES = r"""
mit; mit licen; mit licen[cs]e; mit
mit; x11 licen; mit x11 licen[cs]e;
mit; expat; expat licen[cs]e;
mit-0; mit no attribution; mit no attribution( licen[cs]e)?; mit 0
mit-0; mit 0; mit 0;
apache-1.0; apache; apache( software)? licen[cs]e( version)? 1 0; apache 1 0
apache-1.1; apache; apache( software)? licen[cs]e( version)? 1 1; apache 1 1
apache-2.0; apache; apache( software)? licen[cs]e( version)? 2 0|apache 2( 0)? licen[cs]e|apache licen[cs]e v2( 0)?; apache 2 0
apache; apache; apache( software)? licen[cs]e;
apache-2.0; asl 2 0; asl 2 0;
gpl-1.0; general public; (gnu )?general public licen[cs]e( as published by the free software foundation)? (version|v) ?1( 0)?; gpl 1 0( only| or later)?
gpl-1.0; gpl; (gnu )?gpl ?(version |v)?1( 0)?;
gpl-2.0; general public; (gnu )?general public licen[cs]e( as published by the free software foundation)? (version|v) ?2( 0)?; gpl 2 0( only| or later)?
gpl-2.0; gpl; (gnu )?gpl ?(version |v)?2( 0)?;
gpl-3.0; general public; (gnu )?general public licen[cs]e( as published by the free software foundation)? (version|v) ?3( 0)?; gpl 3 0( only| or later)?
gpl-3.0; gpl; (gnu )?gpl ?(version |v)?3( 0)?;
gpl; general public; gnu general public licen[cs]e;
gpl; gnu public; gnu public licen[cs]e;
gpl; gpl; gnu gpl|gpl licen[cs]e;
lgpl-2.0; library general; (gnu )?library general public licen[cs]e( version| v)?( 2( 0)?)?; lgpl 2 0( only| or later)?
lgpl-2.0; lgpl; lgpl ?v?2 0;
lgpl-2.1; lesser general; (gnu )?lesser general public licen[cs]e( version| v) ?2 1; lgpl 2 1( only| or later)?
lgpl-2.1; lgpl; lgpl ?(version |v)?2 1;
lgpl-3.0; lesser general; (gnu )?lesser general public licen[cs]e( version| v) ?3( 0)?; lgpl 3 0( only| or later)?
lgpl-3.0; lgpl; lgpl ?(version |v)?3( 0)?;
lgpl; lesser general; (gnu )?lesser general public licen[cs]e;
agpl-3.0; affero; (gnu )?affero general public licen[cs]e( version| v) ?3( 0)?; agpl 3 0( only| or later)?
agpl; affero; (gnu )?affero general public licen[cs]e|affero gpl;
agpl-3.0; agpl; agpl ?(version |v)?3( 0)?;
gfdl-1.1; free documentation; (gnu )?free documentation licen[cs]e( version| v) ?1 1; gfdl 1 1( only| or later)?
gfdl-1.2; free documentation; (gnu )?free documentation licen[cs]e( version| v) ?1 2; gfdl 1 2( only| or later)?
gfdl-1.3; free documentation; (gnu )?free documentation licen[cs]e( version| v) ?1 3; gfdl 1 3( only| or later)?
gfdl; free documentation; (gnu )?free documentation licen[cs]e;
bsd-4-clause; bsd; (original|old|4 clause|four clause) bsd licen[cs]e|bsd 4 clause( licen[cs]e)?; bsd 4 clause
bsd-3-clause; bsd; (new|modified|revised|3 clause|three clause) bsd licen[cs]e|bsd 3 clause( licen[cs]e)?; bsd 3 clause
bsd-2-clause; bsd; (simplified|freebsd|2 clause|two clause) bsd licen[cs]e|bsd 2 clause( licen[cs]e)?; bsd 2 clause
bsd-1-clause; bsd; bsd 1 clause( licen[cs]e)?; bsd 1 clause
0bsd; bsd; (zero clause|0 clause) bsd licen[cs]e|0bsd( licen[cs]e)?; 0bsd
bsd; bsd; bsd( style)? licen[cs]e;
mpl-1.0; mozilla; mozilla public licen[cs]e( version| v) ?1 0; mpl 1 0
mpl-1.1; mozilla; mozilla public licen[cs]e( version| v) ?1 1; mpl 1 1
mpl-2.0; mozilla; mozilla public licen[cs]e( version| v)? ?2 0; mpl 2 0( no copyleft exception)?
mpl; mozilla; mozilla public licen[cs]e;
epl-1.0; eclipse; eclipse public licen[cs]e( version| v)? ?1 0; epl 1 0
epl-2.0; eclipse; eclipse public licen[cs]e( version| v)? ?2 0; epl 2 0
epl; eclipse; eclipse public licen[cs]e;
edl-1.0; eclipse; eclipse distribution licen[cs]e( version| v)?( ?1 0)?;
cddl-1.0; development and distribution; common development and distribution licen[cs]e( version| v)?( ?1 0)?; cddl 1 0
cddl-1.1; development and distribution; common development and distribution licen[cs]e( version| v) ?1 1; cddl 1 1
cpl-1.0; common public; common public licen[cs]e( version| v)?( ?1 0)?; cpl 1 0
ipl-1.0; ibm; ibm public licen[cs]e( version| v)?( ?1 0)?; ipl 1 0
eupl-1.1; european union; european union public licen[cs]e( version| v)? ?1 1; eupl 1 1
eupl-1.2; european union; european union public licen[cs]e( version| v)? ?1 2; eupl 1 2
artistic-1.0; artistic; artistic licen[cs]e( version| v)? ?1 0; artistic 1 0
artistic-2.0; artistic; artistic licen[cs]e( version| v)? ?2 0; artistic 2 0
artistic; artistic; (perl |clarified )?artistic licen[cs]e;
isc; isc licen; isc licen[cs]e; isc
zlib; zlib; zlib( libpng)? licen[cs]e; zlib
libpng; libpng; libpng licen[cs]e( version 2)?; libpng( 2 0)?
bsl-1.0; boost software; boost software licen[cs]e( version)?( 1 0)?; bsl 1 0
busl-1.1; business source; business source licen[cs]e( version)?( 1 1)?; busl 1 1
unlicense; unlicense; (the )?unlicense; unlicense
wtfpl; do what the; do what the fuck you want to public licen[cs]e; wtfpl
wtfpl; wtfpl; wtfpl;
psf-2.0; python; python software foundation licen[cs]e( version 2)?; psf 2 0|python 2 0
psf-2.0; psf licen; psf licen[cs]e;
php-3.01; php; php licen[cs]e( version)?( 3 01)?; php 3 01
ruby; ruby; ruby licen[cs]e; ruby
openssl; openssl; openssl licen[cs]e|dual openssl and ssleay licen[cs]e; openssl
ofl-1.1; open font; (sil )?open font licen[cs]e( version)?( 1 1)?; ofl 1 1
ms-pl; microsoft public; microsoft public licen[cs]e( ms pl)?; ms pl
ms-rl; microsoft reciprocal; microsoft reciprocal licen[cs]e( ms rl)?; ms rl
osl-3.0; open software; open software licen[cs]e( version| v)?( ?3 0)?; osl 3 0
afl-3.0; academic free; academic free licen[cs]e( version| v)?( ?3 0)?; afl 3 0
ecl-2.0; educational community; educational community licen[cs]e( version)?( 2 0)?; ecl 2 0
upl-1.0; universal permissive; universal permissive licen[cs]e( version| v)?( ?1 0)?; upl 1 0
ncsa; illinois; university of illinois( ncsa)? open source licen[cs]e; ncsa
postgresql; postgresql; postgresql licen[cs]e; postgresql
vim; vim licen; vim licen[cs]e; vim
w3c; w3c; w3c( software( notice)?( and)?)? licen[cs]e; w3c
x11; x11 licen; x11 licen[cs]e; x11
sspl-1.0; server side; server side public licen[cs]e( version| v)?( ?1)?; sspl 1 0
elastic-2.0; elastic licen; elastic licen[cs]e( version)?( 2 0)?; elastic 2 0
polyform; polyform; polyform (noncommercial|small business|shield|perimeter)( licen[cs]e)?( 1 0 0)?; polyform (noncommercial|small business) 1 0 0
odbl-1.0; database licen; open( data commons open)? database licen[cs]e( version| v)?( ?1 0)?; odbl 1 0
odc-by-1.0; data commons; open data commons attribution licen[cs]e( version| v)?( ?1 0)?; odc by 1 0
pddl-1.0; domain dedication; (open data commons )?public domain dedication( and)? licen[cs]e; pddl 1 0
cecill-2.1; cecill; cecill( b| c)?( free software)? licen[cs]e( agreement)?( 2 1)?; cecill 2 1
openrail; rail; (bigscience |creativeml )?open ?rail( m)? licen[cs]e;
llama; llama; llama (2|3|3 1|3 2)? ?community licen[cs]e( agreement)?;
nasa-1.3; nasa open; nasa open source agreement( 1 3)?( licen[cs]e)?; nasa 1 3
"""

_CC = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
_CC_NAMES = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(ative)?s?", "nc": "non ?commercial"}
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Signatures that name no license: label; keyword; regular expression.
_TEXTS = r"""
mit; permission is hereby; permission is hereby granted free of charge to any person obtaining a copy
isc; permission to use; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd; redistribution and use; redistribution and use in source and binary forms with or without modification are permitted
zlib; permission is granted; permission is granted to anyone to use this software for any purpose including commercial applications
unlicense; released into the public domain; this is free and unencumbered software released into the public domain
gpl; redistribute it; you can redistribute it and or modify it under the terms of the gnu (lesser |affero )?general public licen[cs]e
apache; compliance with the licen; you may not use this file except in compliance with the licen[cs]e
public-domain; the public domain; (placed|released|dedicated) (in|into|to) the public domain
public-domain; domain dedication; public domain dedication
cc0; cc0; cc0( 1 0)?( universal)?
cc; creative commons; (licensed )?under (a |the )?creative commons( licen[cs]e)?
no-warranty; without warranty; provided as is without warranty of any kind
no-warranty; without any warranty; without any warranty without even the implied warranty of merchantability
copyright; copyright; copyright( c| ©)? (19|20)\d\d( (19|20)\d\d){0,12}( by)?( [^ ]+){0,3}
copyright; copyright; copyright( c| ©)? [^ ]+ (19|20)\d\d
all-rights-reserved; all rights reserved; all rights reserved
proprietary; proprietary; proprietary (and confidential licen[cs]e|licen[cs]e)
proprietary; end user; end user licen[cs]e agreement
proprietary; commercial licen; commercial licen[cs]e
license-file; licen; see (the )?(accompanying )?licen[cs]e( file| txt| md)?( for (more )?(details|information))?
licensed; licen; (all )?(code|content|text|software|work|data) (is|are) licen[cs]ed
"""

_GRANT = "(dual )?(licen[cs]ed|released|distributed|available|published|provided|shared) under( the| a| an)?( terms( and conditions)? of( the| a| an)?)? "


class Rule(NamedTuple):
    """priority: 0 SPDX tag, 1 grant in a license's name, 2 name, 3 other signature."""

    priority: int
    label: str
    keyword: str
    regex: str


def _rules() -> list[Rule]:
    found: list[Rule] = []

    def add(priority: int, label: str, keyword: str, regex: str) -> None:
        found.append(Rule(priority, label, keyword, rf"(?<![^ ])(?:{regex})(?![^ ])"))

    for line in filter(None, map(str.strip, _LICENSES.split("\n"))):
        label, keyword, names, tag = (x.strip() for x in line.split(";"))
        if tag:
            add(0, label, "spdx", rf"spdx licen[cs]e identifier (?:{tag})")
        add(1, label, keyword, f"{_GRANT}(?:{names})")
        add(2, label, keyword, names)
    for kind in _CC:
        name = r" ".join(_CC_NAMES[x] for x in kind.split())
        code = kind.replace(" ", " ?")
        for v in _CC_VERSIONS:
            label = f"cc-{kind} {v}".replace(f" {v}", f"-{v.replace(' ', '.')}").replace(" ", "-")
            add(0, label, "spdx", rf"spdx licen[cs]e identifier cc {kind} {v}")
            add(2, label, "cc by", rf"cc {code} {v}")
            add(2, label, "creative commons", rf"creative commons {name} {v}( international| unported| generic)?( licen[cs]e)?")
        label = f"cc-{kind}".replace(" ", "-")
        add(1, label, "cc by", rf"{_GRANT}cc {code}( \d \d)?")
        add(2, label, "cc by", rf"cc {code}")
        add(2, label, "creative commons", rf"creative commons {name}( licen[cs]e)?")
    for line in filter(None, map(str.strip, _TEXTS.split("\n"))):
        label, keyword, regex = (x.strip() for x in line.split(";"))
        add(3, label, keyword, regex)
    return found


RULES = _rules()
#: Every rule's matches hold one of these, so a text without any needs no rule.
ROOTS = ("licen", "gpl", "cc by", "cc0", "copyright", "public domain", "creative commons", "permission", "redistribution", "warrant", "all rights reserved", "spdx", "mit 0", "mit no attribution", "asl 2 0", "wtfpl", "0bsd", "bsd ", "polyform", "nasa")
WEIGHTS = (1.0, 0.95, 0.8, 0.5)


def spaced(text: Column) -> Column:
    """Words of other than ASCII punctuation and controls, A-Z lower-cased, one space apart."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def let(value: Column, body: Callable) -> Column:
    """body(value), with the value computed once: as a lambda's variable, and not at each place that names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, zero: Column, step: Callable, out: Callable, kind: str, block: int = 256) -> Column:
    """out(state, x) for each x of an array, where the state before x is step() over all before. In blocks, as
    each append copies an array: linear but for a small factor, however long the array."""
    return let(values, lambda v: _scan(v, zero, step, out, kind, block))


def _scan(values: Column, zero: Column, step: Callable, out: Callable, kind: str, block: int) -> Column:
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["s"], x).alias("s"), F.concat(acc["o"], F.array(out(acc["s"], x).cast(kind))).alias("o"))

    def many(acc: Column, b: Column) -> Column:
        inner = F.aggregate(F.slice(values, b * block + 1, block), F.struct(acc["s"].alias("s"), none.alias("o")), one)
        return let(inner, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

    start = F.struct(zero.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("o"))
    whole = F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), start, many)["o"])
    return F.when(F.size(values) == 0, none).otherwise(whole)


#: Marks around a match; spaced text holds no controls.
_OPEN, _SHUT = "\x01", "\x02"


def places(text: Column) -> Column:
    """Array of (first, past), in words, of the marked matches of a text."""
    return let(F.split(text, _OPEN, -1), _placed)


def _placed(pieces: Column) -> Column:
    after = F.slice(pieces, 2, F.size(pieces) - 1)
    gaps = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), _spaces)
    firsts = scan(gaps, F.lit(0), lambda s, x: s + x, lambda s, x: s + x, "int")
    return F.zip_with(firsts, after, lambda a, m: F.struct(a.alias("first"), (a + _spaces(F.substring_index(m, _SHUT, 1)) + 1).alias("past")))


def _matching(words: str, rules: list[tuple[str, str, str]]) -> Column:
    """Array of (about, text) for the (keyword, expression, about) that match in a column: `about`, which is SQL, and
    the text with marks around the matches. As one piece of SQL, as hundreds of columns take long to put together."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    mark = quote(f"{_OPEN}$0{_SHUT}")
    each = [f"named_struct('about', {about}, 'text', CASE WHEN contains({words}, {quote(keyword)}) THEN regexp_replace({words}, {quote(regex)}, {mark}) END)" for keyword, regex, about in rules]
    return F.expr(f"filter(array({', '.join(each)}), x -> contains(x.text, '{_OPEN}'))")


def detections(words: str, rules: list[Rule] = RULES) -> Column:
    """Array of (first, past, label, priority, keep) in a column of spaced text, suppressed ones gone, in order of place."""
    found = _matching(words, [(r.keyword, r.regex, f"named_struct('priority', {r.priority}, 'rule', {i}, 'label', '{r.label}')") for i, r in enumerate(rules)])
    hits = F.flatten(
        F.transform(
            found,
            lambda f: F.transform(
                places(f["text"]),
                lambda x: F.struct(x["first"].alias("first"), (-x["past"]).alias("back"), f["about"]["priority"].alias("priority"), f["about"]["rule"].alias("rule"), f["about"]["label"].alias("label")),
            ),
        )
    )
    return let(F.array_sort(hits), lambda ordered: _unsuppressed(ordered, sorted({r.priority for r in rules})))


def _unsuppressed(ordered: Column, levels: list[int]) -> Column:
    name = [f"p{p}" for p in levels]
    zero = F.struct(*[F.lit(0).alias(n) for n in name])
    step = lambda s, x: F.struct(*[F.when(x["priority"] == p, F.greatest(s[n], -x["back"])).otherwise(s[n]).alias(n) for n, p in zip(name, levels, strict=True)])
    inside = lambda s, x: F.greatest(*[F.when(F.lit(p) <= x["priority"], s[n]).otherwise(0) for n, p in zip(name, levels, strict=True)], F.lit(0)) < -x["back"]
    flags = scan(ordered, zero, step, inside, "boolean")
    both = F.zip_with(ordered, flags, lambda x, keep: F.struct(x["first"].alias("first"), (-x["back"]).alias("past"), x["label"].alias("label"), x["priority"].alias("priority"), keep.alias("keep")))
    return F.filter(both, lambda x: x["keep"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    n_base counts the places of the phrases in BASE, first_word and last_word are the smallest and largest
    start (null without one). `found` holds the surviving detections (first, past, label, priority, keep) in
    words from 0; labels joins their labels with the base ones. score is the best detection's weight, 0
    without any. Null and empty texts have no words. Other columns are ignored; repeated rows and null ids
    stay as they are; an empty table gives no rows.
    """
    words = F.col("_w")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), spaced(F.col(text_col).cast("string")).alias("_w"))
    base = F.lit(False)
    for phrase in BASE:
        base = base | F.contains(words, F.lit(phrase))
    rooted = F.lit(False)
    for root in ROOTS:
        rooted = rooted | F.contains(words, F.lit(root))
    base_kinds = "array<struct<first:int,past:int,label:string>>"
    every = _matching("_w", [(p, rf"(?<![^ ]){p}(?![^ ])", f"'{x}'") for p, x in BASE.items()])
    base_hits = F.flatten(F.transform(every, lambda r: F.transform(places(r["text"]), lambda x: F.struct(x["first"].alias("first"), x["past"].alias("past"), r["about"].alias("label")))))
    all_kinds = "array<struct<first:int,past:int,label:string,priority:int,keep:boolean>>"
    rows = rows.select(
        "doc_id",
        F.when(words == "", 0).otherwise(_spaces(words) + 1).cast("long").alias("n_words"),
        F.when(base, base_hits).otherwise(F.array().cast(base_kinds)).alias("_base"),
        F.when(rooted, detections("_w")).otherwise(F.array().cast(all_kinds)).alias("found"),
    )
    labels = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"])))
    weight = F.greatest(*[F.when(F.array_contains(F.transform("found", lambda x: x["priority"]), F.lit(p)), F.lit(w)).otherwise(0.0) for p, w in enumerate(WEIGHTS)], F.when(F.size("_base") > 0, F.lit(WEIGHTS[2])).otherwise(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["first"])).cast("long").alias("first_word"), F.array_max(F.transform("_base", lambda x: x["first"])).cast("long").alias("last_word"),
        F.array_join(labels(F.col("_base")), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(labels(F.col("_base")), labels(F.col("found")))), ",").alias("labels"),
        weight.alias("score"), "found",
    )

"""Plain-Python versions of what the operators return, written from their contracts."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def runs(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width):
    w = runs((text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near(docs, width=3, percent=85):
    """docs: list of (doc_id, text). Rows (doc_id, n_shingles, component_id, kept) as a Counter."""
    sets = [(i, shingles(t, width)) for i, t in docs]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is None or j is None or not a or not b:
                continue
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return Counter((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets)


def leaks(docs, items, size=10):
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            grams[tuple(w[k : k + size])].add(item)
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    found |= grams[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return Counter(out)


def near_leaks(docs, items, size=10, slop=3):
    """For each document, the items all of whose words some window has within slop of their places, and no exact one."""
    out = []
    for _, text in docs:
        w, found = words(text), set()
        for item, own in items:
            v = words(own)
            grams = [v[k : k + size] for k in range(max(1, len(v) - size + 1))] if v else []
            if any(w[s : s + len(g)] == g for g in grams for s in range(len(w) - len(g) + 1)):
                continue
            if any(all(x in w[max(0, s + j - slop) : s + j + slop + 1] for j, x in enumerate(g)) for g in grams if len(g) > 1 for s in range(len(w) - len(g) + 1)):
                found.add(item)
        out.append(len(found))
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())

"""Main text of web pages: a suffix array of each host's pages, with document structure as a hint.

A page is cut into blocks of visible text, each marked by the structure around it: `CHROME` (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, hidden parts), `ARTICLE` (inside
article or main) or `LOOSE` (neither). The token streams of all blocks of a host's pages are laid end to end;
pages with equal streams are one. A suffix array with its common-prefix lengths finds the substrings of `RUN`
tokens or more that distinct pages share, and on how many pages they stand. A token is covered if it lies in
one that stands on two pages at least, and on `SHARE` of the host's distinct pages. Then

* a loose block goes if it is covered for the most part, and its uncovered rest stays otherwise. On a page that
  is covered for the most part, a copy, only substrings on most pages count, and none if they do the same;
* in an article, substrings go only if they stand on most pages of the host (`COMMON`, and `LEAST` pages) and
  most of the article is something else: text that some pages merely quote from each other, or copies of a
  page, are no boilerplate;
* where the structure names an article, loose blocks go as well, and so do blocks that it marks as chrome: a
  menu or form that stands on one page only is not the article either. An article is never chrome for what is
  around it, reader comments and <aside>, <nav>, <footer> apart.

Hosts of more than `GROUP` bytes are dealt into parts by a hash of the stream, so no task holds a large host.
A substring that stands on a share of all distinct pages stands on that share of some part's: each part's
suffix array yields the runs of RUN tokens that do so there, and all parts count these few exactly. The texts
are those of an unsplit host, and only such runs move between parts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.llm.common import small_batches, stored, tidy

CHROME, LOOSE, ARTICLE, MAYBE = 0, 1, 2, 3
RUN, GROUP, MOSTLY = 8, 8 << 20, 0.8
SHARE, COMMON, LEAST = 0.01, 0.6, 5

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*\Z|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Fixed values of HTML: elements by what they do to text.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_CHROME_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "search", "svg", "canvas", "object", "audio", "video", "datalist", "fieldset", "head"}
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "form", "status"}
_CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner sidebar sidebars nav navbar navigation navi menu menus "
    "footer masthead topbar breadcrumb breadcrumbs pagination pager comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices alert alerts "
    "popup modal overlay newsletter subscribe subscription signup signin login search share sharing social related recommended recommendations widget widgets toolbar skip hidden".split()
)
_COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "respond", "replies", "reply"}
#: Words that say no more in a class or id than where or what sort of box it is.
_BOX_WORDS = set(
    "a site page main global primary secondary left right top bottom upper lower header head foot side post posts article articles list lists box area wrapper wrap container section block "
    "inner outer body content bar link links item items group panel form button buttons icon icons col column row unit slot entry user reader section text to js is".split()
)


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(text)}


def _names(attributes: dict[str, str]) -> list[set[str]]:
    """The words of each class and of the id."""
    found = []
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) - {""}
        if words:
            found.append(words)
    return found


def _is_chrome(tag: str, attributes: str, in_article: bool) -> str:
    """What speaks for chrome: `firm` structure (an article within is chrome as well), `weak` names, or ``. A name
    of several words counts if the others only say where or what sort of box it is: not `with-sidebar`."""
    a = _attributes(attributes) if attributes else {}
    names = _names(a) if a else []
    if any(words & _COMMENT_WORDS and words <= _COMMENT_WORDS | _BOX_WORDS for words in names):
        return "firm"
    if tag in ("html", "body", "article", "main"):
        return ""
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower()):
        return "firm"
    if tag in _CHROME_TAGS or tag == "header" and not in_article:
        return "weak" if tag in ("form", "fieldset", "header") else "firm"
    if a.get("role", "").lower() in _CHROME_ROLES:
        return "weak"
    chrome = any(words & _CHROME_WORDS and words <= _CHROME_WORDS | _BOX_WORDS for words in names)
    return "weak" if chrome or any("header" in words and words <= _BOX_WORDS for words in names) and not in_article else ""


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """The page's blocks in order: mark and text, white space made one space, character references decoded. A
    <br> ends a block."""
    page = page or ""
    found: list[tuple[int, str]] = []
    parts: list[str] = []
    chrome: list[list] = []  # the open chrome element: [tag, depth of that tag inside, is it weak]
    open_tags: list[str] = []
    mains = maybes = 0

    def cut() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                found.append((CHROME if chrome or maybes and not mains else MAYBE if maybes else ARTICLE if mains else LOOSE, text))

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0] == "<" or m[0][0] != "<":
                parts.append(m[0])
            elif m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if not m[1]:
            if tag in _RAW:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
                continue
            if tag in _BLOCK:
                cut()
            if tag in _VOID or m[3].endswith("/"):
                continue
            is_main = tag in ("article", "main") or 'role="main"' in m[3] or "articleBody" in m[3]
            if is_main and chrome and chrome[-1][2] and not mains and not _is_chrome(tag, m[3], True):
                cut()  # what looked like chrome by its name is around an article
                open_tags.extend([f"{chrome[-1][0]}?"] * chrome[-1][1])
                maybes += chrome.pop()[1]
            why = "" if chrome else _is_chrome(tag, m[3], mains > 0)
            if chrome and tag == chrome[-1][0]:
                chrome[-1][1] += 1
            elif why:
                cut()
                chrome.append([tag, 1, why == "weak"])
            elif not chrome and is_main:
                cut()
                mains += 1
                open_tags.append(f"{tag}*")
            elif not chrome and tag in _BLOCK and tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                open_tags.append(tag)
            continue
        if tag in _BLOCK:
            cut()
        if chrome:
            if tag == chrome[-1][0]:
                chrome[-1][1] -= 1
                if not chrome[-1][1]:
                    cut()
                    chrome.pop()
                continue
            if tag not in ("article", "main", "body", "html") or not {tag, f"{tag}*", f"{tag}?"} & set(open_tags):
                continue
            cut()
            chrome.pop()  # its end tag is missing: it ends with the element around it
        if {tag, f"{tag}*", f"{tag}?"} & set(open_tags):
            cut()
            while open_tags:
                last = open_tags.pop()
                mains -= last.endswith("*")
                maybes -= last.endswith("?")
                if last.rstrip("*?") == tag:
                    break
    cut()
    stands = CHROME if any(m == ARTICLE for m, _ in found) else ARTICLE
    return [(stands if m == MAYBE else m, text) for m, text in found]


def stream_of(page: list[tuple[int, str]]) -> list[str]:
    """The page's tokens in order."""
    return [w for _, text in page for w in text.split()]


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all suffixes of a token stream, in order, and the length of the prefix that each shares with
    the one before it. Prefix doubling: a round sorts by twice as many tokens, until no two suffixes are equal;
    only those that still are take part. Common prefixes come of the rounds' ranks, longest step first."""
    n = len(tokens)
    rank = _places(np.unique(tokens, return_inverse=True)[1])
    levels = [rank]  # ranks are the number of smaller suffixes, so what is refined stays in its place among the rest
    open_, step = np.arange(n), 1
    while True:
        open_ = open_[np.bincount(rank, minlength=n + 1)[rank[open_]] > 1]
        if not len(open_):
            break
        key = rank[open_] * (n + 1) + np.where(open_ + step < n, rank[np.minimum(open_ + step, n - 1)] + 1, 0)
        order = np.argsort(key)
        key, at = key[order], np.arange(len(order))
        own = key // (n + 1)
        start = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], at, 0))
        place = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
        rank = rank.copy()
        rank[open_[order]] = own + place - start
        levels.append(rank)
        step *= 2
    order = np.argsort(rank)
    return order, _common_prefixes(order, levels)


def _places(values: np.ndarray) -> np.ndarray:
    """For each of some small numbers, how many are smaller."""
    count = np.bincount(values)
    return (np.cumsum(count) - count)[values]


def _common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Of neighbours in a suffix array: levels[k] ranks suffixes by their first 2**k tokens."""
    n = len(order)
    common, a, b = np.zeros(n, np.int64), order[:-1], order[1:]
    pairs = np.arange(n - 1)
    alike = []  # the pairs that share 2**k tokens or more
    for rank in levels:
        pairs = pairs[rank[a[pairs]] == rank[b[pairs]]]
        alike.append(pairs)
    for k in range(len(levels) - 1, -1, -1):
        pairs = alike[k]
        x, y = a[pairs] + common[pairs + 1], b[pairs] + common[pairs + 1]
        pairs, x, y = (v[(x < n) & (y < n)] for v in (pairs, x, y))
        common[pairs[levels[k][x] == levels[k][y]] + 1] += 1 << k
    return common


def enough(n: np.ndarray, n_streams: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether runs on n of a host's distinct pages are shared, and whether they are on most pages."""
    return n >= max(2, SHARE * n_streams), n >= max(LEAST, COMMON * n_streams)


class Streams:
    """The distinct token streams of pages, laid end to end, each with an end token of its own."""

    def __init__(self, pages: list[list[tuple[int, str]]]) -> None:
        number: dict[str, int] = {}
        known: dict[tuple[int, ...], int] = {}
        self.which = [known.setdefault(tuple(number.setdefault(w, len(number)) for w in stream_of(page)), len(known)) for page in pages]
        streams = list(known)
        self.n, self.size = len(streams), np.array([len(t) + 1 for t in streams], np.int64)
        self.tokens = np.concatenate([[*t, -1 - i] for i, t in enumerate(streams)]).astype(np.int64) if streams else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(self.n), self.size)
        self.words = list(number)

    def counted(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array, and on how many streams the first `run` tokens of each entry stand."""
        order, common = suffix_array(self.tokens)
        group = np.cumsum(common < run) - 1
        seen = np.unique(group * self.n + self.owner[order]) // self.n
        return order, np.bincount(seen)[group]

    def runs(self, run: int) -> np.ndarray:
        """A signed 64-bit hash of the `run` tokens from each place on. Ends hash to what no other place does."""
        word = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in [*self.words, ""]], np.uint64)
        token = np.where(self.tokens < 0, np.uint64(0), word[self.tokens])
        out = np.zeros(len(token), np.uint64)
        for k in range(run):
            out = out * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([token[k:], np.zeros(min(k, len(token)), np.uint64)])[: len(token)]
        return out.view(np.int64)

    def whole(self, run: int) -> np.ndarray:
        """Whether the `run` tokens from each place on lie in its stream."""
        end = np.repeat(np.cumsum(self.size), self.size) - 1
        return np.arange(len(self.tokens)) + run <= end

    def covers(self, shared: np.ndarray, common: np.ndarray, run: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each page, for each token (and the end): does it lie in a run from a place that is marked."""
        out = []
        for hit in (shared, common):
            edge = np.zeros(len(self.tokens) + run + 1, np.int64)
            at = np.flatnonzero(hit & self.whole(run))
            np.add.at(edge, at, 1)
            np.add.at(edge, at + run, -1)
            parts = np.split(np.cumsum(edge)[: len(self.tokens)] > 0, np.cumsum(self.size)[:-1])
            out.append([parts[k] for k in self.which])
        return out[0], out[1]


def shared_runs(pages: list[list[tuple[int, str]]], run: int = RUN) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each page of a whole host, for each token of its stream (and its end): is it covered by substrings of
    `run` tokens or more that are shared, and by such on most pages. Pages with the same stream count as one."""
    s = Streams(pages)
    order, n = s.counted(run)
    count = np.zeros(len(s.tokens), np.int64)
    count[order] = n
    return s.covers(*enough(count, s.n), run)


def counted_runs(pages: list[list[tuple[int, str]]], counts: tuple[np.ndarray, np.ndarray, int], run: int = RUN) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """shared_runs for a part of a host's pages, by the host's counts: sorted hashes of runs, on how many distinct
    streams each stands, and how many streams there are. Runs that aren't listed are on too few."""
    known, n, n_streams = counts
    s = Streams(pages)
    own = s.runs(run)
    count = np.zeros(len(own), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        count = np.where(known[at] == own, n[at], 0)
    return s.covers(*enough(count, n_streams), run)


def often_here(pages: list[list[tuple[int, str]]], run: int = RUN) -> tuple[np.ndarray, int]:
    """Hashes of the runs that stand on SHARE of a part's distinct streams or more, and how many streams it has."""
    s = Streams(pages)
    order, n = s.counted(run)
    often = order[n >= SHARE * s.n]
    often = often[s.whole(run)[often]]
    return np.unique(s.runs(run)[often]), s.n


def counts_here(pages: list[list[tuple[int, str]]], wanted: np.ndarray, run: int = RUN) -> np.ndarray:
    """On how many distinct streams each of the wanted runs, sorted hashes, stands."""
    s = Streams(pages)
    own = s.runs(run)
    at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
    hit = (wanted[at] == own) & s.whole(run)
    return np.bincount(np.unique(at[hit] * s.n + s.owner[hit]) // s.n, minlength=len(wanted))


def _mostly(cover: np.ndarray) -> bool:
    return len(cover) > 0 and cover.mean() >= MOSTLY


def main_text(pages: list[list[tuple[int, str]]], run: int = RUN, host: tuple[np.ndarray, np.ndarray, int] | None = None) -> list[str]:
    """The main texts of pages of one host; `host`, of a part of a host's pages: the counts of counted_runs."""
    if len(pages) > 1 or host:
        shared, common = counted_runs(pages, host, run) if host else shared_runs(pages, run)
    out = []
    for i, page in enumerate(pages):
        has_article = any(m == ARTICLE for m, _ in page)
        wanted = ARTICLE if has_article else LOOSE
        cover = None
        if len(pages) > 1 or host:
            mark = np.repeat([m for m, _ in page], [len(t.split()) for _, t in page]) == wanted if page else np.zeros(0, bool)
            cover = common[i] if has_article or _mostly(shared[i][:-1][mark]) else shared[i]
            own = cover[:-1][mark]
            cover = None if not own.any() or (own.mean() > 0.5 if has_article else _mostly(own)) else cover
        kept, at = [], 0
        for m, text in page:
            n = len(text.split()) if cover is not None else 0
            own = cover[at : at + n] if cover is not None else None
            at += n
            if m != wanted or n and own.mean() >= MOSTLY:
                continue
            kept.append(" ".join(w for w, c in zip(text.split(), own, strict=True) if not c) if n and own.any() else text)
        out.append("\n".join(kept))
    return out


def packed(blocks: list[tuple[int, str]]) -> bytes:
    """Blocks, compressed for the shuffle: a line each, the mark first."""
    return zstandard.compress("\n".join(f"{m}{t}" for m, t in blocks).encode("utf-8", "surrogatepass"))


def unpacked(data: bytes) -> list[tuple[int, str]]:
    lines = zstandard.decompress(data).decode("utf-8", "surrogatepass").split("\n")
    return [(int(x[0]), x[1:]) for x in lines if x]


def _cut_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, host, html) to (page_id, url, host, stream, blocks): a hash of the page's stream, its blocks."""
    for batch in batches:
        cut = [blocks_of(x.as_py()) for x in batch.column("html")]
        streams = [xxhash.xxh3_64_intdigest(" ".join(stream_of(x)).encode("utf-8", "surrogatepass")) - (1 << 63) for x in cut]
        keep = [batch.column(c) for c in ("page_id", "url", "host")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(streams, pa.int64()), pa.array([packed(x) for x in cut], pa.binary())], names=["page_id", "url", "host", "stream", "blocks"])


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[tuple[int, str, bytes]]]]:
    group, rows = None, []
    for batch in batches:
        for page_id, url, host, part, blocks in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "part", "blocks")), strict=True):
            if (host, part) != group and rows:
                yield *group, rows
                rows = []
            group = (host, part)
            rows.append((page_id, url, blocks))
    if rows:
        yield *group, rows


def _texts(rows: list[tuple[int, str, bytes]], counts: tuple | None = None) -> pa.RecordBatch:
    texts = main_text([unpacked(r[2]) for r in rows], host=counts)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _whole_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, rows in _by_group(batches):
        yield _texts(rows)


PART = "host string, part long, pages array<struct<page_id:long,url:string,blocks:binary>>, runs array<long>, n_streams long"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pages of large hosts to one row for each part, with the runs that are frequent in it."""
    kind = pa.list_(pa.struct([("page_id", pa.int64()), ("url", pa.string()), ("blocks", pa.binary())]))
    for host, part, rows in _by_group(batches):
        runs, n = often_here([unpacked(r[2]) for r in rows])
        pages = [dict(zip(("page_id", "url", "blocks"), r, strict=True)) for r in rows]
        values = [([host], pa.string()), ([part], pa.int64()), ([pages], kind), ([runs], pa.list_(pa.int64())), ([n], pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in values], names=["host", "part", "pages", "runs", "n_streams"])


def _rows_of(batch: pa.RecordBatch, i: int) -> list[tuple[int, str, bytes]]:
    return [(p["page_id"], p["url"], p["blocks"]) for p in batch.column("pages")[i].as_py()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, pages, wanted) to (host, runs, counts)."""
    for batch in batches:
        for i in range(batch.num_rows):
            wanted = np.sort(np.array(batch.column("wanted")[i].as_py() or [], np.int64))
            n = counts_here([unpacked(r[2]) for r in _rows_of(batch, i)], wanted) if len(wanted) else wanted
            values = [([batch.column("host")[i].as_py()], pa.string()), ([wanted], pa.list_(pa.int64())), ([n], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in values], names=["host", "runs", "counts"])


def _part_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, pages, n_streams, found) to texts; found holds the host's (run, n)."""
    for batch in batches:
        for i in range(batch.num_rows):
            found = batch.column("found")[i].as_py() or []
            known = np.array([x["run"] for x in found], np.int64)
            order = np.argsort(known)
            yield _texts(_rows_of(batch, i), (known[order], np.array([x["n"] for x in found], np.int64)[order], batch.column("n_streams")[i].as_py()))


def _large_hosts(dealt: DataFrame) -> DataFrame:
    """The texts of pages of hosts that are dealt into parts."""
    out = "page_id long, url string, text string"
    grouped = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "page_id", "url").select("page_id", "url", "host", "part", "blocks")
    with small_batches(dealt.sparkSession, 1000):
        parts = stored(grouped.mapInArrow(_parts, PART), "parts")
    with small_batches(dealt.sparkSession, 1):
        wanted = stored(parts.select("host", F.explode("runs").alias("run")).distinct().groupBy("host").agg(F.collect_list("run").alias("wanted")), "wanted")
        counted = stored(parts.select("host", "pages").join(wanted, "host").select("host", "pages", "wanted").mapInArrow(_count, "host string, runs array<long>, counts array<long>"), "counts")
        total = parts.groupBy("host").agg(F.sum("n_streams").alias("n_streams"))
        each = counted.select("host", F.explode(F.arrays_zip("runs", "counts")).alias("x")).groupBy("host", F.col("x.runs").alias("run")).agg(F.sum("x.counts").alias("n"))
        found = each.join(total, "host").where(F.col("n") >= F.greatest(F.lit(2), F.col("n_streams") * SHARE)).groupBy("host").agg(F.collect_list(F.struct("run", "n")).alias("found"))
        found = stored(total.join(found, "host", "left"), "found")
        return stored(parts.select("host", "pages").join(found, "host").select("host", "pages", "n_streams", "found").mapInArrow(_part_texts, out), "texts")


def extract(pages: DataFrame, group_bytes: int = GROUP) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars.

    text is the article's blocks in page order, one to a line; empty if there is none, or html is null or
    empty. n_chars counts code points. Pages whose url is null or names no host form one host. Repeated
    rows stay repeated. Broken markup is read as browsers would, roughly: nothing raises. Other columns are
    ignored; an empty table gives no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    large = rows.groupBy("host").agg(F.sum(F.length("html")).alias("_b")).where(F.col("_b") > group_bytes).select("host", F.ceil(F.col("_b") / group_bytes).alias("_g"))
    large = stored(large, "hosts")  # of known size, so that pages needn't be shuffled to meet a few rows
    kind = "page_id long, url string, host string, stream long, blocks binary"
    whole = rows.join(large, "host", "left_anti").select("page_id", "url", "host", "html").mapInArrow(_cut_pages, kind).withColumn("part", F.lit(0).cast("long"))
    whole = whole.repartition("host").sortWithinPartitions("host", "page_id", "url").select("page_id", "url", "host", "part", "blocks")
    out = whole.mapInArrow(_whole_hosts, "page_id long, url string, text string")
    if not large.isEmpty():
        with tidy() as kept:
            cut = rows.join(large.select("host"), "host", "left_semi").select("page_id", "url", "host", "html").mapInArrow(_cut_pages, kind)
            dealt = cut.join(large, "host").withColumn("part", F.pmod("stream", "_g")).drop("_g", "stream")
            out = out.unionByName(kept(_large_hosts(dealt)))
    return out.withColumn("n_chars", F.length("text").cast("long"))

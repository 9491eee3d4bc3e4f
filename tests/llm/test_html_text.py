import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrid.llm import html_text as h

PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>{0} &amp; co</h1><p>First <b>bold</b>&nbsp;text<br>second   line</p><aside>see also</aside><p>Third &lt;tag&gt; &#233;{1}
<div class="ad">Buy</div><form><input name=x>Send</form><section class="comments"><p>A reader says</p></section></article>
<div id=sidebar><p>Links</p></div><footer>&copy; site</footer></body></html>"""


def text_of(page):
    return h.main_text([h.blocks_of(page)])[0]


def test_article_without_what_is_around_it():
    assert text_of(PAGE.format("Title", "")) == "Title & co\nFirst bold text\nsecond line\nThird <tag> é"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("a<!-- x --><b>b</b>", "ab"), ("<p>a < b</p>", "a < b"),
        ("<article><p>a</article><p>b</p>", "a"), ("<main><nav><p>x</main><p>y</p>", "y"), ("<div hidden>a</div><p>b", "b"), ("<div style='display: none'>a</div><p>b", "b"),
        ("<article><header><h2>Head</h2></header><p>t</p></article>", "Head\nt"), ("<script>a", ""), ("<p>a</p", "a"), ("<p title='>'>a</p>", "a"), ("<article><div class='post-comments'><div>x</div></div><p>t</p></article>", "t"),
        ("<article><p>&lt;b&gt; &amp;amp; &#x41;&unknown;</p></article>", "<b> &amp; A&unknown;"),
    ],
)
def test_markup(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body class="single comments-open"><article><p>t</p></article></body>', "t"), ('<article class="post comments-open"><p>t</p></article>', "t"), ('<div id="page" class="with-sidebar"><article><p>t</p></article></div>', "t"),
        ('<div class="social-science"><main><p>t</p></main></div>', "t"), ('<form id="aspnetForm"><p>x</p><article><p>t</p></article><p>y</p></form>', "t"), ('<article><p>t</p><section class="related-work"><p>u</p></section></article>', "t\nu"),
        ('<div class="modal"><div><article><p>t</p></article></div></div>', "t"), ('<article><p>t</p></article><div class="related-posts"><article><p>teaser</p></article></div>', "t"),
        ('<div class="related-posts"><article><p>teaser</p></article></div><article><p>t</p></article>', "t"), ('<article><p>t</p></article><div id="comments"><article class="comment-body"><p>c</p></article></div>', "t"),
        ('<article><p>t</p><article class="comment"><p>c</p></article></article>', "t"), ("<aside><article><p>x</p></article></aside><p>t</p>", "t"), ('<div class="site-footer"><p>x</p></div><p>t</p>', "t"),
    ],
)
def test_what_is_around_an_article_does_not_take_it_away(page, want):
    assert text_of(page) == want


def test_suffix_array_matches_sorting():
    rng = np.random.default_rng(3)
    for tokens in (rng.integers(0, 3, 300), np.zeros(50, np.int64), np.tile([4, 1, 9], 40), np.arange(20)[::-1], np.array([5]), np.repeat([2, -7], 30)):
        order, common = h.suffix_array(tokens)
        suffix = [[int(x) for x in tokens[i:]] for i in order]
        assert suffix == sorted(suffix)
        for k in range(1, len(order)):
            n = next((j for j, (x, y) in enumerate(zip(suffix[k - 1], suffix[k], strict=False)) if x != y), min(len(suffix[k - 1]), len(suffix[k])))
            assert common[k] == n


def test_a_repeat_counts_by_its_share_of_a_host():
    said = " ".join(f"s{i}" for i in range(12))
    pages = [[(h.LOOSE, f"{said} " * (i < 3) + " ".join(f"w{i}x{k}" for k in range(20)))] for i in range(500)]
    assert all(said in t for t in h.main_text(pages)[:3])  # three of 500 pages quote, they don't repeat a menu
    assert not any(said in t for t in h.main_text(pages[:250]))


def test_repeated_runs_match_brute_force():
    rng = np.random.default_rng(4)
    pages = [[(h.LOOSE, " ".join(f"w{x}" for x in rng.integers(0, 4, rng.integers(1, 40)))) for _ in range(2)] for _ in range(12)]
    shared, _ = h.shared_runs(pages, 4)
    streams = [[w for _, t in p for w in t.split()] for p in pages]
    where = {}
    for i, s in enumerate(streams):
        for k in range(len(s) - 3):
            where.setdefault(tuple(s[k : k + 4]), set()).add(i)
    for i, s in enumerate(streams):
        want = [False] * (len(s) + 1)
        for k in range(len(s) - 3):
            if len(where[tuple(s[k : k + 4])]) > 1:
                want[k : k + 4] = [True] * 4
        assert list(shared[i]) == want


def test_boilerplate_of_a_host_goes_and_quotes_stay():
    legal = "all content on this site is the property of the site owner and may not be used"
    pages = [h.blocks_of(f"<div><p>unique words of page {i} and {'more ' * i}here {i * 7}</p><p>{legal}</p></div>") for i in range(6)]
    assert [t.split("\n")[1:] for t in h.main_text(pages)] == [[]] * 6
    quote = "a passage that two articles share because one of them quotes it from the other"
    articles = [h.blocks_of(f"<article><p>story {i} begins</p><p>{quote}</p></article>") for i in range(2)]
    assert all(quote in t for t in h.main_text(articles))
    copies = [h.blocks_of(f"<article><p>{quote} {quote}</p></article>") for _ in range(9)]
    assert all(quote in t for t in h.main_text(copies))


def test_copies_of_pages_without_article_keep_their_text():
    page = "<div><p>a story without any article mark that is told in one place only</p><p>and its second part is as long as that</p></div>"
    whole = text_of(page)
    assert h.main_text([h.blocks_of(page)] * 3) == [whole] * 3
    other = h.blocks_of("<p>some other page of the host with words that no other page has</p>")
    near = page.replace("</div>", "<p>changed</p></div>")
    assert h.main_text([h.blocks_of(page), h.blocks_of(page), other, h.blocks_of(near)]) == [whole, whole, other[0][1], f"{whole}\nchanged"]


def test_extract_over_tables(spark):
    rows = [(i, f"http://Host.example/{i}", PAGE.format(f"Title {i}", " more" * i)) for i in range(8)] + [(1, None, "<p>x</p>"), (None, "nonsense", None), (3, "http://Host.example/3", PAGE.format("Title 3", " more" * 3))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "part": F.lit(0), "text": F.lit("t")})
    for group in (h.GROUP, 2000):
        got = sorted(((r.page_id is None, r.page_id or 0), r.url or "", r.text, r.n_chars) for r in h.extract(df, group).collect())
        want = sorted(((i is None, i or 0), u or "", t := text_of(p), len(t)) for i, u, p in rows)
        assert got == want
    assert h.extract(df.limit(0)).count() == 0


def test_a_split_host_gives_the_texts_of_a_whole_one(spark):
    rng = np.random.default_rng(5)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    quotes, legal = [words(12) for _ in range(20)], words(10)  # each quote on two pages
    pages = [f"<p>{words(40)}</p><p>{quotes[i % 20]}</p><p>{legal}</p>" for i in range(40)]
    pages += [f"<article><p>{words(30)}</p><p>{legal}</p></article>" for _ in range(60)] + [pages[0], pages[3]]
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    whole, split = ({r.page_id: r.text for r in h.extract(df, size).collect()} for size in (h.GROUP, 2000))
    assert split == whole == dict(enumerate(h.main_text([h.blocks_of(p) for p in pages])))
    assert not any(q in t for q in quotes for t in whole.values())
    assert not any(legal in t for t in whole.values())

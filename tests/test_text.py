import re

import pytest
from pyspark.sql import functions as F

from talkgrid.functions import text as t

ODD = ["Hello, World!\nnew_line", "½ cup", "a b", "x\x1cy", "été", "a‿b", "İstanbul", "Straße", "ну е-е вот", "", "  ", "Ну, привет! 12"]


def normal(s):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s.replace("\n", " ").lower())).strip()


def test_normalize_and_tokens_match_python(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, s string")
    got = {r.i: r for r in df.select("i", t.normalize_text(F.col("s")).alias("n"), t.tokens(F.col("s")).alias("t"), t.flatten_space(F.col("s")).alias("f")).collect()}
    for i, s in enumerate(ODD):
        assert got[i].n == normal(s), s
        assert got[i].t == [w for w in normal(s).split() if w not in t.FILLERS]
        assert got[i].f == " ".join(s.split())


@pytest.mark.parametrize(("a", "b", "want"), [("one two", "two one three", 1.0), ("one", "two", 0.0), ("one two", "two", 0.5), ("", "x", 1.0), ("ну", "x", 1.0), ("a a b", "a", 0.5)])
def test_containment(spark, a, b, want):
    assert spark.range(1).select(t.token_containment(F.lit(a), F.lit(b))).first()[0] == want


def test_times(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(t.parse_timestamp(F.lit("01:30:00.250"))) == 5400.25 and one(t.parse_timestamp(F.lit(" 00:10.5 "))) == 10.5
    assert one(t.parse_timestamp(F.lit("00:10,500"))) is None and one(t.parse_timestamp(F.lit("00:10.5 align:start"))) is None
    assert one(t.format_timestamp(F.lit(5400.25))) == "01:30:00.250" and one(t.format_timestamp(F.lit(0.0005))) == "00:00:00.000"
    assert one(t.clock(F.lit(3661.9))) == "[01:01:01]"
    assert one(t.escape_html(F.lit("<a & 'b' \"c\">"))) == "&lt;a &amp; &#x27;b&#x27; &quot;c&quot;&gt;"
    assert one(t.strip_marks(F.lit("a <mark>b</mark>"))) == "a b"

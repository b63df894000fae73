import html
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sevscale.functions import text as T

TRICKY = [
    "a中b é1", "hi😀there", "٣ three", "http://x.y/z after", "", "AT&amp;T", "a &lt;b&gt; c",
    "<p>one</p><p>two</p>", "<script>var a='<p>';</script>kept", "x <!-- gone --> y",
    "see www.site.org/a?b now", "tab\tand\nline", "  spaced   out  ", "1 < 2 and 3 > 2",
    "<style>p{}</style>t", "unclosed <b", "&quot;q&quot; &#39;s&#39; &nbsp;n",
]
PUNCT = [
    "sooooo good!!!!!!", "a.b.c/d", "*****", "zzzé zzz zzz1", "\nleading", "trailing\n ",
    "wow!! ok??? no????", "'quoted'", "aaaab aaaa aaa_", "x  y", "", "e.g.this/that?yes",
]


class _Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def after_markup(text):
    emoji = ("[\U0001F600-\U0001F64F\U0001F300-\U0001F5FF\U0001F680-\U0001F6FF"
             "\U0001F1E0-\U0001F1FF✂-➰Ⓜ-\U0001F251]+")
    text = re.sub(r"[^a-zA-Z\d]", " ", re.sub(emoji, "", text))
    return re.sub(" +", " ", text).strip()


def without_urls(text):
    return re.sub(r"https?://\S+|www\.\S+", "", text)


def python_punct(text):
    steps = [("\n", " \n "), (r"([a-zA-Z]+)([/!?.])([a-zA-Z]+)", r"\1 \2 \3"),
             (r"([*!?'])\1\1{2,}", r"\1\1\1"), (r"([*!?']+)", r" \1 "),
             (r"([a-zA-Z])\1{2,}\b", r"\1\1"), (r"([a-zA-Z])\1\1{2,}\B", r"\1\1\1"),
             (r"[ ]{2,}", " ")]
    for pattern, by in steps:
        text = re.sub(pattern, by, text)
    return text.strip()


def applied(spark, fn, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.o for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_cleaner_without_markup(spark):
    plain = [t for t in TRICKY if "<" not in t and "&" not in t]
    assert applied(spark, T.clean_text, plain) == [after_markup(without_urls(t)) for t in plain]


def test_markup_against_a_parser(spark):
    for t, got in zip(TRICKY, applied(spark, T.strip_html, TRICKY)):
        if t in ("unclosed <b",):
            continue
        parser = _Plain()
        parser.feed(t)
        parser.close()
        assert got.replace(" ", " ") == "".join(parser.parts).replace(" ", " ")


def test_cleaner_on_given_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("html")
    for raw, got in pages.select("html", T.strip_html(F.col("html")).alias("o")).collect():
        parser = _Plain()
        parser.feed(raw)
        parser.close()
        assert after_markup(got) == after_markup("".join(parser.parts))


def test_order_of_address_and_markup(spark):
    tricky = ['<a href="http://x">word</a> rest']
    assert applied(spark, T.clean_text, tricky) == ["a href rest"]
    assert applied(spark, lambda c: T.clean_text(c, "html_first"), tricky) == ["word rest"]
    with pytest.raises(ValueError):
        T.clean_text(F.col("t"), "other")


def test_entities(spark):
    texts = ["caf&eacute; &#65; &amp;lt;", None, "", "&", "&&amp;&", "a &notit; &ampx &copy2 &nosuch; &#; &#x; &#x41g",
             "&#128; &#129; &#0; &#13; &#x1F600; &#xD800; &#1114112; &#65279;| &#11;| &#xFFFE;| &#99999999999999999999;",
             "&NotEqualTilde; &fjlig; &NewLine;|&Tab;|", "&#x0000000000041; &#000000000000065;", "it&#8217;s &Amp; &AMP"]
    assert applied(spark, T.decode_entities, texts) == [t and html.unescape(t) for t in texts]
    assert applied(spark, T.clean_text, ["caf&eacute; it&#8217;s ok"]) == ["caf it s ok"]


def test_east_asian_letters_go_with_the_emoji(spark):
    assert applied(spark, T.strip_emoji, ["a中b", "hi😀there"]) == ["ab", "hithere"]


def test_punctuation(spark, small):
    assert applied(spark, T.normalize_punct, PUNCT) == [python_punct(t) for t in PUNCT]
    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert applied(spark, T.normalize_punct, docs) == [python_punct(t) for t in docs]


def test_missing_text_stays_missing(spark):
    for fn in (T.clean_text, T.normalize_punct, T.as_text):
        assert applied(spark, fn, [None]) == [None]


def test_open_markup_takes_linear_time(spark):
    import time

    open_ends = ["<!-- x " * 20_000, "<a " * 20_000, "<script>a " * 8_000, "<!-- x " * 9_000 + "<b>", "y" * 40_000]
    df = spark.createDataFrame([(t,) for t in open_ends], "t string")
    start = time.time()
    got = [r[0] for r in df.select(T.strip_html(F.col("t"))).collect()]
    df.select(T.normalize_punct(F.col("t"))).collect()
    assert time.time() - start < 20
    assert got[0] == open_ends[0] and got[1] == open_ends[1] and got[4] == open_ends[4]
    assert got[2] == "a " * 8_000 and got[3] == ""


def test_closed_and_open_markup_together(spark):
    rows = [("a<!-- b --> c <!-- d", "a c <!-- d"), ("<SCRIPT>x</script>y<script>z", "yz"),
            ("<style>p</style ><b>q</b><style", "q<style"), ("1 < 2 <i>3", "1 < 2 3")]
    df = spark.createDataFrame(rows, "t string, e string")
    assert all(r[0] == r[1] for r in df.select(T.strip_html(F.col("t")), "e").collect())

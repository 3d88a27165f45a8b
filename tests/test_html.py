import time

import pytest
from pyspark.sql import functions as F

from pagequarry.functions.html import last_https, page_fields, raw_hrefs, unescaped_hrefs
from pagequarry.operators.index_build import fixed_image


def _title(html, selector):
    return page_fields(html, selector, None, None, "src")[0]


@pytest.mark.parametrize(
    ("html", "selector", "expected"),
    [
        ("<h1> a &amp; b <b> c</b></h1>", "h1", "a & bc"),
        ("<p>a</p>", "h1", ""),
        ("<p>a</p>", None, ""),
        ("<p>a<p>b</p>c</p>d", "p", "abc"),
        ("<div><p>a<b>b</div>c", "p", "ab"),
        ("<p>a</b>b</p>", "p", "ab"),
        ("<script>var t='<h1>no</h1>';</script><h1>yes</h1>", "h1", "yes"),
        ("<div>a<script>x</script>b<style>y</style></div>", "div", "ab"),
        ("<!-- <h1>no</h1> --><h1>a<!-- b -->c</h1>", "h1", "ac"),
        ("<h3 class='big title'>x</h3>", "h3.title", "x"),
        ("<div class='title'>y</div><h3 class=title>x</h3>", "h3.title", "x"),
        ("<p class=a><i>x</i></p><div class=b><i>y</i></div>", ".b i", "y"),
        ("<div class=b></div><i>x</i>", ".b i", ""),
        ("<div id=m><p>1</p><p>2</p></div>", "#m p:nth-of-type(2)", "2"),
        ("<p>a<br>b<br/>c</p>d", "p", "abc"),
        ("<p title='a>b'>x</p>", "p", "x"),
        ("<H1>x</h1 >", "h1", "x"),
        ("<p>open", "p", "open"),
        ("<script>if (a <!-- b) x</script><h1>t</h1>", "h1", "t"),
    ],
)
def test_text_of_first_match(html, selector, expected):
    assert _title(html, selector) == expected


@pytest.mark.parametrize(
    ("html", "selector", "expected"),
    [
        ("<a x\"y <h1>t</h1>", "h1", "t"),
        ("<h1>a<!b</h1>", "h1", "a"),
        ("<h1>a <b <!-- c", "h1", "a <b"),
        ("<div class=a><div><div class=b>x</div></div></div>", ".a div .b", "x"),
        ("<div class=a></div><div class=b><p>x</p></div>", ".a p", ""),
        ("<template><p>x</p></template><p>y</p>", "p", ""),
        ("", "h1", ""),
        (None, "h1", ""),
    ],
)
def test_broken_markup(html, selector, expected):
    assert _title(html, selector) == expected


@pytest.mark.parametrize(
    "piece",
    ["'<a x\"y '", "<a x\"y ", "<b>", "<a", "<!", "<a '", "</i>", "<i></b>"],
)
def test_time_grows_with_the_page(piece):
    def seconds(n):
        began = time.process_time()
        page_fields(piece * n + "\">" + "<b>" * n + "</i>" * n, "x b i", ".q", "i b img", "src")
        return time.process_time() - began

    assert seconds(40_000) < 12 * seconds(10_000) + 0.5


def test_image_attribute():
    html = '<div class="book"><img data-src="b.png" src="a.png?x=1&amp;y=2"></div>'
    assert page_fields(html, None, None, ".book img", "src") == ("", "", "a.png?x=1&y=2")
    assert page_fields(html, None, None, ".book img", "data-src")[2] == "b.png"
    assert page_fields(html, None, None, ".book img", "alt")[2] == ""


def test_hrefs(spark):
    html = (
        '<a href="/1">x</a><a class="c" href=\'/2?a=1&amp;b=2\'>x</a><A HREF = /3>x</A><a name="n">x</a>'
        '<!-- <a href="/no"> --><script>"<a href=\'/no\'>"</script><a data-href="/no">x</a>'
        '<a\n title="href=/no" href="/4&eacute;&copy=1">x</a><abbr href="/no"></abbr>'
    )
    df = spark.createDataFrame([(html,), (None,), ("",)], "h STRING")
    got = [r[0] for r in df.select(unescaped_hrefs(raw_hrefs(F.col("h")))).collect()]
    assert got == [["/1", "/2?a=1&b=2", "/3", "/4é©=1"], [], []]


def test_image_fix(spark):
    df = spark.createDataFrame([("https://x/https://y/a.jpg",), ("https://y/a.jpg",), ("",)], "u STRING")
    assert [r[0] for r in df.select(last_https(F.col("u"))).collect()] == ["https://y/a.jpg"] * 2 + [""]
    kept = df.select(fixed_image(F.col("u"), F.lit(None).cast("string"))).first()[0]
    assert kept == "https://x/https://y/a.jpg"

import pytest
from pyspark.sql import functions as F

from litscore.functions.html import (
    attribute,
    element_bodies,
    element_body,
    open_tags,
    strip_noise,
    text_of,
    unescape,
)
from litscore.functions.text import (
    article_url,
    clean_text,
    first_simple,
    unwrap_text,
    year_before_dash,
    year_of,
)


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, None),
        ("", None),
        ("  \n ", None),
        (" one \n  two ", "one two"),
        ("one\n\ntwo", "one  two"),
        (" wide \n\tlines ", "wide lines"),
    ],
)
def test_unwrap_text(evaluate, text, expected):
    assert evaluate(unwrap_text, text) == expected


def test_clean_text(evaluate):
    assert evaluate(clean_text, " a\n b ") == "a\n b"
    assert evaluate(clean_text, None) is None


@pytest.mark.parametrize("text, year", [("2021-03", 2021), ("c. 2021", None), ("", None), (None, None)])
def test_year_of(evaluate, text, year):
    assert evaluate(year_of, text) == year


def test_year_before_dash(evaluate):
    assert evaluate(year_before_dash, "2021-03-04") == 2021
    assert evaluate(year_before_dash, "March-2021") is None


def test_first_simple(spark):
    df = spark.createDataFrame([([[1, 2], [3]],), ([],), (None,), ([[]],)], "x ARRAY<ARRAY<INT>>")
    assert [r[0] for r in df.select(first_simple(F.col("x"), 2)).collect()] == [1, None, None, None]


def test_article_url(spark):
    rows = [("10.1/x", "2401.1", "arXiv"), ("10.1/x", "2401.1", "arxiv"), ("10.1/x", None, None)]
    df = spark.createDataFrame(rows, "doi STRING, arxiv STRING, journal STRING")
    assert [r[0] for r in df.select(article_url()).collect()] == [
        "https://arxiv.org/abs/2401.1",
        "https://doi.org/10.1/x",
        "https://doi.org/10.1/x",
    ]


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, None),
        ("a &amp;lt; b", "a &lt; b"),
        ("&eacute;&#233;&#xE9;&#x1F600;", "ééé\U0001f600"),
        ("&nosuch; & &#0; &#xD800;", "&nosuch; & \ufffd \ufffd"),
        ("&#0000000065;&#x00000041;&#150;&#99999999999;", "AA\u2013\ufffd"),
        ("&lbrack;&copy 2020 &notit;&copy2020&ampx &AMP &#65 x", "[© 2020 ¬it;©2020&x & A x"),
        ("it&apos;s &quot;q&quot;", "it's \"q\""),
    ],
)
def test_unescape(evaluate, text, expected):
    assert evaluate(unescape, text) == expected


@pytest.mark.parametrize(
    "tag, expected",
    [
        ('<a href="x?a=1&amp;b=2">', "x?a=1&b=2"),
        ("<a class=c HREF='x y'>", "x y"),
        ("<a href=bare>", "bare"),
        ('<a title="href=no" href="yes">', "yes"),
        ('<a data-href="no">', None),
        ('<a title="a > b"\n  href = "yes">', "yes"),
        ('<a href="">', ""),
        ("<a>", None),
    ],
)
def test_attribute(evaluate, tag, expected):
    assert evaluate(lambda s: attribute(s, "href"), tag) == expected


def test_noise_is_not_read(evaluate):
    html = "<!-- <a> --><SCRIPT>x < y</script ><style>p{}</style><p title='a>b'>t</p>"
    assert evaluate(strip_noise, html) == "<p title='a>b'>t</p>"
    assert evaluate(text_of, html) == "t"
    assert evaluate(text_of, "1 < 2 <b>and</b> 3 &gt; 2") == "1 < 2 and 3 > 2"


def test_open_tags(evaluate):
    html = '<meta name="a" content="x > y"><METADATA><link/><Meta\nname=b>'
    found = evaluate(lambda s: open_tags(s, "meta", "link"), html)
    assert found == ['<meta name="a" content="x > y">', "<link/>", "<Meta\nname=b>"]


def test_element_body(evaluate):
    html = "<div class='abstract-x'>no</div><div id=d class='a abstract'>x<div>y</div>z</div><div>no</div>"
    assert evaluate(lambda s: element_body(s, "div", "class", "abstract"), html) == "x<div>y</div>z"
    assert evaluate(lambda s: element_body(s, "div", "id", "d"), html) == "x<div>y</div>z"
    assert evaluate(lambda s: element_body(s, "h1"), html) is None
    assert evaluate(lambda s: element_body(s, "h1"), "<h1>open <b>end") == "open <b>end"
    assert evaluate(lambda s: element_body(s, "h1"), "<h1></h1>") == ""


def test_element_bodies(evaluate):
    html = '<span class="n x">A</span><span class="m">B</span><span class=n>C</span>'
    assert evaluate(lambda s: element_bodies(s, "span", "class", "n"), html) == ["A", "C"]


def test_long_pages_do_not_overflow(evaluate):
    html = "<p>" + "x" * 200_000 + "<br" + " a='1'" * 300 + ">" + "y&amp;" * 20_000 + "</p>"
    assert evaluate(text_of, html) == "x" * 200_000 + "y&" * 20_000


def test_unescape_equals_the_parser(evaluate):
    import html

    for text in ("&NotEqualTilde; &hearts;&nbsp;|", "&lt&gt&quot&&&#x3c&#60", "&Aacute&aacut; &frac12x &#x1F600 &#128;"):
        assert evaluate(unescape, text) == html.unescape(text)

"""Main text of pages, and the wrappers of their hosts."""

from litscore.llm.html import align, extract, groups, host_of, infer_wrappers, main_text, read, roots, stream, write
from pyspark.sql import functions as F

ARTICLE = {("html", "body", "article")}


def text(page):
    return main_text(page, roots(groups(stream(page))))


def test_boilerplate_goes_and_the_article_stays():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>";</script></head>
    <body class=header-page><header>Site</header><nav><ul><li><a href=/>Menu</a></ul></nav><!-- <p>hidden</p> -->
    <div class="ad box">Buy</div><div id=cookie-notice>Cookies</div><aside>Side</aside>
    <article><header><h1>Title&amp;amp;</h1></header><p>One <b>bo</b>ld&nbsp;&#x41;&#0000000066; &copy 2020 &lbrack;x<br>two<p>Three
      lines</p><form><input value=x>Form<button>Go</button></form><div class="share">Share</div>
    <figure><figcaption>Caption</figcaption></figure><table><tr><td>a<td>b</table>
    <section class="comments"><article><p>Reader</p></article></section><footer>Tags</footer></article>
    <footer>&copy; Host</footer></body></html>"""
    assert text(page) == "Title&amp; One bold AB © 2020 [x two Three lines Caption a b"


def test_odd_markup():
    assert text("") == "" and text("plain  text") == "plain text"
    assert text("<p>a < b</p><p title=\"open>c</p>d") == "a < b c d"
    assert text("<nav>menu<article><p>in") == "in"
    assert text("<div class=ad>x<article>y</article></div>z") == "y"
    assert text("<main><p>a</p><div class=sidebar>b</div></main><p>c") == "a"
    assert text("<body><p>no article<ul><li>item<li>more</ul><![CDATA[&lt;]]>") == "no article item more &lt;"
    assert text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert text("<script>while(1)") == "" and text("<!-- never closed <p>x") == ""
    assert text("<article><p>" + "word " * 100_000) == ("word " * 100_000).strip()


def test_alignment_gives_optional_and_repeated_groups():
    one = groups(stream("<body><h1>a</h1><p>b</p></body>"))
    many = groups(stream("<body><h1>a</h1><div>x</div><p>b</p><p>c</p><p><i>d</i></p></body>"))
    assert write(many) == "<body <h1 #><div #><p #>+>"
    merged = align(one, many)
    assert write(merged) == "<body <h1 #><div #>?<p #>+>"
    assert read(write(merged)) == merged and align(merged, one) == merged


def test_extract(spark):
    good = "<html><body><nav>m</nav><article><p>text {}</p></article></body></html>"
    rows = [(i, f"http://Host{i % 2}.example/{i}", good.format(i)) for i in range(20)]
    rows += [(20, "http://host0.example/x", None), (21, None, good.format("none")), (None, "no url", good.format("id")), (3, "http://host1.example/3", good.format("again")), (22, "http://host0.example/y", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"host": F.lit("x"), "wrapper": F.lit("y"), "text": F.lit("z")})
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract(pages).collect()), key=str)
    assert got == sorted(((p, u, t, len(t)) for p, u, h in rows for t in ["text " + h.split("text ")[1].split("<")[0] if h else ""]), key=str)
    wrappers = {r.host: r.wrapper for r in infer_wrappers(pages).collect()}
    assert wrappers["host1.example"] == "<html <body <nav ><article <p #>>>>" and set(wrappers) == {"", "host0.example", "host1.example"}
    assert extract(pages.limit(0)).collect() == []


def test_hosts(evaluate):
    for url, host in (("https://u:p@A.example:80/x", "a.example"), ("http://b.example?x", "b.example"), ("x", ""), (None, "")):
        assert evaluate(host_of, url) == host


def test_class_and_id_words_mark_whole_names_only():
    inner = '<h2 id="related-work">Related</h2><section id="side-effects">Side</section><h2 id="social-history">History</h2><div class="ad-hoc-methods">Methods</div><h3 class="comments">Three</h3>'
    for name in ("post no-sidebar", "hentry comments-open", "category-social", "sidebar", "post with-comments"):
        assert text(f'<body><article class="{name}">{inner}</article></body>') == "Related Side History Methods Three"
    for body in ('<body class="with-sidebar">', '<body id=sidebar>', '<html class="no-ads"><body>', '<body><div class="hentry category-social tag-cookies">'):
        assert text(f"{body}<p>All</p>{inner}") == "All Related Side History Methods Three"
    assert text("<main class='widget'><p>a</p><div class='cookie-notice'>b</div><div id=site_footer>c</div><div class='page-header box'>d</div>") == "a"
    assert text("<article><p>a</p><div class='entry-header'>b</div><article class=comment>c</article></article>") == "a b"


def test_text_of_a_host_without_article_is_told_from_its_template(spark):
    """Menus, notices and footers in unmarked elements go; cells, headings and copies of a page stay."""
    words = "zero one two three four five".split()

    def page(i, extra=""):
        own = f"<div><h1>Title {words[i]}</h1><h2>Abstract</h2>" + "".join(f"<p>Text {words[i]} {k}</p>" for k in range(i + 1)) + f"{extra}</div>"
        menu = "<table><tr><td><ul><li>Home<li>About us</ul></td><td>"
        return f"<html><body><div>Example host</div>{menu}{own}</td></tr></table><div><p>Cookies are used</p></div><div>All rights reserved</div></body></html>"

    def text(i):
        return " ".join([f"Title {words[i]} Abstract", *(f"Text {words[i]} {k}" for k in range(i + 1))])

    long = "<div><p>" + "A long own text. " * 20 + "</p><p>Short.</p></div>"
    rows = [(i, f"http://plain.example/{i}", page(i)) for i in range(6)] + [(9, "http://single.example/", page(0))]
    rows += [(10 + i, f"http://copies.example/{i}", f"<body>{long}<p>Read {words[i]} times</p></body>") for i in range(3)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {i: got[i] for i in range(6)} == {i: text(i) for i in range(6)}
    assert got[9] == "Example host Home About us Title zero Abstract Text zero 0 Cookies are used All rights reserved"
    assert [got[10 + i] for i in range(3)] == ["A long own text. " * 20 + f"Short. Read {words[i]} times" for i in range(3)]

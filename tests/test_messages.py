import base64

import pytest

from litscore.operators import extract

SENDERS = {route: address for address, route in extract.SENDERS.items()}


def messages(spark, *rows):
    data = [(str(i), sender, html, text) for i, (sender, html, text) in enumerate(rows)]
    return spark.createDataFrame(data, "message_id STRING, sender STRING, html STRING, text STRING")


def ids(spark, route, html, text=None):
    found = extract.extract_article_ids(messages(spark, (SENDERS[route], html, text))).collect()
    return sorted(r["id"] for r in found)


def nature(target, pad=True):
    packed = base64.urlsafe_b64encode(target.encode()).decode()
    packed = packed if pad else packed.rstrip("=")
    return f'<a href="https://x.example/c?a=1&amp;_L54AD1F204_={packed}">t</a>'


def test_routes(spark):
    found = extract.route_messages(
        messages(
            spark,
            ("Name <efback@ncbi.nlm.nih.gov>", None, None),
            (" no-reply@arXiv.org ", None, None),
            ("no-reply@arxiv.org", None, None),
            (None, None, None),
        )
    )
    assert [r["route"] for r in found.orderBy("message_id").collect()] == [
        "pubmed",
        "arxiv",
        "unknown_sender",
        "unknown_sender",
    ]


def test_biorxiv(spark):
    html = (
        '<a>no href</a><a href="http://biorxiv.org/content/early/1">x</a>'
        '<a href="https://www.biorxiv.org/content/early/2">x</a>'
        '<A HREF=http://www.biorxiv.org/cgi/content/abstract/3>x'
        "<!-- <a href='http://biorxiv.org/content/early/4'>x</a> -->"
    )
    assert ids(spark, "biorxiv", html) == [
        "http://biorxiv.org/content/early/1",
        "http://www.biorxiv.org/cgi/content/abstract/3",
    ]


def test_arxiv(spark):
    text = "arXiv:2401.00001v2 \n  arXiv:2401.00002\narXiv:math/0001001\nsee arXiv:1.2\narXiv:2401.00002\n"
    assert ids(spark, "arxiv", None, text) == ["2401.00001v2", "2401.00002"]
    assert ids(spark, "arxiv", "<p>arXiv:2401.00003\n</p>", "arXiv:2401.00004") == ["2401.00003"]


def test_pubmed(spark):
    html = (
        '<a class="docsum-title" ref="article_id=12">a</a><a class="x docsum-title y" ref="article_id=13">b</a>'
        '<a class="docsum-title" ref="article_id=">c</a><a class="docsum-title">d</a>'
        '<a class="docsum-titles" ref="article_id=14">e</a><a ref="article_id=15">f</a>'
        '<a class="docsum-title" ref="article_id=12">a</a>'
    )
    assert ids(spark, "pubmed", html) == ["12", "13"]


@pytest.mark.parametrize("pad", [True, False])
@pytest.mark.parametrize("tail", ["", "a", "ab", "abc"])
def test_nature_alert_padding(spark, pad, tail):
    html = nature(f"target=http%3A%2F%2Fwww.nature.com%2Farticles%2Fs41{tail}%3Fq%3D1&z=~~?", pad)
    assert ids(spark, "nature_alert", html) == [f"10.1038/s41{tail}"]


def test_nature_alert_without_article(spark):
    html = (
        nature("x=1")
        + nature("target=https%3A%2F%2Fwww.nature.com%2Fnews%2F1")
        + nature("target=https%3A%2F%2Fwww.nature.com%2Farticlesx")
        + '<a href="https://x.example/?_L54AD1F204_=%%%">t</a><a href="?_L54AD1F204_=_w">t</a><a>t</a>'
    )
    assert ids(spark, "nature_alert", html) == []


def test_nature_ealerts(spark):
    html = "<p>doi:10.1038/a. xdoi:10.1038/b DOI:10.1038/c (doi:10.1038/d)</p>\ndoi: 10.1038/e"
    assert ids(spark, "nature_ealerts", html) == ["10.1038/a.", "10.1038/d)"]


def test_s2(spark):
    html = (
        '<a class="paper-link" href="https://www.semanticscholar.org/paper/Title/abc?utm=1#x">t</a>'
        '<a class="paper-link" href="https://www.semanticscholar.org/paper/">t</a>'
        '<a class="author-link" href="https://www.semanticscholar.org/author/def">t</a>'
    )
    assert ids(spark, "s2", html) == ["abc"]


def test_science(spark):
    html = (
        '<a href="https://a.example">Read <b>more</b></a><a href="https://b.example">READ MORE &raquo;</a>'
        '<a>read more</a><a href="https://c.example">more</a><a href="https://d.example"><b><i>Read more</i></b></a>'
        '<a href="https://e.example">read more<br></a><a href="https://f.example"> <b>read more</b></a>'
    )
    # only anchors that hold one string
    assert ids(spark, "science", html) == ["https://b.example", "https://d.example"]


def test_handled_or_unhandled_once(spark):
    msgs = messages(
        spark,
        (SENDERS["arxiv"], None, "arXiv:1.1\narXiv:1.1"),
        (SENDERS["arxiv"], None, "nothing"),
        (SENDERS["science"], None, None),
        ("nobody@example.org", "<a>x</a>", None),
    )
    handled = {r["message_id"] for r in extract.extract_article_ids(msgs).collect()}
    unhandled = {r["message_id"]: r["reason"] for r in extract.unhandled_messages(msgs).collect()}
    assert handled == {"0"}
    assert unhandled == {"1": "no_ids", "2": "no_ids", "3": "unknown_sender"}


def test_links(spark):
    html = '<a href="u" class="c" ref="r">x <i>y</i> &amp; z</a><a name="n">w</a>'
    rows = extract.message_links(messages(spark, ("x", html, None))).orderBy("pos").collect()
    assert [tuple(r)[1:] for r in rows] == [
        (0, "u", "c", "r", "x y & z"),
        (1, None, None, None, "w"),
    ]

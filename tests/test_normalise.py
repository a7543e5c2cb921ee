import json

import pytest

from litscore.operators import normalise
from litscore.operators.pages import normalise_pages, publisher_of, usable_pages
from litscore.sources import read_source_dump

PUBMED = """<?xml version="1.0"?>
<PubmedArticleSet>
<PubmedArticle>
  <MedlineCitation><PMID>1</PMID><Article>
    <Journal><JournalIssue><PubDate><Year>2020</Year></PubDate></JournalIssue><Title>J. One</Title></Journal>
    <ArticleTitle>A <i>b</i> &amp; c
        d</ArticleTitle>
    <Abstract><AbstractText Label="A">First &lt; <sup>2</sup> &lt;x&gt; &amp;amp; part.</AbstractText>
      <AbstractText Label="B">Second.</AbstractText></Abstract>
    <AuthorList><Author><LastName>Poe</LastName><ForeName>Ada</ForeName></Author>
      <Author><LastName>Li</LastName></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList>
  </Article></MedlineCitation>
  <PubmedData><ArticleIdList><ArticleId IdType="pubmed">1</ArticleId>
    <ArticleId IdType="doi">10.1/a</ArticleId></ArticleIdList></PubmedData>
</PubmedArticle>
<PubmedArticle>
  <MedlineCitation><Article><Journal><JournalIssue><PubDate><MedlineDate>1999 Spring</MedlineDate></PubDate>
    </JournalIssue></Journal><ArticleTitle>Plain</ArticleTitle></Article></MedlineCitation>
  <PubmedData><ArticleIdList><ArticleId IdType="pubmed">2</ArticleId></ArticleIdList></PubmedData>
</PubmedArticle>
</PubmedArticleSet>
"""

ARXIV = """<feed xmlns="http://www.w3.org/2005/Atom"><title>query</title>
<entry><id>http://arxiv.org/abs/2401.00001v2</id><published>2024-01-02T00:00:00Z</published>
<title>One
  two</title><summary>  Some
text &lt;a&gt;. </summary><author><name>Ada Poe</name></author><author><name>Bo Li</name></author></entry>
<entry><id>http://arxiv.org/abs/math/0001001v1</id><published>soon</published><title>Old</title>
<summary>x</summary></entry></feed>
"""


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_pubmed(spark, tmp_path):
    (tmp_path / "a.xml").write_text(PUBMED)
    found = rows(normalise.normalise_pubmed(read_source_dump(spark, "pubmed", str(tmp_path))), "pmid")
    one = found["1"]
    assert (one["doi"], one["title"], one["year"]) == ("10.1/a", "A b & c d", 2020)
    assert one["abstract"] == "First < 2 <x> &amp; part."
    assert (one["journal"], one["authors"]) == ("J. One", "Ada Poe,  Li,  ")
    two = found["2"]
    assert two["title"] == "Plain"
    assert [two[c] for c in ("doi", "abstract", "year", "authors", "journal")] == [None] * 5


def test_arxiv(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ARXIV)
    found = rows(normalise.normalise_arxiv(read_source_dump(spark, "arxiv", str(tmp_path))), "title")
    one = found["One two"]
    assert (one["arxiv"], one["doi"]) == ("2401.00001", "10.48550/arXiv.2401.00001")
    assert (one["abstract"], one["year"]) == ("Some text <a>.", 2024)
    assert (one["authors"], one["journal"]) == ("Ada Poe, Bo Li", "arXiv")
    old = found["Old"]
    assert [old[c] for c in ("arxiv", "doi", "year", "authors")] == [None] * 4


def dump(tmp_path, *records):
    (tmp_path / "a.json").write_text("\n".join(json.dumps(r) for r in records))
    return str(tmp_path)


def test_crossref(spark, tmp_path):
    path = dump(
        tmp_path,
        {
            "DOI": "10.1/a",
            "title": ["T", "U"],
            "abstract": "<jats:p>A</jats:p>",
            "container-title": ["J"],
            "author": [{"given": "Ada", "family": "Poe"}, {"family": "Li"}, {"given": "Bo"}, {}],
            "published-print": {"date-parts": [[2001, 2]]},
            "published-online": {"date-parts": [[2000]]},
            "resource": {"primary": {"URL": "https://x.example"}},
        },
        {"DOI": "10.1/b", "published-online": {"date-parts": [[2000]]}, "abstract": ["x", "y"], "title": []},
        {"DOI": "10.1/c", "published-print": {"date-parts": [[None]]}, "published-online": {"date-parts": [[2000]]}, "author": []},
    )
    found = rows(normalise.normalise_crossref(read_source_dump(spark, "crossref", path)), "doi")
    a, b, c = (found[f"10.1/{x}"] for x in "abc")
    assert (a["title"], a["abstract"], a["journal"], a["year"]) == ("T", "<jats:p>A</jats:p>", "J", 2001)
    assert (a["authors"], a["publisher_url"]) == ("Ada Poe,  Li, Bo ,  ", "https://x.example")
    assert (b["title"], b["abstract"], b["year"], b["authors"], b["publisher_url"]) == (None, "x", 2000, "", None)
    assert (c["year"], c["authors"], c["abstract"]) == (None, "", None)


def test_s2(spark, tmp_path):
    path = dump(
        tmp_path,
        {
            "paperId": "p",
            "externalIds": {"DOI": "10.1/a", "PubMed": "7", "ArXiv": "2401.1", "CorpusId": 5},
            "title": "T",
            "abstract": None,
            "journal": {"name": "J"},
            "year": 2020,
            "authors": [{"name": "Ada Poe"}, {"name": "Bo Li"}],
        },
        {"paperId": "q", "externalIds": {}, "title": "U", "journal": None, "authors": []},
    )
    found = rows(normalise.normalise_s2(read_source_dump(spark, "s2", path)), "semantic_scholar")
    p, q = found["p"], found["q"]
    assert (p["doi"], p["pmid"], p["arxiv"]) == ("10.1/a", "7", "2401.1")
    assert (p["journal"], p["year"], p["authors"], p["abstract"]) == ("J", 2020, "Ada Poe, Bo Li", None)
    assert (q["doi"], q["journal"], q["year"], q["authors"]) == (None, None, None, "")


def test_elsevier(spark, tmp_path):
    record = {
        "pubmed-id": "9",
        "coredata": {
            "prism:doi": "10.1016/a",
            "link": [{"@rel": "self", "@href": "no"}, {"@rel": "scidir", "@href": "https://s.example/pii/S1"}],
            "dc:title": "T",
            "dc:description": "\n  one\n  two ",
            "prism:publicationName": "J",
            "prism:coverDate": "2019-05-01",
            "dc:creator": [{"$": "Poe, Ada"}, {"$": "Li, Bo"}],
        },
    }
    bare = {"coredata": {**record["coredata"], "prism:doi": "10.1016/b", "link": []}}
    path = dump(tmp_path, {"full-text-retrieval-response": record}, bare)
    found = rows(normalise.normalise_elsevier(read_source_dump(spark, "elsevier", path)), "doi")
    a = found["10.1016/a"]
    assert (a["pmid"], a["publisher_url"], a["abstract"]) == ("9", "https://s.example/pii/S1", "one two")
    assert (a["journal"], a["year"], a["authors"]) == ("J", 2019, "Poe, Ada, Li, Bo")
    assert (found["10.1016/b"]["publisher_url"], found["10.1016/b"]["pmid"]) == (None, None)


def test_unknown_kind(spark):
    with pytest.raises(ValueError, match="unknown kind"):
        read_source_dump(spark, "nowhere", "/tmp")


def pages(spark, *rows):
    data = [(i, url, html) for i, (url, html) in enumerate(rows)]
    return spark.createDataFrame(data, "page_id BIGINT, url STRING, html STRING")


NATURE = """<html><head><link rel=stylesheet href=x><link href="https://www.nature.com/articles/s1" rel="CANONICAL">
<meta content="T &amp; U" name='DC.Title'/><meta name="dc.creator" content="Poe, Ada"><META NAME="Dc.Creator" CONTENT="Li,Bo">
<meta name="DC.creator" content="Group"><meta name="dc.description" content="A > b"><meta name="dc.date" content="2021-02-03">
<meta name="citation_journal_title" content="N"><meta name="citation_doi" content="10.1038/s1">"""


def test_nature_pages(spark):
    found = normalise_pages(pages(spark, ("https://www.nature.com/articles/s1", NATURE))).first()
    assert found["publisher"] == "nature"
    assert (found["title"], found["abstract"], found["year"]) == ("T & U", "A > b", 2021)
    assert (found["doi"], found["publisher_url"]) == ("10.1038/s1", "https://www.nature.com/articles/s1")
    assert found["authors"] == "Ada Poe, Bo Li, Group"


def test_names_of_other_case(spark):
    html = '<meta name="Citation_Title" content="T"><meta name="citation_online_date" content="soon">'
    openreview = normalise_pages(pages(spark, ("https://openreview.net/forum?id=1", html))).first()
    assert (openreview["title"], openreview["year"], openreview["authors"]) == (None, None, "")
    html = '<meta name="Publication_DOI" content="10.1126/x"><meta name="DC.Title" content="T">'
    science = normalise_pages(pages(spark, ("https://www.science.org/doi/x", html))).first()
    assert (science["doi"], science["title"]) == ("10.1126/x", "T")


def test_openreview_url(spark):
    html = '<meta name="citation_pdf_url" content="https://openreview.net/pdf?id=a%20b&amp;x=1">'
    found = normalise_pages(pages(spark, ("https://openreview.net/forum?id=a", html))).first()
    assert found["publisher_url"] == "https://openreview.net/forum?id=a%20b&x=1"


def test_biorxiv_pages(spark):
    html = """<meta name="citation_public_url" content="https://www.biorxiv.org/content/1">
    <meta name="article:published_time" content="2022-05-06"><meta name="citation_doi" content="10.1101/1">
    <h1 class="x" id="page-title"> A <em>b</em> </h1>
    <div class="highwire-cite-authors"><span class="highwire-citation-authors">
    <span class="highwire-citation-author first" data-delta="0"><span class="nlm-given-names">Ada</span> <span
    class="nlm-surname">Poe</span></span>, <span class="highwire-citation-author"><span
    class="nlm-given-names">Bo</span> <span class="nlm-surname">Li</span></span></span></div>
    <div class="section abstract"><div>In<br> short</div><p>x &lt; y</p></div><div class="abstract">no</div>"""
    found = normalise_pages(pages(spark, ("https://www.biorxiv.org/content/1", html))).first()
    assert (found["title"], found["authors"]) == ("A b", "Ada Poe, Bo Li")
    assert (found["abstract"], found["journal"], found["year"]) == ("In shortx < y", "BioRxiv", 2022)


def test_usable_pages(spark):
    df = pages(
        spark,
        ("https://www.nature.com/articles/s1", NATURE),
        ("https://www.nature.com/articles/s2", NATURE.replace("dc.description", "none")),
        ("https://www.biorxiv.org/content/1", "<h1>no</h1>"),
        ("https://example.org/1", NATURE.replace("CANONICAL", "alternate")),
    )
    assert [r["page_id"] for r in normalise_pages(df).select("page_id").collect()] == [0, 1, 2]
    assert [r["page_id"] for r in usable_pages(normalise_pages(df)).collect()] == [0]


@pytest.mark.parametrize(
    "url, publisher",
    [
        ("https://www.nature.com/x", "nature"),
        ("http://NATURE.com:80/x", "nature"),
        ("https://notnature.com/x", None),
        ("https://example.org/?u=https://nature.com/", None),
        ("https://u@science.org", "science"),
        (None, None),
    ],
)
def test_publisher(evaluate, url, publisher):
    assert evaluate(publisher_of, url) == publisher


def test_landed_publishers(spark):
    from litscore.operators.pages import normalise_pages, unknown_pages

    body = '<html><head><LINK rel="Canonical" href="https://www.nature.com/articles/s1"></head></html>'
    df = spark.createDataFrame(
        [(1, "https://click.example/1", "", "science"), (2, "https://click.example/2", body, None),
         (3, "https://www.science.org/x", "", None), (4, "https://click.example/4", "", "other"), (5, None, None, None)],
        "page_id BIGINT, url STRING, html STRING, publisher STRING",
    )
    found = {r["page_id"]: r["publisher"] for r in normalise_pages(df).collect()}
    assert found == {1: "science", 2: "nature", 3: "science"}
    assert sorted(r["page_id"] for r in unknown_pages(df).collect()) == [4, 5]
    assert {r["page_id"] for r in normalise_pages(df.drop("publisher")).collect()} == {2, 3}


def test_xml_records_split_anywhere(spark, tmp_path):
    """A dump of many splits is read by many tasks, with what the XML reader gives."""
    from litscore import schema
    from litscore.sources.dumps import read_xml_records

    one = PUBMED.split("<PubmedArticleSet>")[1].split("</PubmedArticleSet>")[0]
    odd = ('<PubmedArticle kind="x"><MedlineCitation><Article><ArticleTitle><![CDATA[a < b & </i>]]> &#233;t&#xE9;'
           '</ArticleTitle></Article></MedlineCitation></PubmedArticle>')
    body = "".join(one.replace(">1<", f">{i}<") + odd for i in range(4000))
    (tmp_path / "big.xml").write_text(f'<?xml version="1.0"?>\n<PubmedArticleSet>{body}</PubmedArticleSet>\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        found = read_xml_records(spark, str(tmp_path), "PubmedArticle", schema.PUBMED)
        assert found.rdd.getNumPartitions() > 4
        whole = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema.PUBMED).load(str(tmp_path))
        assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
        assert found.count() == 12000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

"""Messages, sources and records derived from the given tables.

Each is a list of SQL expressions over whole tables, worded so that Spark and the
SQL check derive the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litscore.session import spread

SPARK_BASE64 = "base64(CAST({0} AS BINARY))"
SQL_BASE64 = "base64(encode({0}))"

TITLE = "split_part(text, chr(10), 1)"
ABSTRACT = f"nullif(substr(text, length({TITLE}) + 2), '')"
ID = "CAST(doc_id AS STRING)"
HOT = "CAST(doc_id % 50 AS STRING)"
ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"


_SPREAD_BY = {"documents": "doc_id", "pages": "page_id", "events": "event_id"}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for costly work on each row; one that is a single file is spread."""
    df = scan(spark, sf_dir, name)
    return spread(df, _SPREAD_BY[name]) if name in _SPREAD_BY else df


# --- messages -----------------------------------------------------------------------

_SENDERS = (
    "bioRxiv <cshljnls-mailer@alerts.highwire.org>",
    "efback@ncbi.nlm.nih.gov",
    '"Nature" <Nature@e-alert.nature.com>',
    "ealert@nature.com",
    "Semantic Scholar <do-not-reply@semanticscholar.org>",
    "no-reply@arXiv.org",
    "Science <alerts@aaas.sciencepubs.org>",
    "nobody@example.org",
)


def _nature_link(k: str, base64: str) -> str:
    target = f"'x=1&target=http%3A%2F%2Fwww.nature.com%2Farticles%2Fs' || {k} || '%3Fa%3D1'"
    packed = f"translate({base64.format(target)}, '+/=' || chr(13) || chr(10), '-_')"
    return f"'<a href=\"http://x.example/c?u=1&amp;_L54AD1F204_=' || {packed} || '\">read</a>'"


def message_columns(base64: str) -> list[str]:
    """A message per document: its text, links to an article of its own and a shared one."""

    def both(before: str, after: str) -> str:
        return " || ".join(f"'{before}' || {k} || '{after}'" for k in (ID, HOT))

    links = (
        both('<a href="http://www.biorxiv.org/content/early/', '">paper</a>')
        + " || '<a href=\"https://example.org/' || " + ID + " || '\">other</a><a name=\"end\">x</a>'",
        both('<a class="docsum-title big" ref="article_id=', '" href="#">title</a>')
        + " || '<a class=\"docsum-title\" ref=\"linksrc=1\">none</a>'",
        f"{_nature_link(ID, base64)} || {_nature_link(HOT, base64)}",
        both("see doi:10.1038/s", " end "),
        both('<a href="https://www.semanticscholar.org/paper/T/h', '?x=1" class="paper-link">t</a>'),
        f"chr(10) || 'arXiv:2401.' || {ID} || chr(10) || ' arXiv:2401.' || {HOT} || 'v2 ' || chr(10)"
        " || 'not arXiv:1.2' || chr(10)",
        both("<a href=''https://science.example/s", "''>READ MORE</a>")
        + " || '<a href=\"https://science.example/mixed\">READ <b>MORE</b></a><a href=\"#\">other</a>'",
        "'<a href=\"http://www.biorxiv.org/content/early/1\">paper</a>'",
    )
    sender = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SENDERS))
    link = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(links))
    return [
        f"{ID} AS message_id",
        "doc_id AS uid",
        "'()' AS flags",
        f"CASE doc_id % 8 {sender} END AS sender",
        "'reader@example.org' AS recipient",
        f"{TITLE} AS subject",
        "CAST(NULL AS TIMESTAMP) AS received_at",
        f"'<html><p>' || {ESCAPED.format('text')} || '</p>' || CASE doc_id % 8 {link} END"
        " || '</html>' AS html",
        "CAST(NULL AS STRING) AS text",
    ]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*message_columns(SPARK_BASE64))


# --- sources ------------------------------------------------------------------------

_PREFIX = (
    "CASE doc_id % 4 WHEN 0 THEN '10.1038/s' WHEN 1 THEN '10.48550/arxiv.2401.'"
    " WHEN 2 THEN '10.1016/j.' ELSE '10.9999/' END"
)
DOI = f"{_PREFIX} || {ID}"
ARTICLE_TEXT = [
    "'Ada Poe, Bo Li' AS authors",
    "CAST(2000 + doc_id % 25 AS INT) AS year",
    "CAST(NULL AS STRING) AS notes",
]


def article(**fields: str) -> list[str]:
    """Columns of an article row; those not given are null strings."""
    names = ("doi", "pmid", "arxiv", "semantic_scholar", "publisher_url", "title", "abstract", "journal")
    return [
        f"{fields.get(name, 'CAST(NULL AS STRING)')} AS {name}" for name in names
    ] + ARTICLE_TEXT


S2 = article(
    doi=DOI,
    semantic_scholar=f"'h' || {ID}",
    title=TITLE,
    abstract=f"CASE WHEN toxic = 1 THEN NULL ELSE coalesce({ABSTRACT}, '-') END",
    journal="'S2 Journal'",
)
CROSSREF = article(
    doi=f"upper({DOI})",
    title=f"CASE WHEN doc_id % 9 = 0 THEN NULL ELSE {TITLE} END",
    abstract=f"coalesce({ABSTRACT}, '-')",
    journal="'Crossref Journal'",
)
# Of the pages one in seven lacks an abstract, so that it gives no article but on bioRxiv,
# which may also lack a title; a Science page without one gives none.
_LANDED = f"'https://publisher.example/' || {ID}"
_SOME = f"CASE WHEN doc_id % 7 <> 0 THEN coalesce({ABSTRACT}, '-') END"
_SIX = f"CASE WHEN doc_id % 6 <> 0 THEN {TITLE} END"
PAGES = [
    f"'https://www.nature.com/articles/s' || {ID} AS url",
    "'nature' AS publisher",
    *article(doi=f"'10.1038/s' || {ID}", publisher_url=_LANDED, title=TITLE, abstract=_SOME, journal="'Nature'"),
]
BIORXIV_PAGES = [
    f"'https://www.biorxiv.org/content/early/' || {ID} AS url",
    "'biorxiv' AS publisher",
    *article(doi=f"'10.1101/' || {ID}", publisher_url=_LANDED, title=_SIX, abstract=_SOME, journal="'BioRxiv'"),
]
SCIENCE_PAGES = [
    f"'https://science.example/s' || {ID} AS url",
    "'science' AS publisher",
    *article(doi=f"'10.1126/s' || {ID}", publisher_url=_LANDED, title=_SIX, abstract=_SOME, journal="'Science'"),
]
OPENREVIEW_PAGES = [
    f"'https://openreview.net/forum?id=' || {ID} AS url",
    "'openreview' AS publisher",
    *article(publisher_url=_LANDED, title=TITLE, abstract=_SOME, journal="'OpenReview'"),
]
ARXIV = article(
    doi=f"'10.48550/arXiv.2401.' || {ID}",
    arxiv=f"'2401.' || {ID}",
    title=TITLE,
    journal="'arXiv'",
)
ELSEVIER = article(
    doi=f"'10.1016/j.' || {ID}",
    publisher_url=f"'https://www.sciencedirect.com/science/article/pii/S' || {ID}",
    title=TITLE,
    journal="'Elsevier Journal'",
)
PUBMED = article(doi=f"'10.7777/' || {ID}", pmid=ID, title=TITLE, abstract=ABSTRACT, journal="'PM'")
REDIRECT = [
    f"{DOI} AS doi",
    f"'https://linkinghub.example/retrieve/pii/S' || {ID} AS url",
]

# What each source holds of the documents, as SQL over ``documents`` (and ``labels``).
SOURCE_ROWS = {
    "s2": (S2, "documents JOIN labels USING (doc_id)", "quality = 1"),
    "crossref": (CROSSREF, "documents", "doc_id % 3 = 0"),
    "nature": (PAGES, "documents", "doc_id % 5 <> 0"),
    "biorxiv": (BIORXIV_PAGES, "documents", "doc_id % 5 <> 0"),
    "science": (SCIENCE_PAGES, "documents", "doc_id % 5 <> 0"),
    "openreview": (OPENREVIEW_PAGES, "documents", "doc_id % 5 <> 0"),
    "arxiv": (ARXIV, "documents", "doc_id % 5 <> 0"),
    "elsevier": (ELSEVIER, "documents", "doc_id % 5 <> 0"),
    "pubmed": (PUBMED, "documents", "doc_id % 5 <> 0"),
    "doi_redirect": (REDIRECT, "documents", "doc_id % 4 = 2"),
}


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The sources of the resolvers: parts of the documents, each with its own gaps."""
    documents = scan(spark, sf_dir, "documents")
    labelled = documents.join(scan(spark, sf_dir, "labels"), "doc_id")
    found = {
        name: (labelled if name == "s2" else documents).filter(where).selectExpr(*columns)
        for name, (columns, _, where) in SOURCE_ROWS.items()
    }
    pages = found.pop("nature")
    for publisher in ("biorxiv", "science", "openreview"):
        pages = pages.unionByName(found.pop(publisher))
    return {**found, "pages": pages}


WANTED = [f"{DOI} AS id"]
# Export rows: three in four with a DOI, the others with an arXiv id, a url or both.
LIBRARY_ROWS = [
    "doc_id AS row_id",
    f"CASE WHEN doc_id % 4 = 0 THEN NULL ELSE {DOI} END AS doi",
    f"CASE WHEN doc_id % 3 = 0 THEN '2401.' || {ID} || 'v1' END AS arxiv",
    "CASE doc_id % 5 WHEN 0 THEN NULL"
    f" WHEN 1 THEN 'https://arxiv.org/abs/2401.' || {ID} || 'v3'"
    f" WHEN 2 THEN 'https://openreview.net/forum?id=' || {ID}"
    " WHEN 3 THEN 'https://arxiv.org/abs/math/0001001'"
    " ELSE 'https://example.org/x' END AS url",
]


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "documents").selectExpr(*WANTED)


def library_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "documents").selectExpr(*LIBRARY_ROWS)


# All documents as articles, with every mix of missing title, abstract and journal.
GAPPED = [
    "doc_id",
    f"{DOI} AS doi",
    f"'2401.' || {ID} AS arxiv",
    f"CASE WHEN doc_id % 5 <> 0 THEN {TITLE} END AS title",
    f"CASE WHEN doc_id % 7 <> 0 THEN {ABSTRACT} END AS abstract",
    "CASE doc_id % 4 WHEN 0 THEN 'arXiv' WHEN 1 THEN 'The Journal' WHEN 2 THEN 'ARXIV' END AS journal",
]


def gapped_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "documents").selectExpr(*GAPPED)


# --- records of dumps ---------------------------------------------------------------

YEAR = "CAST(1990 + doc_id % 30 AS STRING)"
_T, _A = ESCAPED.format(TITLE), ESCAPED.format(f"coalesce({ABSTRACT}, '')")

def page_html() -> str:
    """An article page of one of four publishers, by document."""

    def meta(name: str, content: str) -> str:
        return f"'<meta name=\"{name}\" content=\"' || {content} || '\">'"

    date = f"{YEAR} || '-03-04'"
    openreview = " || ".join(
        [
            meta("citation_title", _T),
            meta("citation_author", "'Ada Poe'"),
            meta("citation_author", "'Bo Li'"),
            meta("citation_online_date", f"{YEAR} || '/03/04'"),
            meta("citation_pdf_url", f"'https://openreview.net/pdf?id=' || {ID}"),
            meta("citation_conference_title", "'ICX'"),
            meta("citation_abstract", _A),
            meta("Citation_Title", "'no'"),
        ]
    )
    biorxiv = " || ".join(
        [
            meta("citation_public_url", f"'https://www.biorxiv.org/content/' || {ID}"),
            meta("citation_doi", f"'10.1101/' || {ID}"),
            meta("article:published_time", date),
            f"'<h1 class=\"big\" id=\"page-title\"> ' || {_T} || ' <sup>2</sup></h1>'",
            "'<div class=\"highwire-cite-authors\"><span class=\"highwire-citation-authors\">"
            "<span class=\"highwire-citation-author first\"><span class=\"nlm-given-names\">Ada</span>"
            " <span class=\"nlm-surname\">Poe</span></span>, <span class=\"highwire-citation-author\">"
            "<span class=\"nlm-given-names\">Bo</span> <span class=\"nlm-surname\">Li</span></span>"
            "</span></div>'",
            f"'<div class=\"section abstract\" id=\"a1\"><div>Aim</div><p>' || {_A} || '</p></div><div>no</div>'",
        ]
    )
    nature = " || ".join(
        [
            meta("DC.title", _T),
            meta("dc.creator", "'Poe, Ada'"),
            meta("Dc.Creator", "'Li, Bo'"),
            meta("dc.description", _A),
            meta("dc.date", date),
            meta("citation_doi", f"'10.1038/s' || {ID}"),
            meta("citation_journal_title", "'Nature X'"),
            f"'<link rel=\"Canonical\" href=\"https://www.nature.com/articles/s' || {ID} || '\">'",
        ]
    )
    science = " || ".join(
        [
            meta("dc.Title", _T),
            meta("dc.Creator", "'Ada Poe'"),
            meta("dc.creator", "'Bo Li'"),
            meta("dc.Description", _A),
            meta("dc.Date", date),
            meta("publication_doi", f"'10.1126/s' || {ID}"),
            meta("citation_journal_title", "'Science'"),
            f"'<link rel=\"canonical\" href=\"https://www.science.org/doi/' || {ID} || '\">'",
        ]
    )
    kinds = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate((openreview, biorxiv, nature, science)))
    return (
        "'<!DOCTYPE html><html><head><!-- <meta name=\"citation_title\" content=\"no\"> -->'"
        f" || CASE doc_id % 4 {kinds} END || '</head><body><p>x<br>y</body></html>'"
    )


PAGE_URL = (
    f"CASE doc_id % 4 WHEN 0 THEN 'https://openreview.net/forum?id=' || {ID}"
    f" WHEN 1 THEN 'https://www.biorxiv.org/content/' || {ID}"
    f" WHEN 2 THEN 'https://www.nature.com/articles/s' || {ID}"
    f" ELSE 'https://www.science.org/doi/' || {ID} END"
)


def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS page_id", f"{PAGE_URL} AS url", f"{page_html()} AS html"
    )


# --- articles to embed --------------------------------------------------------------

ARTICLES = ["doc_id", f"{TITLE} AS title", f"{ABSTRACT} AS abstract"]


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*ARTICLES)


def liked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents a reader liked, as a library to embed."""
    quality = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return articles(spark, sf_dir).join(quality, "doc_id")

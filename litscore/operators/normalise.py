"""Records of bibliographic dumps to article rows; one projection per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscore.functions.text import clean_text, first_simple, unwrap_text, year_of
from litscore.schema import ARTICLE, ARTICLE_FIELDS

# A fixed value: the form of an arXiv abstract link.
ARXIV_URL = r"^https?://arxiv\.org/abs/([0-9]+\.[0-9]+)(v[0-9]+)?"


# The elements PubMed allows inside a title or an abstract.
_INLINE = r"</?(?:b|i|u|sub|sup|DispFormula|mml:[A-Za-z]+)(?:\s[^<>]*)?/?>"


def _without_markup(col: Column) -> Column:
    """Text without its inline elements.

    The XML source has replaced entities already, so a ``<`` that is not one of these
    elements is text.
    """
    return F.regexp_replace(col, _INLINE, "")


def to_articles(df: DataFrame, keep: tuple[str, ...] = (), **fields: Column) -> DataFrame:
    """Project ``df`` to the article columns; those not given are null."""
    return df.select(
        *keep,
        *(
            fields.get(name, F.lit(None)).cast(ARTICLE[name].dataType).alias(name)
            for name in ARTICLE_FIELDS
        ),
    )


def _or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def normalise_pubmed(df: DataFrame) -> DataFrame:
    """PubMed records: all authors, the first section of the abstract, ids by type."""
    article = "MedlineCitation.Article"
    authors = F.col(f"{article}.AuthorList.Author")
    names = F.transform(
        authors,
        lambda a: F.concat(
            _or_empty(clean_text(a["ForeName"])), F.lit(" "), _or_empty(clean_text(a["LastName"]))
        ),
    )

    def record_id(kind: str) -> Column:
        ids = F.col("PubmedData.ArticleIdList.ArticleId")
        return clean_text(F.get(F.filter(ids, lambda i: i["_IdType"] == kind), F.lit(0))["_VALUE"])

    abstract = first_simple(F.col(f"{article}.Abstract.AbstractText"), 1)
    return to_articles(
        df,
        doi=record_id("doi"),
        pmid=record_id("pubmed"),
        title=unwrap_text(_without_markup(F.col(f"{article}.ArticleTitle"))),
        abstract=unwrap_text(_without_markup(abstract)),
        journal=clean_text(F.col(f"{article}.Journal.Title")),
        year=F.expr(f"try_cast(trim({article}.Journal.JournalIssue.PubDate.Year) AS INT)"),
        authors=F.when(F.size(names) > 0, F.array_join(names, ", ")),
    )


def normalise_arxiv(df: DataFrame) -> DataFrame:
    """arXiv entries; the id comes without its version and also makes the DOI."""
    found = F.regexp_extract(clean_text(F.col("id")), ARXIV_URL, 1)
    arxiv = F.when(found != "", found)
    names = F.array_compact(F.transform("author", lambda a: clean_text(a["name"])))
    return to_articles(
        df,
        doi=F.concat(F.lit("10.48550/arXiv."), arxiv),
        arxiv=arxiv,
        title=unwrap_text(F.col("title")),
        abstract=unwrap_text(F.col("summary")),
        journal=F.lit("arXiv"),
        year=year_of(clean_text(F.col("published"))),
        authors=F.when(F.size(names) > 0, F.array_join(names, ", ")),
    )


def normalise_crossref(df: DataFrame) -> DataFrame:
    """Crossref works: the print date if there is one, else the online date."""

    def year(date: str) -> Column:
        return first_simple(F.col(f"`{date}`.`date-parts`"), 2)

    names = F.transform(
        "author", lambda a: F.concat(_or_empty(a["given"]), F.lit(" "), _or_empty(a["family"]))
    )
    abstracts = F.from_json("abstract", "array<string>")
    return to_articles(
        df,
        doi=F.col("DOI"),
        publisher_url=F.col("resource.primary.URL"),
        title=first_simple(F.col("title"), 1),
        # a list arrives as its JSON text, as the field is read as a string
        abstract=F.when(
            F.col("abstract").rlike(r'^\[(\s*"|\])'), first_simple(abstracts, 1)
        ).otherwise(F.col("abstract")),
        journal=first_simple(F.col("`container-title`"), 1),
        year=F.when(F.col("`published-print`").isNotNull(), year("published-print")).otherwise(
            year("published-online")
        ),
        authors=_or_empty(F.array_join(names, ", ")),
    )


def normalise_s2(df: DataFrame) -> DataFrame:
    """Semantic Scholar papers."""
    return to_articles(
        df,
        doi=F.col("externalIds")["DOI"],
        pmid=F.col("externalIds")["PubMed"],
        arxiv=F.col("externalIds")["ArXiv"],
        semantic_scholar=F.col("paperId"),
        title=F.col("title"),
        abstract=F.col("abstract"),
        journal=F.col("journal.name"),
        year=F.col("year"),
        authors=_or_empty(F.array_join(F.transform("authors", lambda a: a["name"]), ", ")),
    )


def normalise_elsevier(df: DataFrame) -> DataFrame:
    """Elsevier records; the url is the ScienceDirect link."""
    core = F.col("coredata")
    links = F.filter(core["link"], lambda link: link["@rel"] == "scidir")
    return to_articles(
        df,
        doi=core["prism:doi"],
        pmid=F.col("`pubmed-id`"),
        publisher_url=F.get(links, F.lit(0))["@href"],
        title=core["dc:title"],
        abstract=unwrap_text(core["dc:description"]),
        journal=core["prism:publicationName"],
        year=year_of(core["prism:coverDate"]),
        authors=F.array_join(F.transform(core["dc:creator"], lambda a: a["$"]), ", "),
    )

"""Schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

ARTICLE_FIELDS = (
    "doi",
    "pmid",
    "arxiv",
    "semantic_scholar",
    "publisher_url",
    "title",
    "abstract",
    "journal",
    "year",
    "authors",
    "notes",
)

ARTICLE = T.StructType(
    [
        T.StructField(name, T.IntegerType() if name == "year" else T.StringType())
        for name in ARTICLE_FIELDS
    ]
    + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
)

MESSAGE = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("uid", T.LongType()),
        T.StructField("flags", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("recipient", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("html", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

# The XML fields that may hold inline markup (<i>, <sup>, ...) are read as
# strings: the XML source then hands over their inner XML, entities replaced.
PUBMED = """
    MedlineCitation STRUCT<Article: STRUCT<
        ArticleTitle: STRING,
        Abstract: STRUCT<AbstractText: ARRAY<STRING>>,
        Journal: STRUCT<Title: STRING,
                        JournalIssue: STRUCT<PubDate: STRUCT<Year: STRING>>>,
        AuthorList: STRUCT<Author: ARRAY<STRUCT<ForeName: STRING, LastName: STRING>>>>>,
    PubmedData STRUCT<ArticleIdList: STRUCT<
        ArticleId: ARRAY<STRUCT<_IdType: STRING, _VALUE: STRING>>>>
"""

ARXIV = """
    id STRING, title STRING, summary STRING, published STRING,
    author ARRAY<STRUCT<name: STRING>>
"""

CROSSREF = """
    DOI STRING, title ARRAY<STRING>, abstract STRING,
    `container-title` ARRAY<STRING>,
    author ARRAY<STRUCT<given: STRING, family: STRING>>,
    `published-print` STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>,
    `published-online` STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>,
    resource STRUCT<primary: STRUCT<URL: STRING>>
"""

S2 = """
    paperId STRING, externalIds MAP<STRING, STRING>, title STRING,
    abstract STRING, journal STRUCT<name: STRING>, year INT,
    authors ARRAY<STRUCT<name: STRING>>
"""

ELSEVIER_BODY = """
    `pubmed-id` STRING,
    coredata STRUCT<`prism:doi`: STRING,
        link: ARRAY<STRUCT<`@rel`: STRING, `@href`: STRING>>,
        `dc:title`: STRING, `dc:description`: STRING,
        `prism:publicationName`: STRING, `prism:coverDate`: STRING,
        `dc:creator`: ARRAY<STRUCT<`$`: STRING>>>
"""

# ``publisher`` may be set where a page is landed, for urls of other hosts
PAGE = "page_id BIGINT, url STRING, html STRING, publisher STRING"
DOI_REDIRECT = "doi STRING, url STRING"

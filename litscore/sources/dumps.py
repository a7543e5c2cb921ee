"""Landed bibliographic dumps, one scan per kind of source, each with its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litscore import schema

SOURCE_KINDS = ("pubmed", "arxiv", "crossref", "s2", "elsevier", "pages", "doi_redirect")


def read_xml_records(spark: SparkSession, path: str, row_tag: str, fields: str) -> DataFrame:
    """Records ``<row_tag>`` of XML files, scanned in splits that may fall anywhere.

    The files are read as text whose lines end at the record's end tag, so a large dump is
    cut into as many tasks as it has splits (a compressed file stays one); what comes
    before a record's start tag in such a line (the declaration, the root's tag, white
    space, the tail of the file, an empty record written as one self-closing tag) is
    dropped, and each record is parsed by ``from_xml`` with the same options as the XML
    reader. A record's end tag may not occur inside its own CDATA or comments; entities
    are those of XML, not of a DTD in the file's header.
    """
    end = f"</{row_tag}>"
    start = rf"(?s).*(<{row_tag}(?=[\s/>]).*)$"  # the last start tag: records do not nest
    lines = spark.read.option("lineSep", end).text(path)
    record = F.regexp_extract(F.col("value"), start, 1)
    opened = lines.select(record.alias("r")).where(F.col("r") != "")
    return opened.select(F.from_xml(F.concat(F.col("r"), F.lit(end)), fields).alias("x")).select("x.*")


def _xml(row_tag: str, fields: str):
    def read(spark: SparkSession, path: str) -> DataFrame:
        return read_xml_records(spark, path, row_tag, fields)

    return read


def _json(fields: str):
    def read(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(fields).json(path)

    return read


def _parquet(fields: str):
    def read(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(fields).parquet(path)

    return read


def _elsevier(spark: SparkSession, path: str) -> DataFrame:
    """Records, bare or still inside their response envelope."""
    envelope = "full-text-retrieval-response"
    body = schema.ELSEVIER_BODY.strip()
    inner = body.replace("`pubmed-id` STRING", "`pubmed-id`: STRING").replace(
        "coredata STRUCT", "coredata: STRUCT"
    )
    df = spark.read.schema(f"`{envelope}` STRUCT<{inner}>, {body}").json(path)
    return df.select(
        *(
            F.coalesce(F.col(f"`{envelope}`.`{name}`"), F.col(f"`{name}`")).alias(name)
            for name in ("pubmed-id", "coredata")
        )
    )


_READERS = {
    "pubmed": _xml("PubmedArticle", schema.PUBMED),
    "arxiv": _xml("entry", schema.ARXIV),
    "crossref": _json(schema.CROSSREF),
    "s2": _json(schema.S2),
    "elsevier": _elsevier,
    "pages": _parquet(schema.PAGE),
    "doi_redirect": _parquet(schema.DOI_REDIRECT),
}


def read_source_dump(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Scan a dump of one of :data:`SOURCE_KINDS`."""
    if kind not in _READERS:
        raise ValueError(f"unknown kind {kind!r}; one of {', '.join(SOURCE_KINDS)}")
    return _READERS[kind](spark, path)

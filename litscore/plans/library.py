"""Jobs over the library: build it from an export, resolve it to full records."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from litscore.operators.filters import (
    encoder_input,
    filter_library_since,
    require_title,
    split_by_id_kind,
)
from litscore.operators.folds import cv_distances
from litscore.operators.resolve import (
    DOI_STAGES,
    Sources,
    leftover_urls,
    missing_ids,
    resolution_report,
    resolve_waterfall,
    resolve_without_doi,
)
from litscore.operators.vectors import Encoder, HashTfIdf, embed
from litscore.schema import ARTICLE, ARTICLE_FIELDS
from litscore.session import materialise, scratch_scope
from litscore.sources.library import read_library_csv, write_library


class BuildReport(NamedTuple):
    """Rows of the export and how many of them had no title."""

    rows: int
    untitled: int


def embed_articles(df: DataFrame, encoder: HashTfIdf | Callable[[], Encoder]) -> DataFrame:
    """Articles with a title and their vectors, stored; no distances are computed.

    Each row gets an ``article_id``, fixed by writing it before it is used: rows of
    an export may be equal in every column and still count one by one. An encoder
    that is not fitted is fitted on these rows.
    """
    prepared = encoder_input(require_title(df))
    if isinstance(encoder, HashTfIdf) and encoder.idf is None:
        encoder.fit(prepared)
    embedded = embed(prepared, encoder).withColumn("article_id", F.monotonically_increasing_id())
    # the encoder's input is title and abstract once more, so it is made again when read
    return encoder_input(materialise(embedded.drop("input"), "embedded")).select(*embedded.columns)


def embed_library(
    df: DataFrame, encoder: HashTfIdf | Callable[[], Encoder], k: int = 5, n: int = 10
) -> DataFrame:
    """:func:`embed_articles`, calibrated by out-of-fold distances."""
    return cv_distances(embed_articles(df, encoder), k, n, id_col="article_id")


def encoder_path(library_path: str) -> str:
    """Where :func:`build_library` keeps the default encoder of a library."""
    return f"{library_path.rstrip('/')}.encoder"


def build_library(
    spark: SparkSession,
    csv_path: str,
    library_path: str,
    encoder: HashTfIdf | Callable[[], Encoder] | None = None,
    since: str | None = None,
) -> BuildReport:
    """Read an export, embed and calibrate it and write it as the library table.

    A :class:`HashTfIdf`, the default, is saved at :func:`encoder_path`, so that alerts
    can be embedded as the library was: ``HashTfIdf.load(encoder_path(library_path))``.
    """
    rows = read_library_csv(spark, csv_path)
    if since is not None:
        rows = filter_library_since(rows, since)
    kinds = {f.name: f.dataType for f in ARTICLE.fields}
    fields = [
        F.col(name) if kinds[name].simpleString() == "string" else F.expr(f"try_cast(`{name}` AS {kinds[name].simpleString()})").alias(name)
        for name in ARTICLE_FIELDS
        if name in rows.columns and name != "embedding"
    ]
    encoder = encoder or HashTfIdf()
    seen = Observation("library rows")
    with scratch_scope(spark):
        articles = materialise(
            rows.select(*fields).observe(
                seen,
                F.count(F.lit(1)).alias("rows"),
                F.count_if(F.col("title").isNull()).alias("untitled"),
            ),
            "export",
        )
        write_library(embed_library(articles, encoder), library_path)
    if isinstance(encoder, HashTfIdf):
        encoder.save(encoder_path(library_path))
    return BuildReport(**seen.get)


class ResolvedLibrary(NamedTuple):
    """Full records of a library export and what could not be found.

    ``articles`` has ``id`` (the DOI or the row's id) and ``stage`` (the source or
    the way it was found) before the article columns.
    """

    articles: DataFrame
    report: DataFrame
    missing: DataFrame
    leftover: DataFrame


def resolve_library(
    rows: DataFrame, sources: Sources, key: str = "lower", row_id: str = "row_id"
) -> ResolvedLibrary:
    """Resolve export rows: those with a DOI by ranked sources, the others by id or url."""
    with_doi, by_arxiv, by_url = split_by_id_kind(rows)
    wanted = materialise(with_doi.select(F.col("doi").alias("id")).distinct(), "wanted")
    found = materialise(resolve_waterfall(wanted, sources, key), "resolved")
    rest = resolve_without_doi(rows, sources, row_id)
    articles = found.drop("rank").unionByName(
        rest.withColumnsRenamed({"row_id": "id", "route": "stage"}).withColumn(
            "id", F.col("id").cast("string")
        )
    )
    return ResolvedLibrary(
        articles,
        resolution_report(wanted, found, DOI_STAGES, key),
        missing_ids(wanted, found).orderBy("id"),
        leftover_urls(rows, row_id),
    )


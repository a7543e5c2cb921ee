"""One query per operator; each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litscore import schema
from litscore.functions import text as text_functions
from litscore.operators import digest, extract, filters, folds, knn, normalise, pages, resolve
from litscore.operators.vectors import HashTfIdf, embed, hash_tfidf
from litscore.plans.alerts import score_messages
from litscore.plans.library import (
    build_library,
    embed_articles,
    embed_library,
    encoder_path,
    resolve_library,
)
from litscore.registry import inputs
from litscore.schema import ARTICLE_FIELDS
from litscore.session import materialise, scratch_path, send_by_value
from litscore.sources import (
    read_library,
    read_library_csv,
    read_messages,
    read_source_dump,
    write_digest,
    write_library,
)
from litscore.sources.digests import read_digest
from litscore.sources.store import SourceStore, land_sources
from litscore.streaming import redrive_unhandled, score_alert_stream, write_density

send_by_value(__name__)

Query = Callable[[SparkSession, str], DataFrame]

# Thresholds that part the given data; real vectors are much nearer to each other.
VECTOR_THRESHOLD = 0.73
TEXT_THRESHOLD = 0.35


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six decimals, as sums depend on their order."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- sources and sinks --------------------------------------------------------------


def library_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to a CSV export, scanned, written as a library and read again."""
    export = scratch_path(spark, "export")
    rows = inputs.articles(spark, sf_dir).withColumn(filters.CREATED, F.lit("2022-01-01"))
    (
        rows.write.option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(export)
    )
    stored = scratch_path(spark, "library")
    write_library(read_library_csv(spark, export), stored)
    return read_library(spark, stored)


def build_library_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of the liked documents, embedded, calibrated and written."""
    export, stored = scratch_path(spark, "export"), scratch_path(spark, "library")
    (
        inputs.liked(spark, sf_dir)
        .write.option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .csv(export)
    )
    build_library(spark, export, stored)
    return read_library(spark, stored).select("title", "abstract", "input")


def message_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = scratch_path(spark, "messages")
    inputs.messages(spark, sf_dir).write.parquet(landed)
    return read_messages(spark, landed).select("message_id", "uid", "sender", "subject")


def _xml_dump(kind: str, root: str, row: str) -> Query:
    """Records written as XML documents, scanned by their kind's reader."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, kind)
        records = XML_RECORDS[kind](inputs.table(spark, sf_dir, "documents"))
        (
            records.write.format("xml")
            .option("rootTag", root)
            .option("rowTag", row)
            .save(path)
        )
        return NORMALISERS[kind](read_source_dump(spark, kind, path)).drop("notes")

    return run


def _json_dump(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, kind)
        JSON_RECORDS[kind](inputs.table(spark, sf_dir, "documents")).write.json(path)
        return NORMALISERS[kind](read_source_dump(spark, kind, path)).drop("notes")

    return run


def pages_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages scanned as a dump and normalised."""
    path = scratch_path(spark, "pages")
    inputs.article_pages(spark, sf_dir).write.parquet(path)
    return pages.normalise_pages(read_source_dump(spark, "pages", path)).drop("notes")


def doi_redirect_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "redirects")
    inputs.sources(spark, sf_dir)["doi_redirect"].write.parquet(path)
    return read_source_dump(spark, "doi_redirect", path)


NORMALISERS = {
    "pubmed": normalise.normalise_pubmed,
    "arxiv": normalise.normalise_arxiv,
    "crossref": normalise.normalise_crossref,
    "s2": normalise.normalise_s2,
    "elsevier": normalise.normalise_elsevier,
}


def _name(given: str | None, family: str | None) -> Column:
    return F.struct(
        F.lit(given).cast("string").alias("given"), F.lit(family).cast("string").alias("family")
    )


def _pubmed_records(documents: DataFrame) -> DataFrame:
    def named(**fields: str) -> Column:
        return F.struct(
            *(F.lit(fields.get(n)).cast("string").alias(n) for n in ("ForeName", "LastName"))
        )

    def article_id(kind: str, value: str) -> Column:
        return F.struct(F.lit(kind).alias("_IdType"), F.expr(value).alias("_VALUE"))

    def section(label: str, value: str) -> Column:
        return F.struct(F.lit(label).alias("_Label"), F.expr(value).alias("_VALUE"))

    first = F.when(F.expr("doc_id % 3 = 0"), named(LastName="Poe")).otherwise(
        named(ForeName="Ada", LastName="Poe")
    )
    date = F.struct(
        F.expr(f"CASE WHEN doc_id % 11 <> 0 THEN {inputs.YEAR} END").alias("Year"),
        F.expr("CASE WHEN doc_id % 11 = 0 THEN '1998 Jan' END").alias("MedlineDate"),
    )
    article = F.struct(
        F.struct(
            F.struct(date.alias("PubDate")).alias("JournalIssue"), F.lit("The Journal").alias("Title")
        ).alias("Journal"),
        F.struct(
            F.expr(inputs.TITLE).alias("_VALUE"), F.lit(" in vivo").alias("i")
        ).alias("ArticleTitle"),
        F.struct(
            F.array(
                section("AIM", f"coalesce({inputs.ABSTRACT}, '') || ' end'"), section("REST", "'no'")
            ).alias("AbstractText")
        ).alias("Abstract"),
        F.when(
            F.expr("doc_id % 5 <> 0"),
            F.struct(F.array(first, named(ForeName="Bo", LastName="Li")).alias("Author")),
        ).alias("AuthorList"),
    )
    ids = F.array(
        article_id("pubmed", inputs.ID),
        F.when(F.expr("doc_id % 7 <> 0"), article_id("doi", f"'10.1/' || {inputs.ID}")),
    )
    return documents.select(
        F.struct(article.alias("Article")).alias("MedlineCitation"),
        F.struct(F.struct(F.array_compact(ids).alias("ArticleId")).alias("ArticleIdList")).alias(
            "PubmedData"
        ),
    )


def _arxiv_records(documents: DataFrame) -> DataFrame:
    def author(name: str) -> Column:
        return F.struct(F.lit(name).alias("name"))

    return documents.select(
        F.expr(
            "'http://arxiv.org/abs/' || CASE WHEN doc_id % 6 = 0 THEN 'math/' ELSE '2401.' END"
            f" || {inputs.ID} || 'v2'"
        ).alias("id"),
        F.expr(f"{inputs.YEAR} || '-05-01T00:00:00Z'").alias("published"),
        F.expr(inputs.TITLE).alias("title"),
        F.expr(f"' ' || coalesce({inputs.ABSTRACT}, 'none') || chr(10)").alias("summary"),
        F.when(F.expr("doc_id % 5 <> 0"), F.array(author("Ada Poe"), author("Bo Li"))).alias("author"),
    )


XML_RECORDS = {"pubmed": _pubmed_records, "arxiv": _arxiv_records}


def _crossref_records(documents: DataFrame) -> DataFrame:
    year = F.expr(f"CAST({inputs.YEAR} AS INT)")

    def date(y: Column) -> Column:
        return F.struct(F.array(F.array(y, F.lit(5))).alias("date-parts"))

    return documents.select(
        F.expr(inputs.DOI).alias("DOI"),
        F.when(F.expr("doc_id % 6 <> 0"), F.array(F.expr(inputs.TITLE), F.lit("no"))).alias("title"),
        F.expr(inputs.ABSTRACT).alias("abstract"),
        F.array(F.lit("The Journal")).alias("container-title"),
        F.when(
            F.expr("doc_id % 5 <> 0"), F.array(_name("Ada", "Poe"), _name(None, "Li"), _name("Bo", None))
        ).alias("author"),
        F.when(F.expr("doc_id % 2 = 0"), date(year)).alias("published-print"),
        F.when(F.expr("doc_id % 3 = 0"), date(year + 100)).alias("published-online"),
        F.struct(
            F.struct(F.concat(F.lit("https://x.example/"), F.expr(inputs.ID)).alias("URL")).alias("primary")
        ).alias("resource"),
    )


def _s2_records(documents: DataFrame) -> DataFrame:
    def author(name: str) -> Column:
        return F.struct(F.lit(name).alias("name"))

    return documents.select(
        F.concat(F.lit("h"), F.expr(inputs.ID)).alias("paperId"),
        F.map_filter(
            F.create_map(
                F.lit("DOI"),
                F.expr(inputs.DOI),
                F.lit("PubMed"),
                F.when(F.expr("doc_id % 3 = 0"), F.expr(inputs.ID)),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("externalIds"),
        F.expr(inputs.TITLE).alias("title"),
        F.expr(inputs.ABSTRACT).alias("abstract"),
        F.when(F.expr("doc_id % 4 <> 0"), F.struct(F.lit("The Journal").alias("name"))).alias("journal"),
        F.expr(f"CAST({inputs.YEAR} AS INT)").alias("year"),
        F.when(F.expr("doc_id % 5 <> 0"), F.array(author("Ada Poe"), author("Bo Li")))
        .otherwise(F.array().cast("array<struct<name:string>>"))
        .alias("authors"),
    )


def _elsevier_records(documents: DataFrame) -> DataFrame:
    def link(rel: str, href: Column) -> Column:
        return F.struct(F.lit(rel).alias("@rel"), href.alias("@href"))

    def author(name: str) -> Column:
        return F.struct(F.lit(name).alias("$"))

    here = F.concat(F.lit("https://www.sciencedirect.com/pii/S"), F.expr(inputs.ID))
    return documents.select(
        F.expr(inputs.ID).alias("pubmed-id"),
        F.struct(
            F.expr(inputs.DOI).alias("prism:doi"),
            F.array(link("self", F.lit("https://no.example")), link("scidir", here)).alias("link"),
            F.expr(inputs.TITLE).alias("dc:title"),
            F.expr(f"chr(10) || '  ' || {inputs.ABSTRACT} || ' '").alias("dc:description"),
            F.lit("The Journal").alias("prism:publicationName"),
            F.expr(f"{inputs.YEAR} || '-02-01'").alias("prism:coverDate"),
            F.array(author("Poe, A."), author("Li, B.")).alias("dc:creator"),
        ).alias("coredata"),
    )


JSON_RECORDS = {
    "crossref": _crossref_records,
    "s2": _s2_records,
    "elsevier": _elsevier_records,
}


def digest_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three batches, one of them written twice, one written and then emptied."""
    out = scratch_path(spark, "digest")
    scored = materialise(_scored_vectors(spark, sf_dir).select("message_id", "distance"), "scored")
    for batch, rows in (("a", scored.filter("message_id % 2 = 0")), ("b", scored.filter("message_id % 2 = 1"))):
        write_digest(rows, out, batch)
    write_digest(scored.filter("message_id % 2 = 1"), out, "b")
    write_digest(scored, out, "c")
    write_digest(scored.filter("message_id < 0"), out, "c")
    stored = read_digest(spark, out, "message_id BIGINT, distance DOUBLE")
    return stored.groupBy("batch").agg(
        F.count("*").alias("n"), F.round(F.sum("distance"), 6).alias("distance")
    )


# --- projections and filters --------------------------------------------------------


def _dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias(filters.CREATED)
    return inputs.table(spark, sf_dir, "orders").select("o_orderkey", day)


def _since(inclusive: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = filters.filter_library_since(_dated_orders(spark, sf_dir), "1998-06-15", inclusive)
        return rows.withColumnRenamed(filters.CREATED, "created")

    return run


def require_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.require_title(inputs.gapped_articles(spark, sf_dir)).select("doc_id", "title")


def require_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.require_complete(inputs.gapped_articles(spark, sf_dir)).select("doc_id", "title")


def split_by_id_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_doi, by_arxiv, by_url = filters.split_by_id_kind(inputs.library_rows(spark, sf_dir))
    return (
        with_doi.select("row_id", F.lit("doi").alias("kind"))
        .unionByName(by_arxiv.select("row_id", F.lit("arxiv").alias("kind")))
        .unionByName(by_url.select("row_id", F.lit("url").alias("kind")))
    )


def encoder_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.encoder_input(inputs.articles(spark, sf_dir)).select("doc_id", "abstract", "input")


def drop_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_vectors(inputs.table(spark, sf_dir, "embeddings"))


# --- messages -----------------------------------------------------------------------


def _on_messages(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(inputs.messages(spark, sf_dir))


def route_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.route_messages(inputs.messages(spark, sf_dir)).select("message_id", "route")


# --- normalisation and scalar functions ---------------------------------------------


def normalise_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.normalise_pages(inputs.article_pages(spark, sf_dir)).drop("notes")


def usable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.normalise_pages(inputs.article_pages(spark, sf_dir))
    return pages.usable_pages(found.withColumn("abstract", F.nullif("abstract", F.lit("")))).select("page_id")


def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (pages.Rule("*", "title", "title"), pages.Rule("*", "h1", "h1"))
    df = inputs.table(spark, sf_dir, "pages").withColumn("publisher", F.lit("any"))
    return pages.page_fields(df, rules).select("page_id", "title", "h1")


def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records of events: first scalars, leading years."""
    record = F.from_json("props", "k INT")
    nested = F.array(F.array(record["k"], F.lit(-1)), F.array(F.lit(-2)))
    return inputs.table(spark, sf_dir, "events").select(
        "event_id",
        text_functions.first_simple(nested, 2).alias("k"),
        text_functions.year_of(F.date_format("ts", "yyyy-MM-dd")).alias("year"),
        text_functions.year_before_dash(F.date_format("ts", "yyyy-MM")).alias("year_dash"),
        text_functions.year_of(F.col("event_type")).alias("no_year"),
    )


def unwrap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit(" \n"), F.col("text"), F.lit("\n\n end \n"))
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id",
        text_functions.clean_text(padded).alias("cleaned"),
        text_functions.unwrap_text(padded).alias("unwrapped"),
    )


def article_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.gapped_articles(spark, sf_dir).select("doc_id", text_functions.article_url().alias("url"))


# --- resolution ---------------------------------------------------------------------

_SHOWN = ("doi", "title", "journal", "year")


def _waterfall(key: str = "lower", stages=resolve.DOI_STAGES) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = resolve.resolve_waterfall(
            inputs.wanted(spark, sf_dir), inputs.sources(spark, sf_dir), key, stages
        )
        return found.select("id", "stage", "rank", *_SHOWN)

    return run


def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = inputs.wanted(spark, sf_dir)
    return resolve.missing_ids(wanted, resolve.resolve_waterfall(wanted, inputs.sources(spark, sf_dir)))


def resolution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = inputs.wanted(spark, sf_dir)
    found = resolve.resolve_waterfall(wanted, inputs.sources(spark, sf_dir))
    return resolve.resolution_report(wanted, found)


def resolve_without_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.resolve_without_doi(
        inputs.library_rows(spark, sf_dir), inputs.sources(spark, sf_dir)
    )
    return found.select("row_id", "route", *_SHOWN)


def leftover_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.leftover_urls(inputs.library_rows(spark, sf_dir))


def _message_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(extract.extract_article_ids(inputs.messages(spark, sf_dir)), "ids")


def resolve_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _message_ids(spark, sf_dir)
    found = resolve.resolve_by_type(ids, inputs.sources(spark, sf_dir))
    return found.select("id_type", "id", "stage", *_SHOWN)


def _landed_store(spark: SparkSession, sf_dir: str) -> SourceStore:
    """The sources of the tables, landed once into a keyed store."""
    path = scratch_path(spark, "source_store")
    land_sources(inputs.sources(spark, sf_dir), path)
    return SourceStore(spark, path)


def resolve_by_type_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``resolve_by_type`` through the keyed store: only the buckets of the wanted keys are read."""
    ids = _message_ids(spark, sf_dir)
    found = resolve.resolve_by_type(ids, _landed_store(spark, sf_dir))
    return found.select("id_type", "id", "stage", *_SHOWN)


def unresolved_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _message_ids(spark, sf_dir)
    return resolve.unresolved_ids(ids, resolve.resolve_by_type(ids, inputs.sources(spark, sf_dir)))


def resolve_library_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a whole export was resolved: rows per stage, missing and left over."""
    found = resolve_library(inputs.library_rows(spark, sf_dir), inputs.sources(spark, sf_dir))
    counted = found.articles.groupBy("stage").agg(F.count("*").alias("n"))
    others = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
        for name, df in (("missing", found.missing), ("leftover", found.leftover))
    ]
    return counted.unionByName(others[0]).unionByName(others[1])


# --- vectors and distances ----------------------------------------------------------


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "embeddings").filter("label < 5")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "embeddings").filter("label >= 5")


_IDS = {"query_id": "vec_id", "library_id": "vec_id"}


def hash_tfidf_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.encoder_input(inputs.articles(spark, sf_dir)).select("doc_id", "input")
    pairs = F.transform(
        "embedding", lambda w, i: F.struct(i.alias("bucket"), F.round(w, 6).alias("weight"), w.alias("exact"))
    )
    # exploding an expression, as Spark pushes a size filter down for a bare column
    entries = F.explode(F.filter(pairs, lambda e: e["exact"] != 0)).alias("e")
    return (
        hash_tfidf(rows, dtype="float64")
        .select("doc_id", entries)
        .select("doc_id", "e.bucket", "e.weight")
    )


def length_encoder():
    """A stand-in for a model: characters, lines and full stops of a text."""

    def encode(texts):
        return np.array([[len(t), t.count("\n"), t.count(".")] for t in texts], dtype=np.float32)

    return encode


def embed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.encoder_input(inputs.articles(spark, sf_dir))
    vector = F.col("embedding")
    return embed(rows, length_encoder).select(
        "doc_id",
        *(vector[i].cast("int").alias(n) for i, n in enumerate(("chars", "breaks", "stops"))),
    )


def knn_mean_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = knn.knn_mean_distance(_candidates(spark, sf_dir), _library(spark, sf_dir), **_IDS)
    return rounded(scored, "distance")


def knn_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = knn.knn_mean_distance(
        _candidates(spark, sf_dir), _library(spark, sf_dir), blocks=(2, 3), **_IDS
    )
    return rounded(scored, "distance")


def knn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = knn.knn_neighbours(_candidates(spark, sf_dir), _library(spark, sf_dir), **_IDS)
    return rounded(near, "distance")


def _knn_ties(blocks: tuple[int, int] | None) -> Query:
    """Neighbours in a library that holds every vector three times, under other ids."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        copy = F.explode(F.array(*(F.lit(n * 10_000_000) for n in range(3))))
        library = _library(spark, sf_dir).select("vec_id", "embedding", copy.alias("copy"))
        library = library.select((F.col("vec_id") + F.col("copy")).alias("vec_id"), "embedding")
        return rounded(knn.knn_neighbours(_candidates(spark, sf_dir), library, blocks=blocks, **_IDS), "distance")

    return run


def match_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = knn.knn_mean_distance(_candidates(spark, sf_dir), _library(spark, sf_dir), **_IDS)
    return rounded(filters.match_filter(scored, VECTOR_THRESHOLD), "distance")


def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "embeddings").select("vec_id")
    return folds.kfold(rows, id_col="vec_id")


def cv_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "embeddings")
    scored = folds.cv_distances(rows, id_col="vec_id").drop("embedding")
    return rounded(scored, "cv_distance")


# --- digest -------------------------------------------------------------------------


def _scored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored vectors with the text of the document of the same number.

    Eight vectors in a row are the articles of a message.
    """
    candidates = _candidates(spark, sf_dir)
    scored = knn.knn_mean_distance(candidates, _library(spark, sf_dir), **_IDS)
    text = inputs.table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS vec_id",
        f"CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {inputs.DOI} END AS doi",
        f"'2401.' || {inputs.ID} AS arxiv",
        f"{inputs.TITLE} AS title",
        "CASE WHEN doc_id % 4 <> 0 THEN 'Ada Poe' END AS authors",
        "CASE doc_id % 3 WHEN 0 THEN 'arXiv' WHEN 1 THEN 'R & D' END AS journal",
    )
    return (
        candidates.select("vec_id", F.expr("vec_id div 8").alias("message_id"), "embedding")
        .join(scored.withColumnRenamed("query_id", "vec_id"), "vec_id")
        .join(text, "vec_id", "left")
    )


def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digest.match_summary(_scored_vectors(spark, sf_dir), VECTOR_THRESHOLD)
    return rounded(found, "percent")


def digest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digest.digest_rows(_scored_vectors(spark, sf_dir), VECTOR_THRESHOLD)
    return rounded(found, "distance")


def distance_rug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(digest.distance_rug(_scored_vectors(spark, sf_dir), VECTOR_THRESHOLD), "distance")


def digest_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.digest_html(_scored_vectors(spark, sf_dir), VECTOR_THRESHOLD)


def fold_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of the out-of-fold distances of all vectors."""
    scores = materialise(folds.cv_scores(inputs.table(spark, sf_dir, "embeddings"), id_col="vec_id"), "scores")
    return rounded(digest.fold_density(scores), "x", "density")


def value_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same curves over a larger table: event values by type."""
    events = inputs.table(spark, sf_dir, "events")
    return rounded(digest.fold_density(events, "value", "event_type"), "x", "density")


# --- whole jobs ---------------------------------------------------------------------

_SCORED = ("message_id", "id_type", "id", "title", "distance")


def _text_library(spark: SparkSession, sf_dir: str) -> tuple[HashTfIdf, DataFrame]:
    """The liked documents with their vectors, stored; not calibrated."""
    encoder = HashTfIdf()
    return encoder, embed_articles(inputs.liked(spark, sf_dir).drop("doc_id"), encoder)


def calibrated_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The liked documents embedded, with the sizes of their folds."""
    library = embed_library(inputs.liked(spark, sf_dir).drop("doc_id"), HashTfIdf())
    return library.groupBy("cv_fold").agg(F.count("*").alias("n"))


def score_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages against the liked documents, from message body to distance."""
    encoder, library = _text_library(spark, sf_dir)
    found = score_messages(
        inputs.messages(spark, sf_dir), library, inputs.sources(spark, sf_dir), encoder
    )
    return rounded(found.scored.select(*_SCORED), "distance")


def unhandled_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of :func:`score_alerts` that stay in the queue, with the reason."""
    messages, sources = inputs.messages(spark, sf_dir), inputs.sources(spark, sf_dir)
    return score_messages(messages, None, sources, None, scored_too=False).unhandled


def _landed(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "messages")
    inputs.messages(spark, sf_dir).write.option("compression", "zstd").parquet(path)
    return path


def _stream(spark: SparkSession, sf_dir: str, library: DataFrame, encoder: HashTfIdf) -> str:
    """All messages as a stream of files; the folder of its digests."""
    out = scratch_path(spark, "digests")
    run = score_alert_stream(
        spark,
        _landed(spark, sf_dir),
        library,
        inputs.sources(spark, sf_dir),
        out,
        scratch_path(spark, "stream"),
        encoder,
        TEXT_THRESHOLD,
    )
    run.awaitTermination()
    return out


def score_alert_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages as a stream of files, through to the digest sink."""
    encoder, library = _text_library(spark, sf_dir)
    out = _stream(spark, sf_dir, library, encoder)
    return rounded(read_digest(spark, f"{out}/scored").select(*_SCORED), "distance")


def score_alert_stream_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of messages resolved through the keyed store of landed sources."""
    encoder, library = _text_library(spark, sf_dir)
    out = scratch_path(spark, "digests")
    run = score_alert_stream(
        spark, _landed(spark, sf_dir), library, _landed_store(spark, sf_dir), out,
        scratch_path(spark, "stream"), encoder, TEXT_THRESHOLD,
    )
    run.awaitTermination()
    return rounded(read_digest(spark, f"{out}/scored").select(*_SCORED), "distance")


def stream_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curves that the stream writes beside its digests, here of event values by type."""
    events = inputs.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("cv_fold"), F.col("value").alias("cv_distance")
    )
    out = scratch_path(spark, "digests")
    write_density(events, out)
    found = spark.read.parquet(f"{out}/density").withColumnRenamed("cv_fold", "event_type")
    return rounded(found, "x", "density")


def redriven_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that a stream without sources left over, scored after the sources have landed."""
    encoder, library = _text_library(spark, sf_dir)
    landed, out = _landed(spark, sf_dir), scratch_path(spark, "digests")
    run = score_alert_stream(
        spark, landed, library, {}, out, scratch_path(spark, "stream"), encoder, TEXT_THRESHOLD
    )
    run.awaitTermination()
    sources = inputs.sources(spark, sf_dir)
    redrive_unhandled(spark, landed, library, sources, out, "later", encoder, TEXT_THRESHOLD)
    return rounded(read_digest(spark, f"{out}/scored").select(*_SCORED), "distance")


def default_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts embedded by the encoder that a built library keeps, reloaded, and scored against it."""
    export, stored = scratch_path(spark, "export"), scratch_path(spark, "library")
    rows = inputs.liked(spark, sf_dir).withColumn("year", F.lit("1999"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(export)
    build_library(spark, export, stored)
    library, encoder = read_library(spark, stored), HashTfIdf.load(encoder_path(stored))
    found = score_messages(inputs.messages(spark, sf_dir), library, inputs.sources(spark, sf_dir), encoder)
    return rounded(found.scored.select(*_SCORED), "distance")


def queries() -> dict[str, Query]:
    """All queries by name."""
    return {
        "library_round_trip": library_round_trip,
        "build_library": build_library_query,
        "message_queue": message_queue,
        "digest_sink": digest_sink,
        "filter_since": _since(True),
        "filter_after": _since(False),
        "require_title": require_title,
        "require_complete": require_complete,
        "match_filter": match_filter,
        "split_by_id_kind": split_by_id_kind,
        "encoder_input": encoder_input,
        "drop_vectors": drop_vectors,
        "route_messages": route_messages,
        "message_links": _on_messages(extract.message_links),
        "biorxiv_urls": _on_messages(extract.biorxiv_urls),
        "arxiv_ids": _on_messages(extract.arxiv_ids),
        "pubmed_pmids": _on_messages(extract.pubmed_pmids),
        "nature_alert_dois": _on_messages(extract.nature_alert_dois),
        "nature_ealert_dois": _on_messages(extract.nature_ealert_dois),
        "s2_ids": _on_messages(extract.s2_ids),
        "science_urls": _on_messages(extract.science_urls),
        "extract_article_ids": _on_messages(extract.extract_article_ids),
        "unhandled_messages": _on_messages(extract.unhandled_messages),
        "normalise_pubmed": _xml_dump("pubmed", "PubmedArticleSet", "PubmedArticle"),
        "normalise_arxiv": _xml_dump("arxiv", "feed", "entry"),
        "normalise_crossref": _json_dump("crossref"),
        "normalise_s2": _json_dump("s2"),
        "normalise_elsevier": _json_dump("elsevier"),
        "pages_dump": pages_dump,
        "doi_redirect_dump": doi_redirect_dump,
        "normalise_pages": normalise_pages,
        "usable_pages": usable_pages,
        "page_fields": page_fields,
        "unwrap_text": unwrap_text,
        "nested_json": nested_json,
        "article_url": article_url,
        "resolve_waterfall": _waterfall(),
        "resolve_waterfall_exact": _waterfall("exact"),
        "resolve_waterfall_nature": _waterfall("lower", resolve.NATURE_STAGES),
        "missing_ids": missing_ids,
        "resolve_without_doi": resolve_without_doi,
        "leftover_urls": leftover_urls,
        "resolution_report": resolution_report,
        "resolve_by_type": resolve_by_type,
        "resolve_by_type_stored": resolve_by_type_stored,
        "unresolved_ids": unresolved_ids,
        "resolve_library": resolve_library_query,
        "hash_tfidf": hash_tfidf_query,
        "embed": embed_query,
        "knn_mean_distance": knn_mean_distance,
        "knn_grid": knn_grid,
        "knn_neighbours": knn_neighbours,
        "knn_ties": _knn_ties(None),
        "knn_ties_grid": _knn_ties((2, 3)),
        "kfold": kfold,
        "cv_distances": cv_distances,
        "match_summary": match_summary,
        "digest_rows": digest_rows,
        "distance_rug": distance_rug,
        "fold_density": fold_density,
        "value_density": value_density,
        "digest_html": digest_html,
        "calibrated_library": calibrated_library,
        "score_alerts": score_alerts,
        "unhandled_alerts": unhandled_alerts,
        "score_alert_stream": score_alert_stream_query,
        "score_alert_stream_stored": score_alert_stream_stored,
        "stream_density": stream_density,
        "redriven_alerts": redriven_alerts,
        "default_encoder": default_encoder,
    }

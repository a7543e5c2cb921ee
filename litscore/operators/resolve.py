"""Identifiers to articles through ranked sources.

``sources`` maps a kind to its article rows: ``s2``, ``crossref``, ``arxiv``,
``elsevier``, ``pubmed``, ``pages`` (with ``url`` and ``publisher``) and
``doi_redirect`` (``doi``, ``url``). A kind that is absent is an empty source.

All resolvers share one shape. A source is scanned once and its records are keyed by
what they can be asked for, pages of all publishers together; records whose key is not
wanted go first, by a broadcast of the wanted keys if these are few, and if not by
broadcast bits of them and a shuffled semi-join; of the others one per key is kept, the first by rank and then by its
ids. A key that many records share is thinned before the shuffle (a row number limit
runs on both sides of the exchange). A page that lacks what its publisher's record needs
gives no article.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscore.functions.text import last_segment
from litscore.operators.joins import first_rows, join_unique, only_wanted
from litscore.operators.normalise import ARXIV_URL
from litscore.operators.pages import usable_pages
from litscore.schema import ARTICLE_FIELDS
from litscore.session import materialise

Sources = Mapping[str, DataFrame]

OPENREVIEW_FORUM = "https://openreview.net/forum?id="
ARXIV_ABSTRACT = "https://arxiv.org/abs/"


class Stage(NamedTuple):
    """A ranked source of the waterfall: whom it serves and what it may serve."""

    name: str
    prefix: str = ""
    complete: bool = False


# The order of the sources and the DOI prefixes they are limited to.
DOI_STAGES = (
    Stage("s2", complete=True),
    Stage("crossref", complete=True),
    Stage("nature", prefix="10.1038/"),
    Stage("arxiv", prefix="10.48550/arxiv"),
    Stage("elsevier", prefix="10.1016/"),
)
NATURE_STAGES = (
    Stage("s2", complete=True),
    Stage("crossref", complete=True),
    Stage("nature"),
)


def without_version(arxiv: Column) -> Column:
    """An arXiv id without its version."""
    return F.regexp_replace(F.trim(arxiv), r"v[0-9]+$", "")


def doi_key(doi: Column, key: str = "lower") -> Column:
    """What DOIs are compared by.

    ``exact`` compares them as they are. ``lower`` ignores case, and the version of
    an arXiv DOI.
    """
    if key == "exact":
        return doi
    if key != "lower":
        raise ValueError("key is 'lower' or 'exact'")
    lowered = F.lower(doi)
    return F.when(
        lowered.startswith("10.48550/arxiv."), F.regexp_replace(lowered, r"v[0-9]+$", "")
    ).otherwise(lowered)


def https_url(url: Column) -> Column:
    """The https form of a url."""
    return F.regexp_replace(url, r"^http://", "https://")


def _articles(df: DataFrame) -> DataFrame:
    return df.select(*ARTICLE_FIELDS)


def _complete() -> Column:
    return F.col("title").isNotNull() & F.col("abstract").isNotNull()


def _empty(wanted: DataFrame, *columns: str) -> DataFrame:
    fields = ", ".join(f"{c} {'INT' if c in ('year', 'rank') else 'STRING'}" for c in columns)
    return wanted.sparkSession.createDataFrame([], fields)


_KEYED = ("id_type", "key", "rank", "stage")


def _keyed(records: DataFrame, *keys: tuple[str, Column, int, str, Column]) -> DataFrame:
    """Records once per key they can be asked for: id type, key, rank, stage, gate."""
    entries = F.array(
        *(
            F.when(
                gate & key.isNotNull(),
                F.struct(
                    F.lit(kind).alias("id_type"),
                    key.alias("key"),
                    F.lit(rank).alias("rank"),
                    F.lit(stage).alias("stage"),
                ),
            )
            for kind, key, rank, stage, gate in keys
        )
    )
    return (
        records.withColumn("_entry", F.explode(F.filter(entries, lambda e: e.isNotNull())))
        .select(*(F.col(f"_entry.{name}").alias(name) for name in _KEYED), *ARTICLE_FIELDS)
    )


def _first_record(candidates: Sequence[DataFrame], wanted_keys: DataFrame) -> DataFrame:
    """The first record of each wanted ``(id_type, key)`` by rank, then by its ids."""
    on = ["id_type", "key"]
    pool = only_wanted(reduce(DataFrame.unionByName, candidates), wanted_keys, on)
    return first_rows(pool, on, ["rank", *ARTICLE_FIELDS])


def _doi_keys(
    sources: Sources, stages: Sequence[Stage], key: str, id_type: str, wanted_keys: DataFrame
) -> list[tuple[str, DataFrame, tuple[str, Column, int, str, Column]]]:
    """The records that serve DOIs, with how they are keyed."""
    found = []
    for rank, stage in enumerate(stages, 1):
        records, by = sources.get(stage.name), F.col("doi")
        of_pages = stage.name == "nature" and "pages" in sources
        if of_pages:
            records = usable_pages(sources["pages"])
        elif stage.name == "elsevier":
            records, by = _elsevier_by_doi(sources, stage.prefix, key, wanted_keys), F.col("wanted_doi")
        if records is None:
            continue
        by = doi_key(by, key)
        gate = _complete() if stage.complete else F.lit(True)
        if of_pages:
            gate = gate & (F.col("publisher") == "nature")
        if stage.prefix:
            gate = gate & by.startswith(stage.prefix)
        name = "pages" if of_pages else stage.name
        found.append((name, records, (id_type, by, rank, stage.name, gate)))
    return found


def _elsevier_by_doi(
    sources: Sources, prefix: str, key: str, wanted_keys: DataFrame
) -> DataFrame | None:
    """Elsevier records by the wanted DOI whose redirect ends in their publisher item id.

    Redirects are cut to wanted DOIs first and records to the items these lead to, so
    nothing else is shuffled.
    """
    if "elsevier" not in sources or "doi_redirect" not in sources:
        return None
    by = doi_key(F.col("doi"), key)
    asked = only_wanted(
        sources["doi_redirect"].filter(by.startswith(prefix)).withColumn("key", by),
        wanted_keys.select("key").distinct(),
        ["key"],
    )
    redirects = asked.select(
        F.col("doi").alias("wanted_doi"), last_segment(F.col("url")).alias("pii")
    ).distinct()
    records = _articles(sources["elsevier"]).withColumn(
        "pii", last_segment(F.col("publisher_url"))
    )
    items = redirects.select("pii").filter(F.col("pii").isNotNull()).distinct()
    records = first_rows(only_wanted(records, items, ["pii"]), ["pii"], [*ARTICLE_FIELDS])
    joined = records.join(redirects, "pii")
    return joined.filter(F.col("doi") == F.col("wanted_doi")) if key == "exact" else joined


def resolve_waterfall(
    wanted: DataFrame,
    sources: Sources,
    key: str = "lower",
    stages: Sequence[Stage] = DOI_STAGES,
) -> DataFrame:
    """``(id, stage, rank)`` and the article of each DOI in ``wanted.id`` that has one.

    The article is the first acceptable record by the rank of its source. ``stages``
    is :data:`DOI_STAGES`, or :data:`NATURE_STAGES` for the shorter way of Nature
    alerts. One row per wanted DOI; give a stored table, as it is read twice.
    """
    ids = wanted.select("id").distinct().withColumn("key", doi_key(F.col("id"), key))
    keys = ids.select(F.lit("doi").alias("id_type"), "key").distinct()
    candidates = [
        _keyed(records, entry) for _, records, entry in _doi_keys(sources, stages, key, "doi", keys)
    ]
    if not candidates:
        return _empty(wanted, "id", "stage", "rank", *ARTICLE_FIELDS)
    first = _first_record(candidates, keys).drop("id_type")
    return ids.join(first, "key").select("id", "stage", "rank", *ARTICLE_FIELDS)


def missing_ids(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """The distinct ids of ``wanted`` that ``found`` lacks."""
    return wanted.select("id").distinct().join(found.select("id").distinct(), "id", "left_anti")


ROW_ROUTES = ("arxiv_id", "arxiv_url", "openreview_url")


def url_route(url: Column) -> Column:
    """How a url without a DOI is looked up; null if it is not."""
    return F.when(url.startswith(ARXIV_ABSTRACT), "arxiv_url").when(
        url.startswith(OPENREVIEW_FORUM), "openreview_url"
    )


def _row_lookups(rows: DataFrame, row_id: str) -> DataFrame:
    url, found = F.col("url"), F.regexp_extract("url", ARXIV_URL, 1)
    route = url_route(url)
    key = F.when(route == "arxiv_url", F.when(found != "", found)).otherwise(url)
    by_url = F.when(
        route.isNotNull() & key.isNotNull(),
        F.struct(
            route.alias("route"),
            F.when(route == "arxiv_url", "arxiv").otherwise("openreview").alias("id_type"),
            key.alias("key"),
        ),
    )
    by_id = F.when(
        F.col("arxiv").isNotNull(),
        F.struct(
            F.lit("arxiv_id").alias("route"),
            F.lit("arxiv").alias("id_type"),
            without_version(F.col("arxiv")).alias("key"),
        ),
    )
    return (
        rows.filter(F.col("doi").isNull())
        .select(
            F.col(row_id).alias("row_id"),
            F.explode(F.filter(F.array(by_id, by_url), lambda x: x.isNotNull())).alias("l"),
        )
        .select("row_id", "l.*")
    )


def resolve_without_doi(rows: DataFrame, sources: Sources, row_id: str = "row_id") -> DataFrame:
    """``(row_id, route)`` and the article of library rows that have no DOI.

    By arXiv id and by url; a row found both ways is there twice, as results are
    appended. ``rows`` has ``doi``, ``arxiv`` and ``url`` and is a stored table.
    """
    lookups = _row_lookups(rows, row_id)
    candidates = []
    if "arxiv" in sources:
        by = without_version(F.col("arxiv"))
        candidates.append(_keyed(sources["arxiv"], ("arxiv", by, 1, "arxiv", F.lit(True))))
    if "pages" in sources:
        gate = F.col("publisher") == "openreview"
        entry = ("openreview", F.col("url"), 1, "openreview", gate)
        candidates.append(_keyed(usable_pages(sources["pages"]), entry))
    if not candidates:
        return _empty(rows, "row_id", "route", *ARTICLE_FIELDS)
    first = materialise(
        _first_record(candidates, lookups.select("id_type", "key").distinct()), "records"
    )
    found = join_unique(lookups, first, ["id_type", "key"])
    return found.select("row_id", "route", *ARTICLE_FIELDS)


def leftover_urls(rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``(row_id, url)`` of rows without a DOI whose url no source serves."""
    return rows.filter(
        F.col("doi").isNull() & F.col("url").isNotNull() & url_route(F.col("url")).isNull()
    ).select(F.col(row_id).alias("row_id"), "url")


def by_type_key(id_type: Column, id_: Column, key: str = "lower") -> Column:
    """What an id of a message is looked up by, given its type."""
    doi = id_type == "nature_doi"
    url = id_type.isin("biorxiv_url", "science_url")
    return (
        F.when(doi, doi_key(id_, key))
        .when(url, https_url(id_))
        .when(id_type == "arxiv", without_version(id_))
        .otherwise(id_)
    )


def by_type_candidates(sources: Sources, key: str = "lower") -> list[DataFrame]:
    """Records of all sources once per ``(id_type, key)`` a message id can ask them by, with rank and stage.

    Needs no wanted keys: the stages of Nature DOIs have no Elsevier lookup.
    """
    always = F.lit(True)
    entries: dict[str, list] = {}
    records: dict[str, DataFrame] = {}
    for name, df, entry in _doi_keys(sources, NATURE_STAGES, key, "nature_doi", None):
        records[name] = df
        entries.setdefault(name, []).append(entry)

    def add(
        name: str, df: DataFrame | None, id_type: str, by: Column, stage: str = "", gate: Column = always
    ) -> None:
        if df is not None:
            records.setdefault(name, df)
            entries.setdefault(name, []).append((id_type, by, 1, stage or name, gate))

    add("s2", sources.get("s2"), "s2", F.col("semantic_scholar"))
    add("pubmed", sources.get("pubmed"), "pmid", F.col("pmid"))
    add("arxiv", sources.get("arxiv"), "arxiv", without_version(F.col("arxiv")))
    if "pages" in sources:
        for publisher in ("biorxiv", "science"):
            gate = F.col("publisher") == publisher
            url = https_url(F.col("url"))
            add("pages", usable_pages(sources["pages"]), f"{publisher}_url", url, publisher, gate)
    return [_keyed(df, *entries[name]) for name, df in records.items()]


def resolve_by_type(ids: DataFrame, sources: Sources, key: str = "lower") -> DataFrame:
    """``(id_type, id, stage)`` and the article of each distinct id that has one.

    ``ids`` are those of the messages (``id_type``, ``id``) and a stored table. An id
    is looked up once however many messages hold it. ``sources`` may also be a keyed
    store of landed sources (:class:`litscore.sources.store.SourceStore`), which reads
    only the buckets of the wanted keys.
    """
    wanted = ids.select("id_type", "id").distinct().withColumn(
        "key", by_type_key(F.col("id_type"), F.col("id"), key)
    )
    keys = wanted.select("id_type", "key").distinct()
    if hasattr(sources, "first_records"):
        first = sources.first_records(keys)
    else:
        candidates = by_type_candidates(sources, key)
        if not candidates:
            return _empty(ids, "id_type", "id", "stage", *ARTICLE_FIELDS)
        first = _first_record(candidates, keys)
    return wanted.join(first, ["id_type", "key"]).select(
        "id_type", "id", "stage", *ARTICLE_FIELDS
    )


def unresolved_ids(ids: DataFrame, resolved: DataFrame) -> DataFrame:
    """The distinct ``(id_type, id)`` of ``ids`` that were not resolved."""
    on = ["id_type", "id"]
    return ids.select(*on).distinct().join(resolved.select(*on).distinct(), on, "left_anti")


def resolution_report(
    wanted: DataFrame,
    resolved: DataFrame,
    stages: Sequence[Stage] = DOI_STAGES,
    key: str = "lower",
) -> DataFrame:
    """``(stage, attempted, loaded)``: one row per stage and one, ``total``, for all.

    A stage attempts what it serves and no stage before it loaded. What ``total``
    attempted and did not load is missing; :func:`missing_ids` lists it.
    """
    by = doi_key(F.col("id"), key)
    last = len(stages) + 1
    rank = F.coalesce(F.col("rank"), F.lit(last))
    tried = [
        F.struct(
            F.lit(stage.name).alias("stage"),
            (by.startswith(stage.prefix) & (rank >= n)).alias("attempted"),
            (rank == n).alias("loaded"),
        )
        for n, stage in enumerate(stages, 1)
    ]
    total = F.struct(
        F.lit("total").alias("stage"), F.lit(True).alias("attempted"), (rank < last).alias("loaded")
    )
    return (
        wanted.select("id")
        .distinct()
        .join(resolved.select("id", "rank"), "id", "left")
        .select(F.explode(F.array(*tried, total)).alias("t"))
        .groupBy("t.stage")
        .agg(
            F.count_if("t.attempted").alias("attempted"),
            F.count_if("t.loaded").alias("loaded"),
        )
    )

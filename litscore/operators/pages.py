"""Publisher pages to article rows, by a table of rules.

All rules are expressions over one page, so four publishers cost one narrow scan:
no tag is exploded into rows and no page is shuffled to be put together again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscore.functions.html import (
    element_bodies,
    element_body,
    open_tags,
    raw_attribute,
    strip_noise,
    text_of,
    unescape,
)
from litscore.functions.text import clean_text, year_before_dash
from litscore.operators.normalise import to_articles
from litscore.schema import ARTICLE_FIELDS


class Rule(NamedTuple):
    """Where a page of ``publisher`` holds ``field``.

    ``tag`` with ``attr`` equal to ``value`` (for a class: holding it), compared
    without case if ``ci``; taken is the text of the element or, for ``meta`` and
    ``link``, their content or target. ``multi`` takes all of them, joined.
    """

    publisher: str
    field: str
    tag: str
    attr: str | None = None
    value: str | None = None
    ci: bool = False
    multi: bool = False


# Where each publisher puts the fields of an article.
PAGE_RULES = (
    Rule("openreview", "publisher_url", "meta", "name", "citation_pdf_url"),
    Rule("openreview", "title", "meta", "name", "citation_title"),
    Rule("openreview", "abstract", "meta", "name", "citation_abstract"),
    Rule("openreview", "authors", "meta", "name", "citation_author", multi=True),
    Rule("openreview", "year", "meta", "name", "citation_online_date"),
    Rule("openreview", "journal", "meta", "name", "citation_conference_title"),
    Rule("biorxiv", "publisher_url", "meta", "name", "citation_public_url"),
    Rule("biorxiv", "doi", "meta", "name", "citation_doi"),
    Rule("biorxiv", "year", "meta", "name", "article:published_time"),
    Rule("biorxiv", "title", "h1", "id", "page-title"),
    Rule("biorxiv", "abstract", "div", "class", "abstract"),
    Rule("biorxiv", "authors", "div", "class", "highwire-cite-authors", multi=True),
    Rule("nature", "doi", "meta", "name", "citation_doi", ci=True),
    Rule("nature", "publisher_url", "link", "rel", "canonical", ci=True),
    Rule("nature", "title", "meta", "name", "dc.title", ci=True),
    Rule("nature", "abstract", "meta", "name", "dc.description", ci=True),
    Rule("nature", "journal", "meta", "name", "citation_journal_title", ci=True),
    Rule("nature", "year", "meta", "name", "dc.date", ci=True),
    Rule("nature", "authors", "meta", "name", "dc.creator", ci=True, multi=True),
    Rule("science", "doi", "meta", "name", "publication_doi", ci=True),
    Rule("science", "publisher_url", "link", "rel", "canonical", ci=True),
    Rule("science", "title", "meta", "name", "dc.title", ci=True),
    Rule("science", "abstract", "meta", "name", "dc.description", ci=True),
    Rule("science", "journal", "meta", "name", "citation_journal_title", ci=True),
    Rule("science", "year", "meta", "name", "dc.date", ci=True),
    Rule("science", "authors", "meta", "name", "dc.creator", ci=True, multi=True),
)

# The site of each publisher.
PUBLISHER_HOSTS = {
    "openreview.net": "openreview",
    "biorxiv.org": "biorxiv",
    "nature.com": "nature",
    "science.org": "science",
}


def publisher_of(url: Column, hosts: dict[str, str] = PUBLISHER_HOSTS) -> Column:
    """The publisher whose site, or a part of it, a url is on; null for others."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    publisher = F.lit(None).cast("string")
    for site, name in hosts.items():
        here = (host == site) | host.endswith(f".{site}")
        publisher = F.when(here, F.lit(name)).otherwise(publisher)
    return publisher


def _head_tags(html: Column) -> Column:
    """The ``meta`` and ``link`` tags of a page as ``tag``, ``key`` and ``content``."""

    def parts(t: Column) -> Column:
        is_meta = t.rlike("(?i)^<meta")
        key = F.when(is_meta, raw_attribute(t, "name")).otherwise(raw_attribute(t, "rel"))
        content = F.when(is_meta, raw_attribute(t, "content")).otherwise(raw_attribute(t, "href"))
        return F.struct(
            F.when(is_meta, "meta").otherwise("link").alias("tag"),
            unescape(key).alias("key"),
            unescape(content).alias("content"),
        )

    return F.transform(open_tags(html, "meta", "link"), parts)


def _values(rule: Rule) -> Column:
    """All values a rule finds, in page order."""
    if rule.tag in ("meta", "link"):
        key, value = ("lower(t.key)", rule.value.lower()) if rule.ci else ("t.key", rule.value)
        same = f"array_contains(split({key}, ' '), '{value}')" if rule.attr == "rel" else f"{key} = '{value}'"
        return F.expr(
            f"transform(filter(_head, t -> t.tag = '{rule.tag}' AND {same}), t -> t.content)"
        )
    body = element_body(F.col("_html"), rule.tag, rule.attr, rule.value)
    return F.array(clean_text(text_of(body)))


def _cited_authors(rule: Rule) -> Column:
    """``given surname`` of each author element nested in the element of a rule."""
    block = element_body(F.col("_html"), rule.tag, rule.attr, rule.value)
    chunks = F.split(
        block, r"(?i)(?=<span(?=[^>]*\sclass\s*=\s*[\"']?(?:[^\"'>]*\s)?highwire-citation-author[\s\"'>]))"
    )

    def part(chunk: Column, name: str) -> Column:
        return text_of(F.get(element_bodies(chunk, "span", "class", name), F.lit(0)))

    people = F.filter(chunks, lambda c: c.rlike(r"(?i)^<span[^>]*highwire-citation-author"))
    return F.transform(
        people,
        lambda c: F.concat(part(c, "nlm-given-names"), F.lit(" "), part(c, "nlm-surname")),
    )


def _first_last(name: Column) -> Column:
    """``Last, First`` turned round; other forms stay as they are."""
    parts = F.split(name, ",")
    turned = F.concat(
        clean_text(F.get(parts, F.lit(1))), F.lit(" "), clean_text(F.get(parts, F.lit(0)))
    )
    return F.when(F.size(parts) == 2, turned).otherwise(clean_text(name))


def _field(rule: Rule) -> Column:
    if not rule.multi:
        value = F.get(_values(rule), F.lit(0))
        if rule.field == "publisher_url" and rule.publisher == "openreview":
            return F.regexp_replace(value, r"openreview\.net/pdf\?", "openreview.net/forum?")
        if rule.field == "year":
            return year_before_dash(
                value if rule.publisher == "biorxiv" else F.substring(value, 1, 4)
            ).cast("string")
        return value
    if rule.publisher == "biorxiv":
        return F.array_join(_cited_authors(rule), ", ")
    values = _values(rule)
    if rule.publisher == "nature":
        values = F.transform(values, _first_last)
    return F.array_join(values, ", ")


def page_fields(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add one string column per field of ``rules``, by the publisher of each page.

    ``df`` has ``publisher`` and ``html``. Rules of publisher ``*`` are for all pages.
    """
    fields = dict.fromkeys(rule.field for rule in rules)
    prepared = df.withColumn("_html", strip_noise(F.col("html"))).withColumn(
        "_head", _head_tags(F.col("_html"))
    )

    def column(field: str) -> Column:
        found = [
            _field(r) if r.publisher == "*" else F.when(F.col("publisher") == r.publisher, _field(r))
            for r in rules
            if r.field == field
        ]
        return F.coalesce(*found)

    return prepared.withColumns({name: column(name) for name in fields}).drop("_html", "_head")


def _publisher(df: DataFrame) -> Column:
    known = F.lit(None).cast("string")
    if "publisher" in df.columns:
        known = F.when(F.col("publisher").isin(*set(PUBLISHER_HOSTS.values())), F.col("publisher"))
    links = F.filter(
        open_tags(F.col("html"), "link"), lambda t: F.lower(raw_attribute(t, "rel")) == "canonical"
    )
    canonical = raw_attribute(F.get(links, F.lit(0)), "href")
    return F.coalesce(known, publisher_of(F.col("url")), publisher_of(canonical))


def unknown_pages(df: DataFrame) -> DataFrame:
    """``(page_id, url)`` of landed pages whose publisher is not known; they give no article."""
    return df.filter(_publisher(df).isNull()).select("page_id", "url")


def normalise_pages(df: DataFrame, rules: Sequence[Rule] = PAGE_RULES) -> DataFrame:
    """Article rows of the pages of known publishers, with ``url`` and ``publisher``.

    The publisher is what the page was landed with, if it is one of those known; else
    that of the url's host; else that of the page's canonical link. Pages of none are
    listed by :func:`unknown_pages`. A field a page does not hold is null. The fields leave the job through an
    explode of one row, so that a later filter on them does not have the rules
    evaluated a second time below the projection.
    """
    known = df.withColumn("publisher", _publisher(df)).filter(F.col("publisher").isNotNull())
    parsed = page_fields(known, rules)
    fields = {r.field: F.col(r.field) for r in rules if r.field in ARTICLE_FIELDS}
    journal = F.when(F.col("publisher") == "biorxiv", F.lit("BioRxiv")).otherwise(
        fields.get("journal", F.lit(None))
    )
    keep = ("page_id", "url", "publisher")
    rows = to_articles(parsed, keep=keep, **{**fields, "journal": journal})
    return rows.select(F.explode(F.array(F.struct("*"))).alias("page")).select("page.*")


def usable_pages(articles: DataFrame) -> DataFrame:
    """Pages that hold all a publisher's record needs; the others give no article.

    bioRxiv may lack a title or an abstract; everything else must be there.
    """
    needed = {
        "openreview": ("publisher_url", "title", "abstract", "journal", "year"),
        "biorxiv": ("publisher_url", "doi", "year", "authors"),
        "nature": ("doi", "publisher_url", "title", "abstract", "journal", "year"),
        "science": ("doi", "publisher_url", "title", "abstract", "journal", "year"),
    }
    tests = [
        reduce(
            lambda a, b: a & b,
            (F.col(c).isNotNull() for c in columns),
            F.col("publisher") == publisher,
        )
        for publisher, columns in needed.items()
    ]
    return articles.filter(reduce(lambda a, b: a | b, tests))

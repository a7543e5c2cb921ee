"""Alert messages to article identifiers, by the rules of each sender.

Every rule is an array expression over one message, so one narrow scan of the
messages serves all senders and nothing is shuffled: identifiers are made
distinct inside their message before they become rows. ``message_id`` is taken to
be unique, as each message is handled on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscore.functions.bind import let
from litscore.functions.html import anchors, has_class, text_of
from litscore.functions.text import last_segment, strip_text

UNKNOWN_SENDER = "unknown_sender"
NO_IDS = "no_ids"

# The address each service sends its alerts from.
SENDERS = {
    "cshljnls-mailer@alerts.highwire.org": "biorxiv",
    "efback@ncbi.nlm.nih.gov": "pubmed",
    "Nature@e-alert.nature.com": "nature_alert",
    "ealert@nature.com": "nature_ealerts",
    "do-not-reply@semanticscholar.org": "s2",
    "no-reply@arXiv.org": "arxiv",
    "alerts@aaas.sciencepubs.org": "science",
}

# How a bioRxiv article link begins.
BIORXIV_PREFIXES = (
    "http://www.biorxiv.org/cgi/content/abstract",
    "http://www.biorxiv.org/content/early",
    "http://biorxiv.org/cgi/content/abstract",
    "http://biorxiv.org/content/early",
)

# The query parameter of a Nature link and the DOI prefix of Nature.
NATURE_PARAMETER = "_L54AD1F204_"
NATURE_PREFIX = "10.1038"


def _body() -> Column:
    """What a reader sees: the HTML part, or the plain one where there is none."""
    return F.coalesce(F.col("html"), F.col("text"))


def sender_address(col: Column) -> Column:
    """The bare address of a ``Name <address>`` header."""
    bracketed = F.regexp_extract(col, r"<([^<>]*)>\s*$", 1)
    return F.when(bracketed != "", strip_text(bracketed)).otherwise(strip_text(col))


def route_messages(msgs: DataFrame, senders: dict[str, str] = SENDERS) -> DataFrame:
    """Add ``route``, the handler of the sender; exact and case-sensitive."""
    table = F.create_map(*(F.lit(x) for pair in senders.items() for x in pair))
    route = table[sender_address(F.col("sender"))]
    return msgs.withColumn("route", F.coalesce(route, F.lit(UNKNOWN_SENDER)))


def message_links(msgs: DataFrame) -> DataFrame:
    """One row per anchor of a message: position, href, class, ref and text."""
    return msgs.select("message_id", F.posexplode(anchors(_body())).alias("pos", "a")).select(
        "message_id", "pos", "a.href", "a.class", "a.ref", "a.text"
    )


# How ids stand in the messages.
_ARXIV_LINE = r"^arXiv:([a-zA-Z0-9]+\.[a-zA-Z0-9]+)$"
_PUBMED_REF = r"^article_id=([0-9]+)$"
_DOI_TEXT = r"\bdoi:([^\s]+)"
_READ_MORE = r"(?i)read more"

# Rules read the anchors of a message from _LINKS and its text from _TEXT.
_LINKS, _TEXT = "_links", "_text"


def _biorxiv_urls() -> Column:
    urls = F.transform(_LINKS, lambda a: a["href"])

    def known(url: Column) -> Column:
        test = F.lit(False)
        for prefix in BIORXIV_PREFIXES:
            test = test | url.startswith(prefix)
        return test

    return F.filter(urls, known)


def _arxiv_ids() -> Column:
    lines = F.transform(F.split(_TEXT, "\n"), strip_text)
    return F.transform(lines, lambda line: F.regexp_extract(line, _ARXIV_LINE, 1))


def _pubmed_pmids() -> Column:
    titles = F.filter(_LINKS, lambda a: has_class(a["class"], "docsum-title"))
    return F.transform(titles, lambda a: F.regexp_extract(a["ref"], _PUBMED_REF, 1))


def query_parameter(query: Column, name: str) -> Column:
    """The first value of a parameter of a query string, decoded; null if absent."""
    raw = F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)
    return F.try_url_decode(F.nullif(raw, F.lit("")))


def url_path(url: Column) -> Column:
    """The path of a url, empty where it has none."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_query(url: Column) -> Column:
    """The query of a url, empty where it has none."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def decode_base64_url(col: Column) -> Column:
    """Text behind url-safe base64, padded or not; null if it is not that.

    Other characters, such as line breaks, are skipped.
    """

    def decoded(plain: Column) -> Column:
        padded = F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, "=")
        return F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))

    return let(F.translate(F.regexp_replace(col, "[^A-Za-z0-9+/_-]", ""), "-_", "+/"), decoded)


def _nature_alert_dois() -> Column:
    def target(a: Column) -> Column:
        packed = let(
            url_query(a["href"]), lambda query: query_parameter(query, NATURE_PARAMETER)
        )
        return let(
            decode_base64_url(packed), lambda payload: query_parameter(payload, "target")
        )

    articles = F.transform(
        _LINKS, lambda a: F.regexp_extract(url_path(target(a)), r"^/articles/(.+)$", 1)
    )
    found = F.filter(articles, lambda x: x != "")
    return F.transform(found, lambda x: F.concat(F.lit(f"{NATURE_PREFIX}/"), x))


def _nature_ealert_dois() -> Column:
    return F.regexp_extract_all(_TEXT, F.lit(_DOI_TEXT), F.lit(1))


def _s2_ids() -> Column:
    links = F.filter(_LINKS, lambda a: has_class(a["class"], "paper-link"))
    return F.transform(links, lambda a: last_segment(url_path(a["href"])))


def _science_urls() -> Column:
    links = F.filter(_LINKS, lambda a: a["single"] & a["text"].rlike(_READ_MORE))
    return F.transform(links, lambda a: a["href"])


# The handler of each route: the kind of id it yields, what it reads and the rule.
HANDLERS: dict[str, tuple[str, str, Callable[[], Column]]] = {
    "biorxiv": ("biorxiv_url", _LINKS, _biorxiv_urls),
    "pubmed": ("pmid", _LINKS, _pubmed_pmids),
    "nature_alert": ("nature_doi", _LINKS, _nature_alert_dois),
    "nature_ealerts": ("nature_doi", _TEXT, _nature_ealert_dois),
    "s2": ("s2", _LINKS, _s2_ids),
    "arxiv": ("arxiv", _TEXT, _arxiv_ids),
    "science": ("science_url", _LINKS, _science_urls),
}


def _distinct_ids(ids: Column) -> Column:
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != "")))


def _read_bodies(routed: DataFrame, routes: Iterable[str]) -> DataFrame:
    """Add what the handlers of ``routes`` read, each for the messages that need it."""

    def reading(source: str) -> Column:
        return F.col("route").isin([r for r in routes if HANDLERS[r][1] == source])

    return routed.withColumns(
        {
            _LINKS: F.when(reading(_LINKS), anchors(_body())),
            _TEXT: F.when(reading(_TEXT), text_of(_body())),
        }
    )


def _extract_one(msgs: DataFrame, route: str) -> DataFrame:
    kind, _, rule = HANDLERS[route]
    routed = route_messages(msgs).filter(F.col("route") == route)
    return _read_bodies(routed, [route]).select(
        "message_id", F.lit(kind).alias("id_type"), F.explode(_distinct_ids(rule())).alias("id")
    )


def biorxiv_urls(msgs: DataFrame) -> DataFrame:
    """Article links of bioRxiv alerts."""
    return _extract_one(msgs, "biorxiv")


def arxiv_ids(msgs: DataFrame) -> DataFrame:
    """Ids on lines of their own in arXiv alerts; a version suffix stays."""
    return _extract_one(msgs, "arxiv")


def pubmed_pmids(msgs: DataFrame) -> DataFrame:
    """PubMed ids of the title links of PubMed alerts."""
    return _extract_one(msgs, "pubmed")


def nature_alert_dois(msgs: DataFrame) -> DataFrame:
    """DOIs behind the tracking links of Nature alerts."""
    return _extract_one(msgs, "nature_alert")


def nature_ealert_dois(msgs: DataFrame) -> DataFrame:
    """DOIs in the text of Nature e-alerts, trailing punctuation included."""
    return _extract_one(msgs, "nature_ealerts")


def s2_ids(msgs: DataFrame) -> DataFrame:
    """Paper ids of Semantic Scholar alerts."""
    return _extract_one(msgs, "s2")


def science_urls(msgs: DataFrame) -> DataFrame:
    """Targets of the "Read More" links of Science alerts."""
    return _extract_one(msgs, "science")


def with_ids(msgs: DataFrame) -> DataFrame:
    """``(message_id, route, id_type, ids)``: the distinct ids of each message."""
    kind, ids = F.lit(None).cast("string"), F.array().cast("array<string>")
    route = F.col("route")
    for name, (id_type, _, rule) in HANDLERS.items():
        kind = F.when(route == name, F.lit(id_type)).otherwise(kind)
        ids = F.when(route == name, rule()).otherwise(ids)
    nothing = F.array().cast("array<string>")
    return _read_bodies(route_messages(msgs), list(HANDLERS)).select(
        "message_id",
        "route",
        kind.alias("id_type"),
        F.coalesce(_distinct_ids(ids), nothing).alias("ids"),
    )


def id_rows(extracted: DataFrame) -> DataFrame:
    """One row per id of :func:`with_ids`.

    The explode is of an expression: for one of a bare column Spark infers a filter
    on its size and pushes it down, where the ids would be extracted a second time.
    """
    return extracted.select(
        "message_id", "id_type", F.explode(F.array_distinct("ids")).alias("id")
    )


def extract_article_ids(msgs: DataFrame) -> DataFrame:
    """``(message_id, id_type, id)`` of all messages, distinct within each."""
    return id_rows(with_ids(msgs))


def unhandled_messages(msgs: DataFrame) -> DataFrame:
    """``(message_id, reason)`` of messages no rule yields an id for."""
    reason = F.when(F.col("route") == UNKNOWN_SENDER, UNKNOWN_SENDER).when(
        F.size("ids") == 0, NO_IDS
    )
    # an explode, not a filter: a filter would be pushed down and extract twice
    return with_ids(msgs).select(
        "message_id", F.explode(F.array_compact(F.array(reason))).alias("reason")
    )

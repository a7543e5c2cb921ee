"""SQL for what each query must return, over the same tables."""

from __future__ import annotations

from litscore.registry import inputs
from litscore.registry.inputs import ABSTRACT, DOI, ID, TITLE, YEAR
from litscore.registry.queries import VECTOR_THRESHOLD


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _select(columns: list[str], rows: str, where: str = "TRUE") -> str:
    return f"SELECT {', '.join(columns)} FROM {rows} WHERE {where}"


# --- messages -----------------------------------------------------------------------

_MESSAGES = f"m AS ({_select(inputs.message_columns(inputs.SQL_BASE64), 'documents')})"


def _ids(kind: int, id_type: str, ids: str) -> str:
    return (
        f"SELECT DISTINCT message_id, '{id_type}' AS id_type, id FROM"
        f" (SELECT message_id, unnest({ids}) AS id FROM m WHERE uid % 8 = {kind})"
    )


_BIORXIV = _ids(0, "biorxiv_url", r"""regexp_extract_all(html, 'href="(http://www\.biorxiv\.org/content/early/[^"]*)"', 1)""")
_PUBMED = _ids(1, "pmid", r"""regexp_extract_all(html, 'ref="article_id=([0-9]+)"', 1)""")
_NATURE_PACKED = r"""(SELECT message_id, translate(unnest(regexp_extract_all(
    html, '_L54AD1F204_=([^"]*)"', 1)), '-_', '+/') AS p FROM m WHERE uid % 8 = 2)"""
_NATURE = (
    "SELECT DISTINCT message_id, 'nature_doi' AS id_type, '10.1038/' || regexp_extract(url_decode("
    "regexp_extract(decode(from_base64(p || repeat('=', (4 - length(p) % 4) % 4))), 'target=([^&]*)', 1)),"
    f" '/articles/([^?]+)', 1) AS id FROM {_NATURE_PACKED}"
)
_EALERT = _ids(3, "nature_doi", r"regexp_extract_all(html, '\bdoi:(\S+)', 1)")
_S2 = _ids(4, "s2", r"""regexp_extract_all(html, '/paper/T/(h[0-9]+)\?x=1" class="paper-link"', 1)""")
_ARXIV = (
    "SELECT DISTINCT message_id, 'arxiv' AS id_type, substr(line, 7) AS id FROM"
    " (SELECT message_id, trim(unnest(string_split(html, chr(10)))) AS line FROM m WHERE uid % 8 = 5)"
    r" WHERE regexp_full_match(line, 'arXiv:[a-zA-Z0-9]+\.[a-zA-Z0-9]+')"
)
_SCIENCE = _ids(6, "science_url", r"""regexp_extract_all(html, 'href=''([^'']*)''>READ', 1)""")
_ALL_IDS = " UNION ALL ".join((_BIORXIV, _PUBMED, _NATURE, _EALERT, _S2, _ARXIV, _SCIENCE))
_IDS = f"ids AS ({_ALL_IDS})"

_ROUTE = (
    "CASE uid % 8 WHEN 0 THEN 'biorxiv' WHEN 1 THEN 'pubmed' WHEN 2 THEN 'nature_alert'"
    " WHEN 3 THEN 'nature_ealerts' WHEN 4 THEN 's2' WHEN 5 THEN 'arxiv' WHEN 6 THEN 'science'"
    " ELSE 'unknown_sender' END"
)


def _unescaped(text: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return text


_LINKS = (
    _with(
        _MESSAGES,
        r"l AS (SELECT message_id, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>') AS found FROM m)",
        "a AS (SELECT message_id, unnest(found) AS a, generate_subscripts(found, 1) - 1 AS pos FROM l)",
    )
    + "SELECT message_id, CAST(pos AS INTEGER) AS pos,"
    + _unescaped(r"""nullif(regexp_extract(a, 'href=["'']([^"'']*)["'']', 1), '')""")
    + """ AS href, nullif(regexp_extract(a, 'class="([^"]*)"', 1), '') AS class,
    nullif(regexp_extract(a, ' ref="([^"]*)"', 1), '') AS ref,
    regexp_replace(a, '<[^>]*>', '', 'g') AS text FROM a"""
)

# --- resolution ---------------------------------------------------------------------

_SOURCES = [
    f"src_{name} AS ({_select(columns, rows, where)})"
    for name, (columns, rows, where) in inputs.SOURCE_ROWS.items()
]
_WANTED = f"wanted AS (SELECT DISTINCT {DOI} AS id FROM documents)"
_FIELDS = "doi, title, journal, year"
_COMPLETE = "title IS NOT NULL AND abstract IS NOT NULL"
_GAPPED = _with(f"gapped AS ({_select(inputs.GAPPED, 'documents')})")


def _tiers(key: str, prefixes: bool = True, fields: str = _FIELDS) -> str:
    """The records that serve DOIs, by key and rank."""

    def by(column: str) -> str:
        return f"lower({column})" if key == "lower" else column

    def prefix(text: str) -> str:
        return f"starts_with({by('doi')}, '{text}')" if prefixes else "TRUE"

    tiers = [
        f"SELECT {by('doi')} AS key, 1 AS rank, 's2' AS stage, {fields} FROM src_s2 WHERE {_COMPLETE}",
        f"SELECT {by('doi')}, 2, 'crossref', {fields} FROM src_crossref WHERE {_COMPLETE}",
        f"SELECT {by('doi')}, 3, 'nature', {fields} FROM src_nature WHERE {_COMPLETE} AND {prefix('10.1038/')}",
    ]
    if prefixes:
        tiers += [
            f"SELECT {by('doi')}, 4, 'arxiv', {_FIELDS} FROM src_arxiv WHERE {prefix('10.48550/arxiv')}",
            f"SELECT {by('r.doi')}, 5, 'elsevier', e.doi, e.title, e.journal, e.year FROM src_elsevier e"
            " JOIN src_doi_redirect r ON regexp_extract(r.url, '[^/]*$') = regexp_extract(e.publisher_url, '[^/]*$')"
            f" WHERE starts_with({by('r.doi')}, '10.1016/')",
        ]
    return " UNION ALL ".join(tiers)


def _first(key: str = "lower", prefixes: bool = True) -> list[str]:
    by = "lower(id)" if key == "lower" else "id"
    return [
        *_SOURCES,
        _WANTED,
        f"tiers AS ({_tiers(key, prefixes)})",
        "ranked AS (SELECT w.id, t.*, row_number() OVER (PARTITION BY w.id ORDER BY t.rank) AS n"
        f" FROM wanted w JOIN tiers t ON {by} = t.key)",
        f"found AS (SELECT id, stage, rank, {_FIELDS} FROM ranked WHERE n = 1)",
    ]


_STAGES = (("s2", 1, ""), ("crossref", 2, ""), ("nature", 3, "10.1038/"), ("arxiv", 4, "10.48550/arxiv"), ("elsevier", 5, "10.1016/"))
_REPORT = _with(
    *_first(),
    "j AS (SELECT w.id, coalesce(f.rank, 6) AS rank FROM wanted w LEFT JOIN found f ON w.id = f.id)",
) + " UNION ALL ".join(
    [
        f"SELECT '{name}' AS stage, count(*) FILTER (WHERE starts_with(id, '{prefix}') AND rank >= {n})"
        f" AS attempted, count(*) FILTER (WHERE rank = {n}) AS loaded FROM j"
        for name, n, prefix in _STAGES
    ]
    + ["SELECT 'total', count(*), count(*) FILTER (WHERE rank < 6) FROM j"]
)

_ROWS = f"rows_ AS ({_select(inputs.LIBRARY_ROWS, 'documents')})"
_ARXIV_ID = r"regexp_extract(url, '^https?://arxiv\.org/abs/([0-9]+\.[0-9]+)', 1)"
_WITHOUT_DOI = f"""
    SELECT r.row_id, 'arxiv_id' AS route, a.doi, a.title, a.journal, a.year FROM rows_ r
    JOIN src_arxiv a ON a.arxiv = regexp_replace(r.arxiv, 'v[0-9]+$', '') WHERE r.doi IS NULL
    UNION ALL
    SELECT r.row_id, 'arxiv_url', a.doi, a.title, a.journal, a.year FROM rows_ r
    JOIN src_arxiv a ON a.arxiv = {_ARXIV_ID.replace('url', 'r.url')}
    WHERE r.doi IS NULL AND starts_with(r.url, 'https://arxiv.org/abs/')
    UNION ALL
    SELECT r.row_id, 'openreview_url', o.doi, o.title, o.journal, o.year FROM rows_ r
    JOIN src_openreview o ON o.url = r.url WHERE r.doi IS NULL AND o.title IS NOT NULL AND o.abstract IS NOT NULL"""
_LEFTOVER = """SELECT row_id, url FROM rows_ WHERE doi IS NULL AND url IS NOT NULL
    AND NOT starts_with(url, 'https://arxiv.org/abs/')
    AND NOT starts_with(url, 'https://openreview.net/forum?id=')"""

_RESOLVE_LIBRARY = (
    _with(
        *[p for p in _first() if not p.startswith("wanted")][: len(_SOURCES)],
        _ROWS,
        "wanted AS (SELECT DISTINCT doi AS id FROM rows_ WHERE doi IS NOT NULL)",
        *_first()[len(_SOURCES) + 1 :],
        f"rest AS ({_WITHOUT_DOI})",
        f"left_over AS ({_LEFTOVER})",
    )
    + "SELECT stage, count(*) AS n FROM found GROUP BY ALL UNION ALL"
    " SELECT route, count(*) FROM rest GROUP BY ALL UNION ALL"
    " SELECT 'missing', count(*) FROM wanted WHERE id NOT IN (SELECT id FROM found) UNION ALL"
    " SELECT 'leftover', count(*) FROM left_over"
)

def _by_type(fields: str = _FIELDS) -> list[str]:
    return [
        _MESSAGES,
        _IDS,
        *_SOURCES,
        f"tiers AS ({_tiers('lower', prefixes=False, fields=fields)})",
        f"""records AS (
    SELECT 'pmid' AS id_type, pmid AS key, 1 AS rank, 'pubmed' AS stage, {fields} FROM src_pubmed
    UNION ALL SELECT 'arxiv', arxiv, 1, 'arxiv', {fields} FROM src_arxiv
    UNION ALL SELECT 's2', semantic_scholar, 1, 's2', {fields} FROM src_s2
    UNION ALL SELECT 'biorxiv_url', url, 1, 'biorxiv', {fields} FROM src_biorxiv
    UNION ALL SELECT 'science_url', url, 1, 'science', {fields} FROM src_science WHERE {_COMPLETE}
    UNION ALL SELECT 'nature_doi', key, rank, stage, {fields} FROM tiers)""",
        """asked AS (SELECT DISTINCT id_type, id, CASE id_type WHEN 'nature_doi' THEN lower(id)
    WHEN 'arxiv' THEN regexp_replace(id, 'v[0-9]+$', '')
    WHEN 'biorxiv_url' THEN replace(id, 'http://', 'https://') ELSE id END AS key FROM ids)""",
        "answers AS (SELECT a.id, r.*, row_number() OVER (PARTITION BY a.id_type, a.id ORDER BY r.rank) AS n"
        " FROM asked a JOIN records r ON a.id_type = r.id_type AND a.key = r.key)",
        f"found AS (SELECT id_type, id, stage, {fields} FROM answers WHERE n = 1)",
    ]


_BY_TYPE = _by_type()

# --- dumps and pages ----------------------------------------------------------------


def _article(**fields: str) -> str:
    names = ("doi", "pmid", "arxiv", "semantic_scholar", "publisher_url", "title", "abstract", "journal", "year", "authors")
    nothing = {"year": "CAST(NULL AS INTEGER)"}
    return ", ".join(
        f"{fields.get(n, nothing.get(n, 'CAST(NULL AS VARCHAR)'))} AS {n}" for n in names
    )


def _unwrapped(text: str) -> str:
    stripped = f"trim({text}, ' ' || chr(10))"
    return f"nullif(array_to_string(list_transform(string_split({stripped}, chr(10)), lambda x: trim(x)), ' '), '')"


_YEAR = f"CAST({YEAR} AS INTEGER)"
_PUBMED_ROWS = "SELECT " + _article(
    doi=f"CASE WHEN doc_id % 7 <> 0 THEN '10.1/' || {ID} END",
    pmid=ID,
    title=f"{TITLE} || ' in vivo'",
    abstract=_unwrapped(f"coalesce({ABSTRACT}, '') || ' end'"),
    journal="'The Journal'",
    year=f"CASE WHEN doc_id % 11 <> 0 THEN {_YEAR} END",
    authors="CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN ' Poe, Bo Li' ELSE 'Ada Poe, Bo Li' END",
) + " FROM documents"
_ARXIV_ROWS = "SELECT " + _article(
    doi=f"CASE WHEN doc_id % 6 <> 0 THEN '10.48550/arXiv.2401.' || {ID} END",
    arxiv=f"CASE WHEN doc_id % 6 <> 0 THEN '2401.' || {ID} END",
    title=TITLE,
    abstract=_unwrapped(f"coalesce({ABSTRACT}, 'none')"),
    journal="'arXiv'",
    year=_YEAR,
    authors="CASE WHEN doc_id % 5 <> 0 THEN 'Ada Poe, Bo Li' END",
) + " FROM documents"
_CROSSREF_ROWS = "SELECT " + _article(
    doi=DOI,
    publisher_url=f"'https://x.example/' || {ID}",
    title=f"CASE WHEN doc_id % 6 <> 0 THEN {TITLE} END",
    abstract=ABSTRACT,
    journal="'The Journal'",
    year=f"CASE WHEN doc_id % 2 = 0 THEN {_YEAR} WHEN doc_id % 3 = 0 THEN {_YEAR} + 100 END",
    authors="CASE WHEN doc_id % 5 <> 0 THEN 'Ada Poe,  Li, Bo ' ELSE '' END",
) + " FROM documents"
_S2_ROWS = "SELECT " + _article(
    doi=DOI,
    pmid=f"CASE WHEN doc_id % 3 = 0 THEN {ID} END",
    semantic_scholar=f"'h' || {ID}",
    title=TITLE,
    abstract=ABSTRACT,
    journal="CASE WHEN doc_id % 4 <> 0 THEN 'The Journal' END",
    year=_YEAR,
    authors="CASE WHEN doc_id % 5 <> 0 THEN 'Ada Poe, Bo Li' ELSE '' END",
) + " FROM documents"
_ELSEVIER_ROWS = "SELECT " + _article(
    doi=DOI,
    pmid=ID,
    publisher_url=f"'https://www.sciencedirect.com/pii/S' || {ID}",
    title=TITLE,
    abstract=_unwrapped(ABSTRACT),
    journal="'The Journal'",
    year=_YEAR,
    authors="'Poe, A., Li, B.'",
) + " FROM documents"


def _of(*values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE doc_id % 4 {cases} END"


_ANY_ABSTRACT = f"coalesce({ABSTRACT}, '')"
_PAGE_ROWS = (
    f"SELECT doc_id AS page_id, {inputs.PAGE_URL} AS url, "
    + _of("'openreview'", "'biorxiv'", "'nature'", "'science'")
    + " AS publisher, "
    + _article(
        doi=_of("NULL", f"'10.1101/' || {ID}", f"'10.1038/s' || {ID}", f"'10.1126/s' || {ID}"),
        publisher_url=inputs.PAGE_URL,
        title=_of(TITLE, f"{TITLE} || ' 2'", TITLE, TITLE),
        abstract=_of(_ANY_ABSTRACT, f"'Aim' || {_ANY_ABSTRACT}", _ANY_ABSTRACT, _ANY_ABSTRACT),
        journal=_of("'ICX'", "'BioRxiv'", "'Nature X'", "'Science'"),
        year=_YEAR,
        authors="'Ada Poe, Bo Li'",
    )
    + " FROM documents"
)
_USABLE = f"SELECT doc_id AS page_id FROM documents WHERE doc_id % 4 = 1 OR {ABSTRACT} IS NOT NULL"


def _element(tag: str) -> str:
    return _unescaped(f"trim(regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1))")


# --- vectors ------------------------------------------------------------------------

_INPUT = f"{TITLE} || '[SEP]' || coalesce({ABSTRACT}, '')"


def _counts(name: str, rows: str) -> str:
    """Token counts by bucket of ``rows`` with ``id`` and ``input``."""
    return (
        f"{name} AS (SELECT id, CAST('0x' || substr(md5(t), 1, 2) AS INTEGER) AS bucket, count(*) AS tf"
        r" FROM (SELECT id, unnest(regexp_split_to_array(lower(input), '[^\p{L}0-9]+')) AS t"
        f" FROM {rows}) WHERE t <> '' GROUP BY ALL)"
    )


def _weights(name: str, counts: str, idf: str) -> list[str]:
    return [
        f"{name}_raw AS (SELECT c.id, c.bucket, c.tf * coalesce(i.idf, (SELECT max(unseen) FROM {idf})) AS w"
        f" FROM {counts} c LEFT JOIN {idf} i ON c.bucket = i.bucket)",
        f"{name} AS (SELECT r.id, r.bucket, r.w / n.norm AS w FROM {name}_raw r JOIN"
        f" (SELECT id, sqrt(sum(w * w)) AS norm FROM {name}_raw GROUP BY id) n ON r.id = n.id"
        " WHERE n.norm > 0 AND r.w <> 0)",
    ]


def _idf(counts: str, rows: str) -> str:
    n = f"(SELECT count(*) FROM {rows})"
    return (
        f"idf AS (SELECT bucket, ln(({n} + 1) / (count(*) + 1)) AS idf, ln(({n} + 1) / 1) AS unseen"
        f" FROM {counts} GROUP BY bucket)"
    )


_HASH_TFIDF = (
    _with(
        f"texts AS (SELECT doc_id AS id, {_INPUT} AS input FROM documents)",
        _counts("counts", "texts"),
        _idf("counts", "texts"),
        *_weights("weights", "counts", "idf"),
    )
    + "SELECT id AS doc_id, bucket, round(w, 6) AS weight FROM weights"
)

_VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_NEAR = f"""near AS (SELECT q.vec_id AS query_id, l.vec_id AS library_id,
    list_cosine_distance(q.e, l.e) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_distance(q.e, l.e), l.vec_id) AS n
    FROM v q JOIN v l ON q.label >= 5 AND l.label < 5)"""
_TIES = """r AS (SELECT vec_id + c * 10000000 AS vec_id, e FROM v, (SELECT unnest(range(3)) AS c) WHERE label < 5),
    near AS (SELECT q.vec_id AS query_id, r.vec_id AS library_id, list_cosine_distance(q.e, r.e) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(q.e, r.e), 12), r.vec_id) AS n
    FROM v q JOIN r ON q.label >= 5)"""
_KNN = "knn AS (SELECT query_id, avg(distance) AS distance FROM near WHERE n <= 10 GROUP BY query_id)"
_FOLDS = """folds AS (SELECT *, CAST(ntile(5) OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || '42'), vec_id)
    - 1 AS INTEGER) AS cv_fold FROM v)"""
_CV = """cv AS (SELECT vec_id, cv_fold, avg(d) AS cv_distance FROM (SELECT q.vec_id, q.cv_fold,
    list_cosine_distance(q.e, r.e) AS d,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_distance(q.e, r.e), r.vec_id) AS n
    FROM folds q JOIN folds r ON q.cv_fold <> r.cv_fold) WHERE n <= 10 GROUP BY ALL)"""

# --- digest -------------------------------------------------------------------------

_SCORED = [
    _VECTORS,
    _NEAR,
    _KNN,
    f"""scored AS (SELECT v.vec_id // 8 AS message_id, k.distance, d.* FROM knn k
    JOIN v ON v.vec_id = k.query_id LEFT JOIN (SELECT doc_id,
    CASE WHEN doc_id % 3 = 0 THEN 'https://arxiv.org/abs/2401.' || {ID}
    ELSE 'https://doi.org/' || {DOI} END AS url, {TITLE} AS title,
    CASE WHEN doc_id % 4 <> 0 THEN 'Ada Poe' END AS authors,
    CASE doc_id % 3 WHEN 0 THEN 'arXiv' WHEN 1 THEN 'R & D' END AS journal
    FROM documents) d ON d.doc_id = k.query_id)""",
]


def _density(data: str, fold: str, value: str) -> list[str]:
    return [
        f"""stats AS (SELECT *, low - 3 * bw AS start, (high - low + 6 * bw) / 199 AS step FROM
        (SELECT {fold} AS fold, sum(count(*)) OVER () AS total, min({value}) AS low, max({value}) AS high,
        stddev_samp({value}) * pow(count(*), -0.2) AS bw FROM {data} GROUP BY {fold}))""",
        "grid AS (SELECT *, start + point * step AS x FROM stats, (SELECT unnest(range(200)) AS point))",
        f"""density AS (SELECT g.fold AS {fold}, CAST(g.point AS INTEGER) AS point, round(g.x, 6) AS x,
        round(sum(exp(-0.5 * pow((d.{value} - g.x) / g.bw, 2)))
        / any_value(g.total * g.bw * sqrt(2 * pi())), 6) AS density
        FROM grid g JOIN {data} d ON d.{fold} = g.fold GROUP BY g.fold, g.point, g.x)""",
    ]


def _html_escaped(text: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("''", "&#39;")):
        text = f"replace({text}, '{char}', '{entity}')"
    return f"coalesce({text}, '')"


_MATCH = f"distance < {VECTOR_THRESHOLD}"
_ENTRY = (
    "'<li><a href=''' || " + _html_escaped("url") + " || '''>' || " + _html_escaped("title")
    + " || '</a><br>' || " + _html_escaped("authors") + " || '<br><i>' || " + _html_escaped("journal")
    + " || '</i><br>' || " + _html_escaped("url") + " || '<br>distance ' || printf('%.3f', distance) || '</li>'"
)
_HTML = (
    "SELECT message_id, '<html><body><h1>Close to your library</h1><p>' || count(*) FILTER (WHERE "
    f"{_MATCH}) || ' of ' || count(*) || ' articles are near</p><p>' || printf('%.1f', count(*) FILTER (WHERE {_MATCH})"
    " / count(*) * 100) || '% near</p><p>Distance below ' || "
    f"printf('%.3f', {VECTOR_THRESHOLD}::DOUBLE) || '</p><ol>' || coalesce(string_agg({_ENTRY}, ''"
    f" ORDER BY distance, url, title) FILTER (WHERE {_MATCH}), '') || '</ol></body></html>' AS html"
    " FROM scored GROUP BY message_id"
)

# --- whole jobs ---------------------------------------------------------------------

_LIKED = "documents JOIN labels USING (doc_id) WHERE quality = 1"
_SCORE_PARTS = [
    *_by_type(f"{_FIELDS}, abstract"),
    f"library AS (SELECT doc_id AS id, {_INPUT} AS input FROM {_LIKED})",
    "queries AS (SELECT id_type || ':' || id AS id, title || '[SEP]' || coalesce(abstract, '') AS input"
    " FROM found WHERE title IS NOT NULL)",
    _counts("library_counts", "library"),
    _counts("query_counts", "queries"),
    _idf("library_counts", "library"),
    *_weights("library_weights", "library_counts", "idf"),
    *_weights("query_weights", "query_counts", "idf"),
    "l AS (SELECT id, bucket, CAST(CAST(w AS FLOAT) AS DOUBLE) AS w FROM library_weights)",
    "q AS (SELECT id, bucket, CAST(CAST(w AS FLOAT) AS DOUBLE) AS w FROM query_weights)",
    "ln AS (SELECT id, sqrt(sum(w * w)) AS norm FROM l GROUP BY id)",
    "qn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM q GROUP BY id)",
    "dots AS (SELECT q.id AS qid, l.id AS lid, sum(q.w * l.w) AS dot FROM q JOIN l USING (bucket) GROUP BY ALL)",
    """pairs AS (SELECT x.id AS qid, y.id AS lid, 1 - coalesce(d.dot / (qn.norm * ln.norm), 0) AS distance
    FROM queries x CROSS JOIN library y LEFT JOIN dots d ON d.qid = x.id AND d.lid = y.id
    LEFT JOIN qn ON qn.id = x.id LEFT JOIN ln ON ln.id = y.id)""",
    """distances AS (SELECT qid, avg(greatest(distance, 0)) AS distance FROM (SELECT *,
    row_number() OVER (PARTITION BY qid ORDER BY distance, lid) AS n FROM pairs) WHERE n <= 10 GROUP BY qid)""",
]
_SCORE_ALERTS = (
    _with(*_SCORE_PARTS)
    + "SELECT i.message_id, i.id_type, i.id, f.title, round(d.distance, 6) AS distance FROM ids i"
    " JOIN found f USING (id_type, id) JOIN distances d ON d.qid = i.id_type || ':' || i.id"
)
_UNHANDLED = (
    _with(
        *_BY_TYPE,
        """state AS (SELECT message_id, count(f.id) AS n, count(f.title) AS titled FROM ids i
        LEFT JOIN found f USING (id_type, id) GROUP BY message_id)""",
    )
    + """SELECT * FROM (SELECT m.message_id, CASE WHEN uid % 8 = 7 THEN 'unknown_sender'
    WHEN s.n IS NULL THEN 'no_ids' WHEN s.n = 0 THEN 'no_articles' WHEN s.titled = 0 THEN 'no_titles' END AS reason
    FROM m LEFT JOIN state s USING (message_id)) WHERE reason IS NOT NULL"""
)


def oracle_sql() -> dict[str, str]:
    """The check of each query, by the same names."""
    dated = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders"
    articles = f"(SELECT doc_id, {TITLE} AS title, {ABSTRACT} AS abstract FROM documents)"
    padded = "(' ' || chr(10) || text || chr(10) || chr(10) || ' end ' || chr(10))"
    knn = _with(_VECTORS, _NEAR, _KNN)
    knn_rows = knn + "SELECT query_id, round(distance, 6) AS distance FROM knn"
    m = _with(_MESSAGES)
    return {
        "library_round_trip": f"SELECT {ID} AS doc_id, title, abstract, '2022-01-01' AS \"created (Read-Only)\" FROM {articles}",
        "build_library": f"SELECT {TITLE} AS title, {_ANY_ABSTRACT} AS abstract, {_INPUT} AS input FROM {_LIKED}",
        "message_queue": m + "SELECT message_id, uid, sender, subject FROM m",
        "digest_sink": _with(*_SCORED)
        + "SELECT CASE WHEN message_id % 2 = 0 THEN 'a' ELSE 'b' END AS batch, count(*) AS n,"
        " round(sum(distance), 6) AS distance FROM scored GROUP BY ALL",
        "filter_since": f"SELECT * FROM ({dated}) WHERE created >= '1998-06-15'",
        "filter_after": f"SELECT * FROM ({dated}) WHERE created > '1998-06-15'",
        "require_title": _GAPPED + "SELECT doc_id, title FROM gapped WHERE title IS NOT NULL",
        "require_complete": _GAPPED + f"SELECT doc_id, title FROM gapped WHERE {_COMPLETE}",
        "match_filter": knn_rows + f" WHERE {_MATCH}".replace("distance", "knn.distance"),
        "split_by_id_kind": _with(_ROWS)
        + "SELECT row_id, 'doi' AS kind FROM rows_ WHERE doi IS NOT NULL UNION ALL"
        " SELECT row_id, 'arxiv' FROM rows_ WHERE doi IS NULL AND arxiv IS NOT NULL UNION ALL"
        " SELECT row_id, 'url' FROM rows_ WHERE doi IS NULL AND url IS NOT NULL",
        "encoder_input": f"SELECT doc_id, {_ANY_ABSTRACT} AS abstract, {_INPUT} AS input FROM documents",
        "drop_vectors": "SELECT vec_id, label FROM embeddings",
        "route_messages": m + f"SELECT message_id, {_ROUTE} AS route FROM m",
        "message_links": _LINKS,
        "biorxiv_urls": m + _BIORXIV,
        "arxiv_ids": m + _ARXIV,
        "pubmed_pmids": m + _PUBMED,
        "nature_alert_dois": m + _NATURE,
        "nature_ealert_dois": m + _EALERT,
        "s2_ids": m + _S2,
        "science_urls": m + _SCIENCE,
        "extract_article_ids": _with(_MESSAGES, _IDS) + "SELECT * FROM ids",
        "unhandled_messages": m + "SELECT message_id, 'unknown_sender' AS reason FROM m WHERE uid % 8 = 7",
        "normalise_pubmed": _PUBMED_ROWS,
        "normalise_arxiv": _ARXIV_ROWS,
        "normalise_crossref": _CROSSREF_ROWS,
        "normalise_s2": _S2_ROWS,
        "normalise_elsevier": _ELSEVIER_ROWS,
        **dict.fromkeys(("normalise_pages", "pages_dump"), _PAGE_ROWS),
        "doi_redirect_dump": _with(*_SOURCES) + "SELECT doi, url FROM src_doi_redirect",
        "usable_pages": _USABLE,
        "page_fields": f"SELECT page_id, {_element('title')} AS title, {_element('h1')} AS h1 FROM pages",
        "unwrap_text": f"SELECT doc_id, trim({padded}, ' ' || chr(10)) AS cleaned, {_unwrapped(padded)} AS unwrapped FROM documents",
        "nested_json": "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k, CAST(year(ts) AS INTEGER) AS year,"
        " CAST(year(ts) AS INTEGER) AS year_dash, CAST(NULL AS INTEGER) AS no_year FROM events",
        "article_url": _GAPPED + "SELECT doc_id, CASE WHEN journal = 'arXiv' THEN 'https://arxiv.org/abs/' || arxiv"
        " ELSE 'https://doi.org/' || doi END AS url FROM gapped",
        "resolve_waterfall": _with(*_first()) + "SELECT * FROM found",
        "resolve_waterfall_exact": _with(*_first("exact")) + "SELECT * FROM found",
        "resolve_waterfall_nature": _with(*_first(prefixes=False)) + "SELECT * FROM found",
        "missing_ids": _with(*_first()) + "SELECT id FROM wanted WHERE id NOT IN (SELECT id FROM found)",
        "resolve_without_doi": _with(*_SOURCES, _ROWS) + _WITHOUT_DOI,
        "leftover_urls": _with(_ROWS) + _LEFTOVER,
        "resolution_report": _REPORT,
        **dict.fromkeys(("resolve_by_type", "resolve_by_type_stored"), _with(*_BY_TYPE) + "SELECT * FROM found"),
        "unresolved_ids": _with(*_BY_TYPE)
        + "SELECT id_type, id FROM asked EXCEPT SELECT id_type, id FROM found",
        "resolve_library": _RESOLVE_LIBRARY,
        "hash_tfidf": _HASH_TFIDF,
        "embed": f"SELECT doc_id, CAST(length(t) AS INTEGER) AS chars,"
        " CAST(length(t) - length(replace(t, chr(10), '')) AS INTEGER) AS breaks,"
        " CAST(length(t) - length(replace(t, '.', '')) AS INTEGER) AS stops"
        f" FROM (SELECT doc_id, {_INPUT} AS t FROM documents)",
        "knn_mean_distance": knn_rows,
        "knn_grid": knn_rows,
        **dict.fromkeys(
            ("knn_ties", "knn_ties_grid"),
            _with(_VECTORS, _TIES)
            + "SELECT query_id, library_id, round(distance, 6) AS distance FROM near WHERE n <= 10",
        ),
        "knn_neighbours": knn + "SELECT query_id, library_id, round(distance, 6) AS distance FROM near WHERE n <= 10",
        "kfold": _with(_VECTORS, _FOLDS) + "SELECT vec_id, cv_fold FROM folds",
        "cv_distances": _with(_VECTORS, _FOLDS, _CV)
        + "SELECT vec_id, label, cv_fold, round(cv_distance, 6) AS cv_distance FROM cv JOIN v USING (vec_id)",
        "match_summary": _with(*_SCORED)
        + f"SELECT message_id, count(*) FILTER (WHERE {_MATCH}) AS matches, count(*) AS total,"
        f" round(count(*) FILTER (WHERE {_MATCH}) / count(*) * 100, 6) AS percent,"
        f" CAST({VECTOR_THRESHOLD} AS DOUBLE) AS threshold FROM scored GROUP BY message_id",
        "digest_rows": _with(*_SCORED)
        + "SELECT message_id, round(distance, 6) AS distance, url, title, authors, journal"
        f" FROM scored WHERE {_MATCH}",
        "distance_rug": _with(*_SCORED)
        + "SELECT message_id, round(distance, 6) AS distance,"
        f" CAST({VECTOR_THRESHOLD} AS DOUBLE) AS threshold FROM scored",
        "fold_density": _with(_VECTORS, _FOLDS, _CV, *_density("cv", "cv_fold", "cv_distance"))
        + "SELECT * FROM density",
        "value_density": _with(*_density("events", "event_type", "value")) + "SELECT * FROM density",
        "digest_html": _with(*_SCORED) + _HTML,
        "calibrated_library": _with(f"n AS (SELECT count(*) AS n FROM {_LIKED})")
        + "SELECT CAST(f AS INTEGER) AS cv_fold, CAST(n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n"
        " FROM n, (SELECT unnest(range(5)) AS f)",
        "score_alerts": _SCORE_ALERTS,
        "unhandled_alerts": _UNHANDLED,
        **dict.fromkeys(("score_alert_stream", "score_alert_stream_stored", "redriven_alerts", "default_encoder"), _SCORE_ALERTS),
        "stream_density": _with(*_density("events", "event_type", "value")) + "SELECT * FROM density",
    }


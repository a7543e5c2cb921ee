"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Links in both directions, to the smallest id reachable.
_GROUPS = """reached AS (SELECT id, id AS root FROM ids UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.id),
    groups AS (SELECT id, min(root) AS component_id FROM reached GROUP BY id)"""

OP3 = f"""WITH RECURSIVE ids AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    links AS (SELECT x.id AS a, y.id AS b FROM ids x JOIN ids y ON x.label = y.label AND x.id <> y.id
        AND list_cosine_similarity(x.e, y.e) >= 0.93),
    {_GROUPS}
    SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept
    FROM groups"""

OP6 = f"""WITH RECURSIVE words AS (SELECT doc_id AS id, regexp_extract_all(
        translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    ids AS (SELECT id FROM words),
    shingles AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5
        THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
    sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
    links AS (SELECT a.id AS a, b.id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.id <> b.id
        JOIN sizes x ON x.id = a.id JOIN sizes y ON y.id = b.id GROUP BY a.id, b.id, x.n, y.n
        HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
    {_GROUPS}
    SELECT groups.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM groups LEFT JOIN sizes USING (id)"""


_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

OP12 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}') AS t FROM documents),
    s AS (SELECT count(*) FILTER (WHERE len(t) > 0)::BIGINT AS n_docs, coalesce(sum(len(t)), 0)::BIGINT AS n_terms FROM d),
    occ AS (SELECT rid, unnest(t) AS term FROM d),
    tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM occ GROUP BY rid, term),
    df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) AS term
        FROM benchmark WHERE item_id IS NOT NULL),
    m AS (SELECT rid, doc_id, 100 - 90 + (90 * len(t)::BIGINT * s.n_docs) // s.n_terms AS m FROM d, s WHERE len(t) > 0 AND doc_id IS NOT NULL),
    w AS (SELECT q.item_id, q.term, floor(1000 * ln((2.0 * s.n_docs + 2) / (2.0 * df.df + 1)))::BIGINT AS w FROM q JOIN df USING (term), s),
    sc AS (SELECT w.item_id, m.doc_id, m.rid, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m)))::BIGINT AS score
        FROM w JOIN tf USING (term) JOIN m USING (rid) GROUP BY w.item_id, m.doc_id, m.rid)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
        SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
    WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op3_neardup": OP3, "op6_jaccard": OP6, "op12_search": OP12}

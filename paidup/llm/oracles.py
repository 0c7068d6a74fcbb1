"""The queries that SQL can express on whole tables, as SQL over the given tables, for comparison by another engine."""

from __future__ import annotations

from paidup.llm.codebooks import ENTRIES, PARTS, ROUNDS, SCALE
from paidup.llm.decontaminate import WINDOW

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def decontaminate_sql() -> str:
    words = "regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(text=_LOWER)
    return f"""WITH words AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
    items AS (SELECT item_id, {words} AS w, least({WINDOW}, len(w)) AS k FROM benchmark),
    windows AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items WHERE k > 0)),
    places AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT DISTINCT k FROM windows))),
    found AS MATERIALIZED (SELECT DISTINCT doc_id, i, k, item_id FROM places JOIN windows USING (k, g)),
    hit AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i - 1, i - 1 + k)) AS p FROM found),
    runs AS (SELECT doc_id, min(p) AS a, max(p) + 1 AS b FROM
        (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit) GROUP BY doc_id, run),
    spans AS (SELECT doc_id, sum(b - a) AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS t FROM runs GROUP BY doc_id),
    ids AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS t
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(s.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(d.n, 0) AS BIGINT) AS n_items,
        sha256(coalesce(d.t, '')) AS items_sha256, coalesce(s.n > 0 AND 20 * s.n >= len(w), false) AS contaminated,
        coalesce(s.t, '') AS hit_spans
    FROM words LEFT JOIN spans s USING (doc_id) LEFT JOIN ids d USING (doc_id)"""


def near_copies_sql() -> str:
    return f"""WITH RECURSIVE words AS MATERIALIZED (
        SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sets AS MATERIALIZED (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
        FROM words),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
        FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS MATERIALIZED (SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
        WHERE 100 * k >= 85 * (p.n + q.n - k)),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
        doc_id <= coalesce(b, doc_id) AS kept
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id"""


def warc_sql() -> str:
    five = "CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT)"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    q AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h,
        min(page_id) OVER (PARTITION BY payload) AS first FROM p)
    SELECT page_id, payload_bytes,
        array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (({five} >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to
    FROM q"""


def vector_codes_sql() -> str:
    """Every pass as a table of its own: ``b`` are codebooks, ``a`` the nearest entries."""
    ctes = [
        """k AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings WHERE len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""v AS MATERIALIZED (SELECT vec_id, CAST(i AS BIGINT) AS i, CAST(i * {PARTS} // len(embedding) AS BIGINT) AS part,
            CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * {SCALE}) AS BIGINT) AS x
            FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM k))""",
        f"""b0 AS MATERIALIZED (SELECT row_number() OVER (PARTITION BY i ORDER BY vec_id) - 1 AS entry, part, i, x FROM v
            WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES}))""",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM (
                SELECT vec_id, v.part, entry, sum((v.x - b.x) * (v.x - b.x)) AS d FROM v JOIN b{r} b USING (i) GROUP BY vec_id, v.part, entry)
                QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)"""
        )
        if r < ROUNDS:
            ctes.append(
                f"""b{r + 1} AS MATERIALIZED (SELECT b.entry, b.part, b.i, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
                    SELECT entry, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
                        SELECT entry, i, sum(v.x) AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id, part) GROUP BY entry, i)
                ) m ON m.entry = b.entry AND m.i = b.i)"""
            )
    return f"""WITH {", ".join(ctes)},
        e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM a{ROUNDS} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i)) FROM b{ROUNDS}) AS codebooks_sha256
        FROM e JOIN k USING (vec_id)"""

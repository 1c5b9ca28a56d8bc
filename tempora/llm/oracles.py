"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM f
    """,
    "op8_units": r"""
        WITH f AS (
            SELECT doc_id, coalesce(text, '') AS text, lower(translate(coalesce(text, ''), '、。！，：；？', repeat(chr(10), 7))) AS low FROM documents
        ), x AS (
            SELECT doc_id, low, regexp_extract_all(low, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS parts FROM f
        ), p AS (
            SELECT doc_id, length(low) AS size, generate_subscripts(parts, 1) AS k, unnest(parts) AS part FROM x
        ), w AS (
            SELECT doc_id, k, regexp_replace(part, '[\x20\x09-\x0D]+$', '') AS word,
                   size - sum(length(part)) OVER (PARTITION BY doc_id) + sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k) - length(part) AS start,
                   contains(part, chr(10)) OR regexp_matches(part, '[,;:.!?][\x20\x09-\x0D]*$') OR k = max(k) OVER (PARTITION BY doc_id) AS mark
            FROM p
        ), c AS (
            SELECT *, coalesce(sum(CAST(mark AS INT)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM w
        ), e AS (
            SELECT *, mark OR (count(*) OVER (PARTITION BY doc_id, stretch) > 12 AND length(word) <= 3) AS last FROM c
        ), b AS (
            SELECT *, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY k), true) AS opens FROM e
        ), r AS (
            SELECT o.doc_id, o.k AS a, z.k AS z FROM (SELECT doc_id, k FROM b WHERE opens) o
            ASOF JOIN (SELECT doc_id, k FROM b WHERE last) z ON o.doc_id = z.doc_id AND o.k + 24 <= z.k
        ), l AS (
            SELECT doc_id, list(word ORDER BY k) AS words FROM b GROUP BY doc_id
        ), u AS (
            SELECT r.*, md5(array_to_string(list_slice(words, a, z), ' ')) AS form FROM r JOIN l USING (doc_id)
        ), g AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id, form ORDER BY a) > 1 OR doc_id > min(doc_id) OVER (PARTITION BY form) AS gone FROM u
        ), t AS (
            SELECT doc_id, k, sum(d) AS d FROM (SELECT doc_id, a AS k, 1 AS d FROM g WHERE gone UNION ALL SELECT doc_id, z + 1, -1 FROM g WHERE gone) q GROUP BY doc_id, k
        ), v AS (
            SELECT b.doc_id, b.k, b.start, b.start + length(b.word) AS stop, sum(coalesce(t.d, 0)) OVER (PARTITION BY b.doc_id ORDER BY b.k) > 0 AS gone FROM b LEFT JOIN t ON t.doc_id = b.doc_id AND t.k = b.k
        ), i AS (
            SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM v WHERE gone
        ), s AS (
            SELECT doc_id, CAST(min(start) AS BIGINT) AS a, CAST(max(stop) AS BIGINT) AS z FROM i GROUP BY doc_id, island
        ), h AS (
            SELECT s.*, f.text, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS free FROM s JOIN f USING (doc_id)
        ), m AS (
            SELECT doc_id, count(*) AS n, string_agg(a || ':' || z, ',' ORDER BY a) AS removed, string_agg(substr(text, free + 1, a - free), '' ORDER BY a) || substr(any_value(text), max(z) + 1) AS kept FROM h GROUP BY doc_id
        ), n AS (
            SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id
        )
        SELECT f.doc_id, coalesce(n.n, 0) AS n_units, coalesce(m.n, 0) AS n_removed, coalesce(m.removed, '') AS removed, sha256(coalesce(m.kept, f.text)) AS kept_sha256
        FROM f LEFT JOIN m ON m.doc_id = f.doc_id LEFT JOIN n ON n.doc_id = f.doc_id
    """,
}

"""The registered query of each operator, and DuckDB SQL where that can state it."""

from .language_model import op1_language_model
from .lines import op7_lines
from .media import op8_media
from .mixing import op9_mixing
from .pieces import op3_pieces
from .quality import op5_quality
from .secrets import op2_secrets, op2_sql
from .simhash import op10_simhash
from .substrings import op4_substrings
from .warc import op6_warc

QUERIES = {"op1_language_model": op1_language_model, "op2_secrets": op2_secrets, "op3_pieces": op3_pieces, "op4_substrings": op4_substrings, "op5_quality": op5_quality, "op6_warc": op6_warc, "op7_lines": op7_lines, "op8_media": op8_media, "op9_mixing": op9_mixing, "op10_simhash": op10_simhash}
ORACLE_SQL: dict[str, str] = {
    "op2_secrets": op2_sql(),
    "op6_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id > first_id THEN first_id END AS refers_to
        FROM f
    """,
    # windows by the hash of their words; what they cover is taken out word by word
    "op4_substrings": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
        l AS (SELECT h, min(doc_id) AS least FROM v GROUP BY h),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM v JOIN l USING (h) WHERE doc_id > least),
        k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN g USING (doc_id, i) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
    """,
    # lines within one edit share a half, and differ in one character behind which all is equal
    "op7_lines": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
        a AS (SELECT doc_id, i, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word FROM (SELECT doc_id, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS i FROM d)),
        f AS (SELECT line, doc_id AS d0, i AS i0, length(line) AS n FROM a WHERE has_word QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, i) = 1),
        t AS (SELECT *, unnest([n, n - 1]) AS l FROM f WHERE n >= 20),
        u AS (SELECT *, unnest([left(line, l // 2), right(line, l - l // 2)]) AS part, unnest([1, 2]) AS side FROM t),
        c AS (SELECT DISTINCT x.line AS a, y.line AS b, x.n, x.d0 AS da, x.i0 AS ia, y.d0 AS db, y.i0 AS ib FROM u x JOIN u y ON x.l = x.n AND y.l = x.n AND x.side = y.side AND x.part = y.part AND x.line <> y.line),
        e AS (SELECT *, coalesce(list_min(list_filter(range(1, n + 1), lambda k: a[k] <> b[k])), n + 1) AS k FROM c),
        z AS (SELECT DISTINCT CASE WHEN (da, ia) < (db, ib) THEN b ELSE a END AS line FROM e WHERE CASE WHEN length(b) = n THEN a[k + 1:] = b[k + 1:] ELSE a[k:] = b[k + 1:] END),
        m AS (SELECT a.*, z.line IS NOT NULL AS near, has_word AND NOT (doc_id = d0 AND a.i = i0) AS again FROM a LEFT JOIN z ON z.line = a.line AND has_word LEFT JOIN f ON f.line = a.line)
        SELECT doc_id, count(*) FILTER (WHERE has_word) AS n_lines, count(*) FILTER (WHERE again AND NOT near) AS n_exact, count(*) FILTER (WHERE near) AS n_near,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT near AND NOT coalesce(again, false)), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
}

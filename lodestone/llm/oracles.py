"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Base 32 of the digest: 40 hex digits are eight groups of 20 bits, four letters each.
op2_warc = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h),
b AS (SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || d[5 * g + 1:5 * g + 5] AS BIGINT)) AS v FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda n: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((v[n // 4 + 1] >> (15 - 5 * (n % 4))) & 31)]), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM b JOIN k USING (h)
"""

op10_substring_dedup = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS o FROM g JOIN m USING (k) WHERE least < doc_id)),
each AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


_CODED = "SELECT pos, row, min(d) AS d, arg_min(e, (d, e)) AS e FROM (SELECT p.pos, p.row, c.e, list_sum(list_transform(list_zip(p.part, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{k} c USING (pos)) GROUP BY pos, row"
_LEARNED = """c{n} AS MATERIALIZED (SELECT c.pos, c.e, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN (
  SELECT pos, e, list(x ORDER BY i) AS c FROM (SELECT a.pos, a.e, i, CAST(floor(sum(p.part[i]) / count(*)) AS BIGINT) AS x FROM a{k} a JOIN p USING (pos, row), unnest(range(1, len(p.part) + 1)) AS u(i) GROUP BY ALL) GROUP BY pos, e) m USING (pos, e))"""

#: Four rounds of Lloyd, each an assignment of all parts to the entries and the entries' new means.
op13_codebooks = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, pos, q[pos * len(q) // 4 + 1:(pos + 1) * len(q) // 4] AS part FROM v, unnest(range(0, 4)) AS u(pos)),
c0 AS MATERIALIZED (SELECT pos, row - 1 AS e, part AS c FROM p WHERE row <= 256),
{", ".join(f"a{k} AS MATERIALIZED ({_CODED.format(k=k)})" + (", " + _LEARNED.format(k=k, n=k + 1) if k < 4 else "") for k in range(5))},
f AS (SELECT row, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY row),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN f USING (row), s
"""


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in globals().items() if name.startswith("op")}

"""The views of ``sources.views`` as DuckDB SQL, for the oracles."""

from __future__ import annotations

HASH = "sha256(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))))"
MEM = f"""mem AS (SELECT *, CASE WHEN status IN ('superseded', 'archived') THEN observed_at + to_days(CAST(1 + id % 60 AS INT))
  WHEN id % 20 = 11 THEN TIMESTAMP '2024-12-31' END AS valid_until FROM (SELECT doc_id AS id, text AS content,
  (['episodic','semantic','procedural','decision','failure','preference'])[doc_id % 6 + 1] AS type,
  CASE WHEN doc_id % 20 < 12 THEN 'active' WHEN doc_id % 20 < 14 THEN 'stale' WHEN doc_id % 20 < 17 THEN 'superseded' WHEN doc_id % 20 = 17 THEN 'disputed' ELSE 'archived' END AS status,
  CASE WHEN doc_id % 10 <> 9 THEN 'p' || (doc_id % 4) END AS project_id, CASE WHEN doc_id % 10 = 9 THEN 'u' || (doc_id % 3) END AS user_id,
  CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS importance, CAST((doc_id * 53) % 101 AS DOUBLE) / 100 AS confidence, doc_id % 13 AS access_count,
  TIMESTAMP '2024-01-01' + to_hours(doc_id % 4000) AS observed_at, TIMESTAMP '2024-01-01' + to_hours(doc_id % 4000) AS valid_from,
  {HASH.format("text")} AS content_hash,
  (['conversation','tool','file','commit','document','explicit','derived','import'])[doc_id % 8 + 1] AS source_kind FROM documents))"""
NOW = "TIMESTAMP '2024-07-01'"
HALF_LIFE = "(CASE type WHEN 'episodic' THEN 30.0::DOUBLE WHEN 'semantic' THEN 400 WHEN 'procedural' THEN 180 WHEN 'decision' THEN 400 WHEN 'failure' THEN 180 WHEN 'preference' THEN 400 ELSE 180 END)"
RECENCY = f"pow(0.5::DOUBLE, greatest(0, date_diff('second', observed_at, {NOW}) / 86400.0::DOUBLE) / {HALF_LIFE})"
ACCESS = "least(1.0::DOUBLE, ln(1.0::DOUBLE + access_count) / ln(11.0::DOUBLE))"
EDGES = """edges AS (SELECT src, dst, relation, min(id) AS id, min(valid_from) AS valid_from FROM (SELECT l_orderkey % nd AS src, l_partkey % nd AS dst,
  'r' || l_linenumber AS relation, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, l_shipdate AS valid_from
  FROM lineitem, (SELECT count(*) AS nd FROM documents)) WHERE src <> dst GROUP BY src, dst, relation)"""
BOUND = "bound AS (SELECT DISTINCT id, entity_id FROM (SELECT doc_id AS id, unnest([doc_id % 25, (doc_id * 7 + 3) % 25]) AS entity_id FROM documents))"
STATEMENTS = f"""{MEM}, claims AS (SELECT * REPLACE ('Version:  tool ' || chr(CAST(97 + id % 26 AS INT)) || ' ' || (id % 7) || '.' || (id % 3) || ' in group g' || substr(md5(CAST(id // 40 AS VARCHAR)), 1, 4) AS content) FROM mem)"""
EVENTS = """ev AS (SELECT event_id AS id, event_type AS kind, 'p' || (user_id % 5) AS project_id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS session_id,
  ts AS occurred_at, user_id, json_extract_string(props, '$.k') AS k, sha256(event_type || '|' || props) AS content_hash FROM events)"""

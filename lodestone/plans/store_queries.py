"""Queries over the store's logs, code memory, extraction and skills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal
from ..operators import code, extraction, metrics, skills, store
from ..sources import views
from .more_queries import _SAID, _any_sql, _first_sql, _lines, _lines_sql
from .registry import query
from .views_sql import BOUND, EDGES, EVENTS, MEM, NOW

now = lambda: temporal.at(views.NOW)
_LOG = "lg AS (SELECT id, 1 AS seq, CASE WHEN id % 2 = 0 THEN occurred_at END AS processed_at, id % 5 = 0 AS needs_review, CASE WHEN id % 3 = 0 THEN 'boom' END AS process_error FROM ev UNION ALL SELECT id, 2, occurred_at, false, NULL FROM ev WHERE id % 3 = 0)"


def _log(spark, d):
    e = views.events(spark, d)
    first = e.select("id", F.lit(1).alias("seq"), F.expr("CASE WHEN id % 2 = 0 THEN occurred_at END AS processed_at"), F.expr("id % 5 = 0 AS needs_review"), F.expr("CASE WHEN id % 3 = 0 THEN 'boom' END AS process_error"))
    return e, first.union(e.where("id % 3 = 0").select("id", F.lit(2), "occurred_at", F.lit(False), F.lit(None).cast("string")))


@query("pending_events", f"WITH {EVENTS}, {_LOG} SELECT id, occurred_at FROM ev WHERE id NOT IN (SELECT id FROM lg WHERE processed_at IS NOT NULL) ORDER BY occurred_at, id LIMIT 100")
def pending_events(spark, d):
    e, log = _log(spark, d)
    return store.pending(e, log, 100).select("id", "occurred_at")


@query("event_processing", f"WITH {EVENTS}, {_LOG} SELECT id, arg_max_null(processed_at, seq) AS processed_at, arg_max_null(needs_review, seq) AS needs_review, arg_max_null(process_error, seq) AS process_error FROM lg GROUP BY id")
def event_processing(spark, d):
    return store.processing(_log(spark, d)[1])


_SOURCES = "src AS (SELECT CAST(n_nationkey AS BIGINT) AS source_id, n_name AS uri, 'file' AS kind FROM nation), ent AS (SELECT CAST(n_nationkey AS BIGINT) AS entity_id, lower(n_name) AS name FROM nation)"


def _dims(spark, d):
    n = views.read(spark, d, "nation")
    k = F.col("n_nationkey").cast("long")
    return n.select(k.alias("source_id"), F.col("n_name").alias("uri"), F.lit("file").alias("kind")), n.select(k.alias("entity_id"), F.lower("n_name").alias("name"))


@query("memories_hydrated", f"""WITH {MEM}, {BOUND}, {_SOURCES}, e AS (SELECT id, string_agg(name, ',' ORDER BY (id + entity_id) % 3 DESC, entity_id) AS names FROM bound JOIN ent USING (entity_id) GROUP BY id)
  SELECT mem.id, uri, names, CASE WHEN type = 'decision' THEN 'p' || mem.id END AS decision FROM mem JOIN src ON source_id = mem.id % 25 JOIN e USING (id)""")
def memories_hydrated(spark, d):
    sources, entities = _dims(spark, d)
    m = views.memories(spark, d).withColumn("source_id", F.col("id") % 25)
    bound = views.memory_entities(spark, d).withColumn("weight", (F.col("id") + F.col("entity_id")) % 3)
    decisions = m.where("type = 'decision'").select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("text"))
    out = store.hydrated(m, sources, bound, entities, decisions)
    return out.select("id", F.col("source.uri").alias("uri"), F.array_join(F.transform("entities", lambda x: x["name"]), ",").alias("names"), F.col("decision.text").alias("decision"))


@query("fetch_by_ids", f"WITH {MEM}, w AS (SELECT (o_orderkey * 7919) % 5000 AS id, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderkey < 40) SELECT pos, id, type FROM w JOIN mem USING (id)")
def fetch_by_ids(spark, d):
    from pyspark.sql.window import Window

    o = views.read(spark, d, "orders").where("o_orderkey < 40")
    wanted = o.select(((F.col("o_orderkey") * 7919) % 5000).alias("id"), F.row_number().over(Window.orderBy("o_orderkey")).alias("pos"))
    return store.fetched(views.memories(spark, d).select("id", "type"), wanted).select("pos", "id", "type")


@query("entity_registry", """WITH e AS (SELECT c_custkey AS entity_id, CASE c_custkey % 3 WHEN 0 THEN 'p1' WHEN 1 THEN 'p2' END AS project_id, CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 1 END AS merged_into, TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 100 AS INT)) AS created_at FROM customer)
  SELECT entity_id, project_id FROM e WHERE merged_into IS NULL AND (project_id IS NULL OR project_id = 'p1')""")
def entity_registry(spark, d):
    k = F.col("c_custkey")
    e = views.read(spark, d, "customer").select(k.alias("entity_id"), F.when(k % 3 == 0, "p1").when(k % 3 == 1, "p2").alias("project_id"), F.when(k % 7 == 0, k + 1).alias("merged_into"), F.timestamp_add("HOUR", (k % 100).cast("int"), temporal.at("2024-01-01 00:00:00")).alias("created_at"))
    return store.registry(e, "p1").select("entity_id", "project_id")


@query("entities_merged", """WITH RECURSIVE c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 < 5 AND c_custkey + 1 < (SELECT count(*) FROM customer) THEN c_custkey + 1 END AS up FROM customer),
  w AS (SELECT id, id AS tip FROM c UNION ALL SELECT w.id, c.up FROM w JOIN c ON c.id = w.tip WHERE c.up IS NOT NULL) SELECT id, max(tip) AS entity_id FROM w GROUP BY id""")
def entities_merged(spark, d):
    k = views.read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    n = k.agg(F.count("*").alias("n"))
    return store.merged_entities(k.crossJoin(F.broadcast(n)).select("id", F.when((F.col("id") % 6 < 5) & (F.col("id") + 1 < F.col("n")), F.col("id") + 1).alias("merged_into")))


@query("edges_inserted", f"WITH {EDGES}, p AS (SELECT * FROM edges WHERE id % 3 = 0) SELECT min(e.id) AS id, src, dst, relation FROM edges e ANTI JOIN p USING (src, dst, relation) GROUP BY src, dst, relation")
def edges_inserted(spark, d):
    e = views.edges(spark, d)
    return store.new_edges(e.union(e), e.where("id % 3 = 0"))


@query("memories_inserted", f"""WITH {MEM}, p AS (SELECT * FROM mem WHERE id % 4 = 0), c AS (SELECT id, project_id, user_id, type, content_hash FROM mem WHERE id % 4 <> 0), k AS (SELECT *, min(id) OVER (PARTITION BY project_id, user_id, type, content_hash) AS first FROM c),
  t AS (SELECT project_id, user_id, type, content_hash, min(id) AS there FROM p GROUP BY ALL)
  SELECT k.id, CASE WHEN there IS NULL AND k.id = first THEN 'inserted' ELSE 'duplicate' END AS outcome, coalesce(there, first) AS stands FROM k LEFT JOIN t ON k.project_id IS NOT DISTINCT FROM t.project_id AND k.user_id IS NOT DISTINCT FROM t.user_id AND k.type = t.type AND k.content_hash = t.content_hash""")
def memories_inserted(spark, d):
    m = views.memories(spark, d)
    return store.inserted(m.where("id % 4 <> 0"), m.where("id % 4 = 0"))[0].select("id", "outcome", "stands")


_NEW = "(['active','stale','superseded','disputed','archived'])[id % 5 + 1]"


@query("status_audit", f"""WITH {MEM}, c AS (SELECT id, status AS old, {_NEW} AS new FROM mem) SELECT id AS memory_id, CASE WHEN new = 'archived' THEN 'archived' WHEN new = 'active' AND old <> 'active' THEN 'restored' ELSE 'status_changed' END AS action, old AS from_status, new AS to_status
  FROM c WHERE (old, new) IN (('active','stale'), ('active','superseded'), ('active','disputed'), ('active','archived'), ('stale','active'), ('stale','superseded'), ('stale','archived'), ('superseded','archived'), ('disputed','active'), ('disputed','stale'), ('disputed','superseded'), ('disputed','archived'), ('archived','active'))""")
def status_audit(spark, d):
    m = views.memories(spark, d)
    new = F.element_at(F.array(*map(F.lit, ("active", "stale", "superseded", "disputed", "archived"))), (F.col("id") % 5 + 1).cast("int"))
    return store.status_changes(m, m.select("id", new.alias("new"), F.col("observed_at").alias("at")), "system")[1].drop("actor", "at")


@query("supersessions", f"""WITH {MEM}, w AS (SELECT id + 100000 AS id, (id * 3) % 1500 AS loser_id, observed_at FROM mem WHERE id % 5 = 0), r AS (SELECT w.*, status AS old, valid_from AS since FROM w LEFT JOIN mem l ON l.id = loser_id),
  o AS (SELECT *, CASE WHEN old IS NULL THEN 'gone' WHEN since >= observed_at THEN 'not_later' WHEN old NOT IN ('active', 'stale', 'disputed') THEN 'illegal' ELSE 'superseded' END AS outcome FROM (SELECT w.*, l.status AS old, l.valid_from AS since FROM w LEFT JOIN mem l ON l.id = w.loser_id))
  SELECT id, 'active' AS status, NULL::TIMESTAMP AS valid_until, NULL::BIGINT AS superseded_by, outcome FROM o WHERE outcome = 'superseded' UNION ALL SELECT loser_id, 'superseded', observed_at, id, outcome FROM o WHERE outcome = 'superseded'
  UNION ALL SELECT id, NULL, NULL, loser_id, outcome FROM o WHERE outcome <> 'superseded'""")
def supersessions(spark, d):
    m = views.memories(spark, d)
    return store.superseded(m, m.where("id % 5 = 0").select((F.col("id") + 100000).alias("id"), ((F.col("id") * 3) % 1500).alias("loser_id"), "observed_at"))


@query("service_calls", f"""WITH {MEM}, a AS (SELECT id, status, (['forget', 'restore', 'purge'])[id % 3 + 1] AS call FROM mem), r AS (SELECT *, CASE call WHEN 'purge' THEN status = 'archived' WHEN 'restore' THEN status = 'archived' ELSE status IN ('active', 'stale', 'superseded', 'disputed') END AS done FROM a)
  SELECT id, call, done, CASE WHEN NOT done THEN status WHEN call = 'forget' THEN 'archived' WHEN call = 'restore' THEN 'active' END AS new_status FROM r""")
def service_calls(spark, d):
    m = views.memories(spark, d)
    call = F.element_at(F.array(F.lit("forget"), F.lit("restore"), F.lit("purge")), (F.col("id") % 3 + 1).cast("int"))
    return store.served_changes(m, m.select("id", call.alias("call")))


@query("revised_memories", f"""WITH {MEM}, u AS (SELECT (id * 2) AS id, id % 3 AS revision FROM mem) SELECT u.id, u.revision, CASE WHEN mem.id IS NULL THEN 'gone' WHEN mem.id % 4 <> u.revision THEN 'conflict' ELSE 'updated' END AS outcome FROM u LEFT JOIN mem USING (id)""")
def revised_memories(spark, d):
    m = views.memories(spark, d).select("id", (F.col("id") % 4).alias("revision"))
    return store.revised(m, m.select((F.col("id") * 2).alias("id"), (F.col("id") % 3).alias("revision"))).select("id", "revision", "outcome")


@query("session_upserts", f"""WITH {EVENTS}, u AS (SELECT session_id AS id, id AS seq, occurred_at AS started_at, CASE WHEN kind = 'purchase' THEN occurred_at END AS ended_at, CASE WHEN kind = 'click' THEN 's' || id END AS summary FROM ev)
  SELECT id, min_by(started_at, seq) AS started_at, max_by(ended_at, seq) FILTER (ended_at IS NOT NULL) AS ended_at, max_by(summary, seq) FILTER (summary IS NOT NULL) AS summary FROM u GROUP BY id""")
def session_upserts(spark, d):
    e = views.events(spark, d)
    return store.sessions(e.select(F.col("session_id").alias("id"), F.col("id").alias("seq"), F.col("occurred_at").alias("started_at"), F.when(F.col("kind") == "purchase", F.col("occurred_at")).alias("ended_at"), F.when(F.col("kind") == "click", F.concat(F.lit("s"), F.col("id").cast("string"))).alias("summary")))


_SCRATCH = """w AS (SELECT conv_id * 1000 + turn AS id, 'p' || (conv_id % 3) AS project_id, CASE WHEN conv_id % 9 = 0 THEN conv_id END AS promoted_memory_id, CASE WHEN conv_id % 4 <> 0 THEN conv_id END AS source_id, turn % 3 AS evidence, CAST(conv_id % 10 AS DOUBLE) / 10 AS importance, 'note ' || (conv_id % 20) || ' ' || turn AS content,
  TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INT)) AS created_at, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id + 24 AS INT)) AS expires_at FROM conversations)"""


def _scratch(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    at = lambda h: F.timestamp_add("HOUR", h.cast("int"), temporal.at("2024-01-01 00:00:00"))
    return views.read(spark, d, "conversations").select(
        (c * 1000 + t).alias("id"), F.concat(F.lit("p"), (c % 3).cast("string")).alias("project_id"), F.when(c % 9 == 0, c).alias("promoted_memory_id"), F.when(c % 4 != 0, c).alias("source_id"), (t % 3).alias("evidence"),
        (c % 10 / 10.0).alias("importance"), F.concat(F.lit("note "), (c % 20).cast("string"), F.lit(" "), t.cast("string")).alias("content"), at(c).alias("created_at"), at(c + 24).alias("expires_at"))


@query("session_end_counts", f"""WITH {_SCRATCH}, d AS (SELECT *, CASE WHEN promoted_memory_id IS NOT NULL THEN 'already_promoted' WHEN source_id IS NULL THEN 'no_source' WHEN evidence = 0 THEN 'no_evidence' WHEN importance < 0.5 THEN 'below_importance_threshold' ELSE 'eligible' END AS decision FROM w),
  p AS (SELECT *, min(CASE WHEN decision = 'eligible' THEN id END) OVER (PARTITION BY project_id, content, decision) AS first FROM d)
  SELECT CASE WHEN decision <> 'eligible' THEN decision WHEN id = first THEN 'inserted' ELSE 'duplicate' END AS outcome, count(*) AS n FROM p GROUP BY 1""")
def session_end_counts(spark, d):
    none = views.memories(spark, d).where("false")
    return store.session_end(_scratch(spark, d), none, temporal.at("2024-01-08 00:00:00"))[1]


@query("event_digest_rows", f"""WITH {EVENTS}, a AS (SELECT l_orderkey % 2000 AS event_id, CAST(l_suppkey AS BIGINT) AS source_id FROM lineitem), s AS (SELECT event_id, array_to_string(list_sort(list_distinct(list(source_id))), ',') AS ids FROM a GROUP BY event_id)
  SELECT id, kind, CASE WHEN trim(l) = '' THEN kind || ' (empty payload)' WHEN length(trim(l)) > 40 THEN left(trim(l), 39) || '…' ELSE trim(l) END AS summary, CAST(octet_length(encode(p)) AS BIGINT) AS payload_bytes, coalesce(ids, '') AS source_ids
  FROM (SELECT id, kind, CASE WHEN id % 10 = 0 THEN '  ' ELSE regexp_replace('event  of ' || kind || repeat(' é word', CAST(id % 9 AS INT)), '\\s+', ' ', 'g') END AS l, '{{"k": "é' || id || '"}}' AS p FROM ev) LEFT JOIN s ON event_id = id""")
def event_digest_rows(spark, d):
    i = F.col("id").cast("string")
    e = views.events(spark, d).select("id", "kind", F.when(F.col("id") % 10 == 0, "  ").otherwise(F.concat(F.lit("event  of "), "kind", F.repeat(F.lit(" é word"), (F.col("id") % 9).cast("int")))).alias("line"), F.concat(F.lit('{"k": "é'), i, F.lit('"}')).alias("payload"))
    anchored = views.read(spark, d, "lineitem").select((F.col("l_orderkey") % 2000).alias("event_id"), F.col("l_suppkey").cast("long").alias("source_id"))
    return store.event_digests(e, anchored, 40).withColumn("source_ids", F.array_join("source_ids", ","))


@query("vector_upserts", """WITH l AS (SELECT vec_id % 200 AS id, vec_id AS seq, 'm' || (vec_id % 2) AS model, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN embedding[1:3] ELSE embedding END AS e FROM embeddings),
  g AS (SELECT * FROM l WHERE e IS NULL OR len(e) = 64), k AS (SELECT id, max(seq) AS seq FROM g GROUP BY id) SELECT id, model, round(CAST(e[1] AS DOUBLE), 6) AS first FROM k JOIN g USING (id, seq) WHERE e IS NOT NULL""")
def vector_upserts(spark, d):
    k = F.col("vec_id")
    log = views.read(spark, d, "embeddings").select((k % 200).alias("id"), k.alias("seq"), F.concat(F.lit("m"), (k % 2).cast("string")).alias("model"), F.when(k % 11 == 0, None).when(k % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding"))
    return store.upserted_vectors(log, 64)[0].select("id", "model", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("embedding_pool", f"WITH {MEM} SELECT content_hash, count(*) AS copies, min(id) AS first FROM mem WHERE id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) GROUP BY content_hash")
def embedding_pool(spark, d):
    have = views.read(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), F.lit("m").alias("model"))
    return store.to_embed(views.memories(spark, d), have, "m").select("content_hash", "copies", "first")


_FILES = "fl AS (SELECT 'r' || (page_id % 2) AS repository, 'src/' || (page_id % 9) || '/f' || page_id || (['.ts', '.py', '.tsx', '', '.md'])[page_id % 5 + 1] AS path FROM pages)"


def _files(spark, d):
    k = F.col("page_id")
    end = F.element_at(F.array(*map(F.lit, (".ts", ".py", ".tsx", "", ".md"))), (k % 5 + 1).cast("int"))
    return views.read(spark, d, "pages").select(F.concat(F.lit("r"), (k % 2).cast("string")).alias("repository"), F.concat(F.lit("src/"), (k % 9).cast("string"), F.lit("/f"), k.cast("string"), end).alias("path"))


@query("language_mix", f"""WITH {_FILES}, g AS (SELECT repository, CASE WHEN path LIKE '%.ts' THEN 'ts' WHEN path LIKE '%.py' THEN 'py' WHEN path LIKE '%.tsx' THEN 'tsx' WHEN path LIKE '%.md' THEN 'md' ELSE 'other' END AS language, count(DISTINCT path) AS files FROM fl GROUP BY ALL)
  SELECT repository, language, files, row_number() OVER (PARTITION BY repository ORDER BY files DESC, language) AS position FROM g QUALIFY position <= 4""")
def language_mix(spark, d):
    return code.language_mix(_files(spark, d), 4)


_SYMBOLS = "sy AS (SELECT 'r' || (l_partkey % 2) AS repository, 'src/' || (l_partkey % 9) || '/s' AS path, (['function', 'class', 'const', 'type', 'enum', 'method'])[l_linenumber % 6 + 1] AS kind, 'n' || (l_suppkey % 50) AS name FROM lineitem)"


def _symbols(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("function", "class", "const", "type", "enum", "method"))), (F.col("l_linenumber") % 6 + 1).cast("int"))
    of = lambda c, n: (F.col(c) % n).cast("string")
    return views.read(spark, d, "lineitem").select(F.concat(F.lit("r"), of("l_partkey", 2)).alias("repository"), F.concat(F.lit("src/"), of("l_partkey", 9), F.lit("/s")).alias("path"), kind.alias("kind"), F.concat(F.lit("n"), of("l_suppkey", 50)).alias("name"))


@query("code_modules", f"""WITH {_FILES}, {_SYMBOLS}, p AS (SELECT repository, regexp_extract(path, '^(.+)/[^/]*$', 1) AS module, count(DISTINCT path) AS files FROM (SELECT repository, path FROM fl UNION SELECT repository, path FROM sy) GROUP BY ALL),
  s AS (SELECT repository, regexp_extract(path, '^(.+)/[^/]*$', 1) AS module, kind, name FROM sy), t AS (SELECT repository, module, count(*) AS symbols FROM s GROUP BY ALL),
  e AS (SELECT repository, module, name, min(list_position(['function', 'class', 'struct', 'interface', 'trait', 'enum', 'type', 'module'], kind)) AS rank FROM s WHERE list_contains(['function', 'class', 'struct', 'interface', 'trait', 'enum', 'type', 'module'], kind) GROUP BY ALL),
  f AS (SELECT repository, module, string_agg(name, ', ' ORDER BY rank, name) AS entry_points FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY repository, module ORDER BY rank, name) <= 3) GROUP BY ALL),
  k AS (SELECT repository, module, string_agg(n || ' ' || kind, ', ' ORDER BY n DESC, kind) AS kinds FROM (SELECT * FROM (SELECT repository, module, kind, count(*) AS n FROM s GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repository, module ORDER BY n DESC, kind) <= 4) GROUP BY ALL)
  SELECT repository, module, files, coalesce(symbols, 0) AS symbols, coalesce(entry_points, '') AS entry_points, coalesce(kinds, 'no symbols') AS kinds FROM p LEFT JOIN t USING (repository, module) LEFT JOIN f USING (repository, module) LEFT JOIN k USING (repository, module)""")
def code_modules(spark, d):
    return code.modules(_files(spark, d), _symbols(spark, d))


@query("architecture_digests")
def architecture_digests(spark, d):
    return code.architecture_digests(_files(spark, d), _symbols(spark, d))


@query("symbol_table_saves", """WITH a AS (SELECT page_id AS path, sha1(html) AS h FROM pages WHERE page_id % 7 <> 0), b AS (SELECT page_id AS path, CASE WHEN page_id % 5 = 0 THEN sha1(url) ELSE sha1(html) END AS h FROM pages WHERE page_id % 11 <> 0)
  SELECT path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'dropped' WHEN a.h = b.h THEN 'unchanged' ELSE 'rewritten' END AS outcome FROM a FULL JOIN b USING (path)""")
def symbol_table_saves(spark, d):
    p, k = views.read(spark, d, "pages"), F.col("page_id")
    return code.symbol_tables(p.where(k % 7 != 0).select(k.alias("path"), F.sha1("html").alias("hash")), p.where(k % 11 != 0).select(k.alias("path"), F.when(k % 5 == 0, F.sha1("url")).otherwise(F.sha1("html")).alias("hash")))


@query("snapshot_saves", """WITH a AS (SELECT page_id AS path, sha1(html) AS h FROM pages WHERE page_id % 7 <> 0), b AS (SELECT page_id AS path, CASE WHEN page_id % 5 = 0 THEN sha1(url) ELSE sha1(html) END AS h, page_id % 13 <> 0 AS ok FROM pages WHERE page_id % 11 <> 0)
  SELECT path, CASE WHEN ok IS NULL THEN 'deleted' WHEN NOT ok THEN 'retained' WHEN a.h IS NULL THEN 'added' WHEN a.h <> b.h THEN 'updated' ELSE 'unchanged' END AS outcome, CASE WHEN ok IS NULL THEN NULL WHEN NOT ok THEN a.h ELSE b.h END AS blob FROM a FULL JOIN b USING (path)""")
def snapshot_saves(spark, d):
    p, k = views.read(spark, d, "pages"), F.col("page_id")
    captured = p.where(k % 11 != 0).select(k.alias("path"), F.when(k % 5 == 0, F.sha1("url")).otherwise(F.sha1("html")).alias("blob"), (k % 13 != 0).alias("available"))
    return code.snapshot_saved(p.where(k % 7 != 0).select(k.alias("path"), F.sha1("html").alias("blob")), captured)


@query("drift_applications", f"""WITH {MEM}, r AS (SELECT id, (['valid', 'moved', 'content_changed', 'path_missing'])[(id + j) % 4 + 1] AS state FROM mem, (SELECT unnest([0, 2]) AS j)),
  g AS (SELECT id, count(*) FILTER (state = 'moved') AS retargeted, count(*) FILTER (state IN ('content_changed', 'path_missing')) AS lost FROM r GROUP BY id)
  SELECT id, retargeted, CASE WHEN lost > 0 AND status = 'active' THEN 'stale' ELSE status END AS status FROM g JOIN mem USING (id)""")
def drift_applications(spark, d):
    m = views.memories(spark, d)
    state = F.element_at(F.array(*map(F.lit, ("valid", "moved", "content_changed", "path_missing"))), ((F.col("id") + F.col("j")) % 4 + 1).cast("int"))
    return code.drift_applied(m.select("id", F.explode(F.array(F.lit(0), F.lit(2))).alias("j")).select("id", state.alias("state")), m)


@query("knowledge_renewed", f"""WITH {MEM}, s AS (SELECT id, type, content_hash, id % 40 AS path FROM mem WHERE status = 'stale'), c AS (SELECT id % 40 AS path, type, content_hash AS h, content, importance, confidence FROM mem WHERE id % 9 < 2),
  j AS (SELECT s.id, bool_or(h = content_hash) AS same, max_by(h, (importance, confidence, content)) AS best FROM s LEFT JOIN c USING (path, type) GROUP BY s.id)
  SELECT id, CASE WHEN same THEN 'refreshed' WHEN best IS NOT NULL THEN 'superseded' ELSE 'deferred' END AS outcome, CASE WHEN same IS DISTINCT FROM true THEN best END AS successor FROM j""")
def knowledge_renewed(spark, d):
    m = views.memories(spark, d).withColumn("path", F.col("id") % 40)
    return code.renewed(m.where("status = 'stale'"), m.where("id % 9 < 2"))


@query("token_efficiency", "SELECT 'b' || (doc_id % 4) AS bucket, count(*) AS queries, round(avg(CASE WHEN doc_id % 97 <= 90 THEN 1.0 ELSE 0.0 END), 4) AS compliance, round(avg((doc_id % 97) / (doc_id % 13 + 5.0)), 4) AS gap, round(max((doc_id % 97) / (doc_id % 13 + 5.0)), 4) AS most, round(coalesce(avg((doc_id % 97) / (doc_id % 13 + 5.0)) FILTER (doc_id % 3 = 0), 0), 4) AS gap_when_satisfied FROM documents GROUP BY 1")
def token_efficiency(spark, d):
    k = F.col("doc_id")
    q = views.read(spark, d, "documents").select(F.concat(F.lit("b"), (k % 4).cast("string")).alias("bucket"), (k % 97).alias("used"), F.lit(90).alias("budget"), (k % 13 + 5.0).alias("oracle"), (k % 3 == 0).alias("satisfied"))
    return metrics.token_efficiency(q, "bucket")


@query("pollution_audit", f"""WITH {MEM} SELECT 'stale_cited' AS finding, count(*) AS n FROM mem WHERE status = 'archived' AND observed_at + to_days(60) BETWEEN {NOW} - to_days(30) AND {NOW}
  UNION ALL SELECT 'unresolved', count(*) FROM mem WHERE id % 10 = 0 AND status NOT IN ('superseded', 'disputed')""")
def pollution_audit(spark, d):
    m = views.memories(spark, d)
    stale = metrics.stale_cited(m.withColumn("last_accessed_at", F.timestamp_add("DAY", F.lit(60), F.col("observed_at"))), now())
    sides = m.where("id % 10 = 0").select("id", F.lit("disputed").alias("expected"))
    count = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("finding"), "n")
    return count(stale, "stale_cited").union(count(metrics.unresolved(sides, m), "unresolved"))


def _agent_events(spark, d):
    """Conversations and events as an agent's events."""
    said = _lines(spark, d, _SAID)
    talk = said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("conversation.message").alias("kind"), F.to_json(F.struct(F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("text").alias("content"))).alias("payload"),
                       F.timestamp_add("MINUTE", (F.col("conv_id") * 7 + F.col("turn")).cast("int"), temporal.at("2024-01-01 00:00:00")).alias("occurred_at"), F.col("conv_id").cast("string").alias("session_id"), F.lit("p0").alias("project_id"))
    e = views.events(spark, d)
    runs = F.element_at(F.array(*map(F.lit, ("bun test", "git status", "make build", "npm run lint", "docker compose up -d"))), (F.col("k").cast("int") % 5 + 1))
    kinds = {"error": ("error.raised", F.to_json(F.struct(F.lit("build").alias("origin"), F.concat(F.lit("cannot find module part"), (F.col("k").cast("int") % 9).cast("string")).alias("message")))),
             "purchase": ("terminal.output", F.to_json(F.struct(runs.alias("command"), F.lit(0).alias("exit_code")))), "click": ("terminal.output", F.to_json(F.struct(runs.alias("command"), F.lit(1).alias("exit_code")))),
             "view": ("file.changed", F.to_json(F.struct(F.concat(F.lit("src/f"), "k").alias("path"), F.lit("modified").alias("change"))))}
    pick = lambda n: F.coalesce(*(F.when(F.col("kind") == k, F.lit(v[0]) if n == 0 else v[1]) for k, v in kinds.items()))
    run = e.where(F.col("kind").isin(*kinds)).select((F.col("id") + 10_000_000).alias("id"), pick(0).alias("kind"), pick(1).alias("payload"), "occurred_at", "session_id", "project_id")
    return talk.unionByName(run)


@query("statement_candidates", f"""WITH c AS (SELECT conv_id * 1000 + turn AS id, turn, text FROM ({_lines_sql(_SAID)})), v AS (SELECT id, turn, text, coalesce({_first_sql(extraction.rules.VERSIONS[:2])}, CASE WHEN regexp_matches(text, '(?i){extraction.rules.VERSIONS[2]}') THEN
    regexp_extract(text, '(?i){extraction.rules.VERSIONS[2]}', 1) || ' ' || regexp_extract(text, '(?i){extraction.rules.VERSIONS[2]}', 2) END) AS s FROM c WHERE NOT {_any_sql(extraction.rules.VERSION_NOISE)})
  SELECT id, 'version' AS rule, 'Version: ' || s AS content, CASE WHEN turn % 2 = 0 THEN 0.7 ELSE 0.6 END AS confidence FROM v WHERE regexp_matches(s, '[0-9]')""")
def statement_candidates(spark, d):
    return extraction.extracted(_agent_events(spark, d)).where("rule = 'version'").select("id", "rule", "content", "confidence")


_RUNS = "(['bun test','git status','make build','npm run lint','docker compose up'])[CAST(k AS INT) % 5 + 1]"


@query("procedure_candidates", f"""WITH {EVENTS}, r AS (SELECT id + 10000000 AS id, project_id, session_id, occurred_at, {_RUNS} AS normal FROM ev WHERE kind IN ('purchase', 'click') AND {_RUNS} <> 'git status'),
  p AS (SELECT *, normal || ' → ' || lead(normal) OVER (PARTITION BY project_id, session_id ORDER BY occurred_at, id) AS pair FROM r), s AS (SELECT project_id, session_id, pair, count(*) AS n FROM p WHERE pair IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
  i AS (SELECT DISTINCT project_id, unnest(string_split(pair, ' → ')) AS normal FROM s), c AS (SELECT project_id, normal, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 2)
  SELECT project_id, session_id, 'sequence' AS rule, 'Recurring command sequence: `' || pair || '` (' || n || ' times)' AS content FROM s
  UNION ALL SELECT project_id, NULL, 'command', 'Recurring command: `' || normal || '` (used ' || n || ' times)' FROM c ANTI JOIN i USING (project_id, normal)""")
def procedure_candidates(spark, d):
    return extraction.extracted(_agent_events(spark, d)).where("rule IN ('sequence', 'command')").select("project_id", "session_id", "rule", "content")


@query("extracted_candidates")
def extracted_candidates(spark, d):
    """All candidates of all rules, counted by rule and type."""
    return extraction.extracted(_agent_events(spark, d)).groupBy("rule", "type", "subtype").agg(F.count("*").alias("n"))


@query("working_signals")
def working_signals(spark, d):
    return extraction.working_signals(_agent_events(spark, d)).groupBy("signal").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"))


@query("dead_letters", """WITH e AS (SELECT event_id AS id, (['terminal.output', 'error.raised', 'custom.kind', 'file.changed'])[event_id % 4 + 1] AS kind, CASE WHEN event_id % 5 = 0 THEN '{"command": "x", "path": "p"}' WHEN event_id % 5 = 1 THEN '{"origin": "build", "message": "m", "path": "p", "change": "c"}' ELSE '{"command": "y", "origin": "o", "message": "m", "path": "p", "change": "c"}' END AS payload,
    CASE WHEN event_id % 17 <> 0 THEN ts END AS occurred_at FROM events)
  SELECT id, CASE kind WHEN 'custom.kind' THEN 'raw.unknown' ELSE kind END AS stored_kind, array_to_string(list_filter([CASE WHEN occurred_at IS NULL THEN 'occurred_at' END, CASE WHEN kind = 'terminal.output' AND json_extract_string(payload, '$.command') IS NULL THEN 'payload.command' END,
    CASE WHEN kind = 'error.raised' AND json_extract_string(payload, '$.origin') IS NULL THEN 'payload.origin' END, CASE WHEN kind = 'error.raised' AND json_extract_string(payload, '$.message') IS NULL THEN 'payload.message' END,
    CASE WHEN kind = 'file.changed' AND json_extract_string(payload, '$.path') IS NULL THEN 'payload.path' END, CASE WHEN kind = 'file.changed' AND json_extract_string(payload, '$.change') IS NULL THEN 'payload.change' END], lambda x: x IS NOT NULL), ',') AS issues FROM e""")
def dead_letters(spark, d):
    k = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("terminal.output", "error.raised", "custom.kind", "file.changed"))), (k % 4 + 1).cast("int"))
    payload = F.when(k % 5 == 0, '{"command": "x", "path": "p"}').when(k % 5 == 1, '{"origin": "build", "message": "m", "path": "p", "change": "c"}').otherwise('{"command": "y", "origin": "o", "message": "m", "path": "p", "change": "c"}')
    e = views.read(spark, d, "events").select(k.alias("id"), kind.alias("kind"), payload.alias("payload"), F.when(k % 17 != 0, F.col("ts")).alias("occurred_at"))
    return extraction.validated(e).select("id", "stored_kind", F.array_join("issues", ",").alias("issues"))


@query("skills_generated", """WITH g AS (SELECT 'p' || (p_partkey % 5) AS scope, md5(p_name) AS signature, 'Fix the ' || p_name || ' now' AS problem, list_sort(list(p_partkey)) AS ids FROM part GROUP BY 1, 2, 3),
  s AS (SELECT p_partkey AS id, 'p' || (p_partkey % 5) AS scope, 'fix-the-' || replace(p_name, ' ', '-') || '-now' AS name, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE -1 END AS had FROM part WHERE p_partkey % 50 = 3),
  h AS (SELECT g.scope, g.signature, min(s.id) AS skill_id FROM g, s WHERE g.scope = s.scope AND list_contains(g.ids, s.had) GROUP BY ALL),
  n AS (SELECT g.*, 'fix-the-' || regexp_replace(lower(regexp_extract(problem, 'Fix the (.*) now', 1)), ' ', '-', 'g') || '-now' AS base FROM g),
  r AS (SELECT n.*, h.skill_id, EXISTS (SELECT 1 FROM s WHERE s.scope = n.scope AND s.name = n.base) AS taken, row_number() OVER (PARTITION BY n.scope, base ORDER BY n.signature) AS k FROM n LEFT JOIN h USING (scope, signature))
  SELECT r.scope, signature, skill_id, CASE WHEN skill_id IS NULL THEN 'created' WHEN len(list_filter(ids, lambda x: x <> s.had)) = 0 THEN 'unchanged' ELSE 'refreshed' END AS outcome,
    CASE WHEN skill_id IS NULL THEN CASE WHEN NOT taken AND k = 1 THEN base ELSE base || '-' || substr(signature, 1, 8) END END AS name FROM r LEFT JOIN s ON s.id = skill_id""")
def skills_generated(spark, d):
    p, k = views.read(spark, d, "part"), F.col("p_partkey")
    scope = F.concat(F.lit("p"), (k % 5).cast("string"))
    groups = p.groupBy(scope.alias("scope"), F.md5("p_name").alias("signature"), F.concat(F.lit("Fix the "), "p_name", F.lit(" now")).alias("problem")).agg(F.array_sort(F.collect_list(k)).alias("failure_ids"))
    had = p.where(k % 50 == 3).select(k.alias("id"), scope.alias("scope"), F.concat(F.lit("fix-the-"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-now")).alias("name"), F.array(F.when(k % 2 == 0, k).otherwise(F.lit(-1).cast("long"))).alias("failure_ids"))
    return skills.generated(groups, had)

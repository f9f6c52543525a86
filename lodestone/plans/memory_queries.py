"""Queries over memories: reads, ranking, graph, lifecycle, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import INTENTS, STOPWORDS, TRANSITIONS
from ..functions import scoring, temporal, text
from ..operators import contradiction, graph, lifecycle, memory, metrics
from ..sources import views
from .registry import query
from .views_sql import ACCESS, BOUND, EDGES, EVENTS, HALF_LIFE, MEM, NOW, RECENCY, STATEMENTS

TERMS = ("thatin", "ononst", "inoran")
now = lambda: temporal.at(views.NOW)
CURRENT = f"status IN ('active','stale') AND valid_from <= {NOW} AND (valid_until IS NULL OR valid_until > {NOW})"
_COUNT = lambda t: f"len(list_filter(string_split_regex(lower(content), '[^a-z0-9.]+'), lambda x: x = '{t}'))"
_RANK = " + ".join(f"CASE WHEN {_COUNT(t)} > 0 THEN 0.1::DOUBLE * list_sum(list_transform(range(1, {_COUNT(t)} + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493406685::DOUBLE / {len(TERMS)} ELSE 0 END" for t in TERMS)
LEXICAL = f"""lex AS (SELECT *, row_number() OVER (ORDER BY ts_rank DESC, observed_at DESC, id DESC) AS lexical_rank FROM
  (SELECT *, round({_RANK}, 9) AS ts_rank FROM mem WHERE {CURRENT}) WHERE ts_rank > 0 QUALIFY lexical_rank <= 50)"""
AFFINITY = "CASE type WHEN 'semantic' THEN 0.1 WHEN 'episodic' THEN 0.03 WHEN 'decision' THEN 0.04 WHEN 'failure' THEN 0.02 WHEN 'procedural' THEN 0.04 WHEN 'preference' THEN 0.04 ELSE 0 END"
SCORE = f"0.12 * importance + 0.08 * confidence + 0.1 * {RECENCY} + 0.05 * {ACCESS} + 0.1 * CASE WHEN project_id = 'p1' THEN 1.0 WHEN project_id IS NULL THEN 0.4 ELSE 0.7 END + {AFFINITY}"


def _lexical(spark, d):
    return memory.lexical(views.memories(spark, d).where(temporal.is_current(now())), list(TERMS))


@query("current_lexical_topk", f"""WITH {MEM}, {LEXICAL}, s AS (SELECT id, type, lexical_rank, 0.16 * 61.0 / (60.0 + lexical_rank) + {SCORE} AS s FROM lex)
  SELECT id, type, lexical_rank, round(s, 6) AS score, round(s / 0.89, 6) AS relevance FROM s ORDER BY s DESC, id LIMIT 10""")
def current_lexical_topk(spark, d):
    hits = _lexical(spark, d)
    out = memory.scored(hits, scoring.contributions(now(), "fact", "p1", lexical=F.col("lexical_rank")), scoring.active_mass("fact", lexical=True, vector=False))
    return out.orderBy(F.col("score").desc(), "id").limit(10).select("id", "type", "lexical_rank", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"))


@query("query_current", f"WITH {MEM} SELECT id, observed_at FROM mem WHERE status IN ('active','stale') AND valid_until IS NULL")
def query_current(spark, d):
    return views.memories(spark, d).where(temporal.is_open_current()).select("id", "observed_at")


@query("current_window", f"WITH {MEM} SELECT id, status FROM mem WHERE {CURRENT}")
def current_window(spark, d):
    return views.memories(spark, d).where(temporal.is_current(now())).select("id", "status")


@query("query_as_of", f"""WITH {MEM} SELECT id, status FROM mem WHERE status <> 'disputed' AND valid_from <= TIMESTAMP '2024-02-15'
  AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-02-15')""")
def query_as_of(spark, d):
    return views.memories(spark, d).where(temporal.is_valid_at(temporal.at("2024-02-15 00:00:00"))).select("id", "status")


@query("overlap_window", f"""WITH {MEM} SELECT id FROM mem WHERE valid_from < TIMESTAMP '2024-03-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-02-01')""")
def overlap_window(spark, d):
    return views.memories(spark, d).where(temporal.overlaps(temporal.at("2024-02-01 00:00:00"), temporal.at("2024-03-01 00:00:00"))).select("id")


@query("scope_admission", f"WITH {MEM} SELECT id, project_id, user_id FROM mem WHERE project_id = 'p1' OR (project_id IS NULL AND user_id = 'u0')")
def scope_admission(spark, d):
    return views.memories(spark, d).where(temporal.in_scope("p1", "u0")).select("id", "project_id", "user_id")


@query("all_of_entities", f"WITH {BOUND} SELECT id FROM bound WHERE entity_id = 3 INTERSECT SELECT id FROM bound WHERE entity_id = 24")
def all_of_entities(spark, d):
    bound = views.memory_entities(spark, d)
    out = bound.select("id").distinct()
    for wanted in (3, 24):
        out = out.join(bound.where(F.col("entity_id") == wanted), "id", "left_semi")
    return out


@query("keyset_page", f"""WITH {MEM} SELECT id, observed_at FROM mem WHERE (observed_at, id) < (TIMESTAMP '2024-01-20', 500) ORDER BY observed_at DESC, id DESC LIMIT 26""")
def keyset_page(spark, d):
    return memory.page(views.memories(spark, d), ("2024-01-20 00:00:00", 500), 25).select("id", "observed_at")


@query("typed_by_importance", f"WITH {MEM} SELECT id, importance FROM mem WHERE type = 'decision' AND {CURRENT} ORDER BY importance DESC, observed_at DESC, id DESC LIMIT 20")
def typed_by_importance(spark, d):
    rows = views.memories(spark, d).where((F.col("type") == "decision") & temporal.is_current(now()))
    return rows.orderBy(F.col("importance").desc(), F.col("observed_at").desc(), F.col("id").desc()).limit(20).select("id", "importance")


@query("status_type_stats", f"WITH {MEM} SELECT status, type, count(*) AS n, count(DISTINCT project_id) AS projects FROM mem GROUP BY status, type")
def status_type_stats(spark, d):
    return views.memories(spark, d).groupBy("status", "type").agg(F.count("*").alias("n"), F.count_distinct("project_id").alias("projects"))


AUTHORITY = "CASE WHEN source_kind = 'explicit' THEN 4 WHEN type = 'decision' THEN 3 WHEN type IN ('semantic','procedural','failure','preference') THEN 2 WHEN type = 'episodic' THEN 1 ELSE 0 END"


@query("exact_dedupe", f"""WITH {MEM} SELECT project_id, user_id, content_hash, id, {AUTHORITY} AS authority, count(*) OVER g AS copies FROM mem
  WINDOW g AS (PARTITION BY project_id, user_id, content_hash) QUALIFY row_number() OVER (PARTITION BY project_id, user_id, content_hash
  ORDER BY authority DESC, confidence DESC, observed_at DESC, id) = 1""")
def exact_dedupe(spark, d):
    return memory.collapsed(views.memories(spark, d), ["project_id", "user_id"])


@query("supersession_history", """WITH RECURSIVE c AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 < 4 AND doc_id + 1 < (SELECT count(*) FROM documents) THEN doc_id + 1 END AS up FROM documents),
  w AS (SELECT id, id AS tip, 0 AS steps FROM c UNION ALL SELECT w.id, c.up, steps + 1 FROM w JOIN c ON c.id = w.tip WHERE c.up IS NOT NULL)
  SELECT id, max_by(tip, steps) AS tip, max(steps) AS steps FROM w GROUP BY id""")
def supersession_history(spark, d):
    docs = views.read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    n = docs.agg(F.count("*").alias("n"))
    chain = docs.crossJoin(F.broadcast(n)).select("id", F.when((F.col("id") % 5 < 4) & (F.col("id") + 1 < F.col("n")), F.col("id") + 1).alias("superseded_by"))
    return memory.history(chain)


VECTORS = """near AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings),
  vec AS (SELECT id, c AS cosine, row_number() OVER (ORDER BY round(c, 9) DESC, id) AS vector_rank FROM near WHERE c >= 0.05 QUALIFY vector_rank <= 50)"""


def _nearest(spark, d):
    vectors = views.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return memory.nearest(vectors, vectors.where("id = 0"))


@query("vector_knn", f"WITH {VECTORS} SELECT id, round(cosine, 6) AS cosine, vector_rank FROM vec")
def vector_knn(spark, d):
    return _nearest(spark, d).select("id", F.round("cosine", 6).alias("cosine"), "vector_rank")


@query("hybrid_fusion", f"""WITH {MEM}, {LEXICAL}, {VECTORS}, m AS (SELECT id, min(l) AS lexical_rank, min(v) AS vector_rank FROM (SELECT id, lexical_rank AS l, NULL AS v FROM lex
  UNION ALL SELECT id, NULL, vector_rank FROM vec) GROUP BY id), s AS (SELECT id, lexical_rank, vector_rank,
  coalesce(0.16 * 61.0 / (60.0 + lexical_rank), 0) + coalesce(0.2 * 61.0 / (60.0 + vector_rank), 0) + {SCORE} AS s FROM m JOIN mem USING (id) WHERE {CURRENT})
  SELECT id, lexical_rank, vector_rank, round(s, 6) AS score, round(s / 1.09, 6) AS relevance FROM s""")
def hybrid_fusion(spark, d):
    merged = memory.merged_channels(_lexical(spark, d), _nearest(spark, d)).drop("graph_boost")
    rows = merged.join(views.memories(spark, d).where(temporal.is_current(now())), "id")
    out = memory.scored(rows, scoring.contributions(now(), "fact", "p1", lexical=F.col("lexical_rank"), vector=F.col("vector_rank")), scoring.active_mass("fact", lexical=True, vector=True))
    return out.select("id", F.col("lexical_rank").cast("long").alias("lexical_rank"), F.col("vector_rank").cast("long").alias("vector_rank"), F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"))


@query("entity_round_robin", f"""WITH {MEM}, {BOUND}, p AS (SELECT id, row_number() OVER (PARTITION BY entity_id ORDER BY observed_at DESC, id DESC) AS pos,
  list_position([3, 24, 10], entity_id) - 1 AS turn FROM bound JOIN mem USING (id) WHERE entity_id IN (3, 24, 10) QUALIFY pos <= 30),
  o AS (SELECT id, min((pos, turn)) AS t FROM p GROUP BY id ORDER BY t, id LIMIT 60)
  SELECT id, t[1] AS pos, t[2] AS entity_index, row_number() OVER (ORDER BY t, id) AS rank FROM o""")
def entity_round_robin(spark, d):
    return graph.interleaved(views.memory_entities(spark, d), views.memories(spark, d).select("id", "observed_at"), [3, 24, 10])


@query("graph_expand_2hop", f"""WITH {EDGES}, v AS (SELECT * FROM edges WHERE valid_from <= TIMESTAMP '2001-01-01'), e AS (SELECT src, dst FROM v UNION SELECT dst, src FROM v), h1 AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (1, 2)),
  h2 AS (SELECT DISTINCT dst AS id FROM e JOIN h1 ON src = h1.id), a AS (SELECT id, 0 AS hop FROM (VALUES (1), (2)) t(id) UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)
  SELECT CAST(id AS BIGINT) AS id, min(hop) AS hop, round(pow(0.8::DOUBLE, min(hop)), 6) AS boost FROM a GROUP BY id""")
def graph_expand_2hop(spark, d):
    seeds = views.read(spark, d, "documents").where("doc_id IN (1, 2)").select(F.col("doc_id").alias("id"))
    return graph.expanded(views.edges(spark, d), seeds, at=temporal.at("2001-01-01 00:00:00")).withColumn("boost", F.round("boost", 6))


@query("graph_neighbours", f"""WITH {MEM}, {EDGES} SELECT n.id, relation, direction, type, importance FROM (SELECT dst AS id, relation, 'out' AS direction FROM edges WHERE src = 7
  UNION ALL SELECT src, relation, 'in' FROM edges WHERE dst = 7) n JOIN mem USING (id)""")
def graph_neighbours(spark, d):
    return graph.neighbours(views.edges(spark, d), views.memories(spark, d), 7).select("id", "relation", "direction", "type", "importance")


PAIRS = """t AS (SELECT *, trim(regexp_replace(regexp_replace(lower(content), '\\d+(?:\\.\\d+)*', '<#>', 'g'), '\\s+', ' ', 'g')) AS template,
  regexp_extract_all(content, '\\d+(?:\\.\\d+)*') AS nums FROM claims), pairs AS (SELECT a.id AS id_a, b.id AS id_b, a.template FROM t a JOIN t b ON a.project_id IS NOT DISTINCT FROM b.project_id AND a.user_id IS NOT DISTINCT FROM b.user_id AND a.template = b.template
  AND a.id < b.id AND a.nums <> b.nums WHERE len(a.nums) > 0 AND (b.valid_until IS NULL OR a.valid_from < b.valid_until) AND (a.valid_until IS NULL OR b.valid_from < a.valid_until))"""


@query("contradiction_pairs", f"WITH {STATEMENTS}, {PAIRS} SELECT * FROM pairs")
def contradiction_pairs(spark, d):
    return lifecycle.contradictions(views.statements(spark, d)).drop("scope")


#: One pair of each template at a time, in order, with the list of what is closed.
@query("contradiction_resolution", f"""WITH RECURSIVE {STATEMENTS}, {PAIRS}, x AS (SELECT p.*, coalesce(a.project_id, '') || '/' || coalesce(a.user_id, '') || '/' || p.template AS g, a.observed_at AS at_a, b.observed_at AS at_b, a.valid_from AS from_a, b.valid_from AS from_b,
    CASE WHEN (a.source_kind = 'explicit') <> (b.source_kind = 'explicit') THEN CASE WHEN a.source_kind = 'explicit' THEN 1 ELSE -1 END WHEN (a.type = 'decision') <> (b.type = 'decision') THEN CASE WHEN a.type = 'decision' THEN 1 ELSE -1 END
      WHEN a.observed_at <> b.observed_at THEN CASE WHEN a.observed_at > b.observed_at THEN 1 ELSE -1 END WHEN a.confidence <> b.confidence THEN CASE WHEN a.confidence > b.confidence THEN 1 ELSE -1 END ELSE 0 END AS won
    FROM pairs p JOIN mem a ON a.id = id_a JOIN mem b ON b.id = id_b), r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY greatest(at_a, at_b), id_a, id_b) AS k FROM x),
  f AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, 0 AS won, CAST(NULL AS TIMESTAMP) AS until FROM r
    UNION ALL SELECT f.g, r.k, CASE WHEN list_has_any(gone, [id_a, id_b]) THEN gone WHEN r.won = 0 THEN list_concat(gone, [id_a, id_b]) WHEN r.won > 0 THEN list_append(gone, id_b) ELSE list_append(gone, id_a) END,
      CASE WHEN NOT list_has_any(gone, [id_a, id_b]) THEN id_a END, CASE WHEN NOT list_has_any(gone, [id_a, id_b]) THEN id_b END, r.won, CASE WHEN r.won > 0 THEN greatest(at_a, from_b) WHEN r.won < 0 THEN greatest(at_b, from_a) END FROM f JOIN r ON r.g = f.g AND r.k = f.k + 1)
  SELECT unnest(CASE WHEN won = 0 THEN [a, b] WHEN won > 0 THEN [b] ELSE [a] END) AS id, CASE WHEN won = 0 THEN 'disputed' ELSE 'superseded' END AS outcome, CASE WHEN won > 0 THEN a WHEN won < 0 THEN b END AS winner, until AS valid_until FROM f WHERE a IS NOT NULL""")
def contradiction_resolution(spark, d):
    return contradiction.settled(views.statements(spark, d))


@query("authority_rules", f"""WITH {STATEMENTS}, {PAIRS} SELECT id_a, id_b, CASE WHEN (a.source_kind = 'explicit') <> (b.source_kind = 'explicit') THEN CASE WHEN a.source_kind = 'explicit' THEN '+' ELSE '-' END || 'explicit'
  WHEN (a.type = 'decision') <> (b.type = 'decision') THEN CASE WHEN a.type = 'decision' THEN '+' ELSE '-' END || 'decision'
  WHEN a.observed_at <> b.observed_at THEN CASE WHEN a.observed_at > b.observed_at THEN '+' ELSE '-' END || 'newer'
  WHEN a.confidence <> b.confidence THEN CASE WHEN a.confidence > b.confidence THEN '+' ELSE '-' END || 'confidence' ELSE 'tie' END AS rule
  FROM pairs JOIN mem a ON a.id = id_a JOIN mem b ON b.id = id_b""")
def authority_rules(spark, d):
    pairs = lifecycle.contradictions(views.statements(spark, d), "source_kind", "type", "observed_at", "confidence")
    return pairs.select("id_a", "id_b", lifecycle.authority_rule("a", "b").alias("rule"))


@query("decay_archive", f"""WITH {MEM}, p AS (SELECT id, sqrt(CASE WHEN type = 'decision' THEN greatest(importance, 0.5) ELSE importance END) * confidence * {RECENCY} * (1 + ln(1.0::DOUBLE + access_count)) AS prominence
  FROM mem WHERE status = 'active') SELECT id, round(prominence, 6) AS prominence FROM p WHERE prominence < 0.05""")
def decay_archive(spark, d):
    return lifecycle.decayed(views.memories(spark, d), now()).select("id", F.round("prominence", 6).alias("prominence"))


_EDGES_SQL = ", ".join(f"('{a}', '{b}')" for a, bs in TRANSITIONS.items() for b in bs)


@query("status_transitions", f"""WITH {MEM}, c AS (SELECT id, status AS old, (['active','stale','superseded','disputed','archived'])[id % 5 + 1] AS new FROM mem)
  SELECT id, old, new, (old, new) IN ({_EDGES_SQL}) AS legal, CASE WHEN new = 'archived' THEN 'archived' WHEN new = 'active' AND old <> 'active' THEN 'restored' ELSE 'status_changed' END AS action FROM c""")
def status_transitions(spark, d):
    new = F.element_at(F.array(*map(F.lit, TRANSITIONS)), (F.col("id") % 5 + 1).cast("int"))
    return memory.transitions(views.memories(spark, d).select("id", F.col("status").alias("old"), new.alias("new")))


@query("version_log_fold", f"""WITH {MEM}, log AS (SELECT id, 1 AS seq, 'create' AS op, status, importance FROM mem UNION ALL SELECT id, 2, 'update', CASE WHEN id % 2 = 0 THEN 'archived' END, NULL FROM mem WHERE id % 3 = 0
  UNION ALL SELECT id, 3, 'purge', NULL, NULL FROM mem WHERE id % 11 = 0)
  SELECT id, CAST(max(seq) AS BIGINT) AS seq, max_by(status, seq) FILTER (status IS NOT NULL) AS status, max_by(importance, seq) FILTER (importance IS NOT NULL) AS importance FROM log GROUP BY id HAVING max_by(op, seq) <> 'purge'""")
def version_log_fold(spark, d):
    m = views.memories(spark, d)
    row = lambda rows, seq, op, status, importance: rows.select("id", F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), F.col("observed_at").alias("at"), status.alias("status"), importance.alias("importance"))
    none = F.lit(None)
    log = (row(m, 1, "create", F.col("status"), F.col("importance"))
           .union(row(m.where("id % 3 = 0"), 2, "update", F.when(F.col("id") % 2 == 0, "archived"), none.cast("double")))
           .union(row(m.where("id % 11 = 0"), 3, "purge", none.cast("string"), none.cast("double"))))
    return memory.folded(log, ["status", "importance"])


@query("token_estimates", f"WITH {MEM} SELECT id, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM mem")
def token_estimates(spark, d):
    return views.memories(spark, d).select("id", text.token_estimate(F.col("content")).alias("tokens"))


_STOP = ", ".join(f"'{x}'" for x in STOPWORDS)
_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9.]+'), lambda x: x <> '')"


@query("keywords", f"""WITH k AS (SELECT conv_id, turn, list_filter({_TOKENS}, lambda x: x NOT IN ({_STOP})) AS w FROM conversations)
  SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:32], ' ') AS keywords FROM k""")
def keywords(spark, d):
    return views.read(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


def _intent_sql() -> str:
    import re

    score = lambda ps: " + ".join(f"CAST(regexp_matches(text, '(?i)\\b{'\\s+'.join(re.escape(w) for w in p.split())}\\b') AS INT)" for p in ps)
    names = list(INTENTS)
    cols = ", ".join(f"{score(INTENTS[n])} AS s{k}" for k, n in enumerate(names))
    best = "greatest(" + ", ".join(f"s{k}" for k in range(len(names))) + ")"
    cases = " ".join(f"WHEN s{k} = {best} THEN '{n}'" for k, n in enumerate(names))
    return f"WITH s AS (SELECT conv_id, turn, {cols} FROM (SELECT conv_id, turn, text || ' ' || (['how to fix the error','why did we choose this','when did it run before','prefer this style','overview'])[conv_id % 5 + 1] AS text FROM conversations)) SELECT conv_id, turn, CASE WHEN {best} = 0 THEN 'fact' {cases} END AS intent FROM s"


@query("intent_classify", _intent_sql())
def intent_classify(spark, d):
    added = F.element_at(F.array(*map(F.lit, ("how to fix the error", "why did we choose this", "when did it run before", "prefer this style", "overview"))), (F.col("conv_id") % 5 + 1).cast("int"))
    return views.read(spark, d, "conversations").select("conv_id", "turn", text.intent(F.concat_ws(" ", "text", added)).alias("intent"))


@query("entity_match", """WITH n AS (SELECT n_nationkey AS entity_id, lower(n_name) AS name FROM nation), q AS (SELECT doc_id AS id, ' ' || lower(text) || ' nation_' || (doc_id % 25) || ' ' AS t FROM documents)
  SELECT id, entity_id FROM q JOIN n ON regexp_matches(t, '\\b' || name || '\\b')""")
def entity_match(spark, d):
    """Names are single tokens here, so the text's tokens are looked up instead of testing every pair."""
    names = views.read(spark, d, "nation").select(F.lower("n_name").alias("token"), F.col("n_nationkey").alias("entity_id"))
    words = F.split(F.lower(F.concat_ws(" ", "text", F.concat(F.lit("nation_"), (F.col("doc_id") % 25).cast("string")))), r"[^\w]+")
    found = views.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(words)).alias("token"))
    return found.join(names, "token").select("id", "entity_id")


@query("path_exclusion", """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) || CASE page_id % 7 WHEN 0 THEN '/.env.local' WHEN 1 THEN '/id_rsa' WHEN 2 THEN '/a.tfstate' ELSE '' END AS path FROM pages)
  SELECT page_id, path, page_id % 7 < 3 OR regexp_matches(path, '(?i)(credentials|secrets|\\.pem$|\\.key$|authorized_keys)') AS excluded FROM p""")
def path_exclusion(spark, d):
    added = F.when(F.col("page_id") % 7 == 0, "/.env.local").when(F.col("page_id") % 7 == 1, "/id_rsa").when(F.col("page_id") % 7 == 2, "/a.tfstate").otherwise("")
    p = views.read(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), added).alias("path"))
    return p.select("page_id", "path", text.is_excluded(F.col("path")).alias("excluded"))

"""Queries over consolidation, similarity and whole searches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import temporal
from ..operators import consolidation, lifecycle, memory, search, similarity
from ..sources import views
from .memory_queries import AFFINITY, PAIRS
from .registry import oracle_of, query
from .views_sql import ACCESS, BOUND, EDGES, MEM, NOW, RECENCY, STATEMENTS

NEAR = 0.3  #: least cosine of these queries, at which the tables' vectors form clusters
_VECTORS = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_REACH = """both_ AS (SELECT a AS id, b AS other FROM vp UNION SELECT b, a FROM vp), reach AS (SELECT id, id AS other FROM both_ UNION SELECT reach.id, both_.other FROM reach JOIN both_ ON reach.other = both_.id),
  members AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""
_MERGE_PAIRS = f"""{_VECTORS}, mv AS (SELECT claims.*, e FROM claims JOIN v USING (id)), vp AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS cosine FROM mv a JOIN mv b ON a.project_id IS NOT DISTINCT FROM b.project_id
  AND a.user_id IS NOT DISTINCT FROM b.user_id AND a.type = b.type AND a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= {NEAR})"""
_KEEPER = "CASE WHEN source_kind = 'explicit' THEN 0 ELSE 1 END, CASE WHEN type = 'decision' THEN 0 ELSE 1 END, observed_at DESC, confidence DESC, id"
_CONFLICTED = "blocked AS (SELECT DISTINCT x.component FROM pairs JOIN members x ON x.id = id_a JOIN members y ON y.id = id_b WHERE x.component = y.component)"


def _vectors(spark, d):
    return views.read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "embedding")


@query("near_dup_pairs", f"WITH {STATEMENTS}, {_MERGE_PAIRS} SELECT a, b, round(cosine, 6) AS cosine FROM vp")
def near_dup_pairs(spark, d):
    rows = views.statements(spark, d).select("project_id", "user_id", "type", "id").join(_vectors(spark, d), "id")
    return similarity.vector_pairs(rows, ["project_id", "user_id", "type"], NEAR).withColumn("cosine", F.round("cosine", 6))


@query("near_dup_components", f"WITH RECURSIVE {STATEMENTS}, {_MERGE_PAIRS}, {_REACH} SELECT id, component FROM members")
def near_dup_components(spark, d):
    rows = views.statements(spark, d).select("project_id", "user_id", "type", "id").join(_vectors(spark, d), "id")
    return similarity.components(similarity.vector_pairs(rows, ["project_id", "user_id", "type"], NEAR))


#: Each vector in five forms, of which some are equal, some very near and some less so.
_COPIES = """cp AS (SELECT vec_id * 5 + m AS id, label, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + 0.01 * m * (vec_id % 3) * ((vec_id * 7 + i * 3) % 5 - 2)) AS e FROM embeddings, unnest(range(0, 5)) AS u(m)),
  pairs AS (SELECT a.id AS a, b.id AS b, a.e <> b.e AS other, list_cosine_similarity(a.e, b.e) AS cosine FROM cp a JOIN cp b ON a.label = b.label AND a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= {least}),
  same AS (SELECT b AS id, min(a) AS representative FROM pairs WHERE NOT other GROUP BY b)"""


def _copies(spark, d):
    e = views.read(spark, d, "embeddings").select(F.col("vec_id"), "embedding", "label", F.explode(F.array(*map(F.lit, range(5)))).alias("m"))
    moved = F.transform("embedding", lambda x, i: x.cast("double") + F.lit(0.01) * F.col("m") * (F.col("vec_id") % 3) * ((F.col("vec_id") * 7 + (i + 1) * 3) % 5 - 2))
    return e.select((F.col("vec_id") * 5 + F.col("m")).cast("long").alias("id"), "label", moved.alias("embedding"))


def _near_copies(spark, d, least):
    """Rows with their class of equal vectors, and how many other classes of their label are near."""
    members, links = similarity.near_links(_copies(spark, d), ["label"], least)
    n = links.select(F.explode(F.array("a", "b")).alias("representative")).groupBy("representative").agg(F.count("*").alias("links"))
    return members.join(n, "representative", "left").select("id", "representative", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def _near_sql(least):
    return f"""WITH {_COPIES.format(least=least)}, r AS (SELECT cp.id, coalesce(representative, cp.id) AS representative FROM cp LEFT JOIN same USING (id)), l AS (SELECT a, b FROM pairs JOIN r x ON x.id = a AND x.representative = a JOIN r y ON y.id = b AND y.representative = b WHERE other),
      n AS (SELECT id AS representative, count(*) AS links FROM (SELECT a AS id FROM l UNION ALL SELECT b FROM l) GROUP BY id) SELECT id, representative, coalesce(links, 0) AS links FROM r LEFT JOIN n USING (representative)"""


@query("near_copies_merge", _near_sql(consolidation.MERGE_COSINE))
def near_copies_merge(spark, d):
    return _near_copies(spark, d, consolidation.MERGE_COSINE)


@query("near_copies_derive", _near_sql(consolidation.DERIVE_COSINE))
def near_copies_derive(spark, d):
    return _near_copies(spark, d, consolidation.DERIVE_COSINE)


@query("merge_outcomes", f"""WITH RECURSIVE {STATEMENTS}, {PAIRS}, {_MERGE_PAIRS}, {_REACH}, {_CONFLICTED}, r AS (SELECT mem.*, component, first_value(id) OVER (PARTITION BY component ORDER BY {_KEEPER}) AS keeper FROM mem JOIN members USING (id))
  SELECT r.id, keeper, component, round(cosine, 6) AS cosine, CASE WHEN component IN (FROM blocked) THEN 'conflict' WHEN id = keeper THEN 'keeper' WHEN valid_from > TIMESTAMP '2024-05-01' THEN 'future' WHEN cosine IS NULL THEN 'not_near' ELSE 'merged' END AS outcome
  FROM r LEFT JOIN vp ON (a = id AND b = keeper) OR (b = id AND a = keeper)""")
def merge_outcomes(spark, d):
    rows = views.statements(spark, d)
    out = consolidation.merges(rows, _vectors(spark, d), lifecycle.contradictions(rows), temporal.at("2024-05-01 00:00:00"), NEAR)
    return out.withColumn("cosine", F.round("cosine", 6))


@query("derive_scores", f"""WITH RECURSIVE {STATEMENTS}, {PAIRS}, {_VECTORS}, pool AS (SELECT claims.*, (id // 6) % 7 AS entity_id, e FROM claims JOIN v USING (id) WHERE type = 'episodic' AND id % 17 <> 0),
  vp AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS cosine FROM pool a JOIN pool b ON a.project_id IS NOT DISTINCT FROM b.project_id AND a.user_id IS NOT DISTINCT FROM b.user_id AND a.entity_id = b.entity_id AND a.id < b.id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.1), {_REACH}, {_CONFLICTED}, s AS (SELECT id, sum(cosine) AS central FROM (SELECT a AS id, cosine FROM vp UNION ALL SELECT b, cosine FROM vp) GROUP BY id),
  r AS (SELECT pool.*, component, row_number() OVER (PARTITION BY component ORDER BY round(central, 9) DESC, {_KEEPER}) AS k, count(*) OVER (PARTITION BY component) AS sources FROM pool JOIN members USING (id) JOIN s USING (id) WHERE component NOT IN (FROM blocked))
  SELECT component, max(CASE WHEN k = 1 THEN id END) AS representative, any_value(entity_id) AS entity_id, any_value(project_id) AS project_id, any_value(user_id) AS user_id, any_value(sources) AS sources,
    round(least(0.95, max(importance) + 0.05), 4) AS importance, round(least(0.95, max(confidence) + 0.1), 4) AS confidence, max(observed_at) AS observed_at, min(valid_from) AS valid_from
  FROM r WHERE sources BETWEEN 3 AND 12 GROUP BY component""")
def derive_scores(spark, d):
    rows = views.statements(spark, d)
    ids = rows.select("id")
    return consolidation.derivations(
        rows.where("type = 'episodic'"), _vectors(spark, d), ids.withColumn("entity_id", F.floor(F.col("id") / 6) % 7), ids.where("id % 17 = 0"), lifecycle.contradictions(rows), 0.1)


#: How contradictions of the live statements are settled, as a table ``done``.
_LIVE = STATEMENTS.removesuffix(")") + " WHERE status IN ('active', 'stale'))"
_DONE = oracle_of("contradiction_resolution").replace(STATEMENTS, _LIVE, 1).replace("\n  SELECT unnest(CASE", ",\n  done AS (SELECT unnest(CASE", 1) + ")"
_FADED = f"sqrt(CASE WHEN type = 'decision' THEN greatest(importance, 0.5) ELSE importance END) * confidence * {RECENCY} * (1.0 + ln(1.0 + access_count)) < 0.05"


#: Derivation and merge each with its own pairs, their components and, of these, what is left of the live rows by then.
_GROUPS = """{k}p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS cosine FROM {rows} a JOIN {rows} b ON {on} AND a.project_id IS NOT DISTINCT FROM b.project_id AND a.user_id IS NOT DISTINCT FROM b.user_id AND a.id < b.id
    WHERE list_cosine_similarity(a.e, b.e) >= {least}), {k}both AS (SELECT a AS id, b AS other FROM {k}p UNION SELECT b, a FROM {k}p), {k}reach AS (SELECT id, id AS other FROM {k}both UNION SELECT {k}reach.id, {k}both.other FROM {k}reach JOIN {k}both ON {k}reach.other = {k}both.id),
  {k}members AS (SELECT id, min(other) AS component FROM {k}reach GROUP BY id)"""
_PASS = f"""pool AS (SELECT * FROM mem WHERE status IN ('active', 'stale') AND id NOT IN (SELECT id FROM done)), {_VECTORS}, pv AS (SELECT pool.*, e FROM pool JOIN v USING (id)), ev AS (SELECT *, id % 3 AS entity_id FROM pv WHERE type = 'episodic'),
  {_GROUPS.format(k="d", rows="ev", on="a.entity_id = b.entity_id", least=consolidation.DERIVE_COSINE)}, {_GROUPS.format(k="m", rows="pv", on="a.type = b.type", least=consolidation.MERGE_COSINE)},
  facts AS (SELECT component FROM dmembers GROUP BY component HAVING count(*) BETWEEN {consolidation.CLUSTER_SIZES[0]} AND {consolidation.CLUSTER_SIZES[1]}),
  mk AS (SELECT pool.*, component, first_value(id) OVER (PARTITION BY component ORDER BY {_KEEPER}) AS keeper FROM pool JOIN mmembers USING (id)),
  merged AS (SELECT mk.id, CASE WHEN id = keeper THEN 'keeper' WHEN valid_from > {NOW} THEN 'future' WHEN cosine IS NULL THEN 'not_near' ELSE 'merged' END AS outcome FROM mk LEFT JOIN mp ON (a = id AND b = keeper) OR (b = id AND a = keeper))"""


@query("consolidation_pass", _DONE + f""", {_PASS} SELECT 'contradiction' AS step, outcome, count(*) AS n FROM done GROUP BY outcome UNION ALL SELECT 'derivation', 'derivation', count(*) FROM facts HAVING count(*) > 0 UNION ALL SELECT 'merge', outcome, count(*) FROM merged GROUP BY outcome
  UNION ALL SELECT 'decay', 'decay', count(*) FROM pool WHERE status = 'active' AND id NOT IN (SELECT id FROM merged WHERE outcome = 'merged') AND {_FADED} HAVING count(*) > 0""")
def consolidation_pass(spark, d):
    """How many rows each step of a whole pass settles, by outcome."""
    rows, ids = views.statements(spark, d), views.read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    steps = consolidation.consolidated(rows, _vectors(spark, d), ids.withColumn("entity_id", F.col("id") % 3), ids.limit(0), temporal.at(views.NOW))
    out = None
    for name, step in steps.items():
        outcome = F.col("outcome") if "outcome" in step.columns else F.lit(name)
        found = step.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n")).withColumn("step", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


@query("evidence_spans", f"""WITH {MEM}, s AS (SELECT id % 50 AS g, id AS rank, p AS position, 'span ' || ((id * 7 + p * 3) % 40) AS span FROM mem, (SELECT unnest([0, 1, 2]) AS p)),
  f AS (SELECT g, span, min((rank, position)) AS f FROM s GROUP BY g, span) SELECT g AS "group", n, span FROM (SELECT g, span, row_number() OVER (PARTITION BY g ORDER BY f.f, span) AS n FROM f) WHERE n <= 24""")
def evidence_spans(spark, d):
    m = views.memories(spark, d).select((F.col("id") % 50).alias("group"), F.col("id").alias("rank"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("position"))
    return consolidation.evidence_union(m.withColumn("span", F.concat(F.lit("span "), ((F.col("rank") * 7 + F.col("position") * 3) % 40).cast("string"))))


@query("gate_dedupe", f"""WITH {MEM}, c AS (SELECT id % 20 AS g, type, (['Use tabs.','use  tabs','Run the tests;','run the tests','Pin node 22'])[id % 5 + 1] AS content, importance, confidence, id AS position, [id % 3, id % 4] AS entities FROM mem),
  k AS (SELECT *, lower(trim(regexp_replace(regexp_replace(trim(content), '\\s+', ' ', 'g'), '[.;,]+$', ''))) AS key FROM c),
  b AS (SELECT g, type, key, max_by(content, (importance, -position)) AS content, max(importance) AS importance, max(confidence) AS confidence, list_sort(list_distinct(flatten(list(entities)))) AS entities FROM k GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY importance DESC, content, type) AS n FROM b) SELECT g AS "group", type, content, importance, confidence, array_to_string(entities, ',') AS entities, n FROM n WHERE n <= 12""")
def gate_dedupe(spark, d):
    said = F.element_at(F.array(*map(F.lit, ("Use tabs.", "use  tabs", "Run the tests;", "run the tests", "Pin node 22"))), (F.col("id") % 5 + 1).cast("int"))
    c = views.memories(spark, d).select((F.col("id") % 20).alias("group"), "type", said.alias("content"), "importance", "confidence", F.col("id").alias("position"),
                                        F.array(F.col("id") % 3, F.col("id") % 4).alias("entities"), F.array("id").alias("evidence"))
    rows = consolidation.gate_merged(c, 12)
    return rows.select("group", "type", "content", "importance", "confidence", F.array_join(F.array_sort("entities"), ",").alias("entities"), "n")


_GRAMS = """g AS (SELECT id, type, project_id, unnest(list_transform(range(1, length(p) - 1), lambda k: p[k:k + 2])) AS gram FROM (SELECT id, type, project_id, '  ' || trim(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g')) || '  ' AS p FROM few)),
  c AS (SELECT id, type, project_id, gram, count(*) AS n FROM g GROUP BY ALL), w AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM c)"""


@query("duplicate_audit", f"""WITH {MEM}, few AS (SELECT * FROM mem WHERE status IN ('active', 'stale')), {_GRAMS},
  p AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS cosine FROM w a JOIN w b ON a.gram = b.gram AND a.type = b.type AND a.project_id IS NOT DISTINCT FROM b.project_id AND a.id < b.id GROUP BY a.id, b.id)
  SELECT a, b, round(cosine, 6) AS cosine FROM p WHERE cosine >= 0.97""")
def duplicate_audit(spark, d):
    rows = views.memories(spark, d).where("status IN ('active', 'stale')")
    return similarity.text_pairs(rows, ["type", "project_id"], 0.97).withColumn("cosine", F.round("cosine", 6))


_REGISTRY = "reg AS (SELECT CAST(n_nationkey AS BIGINT) AS entity_id, lower(replace(n_name, '_', ' ')) AS name, ['country ' || n_nationkey, 'no. ' || n_nationkey] AS aliases FROM nation)"


def _registry(spark, d):
    key = F.col("n_nationkey").cast("string")
    return views.read(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("entity_id"), F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("name"),
        F.array(F.concat(F.lit("country "), key), F.concat(F.lit("no. "), key)).alias("aliases"))


_ASKS = "CASE conv_id % 4 WHEN 0 THEN 'nation ' || (conv_id % 25) || ' and No. 7' WHEN 1 THEN 'country ' || (conv_id % 30) WHEN 2 THEN 'nation 1 nation 2 nation 3 no. 1 country 11 nation 12 nation 13 nation 14 nation 15 nation 16 nation 17' ELSE 'nations 5' END"


@query("entities_in_questions", f"""WITH {_REGISTRY}, q AS (SELECT conv_id * 1000 + turn AS id, text || ' ' || {_ASKS} AS t FROM conversations), f AS (SELECT entity_id, name, unnest(list_concat([name], aliases)) AS form FROM reg),
  m AS (SELECT id, entity_id, name, max_by(form, (length(form), form)) AS form FROM q, f WHERE contains(lower(t), form) AND regexp_matches(lower(t), '(^|[^\\w])' || regexp_escape(form) || '($|[^\\w])') GROUP BY id, entity_id, name)
  SELECT id, entity_id, form, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(form) DESC, name, entity_id) AS place FROM m) WHERE place <= 8""")
def entities_in_questions(spark, d):
    q = views.read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat_ws(" ", "text", F.expr(_ASKS.replace("VARCHAR", "STRING"))).alias("text"))
    return search.entities_in(q, _registry(spark, d))


@query("names_resolved", f"""WITH {_REGISTRY}, n AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN ' Nation  ' || (c_custkey % 40) WHEN 1 THEN 'NO. ' || (c_custkey % 40) ELSE c_name END AS name FROM customer),
  k AS (SELECT name, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS normal FROM n) SELECT k.name, coalesce(min(a.entity_id), min(b.entity_id)) AS entity_id FROM k LEFT JOIN reg a ON a.name = normal LEFT JOIN reg b ON list_contains(b.aliases, normal) GROUP BY k.name""")
def names_resolved(spark, d):
    k = F.col("c_custkey")
    n = F.when(k % 3 == 0, F.concat(F.lit(" Nation  "), (k % 40).cast("string"))).when(k % 3 == 1, F.concat(F.lit("NO. "), (k % 40).cast("string"))).otherwise(F.col("c_name"))
    return search.resolved_names(views.read(spark, d, "customer").select(n.alias("name")), _registry(spark, d))


_POLICIES = {
    "as_of": (search.Request("what", datetime(2024, 7, 1), as_of=datetime(2024, 2, 15)), "status <> 'disputed' AND valid_from <= TIMESTAMP '2024-02-15' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-02-15')"),
    "history": (search.Request("what did we use last year", datetime(2025, 7, 1)), "status <> 'disputed' AND valid_from < TIMESTAMP '2025-01-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-01')"),
    "all_history": (search.Request("before", datetime(2024, 3, 1), include=("disputed",)), "valid_from < TIMESTAMP '2024-03-01'"),
    "current": (search.Request("what runs", datetime(2024, 7, 1), include=("disputed",)), f"status IN ('active', 'stale', 'disputed') AND valid_from <= {NOW} AND (valid_until IS NULL OR valid_until > {NOW})"),
}


@query("temporal_policies", f"WITH {MEM} " + " UNION ALL ".join(f"SELECT '{k}' AS policy, status, count(*) AS n FROM mem WHERE {sql} GROUP BY status" for k, (_, sql) in _POLICIES.items()))
def temporal_policies(spark, d):
    out = None
    for name, (request, _) in _POLICIES.items():
        allowed = search.policy(request, search.intent_of(request.query), search.scopes.time_scope(request.query, request.now))
        rows = views.memories(spark, d).where(search.admitted(allowed)).groupBy("status").agg(F.count("*").alias("n")).withColumn("policy", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


ASKED = search.Request("thatin ononst inoran nation 3", datetime(2024, 7, 1), project_id="p1", user_id="u1")
_TERMS = search.keywords_of(ASKED.query)
_COUNT = lambda t: f"len(list_filter(toks, lambda x: x = '{t}'))"
_RANK = " + ".join(f"CASE WHEN {_COUNT(t)} > 0 THEN 0.1::DOUBLE * list_sum(list_transform(range(1, {_COUNT(t)} + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493406685::DOUBLE / {len(_TERMS)} ELSE 0 END" for t in _TERMS)


@query("hybrid_search", f"""WITH {MEM}, {BOUND}, {EDGES}, allowed AS (SELECT *, string_split_regex(lower(content), '[^a-z0-9.]+') AS toks FROM mem WHERE status IN ('active', 'stale') AND valid_from <= {NOW} AND (valid_until IS NULL OR valid_until > {NOW})
    AND (project_id = 'p1' OR (project_id IS NULL AND user_id = 'u1'))),
  lex AS (SELECT id, row_number() OVER (ORDER BY ts DESC, observed_at DESC, id DESC) AS lexical_rank FROM (SELECT *, round({_RANK}, 9) AS ts FROM allowed) WHERE ts > 0 QUALIFY lexical_rank <= 50),
  near AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings),
  top AS (SELECT id, row_number() OVER (ORDER BY round(c, 9) DESC, id) AS r FROM near WHERE c >= 0.05 QUALIFY r <= 50),
  vec AS (SELECT id, row_number() OVER (ORDER BY r) AS vector_rank FROM top SEMI JOIN allowed USING (id)),
  own AS (SELECT id, row_number() OVER (ORDER BY observed_at DESC, id DESC) AS pos FROM bound JOIN allowed USING (id) WHERE entity_id = 3 QUALIFY pos <= 30),
  seeds AS (SELECT id, min(pos) AS pos FROM (SELECT id, pos FROM own UNION ALL SELECT id, lexical_rank + 60 FROM lex WHERE lexical_rank <= 5 UNION ALL SELECT id, vector_rank + 65 FROM vec WHERE vector_rank <= 5) GROUP BY id),
  e AS (SELECT src, dst, id FROM edges WHERE valid_from <= {NOW} UNION ALL SELECT dst, src, id FROM edges WHERE valid_from <= {NOW}),
  h1 AS (SELECT dst AS id, min((pos, e.id)) AS f FROM e JOIN seeds ON src = seeds.id WHERE dst NOT IN (SELECT id FROM seeds) GROUP BY dst ORDER BY f, dst LIMIT 40),
  p1 AS (SELECT id, row_number() OVER (ORDER BY f, id) AS pos FROM h1),
  h2 AS (SELECT dst AS id, min((pos, e.id)) AS f FROM e JOIN p1 ON src = p1.id WHERE dst NOT IN (SELECT id FROM seeds UNION SELECT id FROM p1) GROUP BY dst ORDER BY f, dst LIMIT 40),
  p2 AS (SELECT id, row_number() OVER (ORDER BY f, id) AS pos FROM h2), hops AS (SELECT * FROM (SELECT id, 1 AS hop, pos FROM p1 UNION ALL SELECT id, 2, pos FROM p2) ORDER BY hop, pos LIMIT 40),
  boost AS (SELECT id, max(b) AS b FROM (SELECT id, 1.0::DOUBLE AS b FROM own UNION ALL SELECT id, pow(0.8::DOUBLE, hop) FROM hops) GROUP BY id),
  m AS (SELECT id, min(l) AS lexical_rank, min(v) AS vector_rank, max(b) AS graph_boost FROM (SELECT id, lexical_rank AS l, NULL AS v, NULL AS b FROM lex UNION ALL SELECT id, NULL, vector_rank, NULL FROM vec UNION ALL SELECT id, NULL, NULL, b FROM boost) GROUP BY id),
  j AS (SELECT allowed.* EXCLUDE (toks), min(lexical_rank) OVER h AS lexical_rank, min(vector_rank) OVER h AS vector_rank, max(graph_boost) OVER h AS graph_boost, CASE WHEN id IN (SELECT id FROM bound WHERE entity_id = 3) THEN 1.0 ELSE 0.0 END AS matched,
    CASE WHEN source_kind = 'explicit' THEN 4 WHEN type = 'decision' THEN 3 WHEN type IN ('semantic', 'procedural', 'failure', 'preference') THEN 2 WHEN type = 'episodic' THEN 1 ELSE 0 END AS authority
    FROM m JOIN allowed USING (id) WINDOW h AS (PARTITION BY content_hash)),
  k AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY authority DESC, confidence DESC, observed_at DESC, id) = 1),
  s AS (SELECT id, type, lexical_rank, vector_rank, graph_boost, coalesce(0.16 * 61.0 / (60.0 + lexical_rank), 0) + coalesce(0.2 * 61.0 / (60.0 + vector_rank), 0) + 0.08 * coalesce(graph_boost, 0) + 0.1 * matched
    + 0.12 * importance + 0.08 * confidence + 0.1 * {RECENCY} + 0.05 * {ACCESS} + 0.1 * CASE WHEN project_id = 'p1' THEN 1.0 WHEN project_id IS NULL THEN 0.4 ELSE 0.7 END + {AFFINITY} AS s FROM k)
  SELECT id, type, CAST(lexical_rank AS BIGINT) AS lexical_rank, CAST(vector_rank AS BIGINT) AS vector_rank, round(graph_boost, 6) AS graph_boost, round(s, 6) AS score, round(least(1, s / 1.09), 6) AS relevance FROM s""")
def hybrid_search(spark, d):
    vectors = _vectors(spark, d)
    sources = search.Sources(views.memories(spark, d), vectors, views.edges(spark, d), views.memory_entities(spark, d))
    out = search.ranked(ASKED, sources, vectors.where("id = 0"), matched=[3])
    return out.select("id", "type", F.col("lexical_rank").cast("long").alias("lexical_rank"), F.col("vector_rank").cast("long").alias("vector_rank"), F.round("graph_boost", 6).alias("graph_boost"), F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"))


@query("access_reinforcement", "SELECT l_partkey AS id, count(*) AS accesses, max(l_shipdate) AS last_accessed_at FROM lineitem GROUP BY l_partkey")
def access_reinforcement(spark, d):
    return search.reinforced(views.read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_shipdate").alias("at")))


@query("conflict_labels", f"""WITH {MEM}, {EDGES}, c AS (SELECT src AS id, dst AS other FROM edges WHERE relation = 'r3' UNION SELECT dst, src FROM edges WHERE relation = 'r3')
  SELECT mem.id, coalesce(array_to_string(list_sort(list_distinct(list(other) FILTER (other IS NOT NULL))), ','), '') AS conflicts FROM mem LEFT JOIN c USING (id) WHERE status = 'disputed' GROUP BY mem.id""")
def conflict_labels(spark, d):
    edges = views.edges(spark, d).withColumn("relation", F.when(F.col("relation") == "r3", "contradicts").otherwise(F.col("relation")))
    return search.conflict_labels(views.memories(spark, d).where("status = 'disputed'"), edges).withColumn("conflicts", F.array_join("conflicts", ","))

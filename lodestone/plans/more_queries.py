"""Queries over redaction, summaries, skills, derived facts and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extraction, scopes, temporal
from ..operators import redaction, skills
from ..sources import views
from .registry import query
from .views_sql import BOUND, EVENTS, MEM, NOW


@query("redaction_scan")
def redaction_scan(spark, d):
    """Redacted texts' hashes and the number of secrets of each kind."""
    docs = views.read(spark, d, "documents").select("doc_id", redaction.redacted(F.col("text")).alias("r"))
    return docs.select("doc_id", F.sha2("r.text", 256).alias("text_sha256"), F.array_join(F.transform("r.records", lambda x: x["kind"]), ",").alias("kinds"))


@query("key_detection", """SELECT doc_id, regexp_matches(text, 'AKIA[0-9A-Z]{16}') AS akia, regexp_matches(text, 'gh[pousr]_[A-Za-z0-9]{36}') AS gh,
  regexp_matches(text, '(?i)(password|passwd|pwd)\\s*[=:]\\s*\\S') AS password FROM documents""")
def key_detection(spark, d):
    t = F.col("text")
    return views.read(spark, d, "documents").select("doc_id", t.rlike("AKIA[0-9A-Z]{16}").alias("akia"), t.rlike("gh[pousr]_[A-Za-z0-9]{36}").alias("gh"), t.rlike(r"(?i)(password|passwd|pwd)\s*[=:]\s*\S").alias("password"))


#: Sentences by a mark put behind their ends; a second mark says that a summary is full.
@query("derived_summaries", f"""WITH {MEM}, p AS (SELECT id, list_filter(string_split(regexp_replace(trim(content), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM mem),
  q AS (SELECT id, coalesce(s[1], '') AS f, rtrim(coalesce(list_reduce(s, lambda a, x: CASE WHEN ends_with(a, chr(2)) THEN a WHEN length(a || ' ' || x) > 160 THEN a || chr(2) ELSE a || ' ' || x END), ''), chr(2)) AS summary FROM p)
  SELECT id, summary, CASE WHEN length(f) <= 60 THEN f ELSE rtrim(left(f, CAST(CASE WHEN length(left(f, 60)) - length(string_split(left(f, 60), ' ')[-1]) - 1 > 30 THEN length(left(f, 60)) - length(string_split(left(f, 60), ' ')[-1]) - 1 ELSE 60 END AS INT))) || '…' END AS label FROM q""")
def derived_summaries(spark, d):
    m = views.memories(spark, d)
    return m.select("id", scopes.summary(F.col("content")).alias("summary"), scopes.label(F.col("content")).alias("label"))


@query("corroborated_facts", f"""WITH {MEM}, {BOUND} SELECT project_id, entity_id, count(*) AS sources, round(least(0.95, max(importance) + 0.05), 4) AS importance, round(least(0.95, max(confidence) + 0.1), 4) AS confidence,
  max(observed_at) AS observed_at, min(valid_from) AS valid_from FROM mem JOIN bound USING (id) WHERE type = 'episodic' GROUP BY project_id, entity_id HAVING count(*) >= 3""")
def corroborated_facts(spark, d):
    rows = views.memories(spark, d).where("type = 'episodic'").join(views.memory_entities(spark, d), "id")
    return skills.corroborated(rows, ["project_id", "entity_id"])


@query("skill_usage", """WITH e AS (SELECT event_id, user_id, ts, lower(event_type || ' skill-' || (event_id % 12)) AS t FROM events), s AS (SELECT CAST(n_nationkey AS BIGINT) AS id, 'skill-' || n_nationkey AS name FROM nation)
  SELECT s.id, count(event_id) AS mentions, count(DISTINCT user_id) AS sessions, max(ts) AS last_used_at FROM s LEFT JOIN e ON list_contains(string_split(t, ' '), name) GROUP BY s.id""")
def skill_usage(spark, d):
    e = views.read(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("occurred_at"), F.concat(F.col("event_type"), F.lit(" skill-"), (F.col("event_id") % 12).cast("string")).alias("text"))
    s = views.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("skill-"), F.col("n_nationkey").cast("string")).alias("name"))
    return skills.usage(e, s)


_SKILLS = "sk AS (SELECT c_custkey AS id, (['candidate','verified','promoted','deprecated'])[c_custkey % 4 + 1] AS status, c_custkey * 7 % 31 AS usage, TIMESTAMP '2024-01-01' + to_hours(c_custkey % 500) AS updated_at FROM customer)"


def _skills(spark, d):
    k = F.col("c_custkey")
    status = F.element_at(F.array(*map(F.lit, ("candidate", "verified", "promoted", "deprecated"))), (k % 4 + 1).cast("int"))
    return views.read(spark, d, "customer").select(k.alias("id"), status.alias("status"), (k * 7 % 31).alias("usage"), F.timestamp_add("HOUR", (k % 500).cast("int"), temporal.at("2024-01-01 00:00:00")).alias("updated_at"))


@query("skills_served", f"""WITH {_SKILLS} SELECT id, status, usage, row_number() OVER (ORDER BY status, usage DESC, updated_at DESC, id) AS position FROM sk WHERE status IN ('promoted', 'verified') ORDER BY position LIMIT 25""")
def skills_served(spark, d):
    return skills.served(_skills(spark, d), 25).select("id", "status", "usage", "position")


@query("skill_transitions", f"""WITH {_SKILLS}, t AS (SELECT id, status AS old, (['candidate','verified','promoted','deprecated'])[id % 3 + 1] AS new FROM sk)
  SELECT id, old, new, (old, new) IN (('candidate','verified'), ('candidate','deprecated'), ('verified','promoted'), ('verified','deprecated'), ('promoted','deprecated')) AS legal FROM t""")
def skill_transitions(spark, d):
    new = F.element_at(F.array(*map(F.lit, ("candidate", "verified", "promoted", "deprecated"))), (F.col("id") % 3 + 1).cast("int"))
    s = _skills(spark, d).select("id", F.col("status").alias("old"), new.alias("new"))
    return s.withColumn("legal", skills.may_become(F.col("old"), F.col("new")))


_REFS = "refs AS (SELECT doc_id % 300 AS id, 'r' || (doc_id % 2) AS repository, 'f/' || doc_id AS path FROM documents)"


@query("code_ref_cap", f"""WITH {_REFS}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY repository, path) AS position, count(*) OVER (PARTITION BY id) AS n FROM refs)
  SELECT id, position, repository, CASE WHEN position <= 2 THEN path ELSE '<' || (n - 2) || ' more refs>' END AS path FROM k WHERE position <= 3""")
def code_ref_cap(spark, d):
    k = F.col("doc_id")
    refs = views.read(spark, d, "documents").select((k % 300).alias("id"), F.concat(F.lit("r"), (k % 2).cast("string")).alias("repository"), F.concat(F.lit("f/"), k.cast("string")).alias("path"))
    return skills.code_refs(refs, 2)


@query("project_of_path", """WITH p AS (SELECT doc_id AS id, 'home/u' || (doc_id % 7) || '/w' || (doc_id % 3) || '/src/f' || doc_id AS path FROM documents),
  r AS (SELECT * FROM (VALUES ('home/u1', 'a'), ('home/u1/w2', 'b'), ('home/u3/w', 'c'), ('home/u4/w0/src', 'd')) t(root, project))
  SELECT id, max_by(project, length(root)) AS project FROM p LEFT JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY id""")
def project_of_path(spark, d):
    k = F.col("doc_id")
    paths = views.read(spark, d, "documents").select(k.alias("id"), F.concat(F.lit("home/u"), (k % 7).cast("string"), F.lit("/w"), (k % 3).cast("string"), F.lit("/src/f"), k.cast("string")).alias("path"))
    roots = spark.createDataFrame([("home/u1", "a"), ("home/u1/w2", "b"), ("home/u3/w", "c"), ("home/u4/w0/src", "d")], "root string, project string")
    return skills.project_of(paths, roots)


@query("rerank_splice", """WITH r AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders ORDER BY rank LIMIT 60), p AS (SELECT id, 51 - rank AS position FROM r WHERE rank <= 50 AND rank % 4 <> 0)
  SELECT id, row_number() OVER (ORDER BY position NULLS LAST, rank) AS rank FROM r LEFT JOIN p USING (id)""")
def rerank_splice(spark, d):
    from pyspark.sql.window import Window

    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    top = views.read(spark, d, "orders").orderBy(*order).limit(60).select(F.col("o_orderkey").alias("id"), F.row_number().over(Window.orderBy(*order)).alias("rank"))
    return skills.reranked(top, top.where("rank <= 50 AND rank % 4 <> 0").select("id", (51 - F.col("rank")).alias("position")))


@query("probe_accuracy", """WITH o AS (SELECT doc_id AS id, (['current','point_in_time','history'])[doc_id % 3 + 1] AS bucket, [doc_id, doc_id + 1, doc_id + 2] AS returned, [doc_id + doc_id % 4] AS expected, [doc_id + 1 + doc_id % 5] AS forbidden FROM documents)
  SELECT bucket, count(*) AS probes, count(*) FILTER (list_has_all(returned, expected) AND NOT list_has_any(returned, forbidden)) AS correct,
  count(*) FILTER (list_has_all(returned, expected) AND list_has_any(returned, forbidden)) AS silent FROM o GROUP BY bucket""")
def probe_accuracy(spark, d):
    k = F.col("doc_id")
    o = views.read(spark, d, "documents").select(F.element_at(F.array(*map(F.lit, ("current", "point_in_time", "history"))), (k % 3 + 1).cast("int")).alias("bucket"), F.array(k, k + 1, k + 2).alias("returned"), F.array(k + k % 4).alias("expected"), F.array(k + 1 + k % 5).alias("forbidden"))
    all_in, leaked = F.size(F.array_except("expected", "returned")) == 0, F.arrays_overlap("returned", "forbidden")
    return o.groupBy("bucket").agg(F.count("*").alias("probes"), F.count_if(all_in & ~leaked).alias("correct"), F.count_if(all_in & leaked).alias("silent"))


@query("event_validation", f"""WITH {EVENTS} SELECT CASE WHEN kind IN ('view', 'click', 'purchase') THEN kind ELSE 'raw.unknown' END AS stored_kind, CASE WHEN k IS NULL THEN 'dead_letter' ELSE 'stored' END AS outcome, count(*) AS n FROM ev GROUP BY 1, 2""")
def event_validation(spark, d):
    e = views.events(spark, d)
    kind = F.when(F.col("kind").isin("view", "click", "purchase"), F.col("kind")).otherwise("raw.unknown")
    return e.groupBy(kind.alias("stored_kind"), F.when(F.col("k").isNull(), "dead_letter").otherwise("stored").alias("outcome")).agg(F.count("*").alias("n"))


@query("session_fold", f"WITH {EVENTS} SELECT session_id, min(occurred_at) AS started_at, max(occurred_at) AS ended_at, count(*) AS events, min_by(kind, (occurred_at, id)) AS first_kind, max_by(kind, (occurred_at, id)) AS last_kind FROM ev GROUP BY session_id")
def session_fold(spark, d):
    at = F.struct("occurred_at", "id")
    return views.events(spark, d).groupBy("session_id").agg(F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at"), F.count("*").alias("events"), F.min_by("kind", at).alias("first_kind"), F.max_by("kind", at).alias("last_kind"))


@query("consolidation_quality", f"""WITH {MEM}, g AS (SELECT type, project_id, count(*) AS observations, count(DISTINCT content_hash) AS distinct_rows FROM mem GROUP BY type, project_id)
  SELECT type, count(*) AS groups, round(avg(greatest(0, least(1, 1 - distinct_rows / CAST(observations AS DOUBLE)))), 6) AS quality FROM g GROUP BY type""")
def consolidation_quality(spark, d):
    g = views.memories(spark, d).groupBy("type", "project_id").agg(F.count("*").alias("observations"), F.count_distinct("content_hash").alias("distinct_rows"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distinct_rows") / F.col("observations")))
    return g.groupBy("type").agg(F.count("*").alias("groups"), F.round(F.avg(share), 6).alias("quality"))


_FIRST = "CASE WHEN regexp_matches(trim(content), '(?s)^.*?[.!?]\\s') THEN regexp_extract(trim(content), '(?s)^(.*?[.!?])\\s', 1) ELSE trim(content) END"
_CUT = "left(f, 120)"
_LAST = f"(length({_CUT}) - length(string_split({_CUT}, ' ')[-1]) - 1)"
#: Lines of sections, and a row without one that opens each section of a project.
_SECTIONS = f"""l0 AS (SELECT project_id, type AS section, id, {_FIRST} AS f, row_number() OVER (PARTITION BY project_id, type ORDER BY CASE WHEN type IN ('decision','failure') THEN 0.0 ELSE importance END DESC, observed_at DESC, id DESC) AS position
  FROM mem WHERE project_id IS NOT NULL AND type IN ('decision','failure','procedural','preference') AND status IN ('active','stale') AND valid_from <= TIMESTAMP '2024-07-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-07-01') QUALIFY position <= CASE type WHEN 'decision' THEN 8 ELSE 6 END),
  l AS (SELECT project_id, section, position, '- ' || CASE WHEN length(f) <= 120 THEN f ELSE rtrim(left({_CUT}, CAST(CASE WHEN {_LAST} > 60 THEN {_LAST} ELSE 120 END AS INT))) || '…' END AS line FROM l0)"""
_SEQUENCE = """o AS (SELECT project_id, ord, share, title, position, line FROM sec JOIN l USING (section) UNION ALL SELECT project_id, ord, share, title, 0, NULL FROM sec, (SELECT DISTINCT project_id FROM l)),
  r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ord, position) AS k FROM o)"""


@query("session_contexts", f"""WITH RECURSIVE {MEM}, {_SECTIONS}, sec(section, share, ord, title) AS (VALUES ('digest', 200, 0, ''), ('decision', 250, 1, ''), ('failure', 150, 2, ''), ('procedural', 100, 3, ''), ('preference', 50, 4, '')), {_SEQUENCE},
  f AS (SELECT DISTINCT project_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS allowance, CAST(0 AS BIGINT) AS spent, CAST(0 AS BIGINT) AS used, '' AS text FROM r
    UNION ALL SELECT f.project_id, r.k, CASE WHEN line IS NULL THEN least(750 - used, share + greatest(0, allowance - spent)) ELSE allowance END,
      CASE WHEN line IS NULL THEN 0 WHEN CAST(ceil(length(line) / 4.0) AS BIGINT) <= allowance - spent THEN spent + CAST(ceil(length(line) / 4.0) AS BIGINT) ELSE spent END,
      CASE WHEN line IS NOT NULL AND CAST(ceil(length(line) / 4.0) AS BIGINT) <= allowance - spent THEN used + CAST(ceil(length(line) / 4.0) AS BIGINT) ELSE used END,
      CASE WHEN line IS NOT NULL AND CAST(ceil(length(line) / 4.0) AS BIGINT) <= allowance - spent THEN text || CASE WHEN text = '' THEN '' WHEN spent = 0 THEN chr(10) || chr(10) ELSE chr(10) END || line ELSE text END FROM f JOIN r ON r.project_id = f.project_id AND r.k = f.k + 1)
  SELECT project_id, used, text FROM f QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY k DESC) = 1""")
def session_contexts(spark, d):
    from ..operators import context

    return context.contexts(views.memories(spark, d).where(temporal.is_current(temporal.at(views.NOW))))


_LINE = "CAST(ceil((length(line) + 1) / 4.0) AS BIGINT)"
_TITLE = "CAST(ceil((length(title) + 1) / 4.0) AS BIGINT)"
_FITS = f"(line IS NOT NULL AND {_LINE} <= allowance - spent)"


@query("project_digests", f"""WITH RECURSIVE {MEM}, {_SECTIONS}, sec(section, share, ord, title) AS (VALUES ('decision', 0.5, 1, 'top decisions:'), ('failure', 0.3, 2, 'known failures:'), ('procedural', 0.2, 3, 'procedures:')), {_SEQUENCE},
  h AS (SELECT DISTINCT project_id, CAST(ceil((length('project: ' || project_id) + 1) / 4.0) AS BIGINT) AS head FROM l),
  f AS (SELECT project_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS allowance, CAST(0 AS BIGINT) AS spent, false AS has, head AS used, 'project: ' || project_id AS text FROM h
    UNION ALL SELECT f.project_id, r.k, CASE WHEN line IS NULL THEN CAST(floor((300 - head) * CAST(share AS DOUBLE)) AS BIGINT) + CASE WHEN has THEN allowance - spent ELSE allowance END ELSE allowance END,
      CASE WHEN line IS NULL THEN {_TITLE} WHEN {_FITS} THEN spent + {_LINE} ELSE spent END, CASE WHEN line IS NULL THEN false ELSE has OR {_FITS} END,
      CASE WHEN {_FITS} THEN used + {_LINE} + CASE WHEN has THEN 0 ELSE {_TITLE} END ELSE used END,
      CASE WHEN {_FITS} THEN text || CASE WHEN has THEN '' ELSE chr(10) || title END || chr(10) || line ELSE text END FROM f JOIN r ON r.project_id = f.project_id AND r.k = f.k + 1 JOIN h ON h.project_id = f.project_id)
  SELECT project_id, used, text FROM f QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY k DESC) = 1""")
def project_digests(spark, d):
    from ..operators import context

    return context.digests(views.memories(spark, d).where(temporal.is_current(temporal.at(views.NOW))))


@query("section_positions", f"""WITH {MEM} SELECT project_id, type AS section, id, row_number() OVER (PARTITION BY project_id, type ORDER BY CASE WHEN type IN ('decision','failure') THEN 0.0 ELSE importance END DESC, observed_at DESC, id DESC) AS position
  FROM mem WHERE project_id IS NOT NULL AND type IN ('decision','failure','procedural','preference') AND status IN ('active','stale') AND valid_from <= TIMESTAMP '2024-07-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-07-01')
  QUALIFY position <= CASE type WHEN 'decision' THEN 8 ELSE 6 END""")
def section_positions(spark, d):
    from ..operators import context

    return context.section_lines(views.memories(spark, d).where(temporal.is_current(temporal.at(views.NOW)))).drop("line")


_GATES = "(VALUES ('precision', 'min', 0.1), ('recall', 'min', 0.9), ('leaked', 'max', 0.2)) g(metric, side, bound)"


@query("metric_gates", f"""WITH o AS (SELECT [doc_id, doc_id + 1, doc_id + 2, doc_id + 3, doc_id + 4, doc_id + 5] AS returned, CASE WHEN doc_id % 3 = 0 THEN [doc_id + 2, doc_id + 9] ELSE [doc_id, doc_id + 1] END AS expected, [doc_id + 5 + doc_id % 4] AS forbidden FROM documents),
  m AS (SELECT avg(len(list_intersect(returned[1:5], expected)) / 5.0) AS p, avg(len(list_intersect(returned[1:5], expected)) / 2.0) AS r, avg(CAST(list_has_any(returned, forbidden) AS INT)) AS l FROM o),
  v AS (SELECT 'precision' AS metric, p AS value FROM m UNION ALL SELECT 'recall', r FROM m UNION ALL SELECT 'leaked', l FROM m)
  SELECT metric, round(value, 6) AS value, CASE WHEN side = 'min' THEN value >= bound ELSE value <= bound END AS passed FROM v JOIN {_GATES} USING (metric)""")
def metric_gates(spark, d):
    from ..operators import metrics
    from .event_queries import _outcomes

    m = metrics.retrieval(_outcomes(spark, d)).agg(F.avg("precision_at_k").alias("precision"), F.avg("recall_at_k").alias("recall"), F.avg(F.col("leaked").cast("double")).alias("leaked"))
    return metrics.gated(m.unpivot([], ["precision", "recall", "leaked"], "metric", "value"), {"precision": ("min", 0.1), "recall": ("min", 0.9), "leaked": ("max", 0.2)}).withColumn("value", F.round("value", 6))


_HEADS = ("bun test --watch ", "git status ", "cd /tmp ", "npm run build && ", "python -m ", "docker compose up ", "FOO=1 make ", '"quoted" ', "", "git  log ")
_SAID = ("I prefer tabs in code. ", "We always forget this. ", "never commit secrets! ", "upgraded to Node 22 today. ", "We decided to use Postgres and Docker because of next.js. ", "The api is now on v1.2.3; ",
         "Maybe the cache is stale. ", "What if k8s fails? ", "TODO: write the Kafka and sqlite-vec docs ", "")


def _lines(spark, d, heads):
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("conv_id") % len(heads) + 1).cast("int"))
    return views.read(spark, d, "conversations").select("conv_id", "turn", F.concat(head, F.col("text")).alias("text"))


def _lines_sql(heads) -> str:
    return "SELECT conv_id, turn, ([" + ", ".join("'" + h.replace("'", "''") + "'" for h in heads) + f"])[conv_id % {len(heads)} + 1] || text AS text FROM conversations"


_DENIED = ", ".join(f"('{x}')" for x in extraction.DENIED_COMMANDS)


@query("normalized_commands", f"""WITH c AS ({_lines_sql(_HEADS)}), w AS (SELECT conv_id, turn, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')[1:3] AS w FROM c),
  s AS (SELECT *, list_position(list_transform(w, lambda x: regexp_matches(x, '^(-|/|\\./|~|"|'')|[=<>|&;]')), true) AS p FROM w),
  n AS (SELECT conv_id, turn, array_to_string(CASE WHEN p > 0 THEN w[1:p - 1] ELSE w END, ' ') AS command FROM s)
  SELECT conv_id, turn, command, command = '' OR EXISTS (SELECT 1 FROM (VALUES {_DENIED}) d(x) WHERE lower(trim(command)) = x OR starts_with(lower(trim(command)), x || ' ')) AS denied FROM n""")
def normalized_commands(spark, d):
    c = _lines(spark, d, _HEADS).select("conv_id", "turn", extraction.command(F.col("text")).alias("command"))
    return c.withColumn("denied", extraction.is_denied(F.col("command")))


def _any_sql(patterns) -> str:
    return "(" + " OR ".join("regexp_matches(text, '(?i)" + p.replace("'", "''") + "')" for p in patterns) + ")"


def _first_sql(patterns) -> str:
    each = ("'(?i)" + p.replace("'", "''") + "'" for p in patterns)
    return "CASE " + " ".join(f"WHEN regexp_matches(text, {p}) THEN trim(regexp_extract(text, {p}, 1))" for p in each) + " END"


_VERSION = "'(?i)" + extraction.VERSIONS[2] + "'"
_MENTIONS = ", ".join(f"('{x}', '{name}')" for name, aliases in extraction.TECHNOLOGIES.items() for x in (name.lower(), *aliases))


@query("stated_preferences", f"""WITH c AS ({_lines_sql(_SAID)}) SELECT conv_id, turn, CASE WHEN NOT {_any_sql(extraction.PREFERENCE_NOISE)} THEN {_first_sql(extraction.PREFERENCES)} END AS preference,
  CASE WHEN NOT {_any_sql(extraction.VERSION_NOISE)} THEN coalesce({_first_sql(extraction.VERSIONS[:2])}, CASE WHEN regexp_matches(text, {_VERSION}) THEN regexp_extract(text, {_VERSION}, 1) || ' ' || regexp_extract(text, {_VERSION}, 2) END) END AS version,
  CASE WHEN NOT {_any_sql(extraction.DECISION_NOISE)} THEN {_first_sql(extraction.DECISIONS)} END AS decision, {_first_sql(extraction.TASKS)} AS task,
  {_any_sql(extraction.HYPOTHESES)} AS hypothesis, {_any_sql(extraction.QUESTIONS)} AS question FROM c""")
def stated_preferences(spark, d):
    t = F.col("text")
    return _lines(spark, d, _SAID).select(
        "conv_id", "turn", extraction.statement(t, extraction.PREFERENCES, extraction.PREFERENCE_NOISE).alias("preference"), extraction.version(t).alias("version"),
        extraction.statement(t, extraction.DECISIONS, extraction.DECISION_NOISE).alias("decision"), extraction.statement(t, extraction.TASKS).alias("task"),
        extraction.matched(t, extraction.HYPOTHESES).alias("hypothesis"), extraction.matched(t, extraction.QUESTIONS).alias("question"))


@query("technology_mentions", f"""WITH c AS ({_lines_sql(_SAID)}), a AS (SELECT * FROM (VALUES {_MENTIONS}) a(alias, name)),
  f AS (SELECT conv_id, turn, name, min(length(regexp_extract(lower(text), '(?s)^((?:.*?[^a-z0-9])?)' || regexp_escape(alias) || '(?:[^a-z0-9]|$)', 1))) AS p FROM c, a WHERE contains(lower(text), alias)
    AND regexp_matches(lower(text), '(?:^|[^a-z0-9])' || regexp_escape(alias) || '(?:[^a-z0-9]|$)') GROUP BY ALL)
  SELECT conv_id, turn, string_agg(name, ',' ORDER BY p) AS technologies FROM f GROUP BY ALL""")
def technology_mentions(spark, d):
    rows = _lines(spark, d, _SAID).select("conv_id", "turn", F.array_join(extraction.technologies(F.col("text")), ",").alias("technologies"))
    return rows.where("technologies <> ''")


_ASKED = ("what changed last year? ", "errors in the last 3 weeks ", "who deployed 2 months ago ", "what did we decide in 2023 ", "during 2023-12 ", "in 2024-02-10 ", "before 2024-03 ", "until 2023 but after 2022-05-04 ", "since 2024 ", "what runs now ", "")
_DATED = r"(20\d{2})(?:-(\d{2}))?(?:-(\d{2}))?"


def _scope_sql() -> str:
    g = lambda p, k: f"nullif(regexp_extract(q, '{p}', {k}), '')"
    start = lambda p: f"(make_timestamp(CAST({g(p, 1)} AS INT), coalesce(CAST({g(p, 2)} AS INT), 1), coalesce(CAST({g(p, 3)} AS INT), 1), 0, 0, 0))"
    month = lambda p: f"(make_timestamp(CAST({g(p, 1)} AS INT), coalesce(CAST({g(p, 2)} AS INT), 1), 1, 0, 0, 0))"
    end = lambda p: f"(CASE WHEN {g(p, 3)} IS NOT NULL THEN {start(p)} WHEN {g(p, 2)} IS NOT NULL THEN {month(p)} + INTERVAL 1 MONTH ELSE {month(p)} + INTERVAL 1 YEAR END)"
    last, ago = (r"\b(?:last|past)\s+(\d+)\s+(day|week|month|year)s?\b", r"\b(\d+)\s+(day|week|month|year)s?\s+ago\b")
    within, before, since = (rf"\b(?:{w})\s+{_DATED}\b" for w in ("in|during", "before|until", "after|since"))
    has = lambda p: f"regexp_matches(q, '{p}')"
    back = lambda p: f"{NOW} - to_days(CAST(CAST({g(p, 1)} AS INT) * CASE {g(p, 2)} WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 ELSE 365 END AS INT))"
    any_range = " OR ".join(map(has, (r"\blast year\b", last, ago, within, before, since)))
    return f"""WITH c AS (SELECT conv_id, turn, lower(text) AS q FROM ({_lines_sql(_ASKED)})) SELECT conv_id, turn, CASE WHEN {any_range} THEN 'historical' WHEN {has(r"\b(?:now|today|currently|current)\b")} THEN 'current' END AS mode,
      CASE WHEN {has(r"\blast year\b")} THEN TIMESTAMP '2023-01-01' WHEN {has(last)} THEN {back(last)} WHEN {has(ago)} THEN {back(ago)} WHEN {has(within)} THEN {month(within)} WHEN {has(since)} THEN {start(since)} END AS since,
      CASE WHEN {has(r"\blast year\b")} THEN TIMESTAMP '2024-01-01' WHEN {has(last)} OR {has(ago)} THEN {NOW} WHEN {has(within)} THEN {end(within)} WHEN {has(before)} THEN {end(before)} END AS until FROM c"""


@query("time_scopes", _scope_sql())
def time_scopes(spark, d):
    scope = scopes.time_scopes(F.col("text"), temporal.at(views.NOW))
    return _lines(spark, d, _ASKED).select("conv_id", "turn", scope.alias("s")).select("conv_id", "turn", "s.mode", F.col("s.from").alias("since"), "s.until")


_LEAKS = (
    ("AKIA", "id"), ("ghp_", "id40"), ("password=", "id"), ("author: Jane authority=high ", ""), ("Authorization: Bearer ", "id"), ("API_KEY=", "id"), ("client_secret: ", "id"), ("my_password = ", "id"), ("", ""),
)


@query("redaction_counts", r"""WITH h AS (SELECT doc_id, text, upper(substr(md5(CAST(doc_id AS VARCHAR)), 1, 16)) AS id, md5(CAST(doc_id AS VARCHAR)) || '00000000' AS id40 FROM documents),
  t AS (SELECT doc_id, text || ' ' || CASE doc_id % 9 WHEN 0 THEN 'AKIA' || id WHEN 1 THEN 'ghp_' || id40 WHEN 2 THEN 'password=' || id WHEN 3 THEN 'author: Jane authority=high ' WHEN 4 THEN 'Authorization: Bearer ' || id
    WHEN 5 THEN 'API_KEY=' || id WHEN 6 THEN 'client_secret: ' || id WHEN 7 THEN 'my_password = ' || id ELSE '' END AS t FROM h),
  a AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '(?:^|[^A-Za-z0-9_-])([A-Za-z][A-Za-z0-9_-]{0,60})\s*[=:]\s*(?:"[^"\n]{0,400}"|[^\s"''\n`;&]{1,400})', 1), lambda x: lower(x)) AS names FROM t),
  k AS (SELECT doc_id, len(regexp_extract_all(t, '(?:^|[^A-Z0-9])AKIA[0-9A-Z]{16}(?:[^A-Z0-9]|$)')) + len(list_filter(names, lambda x: contains(x, 'key'))) AS api_keys,
    len(regexp_extract_all(t, '(?:^|[^A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}(?:[^A-Za-z0-9]|$)')) + len(regexp_extract_all(t, '(?:[Bb]earer|[Tt]oken)\s+[A-Za-z0-9._~+/=-]{16,}')) + len(list_filter(names, lambda x: contains(x, 'token') AND NOT contains(x, 'key'))) AS tokens,
    len(list_filter(names, lambda x: regexp_matches(x, 'secret|password|passwd|pwd|credential|passphrase') AND NOT regexp_matches(x, 'key|token'))) AS passwords FROM a)
  SELECT doc_id, api_keys, tokens, passwords FROM k WHERE api_keys + tokens + passwords > 0""")
def redaction_counts(spark, d):
    """Documents with secrets, some of them added, and how many there are of each kind."""
    docs = views.read(spark, d, "documents")
    md5 = F.md5(F.col("doc_id").cast("string"))
    values = {"id": F.upper(F.substring(md5, 1, 16)), "id40": F.concat(md5, F.lit("00000000")), "": F.lit("")}
    added = F.element_at(F.array(*(F.concat(F.lit(head), values[tail]) for head, tail in _LEAKS)), (F.col("doc_id") % 9 + 1).cast("int"))
    found = docs.select("doc_id", redaction.redacted(F.concat_ws(" ", "text", added))["records"].alias("r")).where(F.size("r") > 0)
    count = lambda kind: F.size(F.filter("r", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", count("api-key").alias("api_keys"), count("token").alias("tokens"), count("password").alias("passwords"))


@query("skill_freshness", f"""WITH {EVENTS}, s AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 5 = 1 THEN 'none' ELSE CAST(n_nationkey AS VARCHAR) END AS signature FROM nation),
  f AS (SELECT k AS signature, max(occurred_at) AS "at" FROM ev WHERE kind = 'error' GROUP BY k)
  SELECT id, CAST(s.signature IS NOT NULL AS BIGINT) AS signatures, CAST(f."at" IS NOT NULL AS BIGINT) AS recurring, f."at" AS last_seen_at, CASE WHEN s.signature IS NULL THEN 'unresolved' WHEN f."at" IS NULL THEN 'stale' ELSE 'fresh' END AS state FROM s LEFT JOIN f ON s.signature = f.signature""")
def skill_freshness(spark, d):
    k = F.col("n_nationkey")
    signature = F.when(k % 5 == 1, "none").otherwise(k.cast("string"))
    s = views.read(spark, d, "nation").select(k.cast("long").alias("id"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(signature)).alias("signatures"))
    f = views.events(spark, d).where("kind = 'error'").select(F.col("k").alias("signature"), F.col("occurred_at").alias("at"))
    return skills.freshness(s, f)


@query("code_refs_hydrated", """WITH a AS (SELECT page_id, 'f/' || page_id AS path, sha1(html) AS blob FROM pages), y AS (SELECT 'f/' || (l_orderkey % 500) AS path, l_linenumber AS line_start, 's' || l_partkey AS name FROM lineitem),
  s AS (SELECT path, list(name ORDER BY line_start, name) AS names FROM y GROUP BY path)
  SELECT page_id AS id, path, CASE WHEN page_id % 3 <> 0 THEN 'c' || (page_id % 9) END AS commit, len(coalesce(names, [])) AS n_symbols, coalesce(names[1], '') AS first_symbol FROM a LEFT JOIN s USING (path)""")
def code_refs_hydrated(spark, d):
    k = F.col("page_id")
    files = views.read(spark, d, "pages").select(k, F.concat(F.lit("f/"), k.cast("string")).alias("path"), F.sha1("html").alias("blob"), F.concat(F.lit("c"), (k % 9).cast("string")).alias("commit"))
    refs = files.select(k.alias("id"), "path", F.when(k % 3 == 0, F.lit("old")).otherwise(F.col("blob")).alias("blob"))
    names = views.read(spark, d, "lineitem").select(F.concat(F.lit("f/"), (F.col("l_orderkey") % 500).cast("string")).alias("path"), F.col("l_linenumber").alias("line_start"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("name"))
    return skills.hydrated(refs, files, names).select("id", "path", "commit", F.size("symbols").alias("n_symbols"), F.coalesce(F.get("symbols", F.lit(0)), F.lit("")).alias("first_symbol"))

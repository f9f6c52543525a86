"""Queries over events, snapshots, failures, sessions and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import ERROR_CLASSES, FALLBACK_CLASS
from ..functions import temporal, text
from ..operators import lifecycle, memory, metrics, packing
from ..sources import views
from .registry import query
from .views_sql import EVENTS, MEM


@query("event_dedupe", f"WITH {EVENTS} SELECT project_id, kind, content_hash, min_by(id, (occurred_at, id)) AS id FROM ev WHERE kind <> 'view' OR id IS NULL GROUP BY project_id, kind, content_hash")
def event_dedupe(spark, d):
    """What an append may add when all views are in the log already."""
    e = views.events(spark, d)
    present = e.where("kind = 'view'")
    return memory.inserted(e, present, ["project_id", "kind", "content_hash"]).select("project_id", "kind", "content_hash", "id")


_CLEAN = "CASE WHEN id % 7 <> 0 THEN occurred_at END AS processed_at, id % 11 = 0 AS needs_review, CASE WHEN id % 13 = 0 THEN 'x' END AS process_error"


@query("compaction_plan", f"""WITH {EVENTS}, e AS (SELECT *, {_CLEAN}, id % 3 = 0 AS digest, occurred_at < TIMESTAMP '2024-04-15' - INTERVAL 90 DAY AS old, occurred_at < TIMESTAMP '2024-04-15' - INTERVAL 80 DAY AS aging FROM ev),
  a AS (SELECT CASE WHEN NOT old AND (NOT aging OR digest) THEN 'keep' WHEN NOT old THEN 'summarize' WHEN processed_at IS NULL OR needs_review OR process_error IS NOT NULL THEN 'keep' WHEN digest THEN 'purge' ELSE 'summarize_and_purge' END AS action,
  CASE WHEN NOT old AND NOT aging THEN 'recent' WHEN NOT old AND digest THEN 'summarized' WHEN NOT old THEN 'aging' WHEN processed_at IS NULL THEN 'unprocessed' WHEN needs_review THEN 'needs_review' WHEN process_error IS NOT NULL THEN 'process_error'
  WHEN digest THEN 'old with summary' ELSE 'old and clean' END AS reason FROM e) SELECT action, reason, count(*) AS n FROM a GROUP BY action, reason""")
def compaction_plan(spark, d):
    e = views.events(spark, d).select("*", F.expr("CASE WHEN id % 7 <> 0 THEN occurred_at END AS processed_at"), F.expr("id % 11 = 0 AS needs_review"), F.expr("CASE WHEN id % 13 = 0 THEN 'x' END AS process_error"))
    plan = lifecycle.compaction(e, e.where("id % 3 = 0").select("id"), temporal.at("2024-04-15 00:00:00"), 80, 90)
    return plan.groupBy("action", "reason").agg(F.count("*").alias("n"))


@query("recurring_commands", f"WITH {EVENTS} SELECT session_id, kind, count(*) AS n FROM ev GROUP BY session_id, kind HAVING count(*) >= 2")
def recurring_commands(spark, d):
    return views.events(spark, d).groupBy("session_id", "kind").agg(F.count("*").alias("n")).where("n >= 2")


@query("command_bigrams", f"""WITH {EVENTS}, b AS (SELECT user_id, kind AS first, lead(kind) OVER (PARTITION BY session_id ORDER BY occurred_at, id) AS second FROM ev)
  SELECT first, second, count(*) AS n, count(DISTINCT user_id) AS users FROM b WHERE second IS NOT NULL GROUP BY first, second HAVING count(*) >= 2""")
def command_bigrams(spark, d):
    w = Window.partitionBy("session_id").orderBy("occurred_at", "id")
    b = views.events(spark, d).select("user_id", F.col("kind").alias("first"), F.lead("kind").over(w).alias("second")).where("second IS NOT NULL")
    return b.groupBy("first", "second").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).where("n >= 2")


@query("failure_resolution", f"""WITH {EVENTS}, p AS (SELECT user_id, occurred_at, min(id) AS id FROM ev WHERE kind = 'purchase' GROUP BY user_id, occurred_at)
  SELECT f.user_id, f.id AS failure_id, p.id AS success_id, p.occurred_at AS success_at FROM ev f ASOF LEFT JOIN p ON f.user_id = p.user_id AND f.occurred_at < p.occurred_at WHERE f.kind = 'error'""")
def failure_resolution(spark, d):
    return lifecycle.first_success_after(views.events(spark, d), F.col("kind") == "error", F.col("kind") == "purchase", ["user_id"])


@query("related_resolution", f"""WITH {EVENTS}, x AS (SELECT *, unnest(list_distinct([CAST(k AS INT) % 7, id % 5])) AS shared FROM ev WHERE kind IN ('error', 'purchase')),
  j AS (SELECT f.user_id, f.id AS failure_id, min((p.occurred_at, p.id)) AS s FROM x f LEFT JOIN x p ON f.user_id = p.user_id AND f.shared = p.shared AND p.kind = 'purchase' AND f.occurred_at < p.occurred_at WHERE f.kind = 'error' GROUP BY f.user_id, f.id)
  SELECT user_id, failure_id, s[2] AS success_id, s[1] AS success_at FROM j""")
def related_resolution(spark, d):
    """The first later success that shares something with the failure (a command, a tool, a token)."""
    shared = F.array(F.col("k").cast("long") % 7, F.col("id") % 5)
    return lifecycle.first_success_after(views.events(spark, d), F.col("kind") == "error", F.col("kind") == "purchase", ["user_id"], shared)


#: Failure messages around values of the events, in the forms that the rewrites and error classes are about.
_FORMS = (
    ("Error: connect ECONNREFUSED 10.0.", "k", ".7:54", "n", " after ", "value", "ms"), ("EACCES: permission denied, open '/srv/app-", "k", "/data/", "n", ".json'", "", ""),
    ("\x1b[31mENOENT\x1b[0m: no such file or directory, stat ./src/mod", "k", "/file", "n", ".ts:12:", "k", ""), ("Cannot find module './lib/part-", "n", "' imported from packages/core/src/", "k", ".ts", "", ""),
    ("src/a", "k", ".ts:4:5 - error TS23", "k", "45: type", "n", " mismatch"), ("SyntaxError: Unexpected token at position ", "n", "", "", "", "", ""), ("TypeError:   undefined is not a function ", "k", "", "", "", "", ""),
    ("AssertionError: expected ", "value", " to equal ", "k", "", "", ""), ("JavaScript heap out of memory at 0x7ffe", "k", "ab", "", "", "", ""), ("duplicate key value violates unique constraint u_", "k", "", "", "", "", ""),
    ("deadlock detected by process ", "n", "", "", "", "", ""), ("request timed out after ", "value", " s", "", "", "", ""), ("exit code ", "k", " from job 123e4567-e89b-12d3-a456-4266141740", "two", "", "", ""), ("unknown trouble ", "n", "", "", "", "", ""),
)
_ORIGINS = ("build", "test", "tool", "terminal", "runtime", "command", "other")
_VALUES = {"k": "k", "n": "CAST(n AS VARCHAR)", "value": "v", "two": "lpad(CAST(n % 100 AS VARCHAR), 2, '0')"}


def _message_sql() -> str:
    say = lambda part: _VALUES[part] if part in _VALUES else "'" + part.replace("'", "''").replace("\x1b", "' || chr(27) || '") + "'"
    return "CASE n % 14 " + " ".join(f"WHEN {i} THEN " + " || ".join(map(say, form)) for i, form in enumerate(_FORMS)) + " END"


def _rewritten_sql(text: str) -> str:
    """The rewrites in a dialect without lookbehind: what stands before a path is kept by a group."""
    forms = (
        (r"\x1b\[[0-9;?]*[ -/]*[@-~]", " "), (r"\s+", " "), None,
        (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"), (r"\b0x[0-9a-f]+\b|\b[0-9a-f]{16,}\b", "<hex>"), (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<host>"),
        (r"(^|[^\w.-])(?:\.{1,2}/|/)[\w.@~-]+(?:/[\w.@~-]+)*(?:\.[a-z0-9]{1,8})?", r"\1<path>"), (r"(^|[^\w./-])(?:[\w.@~-]+/)+[\w.@-]+(?:\.[a-z0-9]{1,8})?", r"\1<path>"),
        (r":(\d+):(\d+)\b", ":<line>:<col>"), (r":\d{2,5}\b", ":<port>"), (r"\b\d+(?:\.\d+)?\s?(?:ms|s|min|h)\b", "<duration>"), (r"\b\d+(?:\.\d+)?\b", "<n>"), (r"\s+", " "),
    )
    for form in forms:
        text = f"lower(trim({text}))" if form is None else f"regexp_replace({text}, '{form[0]}', '{form[1]}', 'g')"
    return f"left(trim({text}), 300)"


_CLASSES = " ".join(f"WHEN regexp_matches(message, '{p}') THEN '{c}'" for c, p in ERROR_CLASSES)
_FALLBACKS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FALLBACK_CLASS.items())


@query("failure_signature", f"""WITH e AS (SELECT event_id AS id, event_id AS n, json_extract_string(props, '$.k') AS k, CAST(round(value) AS INT)::VARCHAR AS v, ({list(_ORIGINS)})[event_id % 7 + 1] AS origin FROM events WHERE event_type = 'error'),
  m AS (SELECT id, origin, {_rewritten_sql(_message_sql())} AS message FROM e),
  c AS (SELECT id, message, CASE {_CLASSES} ELSE coalesce(CASE origin {_FALLBACKS} END, 'ERROR') END AS class FROM m)
  SELECT id, message, class, substr(sha256('failure-v1' || chr(0) || class || chr(0) || message), 1, 16) AS signature FROM c""")
def failure_signature(spark, d):
    say = lambda part: F.expr(_VALUES[part].replace("VARCHAR", "STRING")) if part in _VALUES else F.lit(part)
    e = views.read(spark, d, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("id"), F.col("event_id").alias("n"), F.get_json_object("props", "$.k").alias("k"), F.round("value").cast("int").cast("string").alias("v"),
        F.element_at(F.array(*map(F.lit, _ORIGINS)), (F.col("event_id") % 7 + 1).cast("int")).alias("origin"))
    message = F.element_at(F.array(*(F.concat(*map(say, form)) for form in _FORMS)), (F.col("n") % 14 + 1).cast("int"))
    e = e.select("id", "origin", text.failure_message(message).alias("message"))
    e = e.withColumn("class", text.failure_class(F.col("message"), F.col("origin"))).drop("origin")
    return e.withColumn("signature", text.failure_signature(F.col("class"), F.col("message")))


_FAILURES = f"""f AS (SELECT project_id AS scope, user_id % 3 AS entity, k AS signature, CASE WHEN id % 3 <> 0 THEN 'restart the service and clear cache' || CASE WHEN id % 2 = 0 THEN ' twice' ELSE '' END END AS solution,
  CASE WHEN id % 5 = 0 THEN 'ok' END AS verification FROM ev WHERE kind = 'error')"""


@query("skill_gate", f"""WITH {EVENTS}, {_FAILURES}, t AS (SELECT DISTINCT scope, entity, signature, solution, string_split(solution, ' ') AS w FROM f WHERE solution IS NOT NULL),
  w AS (SELECT a.scope, a.entity, a.signature, min(len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE)) AS weakest FROM t a JOIN t b ON a.scope = b.scope AND a.entity = b.entity
  AND a.signature IS NOT DISTINCT FROM b.signature AND a.solution < b.solution GROUP BY ALL),
  g AS (SELECT scope, entity, signature, count(*) AS seen, count(solution) AS solved, max(CASE WHEN solution IS NOT NULL AND verification IS NOT NULL THEN 1 ELSE 0 END) AS proved FROM f GROUP BY ALL)
  SELECT g.*, round(coalesce(weakest, 1.0), 6) AS weakest, CASE WHEN solved < 2 THEN 'insufficient_solved_failures' WHEN weakest < 0.6 THEN 'divergent_solutions' WHEN proved = 0 THEN 'no_verification_evidence' ELSE 'qualified' END AS outcome
  FROM g LEFT JOIN w ON g.scope = w.scope AND g.entity = w.entity AND g.signature = w.signature""")
def skill_gate(spark, d):
    e = views.events(spark, d).where("kind = 'error'")
    f = e.select(F.col("project_id").alias("scope"), (F.col("user_id") % 3).alias("entity"), F.col("k").alias("signature"),
                 F.expr("CASE WHEN id % 3 <> 0 THEN concat('restart the service and clear cache', CASE WHEN id % 2 = 0 THEN ' twice' ELSE '' END) END AS solution"),
                 F.expr("CASE WHEN id % 5 = 0 THEN 'ok' END AS verification"))
    return lifecycle.recurring(f).withColumn("weakest", F.round("weakest", 6))


_SNAP = """a AS (SELECT page_id, 'src/' || (page_id % 9) || '/f' || page_id AS path, sha1(html) AS blob FROM pages), b AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'moved/' || page_id ELSE path END AS path,
  CASE WHEN page_id % 7 = 0 THEN sha1(blob) ELSE blob END AS blob FROM a WHERE page_id % 11 <> 0),
  d AS (SELECT path, a.blob AS old, b.blob AS new, CASE WHEN a.blob IS NULL THEN 'added' WHEN b.blob IS NULL THEN 'deleted' WHEN a.blob <> b.blob THEN 'modified' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (path))"""
_RENAMES = """r AS (SELECT x.path AS from_path, y.path AS to_path, x.old AS blob FROM (SELECT old, min(path) AS path FROM d WHERE change = 'deleted' GROUP BY old HAVING count(*) = 1) x
  JOIN (SELECT new, min(path) AS path FROM d WHERE change = 'added' GROUP BY new HAVING count(*) = 1) y ON x.old = y.new)"""


def _snapshots(spark, d):
    a = views.read(spark, d, "pages").select("page_id", F.concat(F.lit("src/"), (F.col("page_id") % 9).cast("string"), F.lit("/f"), F.col("page_id").cast("string")).alias("path"), F.sha1("html").alias("blob"))
    b = a.where("page_id % 11 <> 0").select(F.when(F.col("page_id") % 13 == 0, F.concat(F.lit("moved/"), F.col("page_id").cast("string"))).otherwise(F.col("path")).alias("path"), F.when(F.col("page_id") % 7 == 0, F.sha1("blob")).otherwise(F.col("blob")).alias("blob"))
    return a, b


@query("snapshot_diff", f"WITH {_SNAP} SELECT * FROM d")
def snapshot_diff(spark, d):
    return lifecycle.snapshot_diff(*_snapshots(spark, d))


@query("rename_pairs", f"WITH {_SNAP}, {_RENAMES} SELECT * FROM r")
def rename_pairs(spark, d):
    return lifecycle.renames(lifecycle.snapshot_diff(*_snapshots(spark, d)))


@query("drift_status", f"""WITH {_SNAP}, {_RENAMES}, n AS (SELECT count(*) AS n FROM pages), refs AS (SELECT doc_id AS id, path, blob FROM documents, n JOIN a ON page_id = doc_id % n)
  SELECT refs.id, path, CASE WHEN to_path IS NOT NULL THEN 'moved' WHEN change IS NULL OR change = 'deleted' THEN 'path_missing' WHEN new <> refs.blob THEN 'content_changed' ELSE 'valid' END AS state, to_path
  FROM refs LEFT JOIN d USING (path) LEFT JOIN r ON from_path = path""")
def drift_status(spark, d):
    a, b = _snapshots(spark, d)
    diff = lifecycle.snapshot_diff(a, b)
    n = views.read(spark, d, "pages").agg(F.count("*").alias("n"))
    refs = views.read(spark, d, "documents").crossJoin(F.broadcast(n)).select(F.col("doc_id").alias("id"), (F.col("doc_id") % F.col("n")).alias("page_id")).join(a, "page_id").select("id", "path", "blob")
    return lifecycle.drift(refs, diff, lifecycle.renames(diff))


@query("architecture_modules", f"""WITH {_SNAP} SELECT regexp_extract(path, '^((?:[^/]+/)?[^/]+)/', 1) AS module, count(DISTINCT path) AS files, count(DISTINCT blob) AS blobs, array_to_string(list(path ORDER BY path)[1:3], ' ') AS entry_points FROM a GROUP BY 1""")
def architecture_modules(spark, d):
    a = _snapshots(spark, d)[0].withColumn("module", F.regexp_extract("path", r"^((?:[^/]+/)?[^/]+)/", 1))
    first = Window.partitionBy("module").orderBy("path")
    top = a.withColumn("k", F.row_number().over(first)).groupBy("module").agg(
        F.count_distinct("path").alias("files"), F.count_distinct("blob").alias("blobs"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.col("path")))), " ").alias("entry_points"))
    return top


_WORKING = """w AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN conv_id END AS promoted_memory_id, CASE WHEN conv_id % 4 <> 0 THEN conv_id END AS source_id, turn % 3 AS evidence, CAST(conv_id % 10 AS DOUBLE) / 10 AS importance,
  TIMESTAMP '2024-01-01' + to_hours(conv_id) + INTERVAL 24 HOUR AS expires_at FROM conversations)"""


def _working(spark, d):
    return views.read(spark, d, "conversations").select(
        "conv_id", "turn", F.expr("CASE WHEN conv_id % 9 = 0 THEN conv_id END AS promoted_memory_id"), F.expr("CASE WHEN conv_id % 4 <> 0 THEN conv_id END AS source_id"),
        (F.col("turn") % 3).alias("evidence"), (F.col("conv_id") % 10 / 10.0).alias("importance"),
        F.timestamp_add("HOUR", (F.col("conv_id") + 24).cast("int"), temporal.at("2024-01-01 00:00:00")).alias("expires_at"))


@query("promotion_decisions", f"""WITH {_WORKING} SELECT conv_id, turn, CASE WHEN promoted_memory_id IS NOT NULL THEN 'already_promoted' WHEN source_id IS NULL THEN 'no_source' WHEN evidence = 0 THEN 'no_evidence'
  WHEN importance < 0.5 THEN 'below_importance_threshold' ELSE 'eligible' END AS decision FROM w""")
def promotion_decisions(spark, d):
    return lifecycle.promotion(_working(spark, d)).select("conv_id", "turn", "decision")


@query("ttl_sweep", f"WITH {_WORKING} SELECT expires_at <= TIMESTAMP '2024-01-08' AS expired, promoted_memory_id IS NOT NULL AS promoted, count(*) AS n FROM w GROUP BY 1, 2")
def ttl_sweep(spark, d):
    at = temporal.at("2024-01-08 00:00:00")
    return _working(spark, d).groupBy((F.col("expires_at") <= at).alias("expired"), F.col("promoted_memory_id").isNotNull().alias("promoted")).agg(F.count("*").alias("n"))


@query("future_value_gate", f"""WITH {MEM}, c AS (SELECT id, content, importance, confidence, CASE WHEN id % 4 = 0 THEN 'semantic_candidate' ELSE type END AS type, id % 5 AS evidence, CASE WHEN id % 7 <> 0 THEN 'reuse' END AS rationale FROM mem)
  SELECT id, CASE WHEN evidence = 0 THEN 'no_evidence' WHEN length(trim(coalesce(rationale, ''))) = 0 THEN 'no_rationale' WHEN length(trim(content)) < 8 THEN 'too_short' WHEN importance < 0.45 THEN 'importance'
  WHEN type = 'semantic_candidate' AND confidence < 0.5 THEN 'confidence' END AS reason FROM c""")
def future_value_gate(spark, d):
    c = views.memories(spark, d).select("id", "content", "importance", "confidence", F.when(F.col("id") % 4 == 0, "semantic_candidate").otherwise(F.col("type")).alias("type"), (F.col("id") % 5).alias("evidence"), F.when(F.col("id") % 7 != 0, "reuse").alias("rationale"))
    return lifecycle.gate(c).select("id", "reason")


_OUT = """o AS (SELECT doc_id AS query_id, [doc_id, doc_id + 1, doc_id + 2, doc_id + 3, doc_id + 4, doc_id + 5] AS returned, CASE WHEN doc_id % 3 = 0 THEN [doc_id + 2, doc_id + 9] ELSE [doc_id, doc_id + 1] END AS expected,
  [doc_id + 5 + doc_id % 4] AS forbidden, doc_id % 97 AS used, 90 AS budget, 'b' || (doc_id % 4) AS bucket FROM documents)"""


def _outcomes(spark, d):
    q = F.col("doc_id")
    return views.read(spark, d, "documents").select(
        q.alias("query_id"), F.array(*(q + k for k in range(6))).alias("returned"), F.when(q % 3 == 0, F.array(q + 2, q + 9)).otherwise(F.array(q, q + 1)).alias("expected"),
        F.array(q + 5 + q % 4).alias("forbidden"), (q % 97).alias("used"), F.lit(90).alias("budget"), F.concat(F.lit("b"), (q % 4).cast("string")).alias("bucket"))


_METRIC = """m AS (SELECT query_id, bucket, len(list_intersect(returned[1:5], expected)) / 5.0::DOUBLE AS precision_at_k, len(list_intersect(returned[1:5], expected)) / CAST(len(expected) AS DOUBLE) AS recall_at_k,
  1.0::DOUBLE / list_min(list_filter(list_transform(expected, lambda x: list_position(returned, x)), lambda p: p > 0)) AS reciprocal_rank, list_has_any(returned, forbidden) AS leaked FROM o)"""


@query("retrieval_metrics", f"WITH {_OUT}, {_METRIC} SELECT query_id, precision_at_k, recall_at_k, round(coalesce(reciprocal_rank, 0), 6) AS reciprocal_rank, leaked FROM m")
def retrieval_metrics(spark, d):
    return metrics.retrieval(_outcomes(spark, d)).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query("precision_intervals", f"""WITH {_OUT}, {_METRIC}, g AS (SELECT bucket, count(*) AS n, avg(precision_at_k) AS mean, stddev_samp(precision_at_k) AS sd FROM m GROUP BY bucket)
  SELECT bucket, n, round(mean, 6) AS mean, round(greatest(0, mean - 1.96 * sd / sqrt(n)), 6) AS low, round(least(1, mean + 1.96 * sd / sqrt(n)), 6) AS high FROM g""")
def precision_intervals(spark, d):
    rows = metrics.retrieval(_outcomes(spark, d)).withColumn("bucket", F.concat(F.lit("b"), (F.col("query_id") % 4).cast("string")))
    return metrics.mean_interval(rows, "precision_at_k", "bucket").select("bucket", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query("token_metrics", f"""WITH {_OUT} SELECT round(avg(CASE WHEN used <= budget THEN 1.0 ELSE 0.0 END), 6) AS compliance, round(avg(used), 6) AS mean, max(used) AS most, CAST(quantile_disc(used, 0.95) AS BIGINT) AS p95 FROM o""")
def token_metrics(spark, d):
    return metrics.tokens(_outcomes(spark, d)).select(F.round("compliance", 6).alias("compliance"), F.round("mean", 6).alias("mean"), "most", "p95")


@query("cross_project_leakage", f"""WITH {MEM}, r AS (SELECT id % 50 AS query_id, row_number() OVER (PARTITION BY id % 50 ORDER BY importance DESC, id) AS pos, project_id FROM mem)
  SELECT round(avg(CAST(project_id IS NOT NULL AND project_id <> 'p1' AS INT)), 6) AS leakage, round(avg(CASE WHEN pos = 1 THEN CAST(project_id IS NOT NULL AND project_id <> 'p1' AS INT) END), 6) AS top1 FROM r""")
def cross_project_leakage(spark, d):
    order = Window.partitionBy("query_id").orderBy(F.col("importance").desc(), "id")
    r = views.memories(spark, d).withColumn("query_id", F.col("id") % 50).select("query_id", F.row_number().over(order).alias("pos"), "project_id", F.lit("p1").alias("wanted"))
    return metrics.leakage(r).select(F.round("leakage", 6).alias("leakage"), F.round("top1", 6).alias("top1"))


_SIZE = lambda c: f"CAST(ceil(length({c}) / 4.0) AS BIGINT)"


def _packed_sql() -> str:
    """Summaries by score for a token, then contents, then titles, one item at a time."""
    from .memory_queries import LEXICAL

    return f"""WITH RECURSIVE {MEM}, {LEXICAL}, i AS (SELECT id, lexical_rank AS rank, ts_rank AS score, content, string_split(content, '.')[1] AS summary, left(content, 60) AS title FROM lex),
  z AS (SELECT *, {_SIZE("title")} AS t, {_SIZE("summary")} AS s, {_SIZE("content")} AS c FROM i),
  o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY phase, CASE WHEN phase = 1 THEN -score / greatest(1, s) ELSE 0 END, rank) AS k FROM z, (VALUES (1), (2), (3)) AS p(phase)),
  f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS titles, CAST([] AS BIGINT[]) AS sums, CAST(NULL AS BIGINT) AS id, NULL::VARCHAR AS kind, CAST(0 AS BIGINT) AS tokens
    UNION ALL SELECT o.k, CASE WHEN g THEN used + CASE phase WHEN 1 THEN s WHEN 2 THEN c - s ELSE t END ELSE used END, CASE WHEN g AND phase = 3 THEN titles + 1 ELSE titles END, CASE WHEN g AND phase = 1 THEN list_append(sums, o.id) ELSE sums END,
      CASE WHEN g THEN o.id END, CASE phase WHEN 1 THEN 'summary' WHEN 2 THEN 'content' ELSE 'title-only' END, CASE phase WHEN 1 THEN s WHEN 2 THEN c ELSE t END
    FROM (SELECT o.*, f.used, f.titles, f.sums, CASE phase WHEN 1 THEN s > 0 AND s <= 800 - used WHEN 2 THEN list_contains(sums, o.id) AND content <> summary AND c > s AND c - s <= 800 - used ELSE NOT list_contains(sums, o.id) AND titles < 10 AND t > 0 AND t <= 800 - used END AS g FROM f JOIN o ON o.k = f.k + 1) o)
  SELECT CAST(1 AS BIGINT) AS query_id, f.id, CAST(z.rank AS INT) AS rank, f.kind, f.tokens FROM f JOIN z ON z.id = f.id QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY f.k DESC) = 1"""


@query("packed_results", _packed_sql())
def packed_results(spark, d):
    """The lexical top rows packed into 800 tokens: summaries, then contents, then titles."""
    from .memory_queries import _lexical

    hits = _lexical(spark, d)
    rows = hits.select(F.lit(1).cast("long").alias("query_id"), F.col("lexical_rank").alias("rank"), "id", F.substring("content", 1, 60).alias("title"),
                       F.substring_index("content", ".", 1).alias("summary"), "content", F.col("ts_rank").alias("score"))
    return packing.packed(rows, 800)


@query("evidence_locators", f"""WITH {MEM}, e AS (SELECT id, unnest(['event:' || (id % 200), 'file:' || (id % 31)]) AS locator FROM mem) SELECT DISTINCT locator FROM (SELECT locator FROM e UNION SELECT 'event:' || (l_orderkey % 300) FROM lineitem)""")
def evidence_locators(spark, d):
    m = views.memories(spark, d).select(F.explode(F.array(F.concat(F.lit("event:"), (F.col("id") % 200).cast("string")), F.concat(F.lit("file:"), (F.col("id") % 31).cast("string")))).alias("locator"))
    return m.union(views.read(spark, d, "lineitem").select(F.concat(F.lit("event:"), (F.col("l_orderkey") % 300).cast("string")))).distinct()


@query("top_decisions", """SELECT o_orderkey AS decision_id, o_orderstatus AS status, o_orderdate AS decided_at FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10""")
def top_decisions(spark, d):
    o = views.read(spark, d, "orders").where("o_orderstatus = 'O'")
    return o.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(10).select(F.col("o_orderkey").alias("decision_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("decided_at"))



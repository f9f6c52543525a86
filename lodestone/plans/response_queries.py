"""Queries over what goes with a search's results and with extracted candidates, and over benchmark gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extraction as rules
from ..operators import context, extraction, metrics, search, skills
from ..sources import views
from .registry import query
from .store_queries import _agent_events
from .views_sql import EDGES, EVENTS, MEM

L = r"\pL\pN_"  #: letters, digits and _ of a name
_REFS = """refs AS (SELECT DISTINCT l_orderkey % nd AS id, 'r' || (l_linenumber % 2) AS repository, 'src/f' || (l_partkey % 50) || '.ts' AS path FROM lineitem, (SELECT count(*) AS nd FROM documents)),
  symbols AS (SELECT 'r' || (p_partkey % 2) AS repository, 'src/f' || (p_partkey % 50) || '.ts' AS path, (['the','In','que','die','tion','of'])[p_partkey % 6 + 1] AS name, p_partkey % 90 AS line_start FROM part)"""


def _code(spark, d):
    n = views.read(spark, d, "documents").agg(F.count("*").alias("nd"))
    file = lambda c: F.concat(F.lit("src/f"), (F.col(c) % 50).cast("string"), F.lit(".ts"))
    refs = views.read(spark, d, "lineitem").crossJoin(F.broadcast(n)).select((F.col("l_orderkey") % F.col("nd")).alias("id"), F.concat(F.lit("r"), (F.col("l_linenumber") % 2).cast("string")).alias("repository"), file("l_partkey").alias("path")).distinct()
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, ("the", "In", "que", "die", "tion", "of"))), (k % 6 + 1).cast("int"))
    symbols = views.read(spark, d, "part").select(F.concat(F.lit("r"), (k % 2).cast("string")).alias("repository"), file("p_partkey").alias("path"), name.alias("name"), (k % 90).alias("line_start"))
    return refs.withColumn("commit", F.lit("c1")).withColumn("blob", F.sha2("path", 256)), symbols


@query("result_attachments", f"""WITH {MEM}, {EDGES}, {_REFS}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY repository, path) AS k, count(*) OVER (PARTITION BY id) AS n FROM refs JOIN (SELECT id, content FROM mem) USING (id)),
  w AS MATERIALIZED (SELECT id, name FROM (SELECT id, content, unnest(['the','In','que','die','tion','of']) AS name FROM mem) WHERE CASE name {" ".join(f"WHEN '{x}' THEN regexp_matches(content, '(^|[^{L}])' || '{x}' || '($|[^{L}])')" for x in ("the", "In", "que", "die", "tion", "of"))} END),
  s AS (SELECT id, k, name, row_number() OVER (PARTITION BY id, k ORDER BY line_start, name) AS first FROM k JOIN symbols USING (repository, path) JOIN w USING (id, name) WHERE k <= 5),
  r AS (SELECT id, string_agg(repository || ' ' || CASE WHEN k = 6 THEN '<' || (n - 5) || ' more refs>' ELSE path || coalesce(' ' || name, '') END, ',' ORDER BY k) AS code_refs FROM k LEFT JOIN (FROM s WHERE first = 1) USING (id, k) WHERE k <= 6 GROUP BY id),
  c AS (SELECT src AS id, dst AS other FROM edges WHERE relation = 'r3' UNION SELECT dst, src FROM edges WHERE relation = 'r3'), o AS (SELECT id, string_agg(other, ',' ORDER BY other) AS others FROM c GROUP BY id)
  SELECT id, coalesce(code_refs, '') AS code_refs, CASE WHEN status = 'disputed' THEN coalesce(others, CAST(id AS VARCHAR)) ELSE '' END AS conflicts FROM mem LEFT JOIN r USING (id) LEFT JOIN o USING (id)""")
def result_attachments(spark, d):
    """Code references and conflicts of all memories, as they go with a result."""
    refs, symbols = _code(spark, d)
    edges = views.edges(spark, d).withColumn("relation", F.when(F.col("relation") == "r3", "contradicts").otherwise(F.col("relation")))
    rows = search.attached(views.memories(spark, d), search.Sources(None, edges=edges, refs=refs, symbols=symbols))
    line = F.transform("code_refs", lambda x: F.concat_ws(" ", x["repository"], x["path"], x["symbol"]))
    return rows.select("id", F.array_join(line, ",").alias("code_refs"), F.array_join(F.transform("conflicts", lambda x: x["memory_id"].cast("string")), ",").alias("conflicts"))


_RUN = "([' bun test','make all','git pull'])[id % 3 + 1]"
_TRIED = f"""t AS (SELECT id, project_id, session_id, occurred_at, CASE id % 7 WHEN 0 THEN 'run' WHEN 1 THEN 'run' WHEN 2 THEN 'error' WHEN 3 THEN 'tests' WHEN 4 THEN 'tests' ELSE 'tool' END AS what, id % 7 IN (1, 4, 6) AS good,
  CASE id % 7 WHEN 0 THEN {_RUN} WHEN 1 THEN {_RUN} WHEN 2 THEN 'codex: ' || trim({_RUN}) || ' in src/a' || (id % 5) || '/x' END AS said, CASE WHEN id % 7 IN (3, 4) THEN 'suite' || (id % 2) WHEN id % 7 >= 5 THEN 'tool' || (id % 2) END AS name FROM ev)"""


def _tried(spark, d):
    """Events of commands, errors, test runs and tool calls, some of which repeat what failed before."""
    e = views.events(spark, d)
    i = F.col("id").cast("long")
    run = F.element_at(F.array(F.lit(" bun test"), F.lit("make all"), F.lit("git pull")), (i % 3 + 1).cast("int"))
    js = lambda **x: F.to_json(F.struct(*(v.alias(k) for k, v in x.items())))
    n = lambda x: F.lit(x)
    suite, tool = (F.concat(F.lit(x), (i % 2).cast("string")) for x in ("suite", "tool"))
    said = F.concat(F.lit("codex: "), F.trim(run), F.lit(" in src/a"), (i % 5).cast("string"), F.lit("/x"))
    kinds = (("terminal.output", js(command=run, exit_code=n(1))), ("terminal.output", js(command=run, exit_code=n(0))), ("error.raised", js(origin=n("build"), message=n("cannot find it"), context=said)),
             ("test.results", js(passed=n(1), failed=n(2), framework=suite)), ("test.results", js(passed=n(3), failed=n(0), framework=suite)),
             ("conversation.tool_result", js(call_id=n("c"), ok=n(False), tool=tool, output_digest=n("no"))), ("conversation.tool_result", js(call_id=n("c"), ok=n(True), tool=tool, output_digest=n(" done "))))
    pick = lambda k: F.coalesce(*(F.when(i % 7 == r, F.lit(v[0]) if k == 0 else v[1]) for r, v in enumerate(kinds)))
    return e.select(i.alias("id"), pick(0).alias("kind"), pick(1).alias("payload"), "occurred_at", "session_id", "project_id")


@query("failure_payloads", f"""WITH {EVENTS}, {_TRIED}, m AS (SELECT f.id, f.what, s.id AS done, s.said AS ran, s.name, row_number() OVER (PARTITION BY f.id ORDER BY s.occurred_at, s.id) AS k FROM t f LEFT JOIN t s ON s.good AND f.project_id = s.project_id AND f.session_id = s.session_id AND s.occurred_at > f.occurred_at
    AND ((s.what = 'run' AND trim(s.said) = CASE f.what WHEN 'run' THEN trim(f.said) WHEN 'error' THEN regexp_replace(regexp_replace(f.said, '^codex: ', ''), ' in src/.*$', '') END) OR (s.what = f.what AND s.name = f.name)) WHERE NOT f.good)
  SELECT id, CASE WHEN done IS NULL THEN 'open' WHEN what = 'tool' THEN 'mitigated' ELSE 'verified' END AS status,
    CASE WHEN done IS NOT NULL THEN CASE what WHEN 'tests' THEN 'Successful ' || name || ' test rerun' WHEN 'tool' THEN 'Observed successful ' || name || ' call' ELSE 'Successful retry: ' || ran END END AS solution,
    CASE WHEN done IS NOT NULL THEN CASE what WHEN 'tests' THEN name || ': 3 passed, 0 failed' WHEN 'tool' THEN 'Tool ' || name || ' reported ok: true:  done ' ELSE 'Command ' || ran || ' exited 0' END END AS verification FROM m WHERE k = 1""")
def failure_payloads(spark, d):
    """What is stored with each failure: open, mitigated or verified, and by what."""
    return extraction.failure_payloads(_tried(spark, d)).select("id", "status", "solution", "verification")


_RUNS = "(['bun test','git status','make build','npm run lint','docker compose up'])[CAST(k AS INT) % 5 + 1]"


@query("candidate_evidence", f"""WITH {EVENTS}, r AS (SELECT id + 10000000 AS id, project_id, session_id, occurred_at, {_RUNS} AS normal, {_RUNS} || CASE WHEN CAST(k AS INT) % 5 = 4 THEN ' -d' ELSE '' END AS said, CASE WHEN kind = 'click' THEN 1 ELSE 0 END AS code FROM ev WHERE kind IN ('purchase', 'click') AND {_RUNS} <> 'git status'),
  p AS (SELECT *, normal || ' → ' || lead(normal) OVER (PARTITION BY project_id, session_id ORDER BY occurred_at, id) AS pair FROM r), s AS (SELECT project_id, session_id, pair, min(id) AS a, max(id) AS b FROM p WHERE pair IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
  SELECT s.project_id, s.session_id, pair, 'event:' || a || ' $ ' || x.said || ' → exit ' || x.code || ',event:' || b || ' $ ' || y.said || ' → exit ' || y.code AS evidence FROM s JOIN r x ON x.id = a JOIN r y ON y.id = b""")
def candidate_evidence(spark, d):
    """Where recurring sequences of commands come from: their first and last events."""
    events = _agent_events(spark, d)
    found = extraction.with_evidence(extraction.extracted(events).where("rule = 'sequence'"), events)
    spans = F.transform("evidence", lambda x: F.concat_ws(" ", x["locator"], x["excerpt"]))
    return found.select("project_id", "session_id", F.regexp_extract("content", "`(.*)`", 1).alias("pair"), F.array_join(spans, ",").alias("evidence"))


@query("event_texts", """WITH e AS (SELECT conv_id * 1000 + turn AS id, conv_id % 4 AS k, turn, text FROM conversations)
  SELECT id, CASE k WHEN 0 THEN 'document ' || CASE turn % 3 WHEN 0 THEN 'T' || turn WHEN 1 THEN 'p/' || turn ELSE '' END || ': ' || text WHEN 1 THEN 'session.start cwd=/w' || turn || ' ' WHEN 2 THEN 'session.end cwd= ' || text ELSE 'explicit remember: ' || text END AS text FROM e""")
def event_texts(spark, d):
    """Texts of documents, session starts and ends, for matching."""
    c = views.read(spark, d, "conversations")
    k, t = F.col("conv_id") % 4, F.col("turn").cast("string")
    title, path = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("T"), t)), F.when(F.col("turn") % 3 == 1, F.concat(F.lit("p/"), t))
    payload = (F.when(k == 0, F.to_json(F.struct(title.alias("title"), path.alias("path"), F.col("text").alias("content_digest")))).when(k == 1, F.to_json(F.struct(F.concat(F.lit("/w"), t).alias("cwd"))))
               .when(k == 2, F.to_json(F.struct(F.col("text").alias("summary")))).otherwise(F.to_json(F.struct(F.col("text").alias("content")))))
    kind = F.when(k == 0, "document.added").when(k == 1, "session.start").when(k == 2, "session.end").otherwise("explicit.remember")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), rules.event_text(kind, payload).alias("text"))


@query("digest_lines", """WITH p AS (SELECT 'p' || c_custkey AS project_id, c_name AS name, c_mktsegment AS description, CAST(c_custkey AS BIGINT) AS k FROM customer)
  SELECT project_id, unnest(list_transform(list_filter(['project: ' || name, CASE WHEN k % 3 <> 0 THEN 'description: ' || description END, CASE WHEN k % 4 = 0 THEN 'code map: ' || name END, 'stack: ' || repeat('word ', CAST(k % 40 AS INT)) || 'end'], lambda x: x IS NOT NULL), lambda x, i: {'position': CAST(i AS INT), 'line': x}), recursive := true) FROM p""")
def digest_lines(spark, d):
    """Lines of projects' digests as they open a session's context."""
    k = F.col("c_custkey").cast("int")
    digest = F.map_concat(F.create_map(F.lit("stack"), F.concat(F.repeat(F.lit("word "), k % 40), F.lit("end"))), F.when(k % 4 == 0, F.create_map(F.lit("code_map"), F.col("c_name"))).otherwise(F.create_map(F.lit("code_map"), F.lit(""))))
    projects = views.read(spark, d, "customer").select(F.concat(F.lit("p"), k.cast("string")).alias("project_id"), F.col("c_name").alias("name"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("description"), digest.alias("digest"))
    return context.digest_lines(projects).select("project_id", F.col("position").cast("int").alias("position"), "line")


_RUN_OF = """o AS (SELECT doc_id AS query_id, (['procedural','decision','failure','fact'])[doc_id % 4 + 1] AS kind, [doc_id, doc_id + 1, doc_id + 2, doc_id + 3, doc_id + 4, doc_id + 5] AS returned, CASE WHEN doc_id % 3 = 0 THEN [doc_id + 2, doc_id + 9] ELSE [doc_id, doc_id + 1] END AS expected,
  [doc_id + 5 + doc_id % 4] AS forbidden, doc_id % 97 AS used, 90 AS budget, 10 + doc_id % 20 AS oracle, doc_id % 5 <> 0 AS satisfied, doc_id FROM documents),
  m AS (SELECT kind, len(list_intersect(returned[1:5], expected)) / 5.0::DOUBLE AS p, len(list_intersect(returned[1:5], expected)) / CAST(len(expected) AS DOUBLE) AS r, CAST(list_has_any(returned, forbidden) AS INT) AS l, CAST(used <= budget AS INT) AS b, used / CAST(oracle AS DOUBLE) AS g, satisfied FROM o)"""
_BOUNDS = "(VALUES " + ", ".join(f"('{k}', '{side}', {bound})" for k, (side, bound) in metrics.GATES.items()) + ") AS g(metric, side, bound)"


@query("gate_report", f"""WITH {MEM}, {_RUN_OF}, v AS (SELECT unnest([{{'metric': 'retrieval_precision_at_k', 'value': avg(p)}}, {{'metric': 'retrieval_recall_at_k', 'value': avg(r)}}, {{'metric': 'irrelevant_leakage_rate', 'value': avg(l)}}, {{'metric': 'token_budget_compliance', 'value': avg(b)}},
    {{'metric': 'token_oracle_gap_mean', 'value': avg(CASE WHEN kind <> 'fact' AND satisfied THEN g END)}}], recursive := true) FROM m
  UNION ALL SELECT n || '_' || kind, CASE n WHEN 'retrieval_precision' THEN avg(p) WHEN 'retrieval_recall' THEN avg(r) ELSE avg(b) END FROM m, (SELECT unnest(['retrieval_precision', 'retrieval_recall', 'token_budget_compliance']) AS n) WHERE kind <> 'fact' GROUP BY n, kind
  UNION ALL SELECT 'cross_project_top1_rate', avg(CAST(project_id IS NOT NULL AND project_id <> 'p1' AS INT)) FROM mem WHERE id % 7 = 0
  UNION ALL SELECT 'temporal_accuracy', avg(CAST(status = 'active' AS INT)) FROM mem UNION ALL SELECT 'contradiction_accuracy', avg(CAST(status IN ('superseded', 'disputed') AS INT)) FROM mem WHERE id % 5 = 2
  UNION ALL SELECT 'consolidation_quality', avg(CAST(status = 'superseded' AS INT)) FROM mem WHERE id % 10 = 4 UNION ALL SELECT 'stale_cited_memories', count(*) FROM mem WHERE status = 'archived' AND access_count = 12
  UNION ALL SELECT 'unresolved_contradicted_memories', count(*) FROM mem WHERE id % 100 = 2 AND status NOT IN ('superseded', 'disputed') UNION ALL SELECT 'duplicate_surfaced_pairs', 0)
  SELECT metric, round(value, 6) AS value, CASE WHEN side = 'min' THEN value >= bound ELSE value <= bound END AS passed FROM v JOIN {_BOUNDS} USING (metric)""")
def gate_report(spark, d):
    """All gates of a benchmark run."""
    q = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("procedural", "decision", "failure", "fact"))), (q % 4 + 1).cast("int"))
    outcomes = views.read(spark, d, "documents").select(
        q.alias("query_id"), kind.alias("kind"), F.array(*(q + k for k in range(6))).alias("returned"), F.when(q % 3 == 0, F.array(q + 2, q + 9)).otherwise(F.array(q, q + 1)).alias("expected"),
        F.array(q + 5 + q % 4).alias("forbidden"), (q % 97).alias("used"), F.lit(90).alias("budget"), (10 + q % 20).alias("oracle"), (q % 5 != 0).alias("satisfied"))
    m = views.memories(spark, d)
    returned = m.select((F.col("id") / 7).cast("long").alias("query_id"), (F.col("id") % 7 + 1).alias("pos"), "project_id", F.lit("p1").alias("wanted"))
    counts = m.where("status = 'archived' AND access_count = 12").agg(F.count("*").alias("n")).select(F.lit("stale_cited_memories").alias("metric"), "n")
    counts = counts.unionByName(m.where("id % 100 = 2 AND status NOT IN ('superseded', 'disputed')").agg(F.count("*").alias("n")).select(F.lit("unresolved_contradicted_memories").alias("metric"), "n"))
    of = lambda where, good, name: m.where(where).select(F.expr(good).alias(name))
    values = metrics.gate_values(outcomes, returned, of("true", "status = 'active'", "correct"), of("id % 5 = 2", "status IN ('superseded', 'disputed')", "correct"), of("id % 10 = 4", "status = 'superseded'", "done"), counts)
    return metrics.gated(values, metrics.GATES).withColumn("value", F.round("value", 6))


_HEADS = ", ".join(f"'## {s}' || chr(10) || CASE WHEN s_suppkey % 13 = {k} THEN 'x' ELSE 'about ' || s_name END" for k, s in enumerate(skills.SECTIONS))


@query("skill_evaluation", f"""WITH s AS (SELECT s_suppkey AS k, s_name AS name, [{_HEADS}] AS parts FROM supplier),
  d AS (SELECT k, name, 'title' || chr(10) || array_to_string(CASE WHEN k % 9 = 0 THEN list_reverse(parts) ELSE parts END, chr(10) || chr(10)) || CASE WHEN k % 17 = 0 THEN repeat('y', 9000) ELSE '' END AS markdown FROM s),
  v AS (SELECT 'gate_accuracy' AS metric, avg(CASE WHEN k % 3 = 0 THEN CAST(k % 6 = 0 AS INT) END) AS value FROM s UNION ALL SELECT 'generation_accuracy', avg(CASE WHEN k % 3 <> 0 THEN CAST(k % 5 <> 0 AS INT) END) FROM s
    UNION ALL SELECT 'section_completeness', avg(CAST(k % 9 <> 0 AS INT)) FROM d UNION ALL SELECT 'compactness', avg(CAST(length(markdown) <= 8000 AS INT)) FROM d UNION ALL SELECT 'canonical_stability', avg(CAST(k % 8 <> 0 AS INT)) FROM d
    UNION ALL SELECT 'content_grounding', avg(CAST(k % 13 <> 2 AS INT)) FROM d)
  SELECT metric, round(value, 6) AS value, value = 1 AS passed FROM v""")
def skill_evaluation(spark, d):
    """The invariants of generated skills, over documents of which some are wrong."""
    k = F.col("s_suppkey")
    parts = F.array(*(F.concat(F.lit(f"## {s}\n"), F.when(k % 13 == n, "x").otherwise(F.concat(F.lit("about "), "s_name"))) for n, s in enumerate(skills.SECTIONS)))
    body = F.array_join(F.when(k % 9 == 0, F.reverse(parts)).otherwise(parts), "\n\n")
    s = views.read(spark, d, "supplier")
    docs = s.select(F.col("s_name").alias("name"), F.concat(F.lit("title\n"), body, F.when(k % 17 == 0, F.repeat(F.lit("y"), F.lit(9000))).otherwise("")).alias("markdown"), k.alias("k"))
    docs = docs.withColumn("again", F.when(F.col("k") % 8 == 0, "other").otherwise(F.col("markdown"))).drop("k")
    cases = s.select(k.alias("key"), F.when(k % 3 == 0, "divergent_solutions").alias("reason"), F.when(k % 3 != 0, F.col("s_name")).alias("name"))
    outcomes = s.select(k.alias("key"), F.when(k % 6 == 0, "divergent_solutions").alias("reason"), F.when(k % 5 != 0, F.col("s_name")).alias("name"))
    probes = s.select(F.col("s_name").alias("name"), F.lit(skills.SECTIONS[2]).alias("section"), F.concat(F.lit("about "), "s_name").alias("text"))
    return skills.evaluation(cases, outcomes, docs, probes).withColumn("value", F.round("value", 6))

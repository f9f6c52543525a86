"""Queries over what comes in: outcomes of ingest, typed validation, git records, embeddings, rows by natural keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction, mutations, store
from ..operators.lineage import new_path
from ..operators.versions import Versioned
from ..sources import repository, views
from ..streaming import pipeline
from .registry import query
from .views_sql import EVENTS, MEM

#: Payloads of which some lack a field, have one of a wrong type or a path that is kept out.
_PAYLOADS = (
    ("terminal.output", '{"command": "make", "exit_code": 0}', ""), ("terminal.output", '{"command": "make", "exit_code": "0"}', "payload.exit_code"), ("terminal.output", '{"exit_code": 1}', "payload.command"),
    ("file.changed", '{"path": "src/a.ts", "change": "modified"}', ""), ("file.changed", '{"path": "conf/.env", "change": "created"}', ""), ("file.changed", '{"path": "", "change": "moved"}', "payload.change,payload.path"),
    ("test.results", '{"passed": 3, "failed": 0, "skipped": -1}', "payload.skipped"), ("explicit.remember", '{"content": "x", "importance": 0.5, "tags": "a"}', "payload.tags"), ("error.raised", '{"origin": "moon", "message": "m"}', "payload.origin"),
    ("conversation.message", '{"role": "user", "content": "hi"}', ""), ("other.kind", '{"a": 1}', ""), ("conversation.tool_result", '{"call_id": "c", "ok": 1}', "payload.ok"), ("terminal.output", '{"command"', "payload,payload.command"),
)
_ROWS = "p(k, kind, payload, issues) AS (VALUES " + ", ".join(f"({n}, '{k}', '{p}', '{i}')" for n, (k, p, i) in enumerate(_PAYLOADS)) + f"), e AS (SELECT ev.id, ev.project_id, p.kind, p.payload, p.issues FROM ev JOIN p ON p.k = ev.id % {len(_PAYLOADS)})"


def _drafts(spark, d):
    e = views.events(spark, d)
    at = (F.col("id") % len(_PAYLOADS) + 1).cast("int")
    pick = lambda n: F.element_at(F.array(*(F.lit(x[n]) for x in _PAYLOADS)), at)
    return e.select(F.col("id").cast("long").alias("id"), "project_id", "session_id", pick(0).alias("kind"), pick(1).alias("payload"), "occurred_at")


@query("typed_issues", f"WITH {EVENTS}, {_ROWS} SELECT id, CASE kind WHEN 'other.kind' THEN 'raw.unknown' ELSE kind END AS stored_kind, issues FROM e")
def typed_issues(spark, d):
    """Issues of events' payloads, with types, choices and bounds."""
    rows = extraction.validated(_drafts(spark, d), typed=True)
    return rows.select("id", "stored_kind", F.array_join(F.array_sort("issues"), ",").alias("issues"))


@query("ingest_outcomes", f"""WITH {EVENTS}, {_ROWS} SELECT CASE WHEN issues <> '' THEN 'dead_letter' WHEN payload LIKE '%.env%' THEN 'excluded' WHEN project_id <> 'p1' THEN 'foreign' ELSE 'stored' END AS outcome, count(*) AS n FROM e GROUP BY 1""")
def ingest_outcomes(spark, d):
    """What becomes of a batch of events of one project's endpoint."""
    return pipeline.accepted(_drafts(spark, d), "p1").groupBy("outcome").agg(F.count("*").alias("n"))


@query("git_renames", """WITH l AS (SELECT page_id AS id, page_id % 7 AS k, 'src/' || page_id || '.ts' AS path FROM pages)
  SELECT id, CASE WHEN k IN (5, 6) THEN NULL WHEN k = 0 THEN '' WHEN k = 1 THEN path || '>' || path || '.new' WHEN k = 2 THEN 'a>b,' || path || '>c d' ELSE '' END AS renames FROM l""")
def git_renames(spark, d):
    """Renames in listings of changes, of which some can't be read."""
    k, path = F.col("page_id") % 7, F.concat(F.lit("src/"), F.col("page_id").cast("string"), F.lit(".ts"))
    z = lambda *parts: F.concat(*(x for p in parts for x in (F.lit(p) if isinstance(p, str) else p, F.lit("\0"))))
    listing = (F.when(k == 0, "").when(k == 1, z("M", "x", "R100", path, F.concat(path, F.lit(".new")))).when(k == 2, z("R7", "a", "b", "R90", path, "c d", "D", "y")).when(k == 3, z("C80", path, "copy")).when(k == 4, z("A", path))
               .when(k == 5, z("R100", path)).otherwise(z("M", F.concat(F.lit("../"), path))))
    found = views.read(spark, d, "pages").select(F.col("page_id").alias("id"), repository.rename_entries(listing).alias("r"))
    return found.select("id", F.array_join(F.transform("r", lambda x: F.concat_ws(">", x["previous_path"], x["path"])), ",").alias("renames"))


@query("repository_capture", """WITH i AS (SELECT 'src/' || page_id AS path, sha1(html) AS staged FROM pages WHERE page_id % 5 <> 0 AND page_id % 11 <> 0), w AS (SELECT 'src/' || page_id AS path, CASE WHEN page_id % 13 <> 0 THEN CASE WHEN page_id % 3 = 0 THEN sha1(url) ELSE sha1(html) END END AS blob,
  CASE WHEN page_id % 13 = 0 THEN 'excluded' END AS skipped FROM pages WHERE page_id % 7 <> 0)
  SELECT path, blob, CASE WHEN skipped IS NOT NULL THEN NULL WHEN blob IS NULL THEN 'missing' WHEN blob = staged THEN 'committed' ELSE 'worktree' END AS tier, skipped FROM w FULL JOIN i USING (path)""")
def repository_capture(spark, d):
    """A snapshot against index listings, of which some entries don't count."""
    p, k = views.read(spark, d, "pages"), F.col("page_id")
    path = F.concat(F.lit("src/"), k.cast("string"))
    stage = F.when(k % 11 == 0, "2").otherwise("0")
    record = F.concat(F.when(k % 5 == 0, "160000").otherwise("100644"), F.lit(" "), F.sha1("html"), F.lit(" "), stage, F.lit("\t"), path, F.lit("\0"))
    skipped = F.when(k % 13 == 0, "excluded")
    files = p.where(k % 7 != 0).select(path.alias("path"), F.when(skipped.isNull(), F.when(k % 3 == 0, F.sha1("url")).otherwise(F.sha1("html"))).alias("blob"), skipped.alias("skipped"))
    return repository.captured(files, p.select(record.alias("listing")))


@query("reembedded_vectors", f"""WITH {MEM} SELECT id, CAST(length(content) AS DOUBLE) AS chars, CAST(length(replace(content, ' ', '')) AS DOUBLE) AS letters FROM mem WHERE id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0)""")
def reembedded_vectors(spark, d):
    """Vectors of a new revision for memories without one; each distinct content is embedded once."""
    have = views.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("m").alias("model"), F.when(F.col("vec_id") % 3 == 0, "r2").otherwise("r1").alias("revision"))
    m = views.memories(spark, d).withColumn("content_hash", F.sha2("content", 256))
    measured = lambda contents: contents.select("content_hash", F.array(F.char_length("content").cast("double"), F.char_length(F.replace("content", F.lit(" "), F.lit(""))).cast("double")).alias("embedding"))
    rows, _ = store.reembedded(m, have, measured, "m", "r2", 2)
    return rows.select("id", F.get("embedding", F.lit(0)).alias("chars"), F.get("embedding", F.lit(1)).alias("letters"))


@query("sources_made", """WITH s AS (SELECT page_id AS id, CASE WHEN page_id % 5 <> 0 THEN 'web' END AS kind, 'u' || (page_id % 20) AS uri FROM pages), f AS (SELECT kind, uri, min(CASE WHEN id % 3 = 0 THEN id END) AS a, min(CASE WHEN id % 3 <> 0 THEN id END) AS b FROM s GROUP BY ALL)
  SELECT id, CASE WHEN id % 3 = 0 THEN a ELSE coalesce(a, b) END AS stands, CASE WHEN id = CASE WHEN id % 3 = 0 THEN a ELSE coalesce(a, b) END THEN 'created' ELSE 'exists' END AS outcome FROM s JOIN f ON s.kind IS NOT DISTINCT FROM f.kind AND s.uri = f.uri""")
def sources_made(spark, d):
    """Sources made in two batches: one stands for each kind and address."""
    k = F.col("page_id").cast("long")
    rows = views.read(spark, d, "pages").select(k.alias("id"), F.when(k % 5 != 0, "web").alias("kind"), F.concat(F.lit("u"), (k % 20).cast("string")).alias("uri"))
    table = Versioned.create(rows.limit(0), new_path(spark, "sources"), buckets=4)
    return mutations.get_or_create(table, rows.where("id % 3 = 0"), ["kind", "uri"]).unionByName(mutations.get_or_create(table, rows.where("id % 3 <> 0"), ["kind", "uri"]))


@query("raw_event_count", f"WITH {EVENTS} SELECT count(*) AS n FROM ev WHERE project_id = 'p1'")
def raw_event_count(spark, d):
    return store.raw_events(views.events(spark, d), "p1")

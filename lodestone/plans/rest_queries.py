"""More queries over memories, skills and code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import MEMORY_TYPES, STATUSES
from ..functions import temporal
from ..operators import memory, skills, store
from ..sources import views
from .registry import query
from .views_sql import EVENTS, MEM, NOW


@query("status_type_zero_filled", f"""WITH {MEM}, f AS (SELECT * FROM mem WHERE id % 20 < 12 AND id % 6 < 3), s AS (SELECT unnest({list(STATUSES)}) AS status), t AS (SELECT unnest({list(MEMORY_TYPES)}) AS type)
  SELECT s.status, t.type, count(f.id) AS n FROM s CROSS JOIN t LEFT JOIN f ON f.status = s.status AND f.type = t.type GROUP BY s.status, t.type""")
def status_type_zero_filled(spark, d):
    return memory.stats(views.memories(spark, d).where("id % 20 < 12 AND id % 6 < 3"), STATUSES, MEMORY_TYPES)


@query("supersession_chains", """WITH RECURSIVE c AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 < 4 AND doc_id + 1 < (SELECT count(*) FROM documents) THEN doc_id + 1 END AS up FROM documents),
  w AS (SELECT id, id AS tip, 0 AS steps FROM c UNION ALL SELECT w.id, c.up, steps + 1 FROM w JOIN c ON c.id = w.tip WHERE c.up IS NOT NULL), e AS (SELECT id, max_by(tip, steps) AS tip, max(steps) AS steps FROM w GROUP BY id)
  SELECT tip, string_agg(id, ',' ORDER BY steps DESC) AS ids FROM e GROUP BY tip""")
def supersession_chains(spark, d):
    docs = views.read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    n = docs.agg(F.count("*").alias("n"))
    chain = docs.crossJoin(F.broadcast(n)).select("id", F.when((F.col("id") % 5 < 4) & (F.col("id") + 1 < F.col("n")), F.col("id") + 1).alias("superseded_by"))
    return memory.chains(chain).select("tip", F.array_join("ids", ",").alias("ids"))


_DIGESTS = "dg AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'project_digest' ELSE 'architecture' END AS subtype, CASE WHEN id % 4 = 0 THEN ['digest'] ELSE ['x'] END AS tags FROM mem)"


@query("digests_in_force", f"WITH {MEM}, {_DIGESTS} SELECT id FROM dg WHERE status IN ('active', 'stale') AND valid_until IS NULL AND subtype = 'project_digest' AND list_contains(tags, 'digest')")
def digests_in_force(spark, d):
    m = views.memories(spark, d).withColumn("subtype", F.when(F.col("id") % 3 == 0, "project_digest").otherwise("architecture")).withColumn("tags", F.when(F.col("id") % 4 == 0, F.array(F.lit("digest"))).otherwise(F.array(F.lit("x"))))
    return store.current_digests(m, "project_digest", "digest").select("id")


@query("digest_outcomes", f"""WITH {MEM}, c AS (SELECT project_id, min(content_hash) AS old, min(id) AS old_id FROM mem WHERE project_id <> 'p3' GROUP BY project_id), b AS (SELECT DISTINCT project_id FROM mem WHERE project_id IS NOT NULL)
  SELECT b.project_id, old_id, CASE WHEN old IS NULL THEN 'first' WHEN b.project_id = 'p1' THEN 'unchanged' ELSE 'supersedes' END AS outcome FROM b LEFT JOIN c USING (project_id)""")
def digest_outcomes(spark, d):
    m = views.memories(spark, d).where("project_id IS NOT NULL")
    current = m.where("project_id <> 'p3'").groupBy("project_id").agg(F.min("content_hash").alias("content_hash"), F.min("id").alias("id"))
    built = m.select("project_id").distinct().join(current.select("project_id", F.col("content_hash").alias("h")), "project_id", "left").select("project_id", F.when(F.col("project_id") == "p1", F.col("h")).otherwise(F.lit("new")).alias("content_hash"))
    return store.digest_rewrite(current, built).drop("content_hash")


@query("digest_maps", """SELECT c_custkey AS id, 'a=' || c_custkey || ',code.x=new' || (c_custkey % 3) || CASE WHEN c_custkey % 2 = 0 THEN ',code.y=1' ELSE '' END AS digest FROM customer""")
def digest_maps(spark, d):
    """A digest's keys with one owner's namespace replaced."""
    k = F.col("c_custkey").cast("string")
    old = F.create_map(F.lit("a"), k, F.lit("code.old"), F.lit("gone"), F.lit("code.x"), F.lit("old"))
    new = F.map_filter(F.create_map(F.lit("code.x"), F.concat(F.lit("new"), (F.col("c_custkey") % 3).cast("string")), F.lit("code.y"), F.when(F.col("c_custkey") % 2 == 0, "1"), F.lit("other"), F.lit("never")), lambda _, v: v.isNotNull())
    merged = store.digest_merged(old, new, "code.")
    said = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return views.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), said.alias("digest"))


_FAILED = "fl AS (SELECT id, 'sig' || (id % 7) AS signature, observed_at AS last_seen_at, 'problem ' || id AS problem FROM mem WHERE type = 'failure')"


@query("recurrence_pool", f"WITH {MEM}, {_FAILED} SELECT fl.id, signature, last_seen_at FROM fl JOIN mem USING (id) WHERE status IN ('active', 'stale') AND valid_from <= {NOW} AND (valid_until IS NULL OR valid_until > {NOW}) ORDER BY signature, last_seen_at, id LIMIT 60")
def recurrence_pool(spark, d):
    m = views.memories(spark, d).withColumn("source_id", F.col("id") % 25)
    f = m.where("type = 'failure'").select("id", F.concat(F.lit("sig"), (F.col("id") % 7).cast("string")).alias("signature"), F.col("observed_at").alias("last_seen_at"))
    sources = views.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("source_id"), F.lit("file").alias("kind"))
    return store.recurrence_pool(f, m, sources, temporal.at(views.NOW), 60).select("id", "signature", "last_seen_at")


@query("session_events_latest", f"WITH {EVENTS} SELECT id, session_id, occurred_at FROM ev WHERE project_id = 'p2' ORDER BY occurred_at DESC, id DESC LIMIT 200")
def session_events_latest(spark, d):
    return views.events(spark, d).where("project_id = 'p2'").orderBy(F.col("occurred_at").desc(), F.col("id").desc()).limit(200).select("id", "session_id", "occurred_at")


@query("as_of_newest_first", f"WITH {MEM} SELECT id, valid_from FROM mem WHERE status <> 'disputed' AND valid_from <= TIMESTAMP '2024-02-15' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-02-15') ORDER BY valid_from DESC, id DESC LIMIT 50")
def as_of_newest_first(spark, d):
    rows = views.memories(spark, d).where(temporal.is_valid_at(temporal.at("2024-02-15 00:00:00")))
    return rows.orderBy(F.col("valid_from").desc(), F.col("id").desc()).limit(50).select("id", "valid_from")


_USED = """e AS (SELECT conv_id * 1000 + turn AS event_id, text || CASE WHEN conv_id % 3 = 0 THEN ' ran skills/s' || (conv_id % 20) || '/x' ELSE ' useskill-' || (conv_id % 30) || 'now' END AS t FROM conversations), s AS (SELECT CAST(n_nationkey AS BIGINT) AS id, 'skill-' || n_nationkey AS name, 'skills/s' || n_nationkey || '/' AS path FROM nation UNION ALL SELECT 100, 'tiny', 'q/')"""


@query("skills_mentioned", f"WITH {_USED} SELECT id, event_id FROM e JOIN s ON contains(t, path) OR (length(name) >= 6 AND contains(t, name))")
def skills_mentioned(spark, d):
    c = F.col("conv_id")
    tail = F.when(c % 3 == 0, F.concat(F.lit(" ran skills/s"), (c % 20).cast("string"), F.lit("/x"))).otherwise(F.concat(F.lit(" useskill-"), (c % 30).cast("string"), F.lit("now")))
    e = views.read(spark, d, "conversations").select((c * 1000 + F.col("turn")).alias("event_id"), F.concat("text", tail).alias("text"))
    k = F.col("n_nationkey").cast("string")
    s = views.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("skill-"), k).alias("name"), F.concat(F.lit("skills/s"), k, F.lit("/")).alias("path"))
    return skills.mentioned(e, s.union(spark.createDataFrame([(100, "tiny", "q/")], "id long, name string, path string")))


@query("skill_reviews", """WITH s AS (SELECT CAST(n_nationkey AS BIGINT) AS id, [CAST(n_nationkey AS BIGINT) * 5, CAST(n_nationkey AS BIGINT) * 5 + 1, CAST(n_nationkey AS BIGINT) + 100000] AS f FROM nation), e AS (SELECT id, unnest(f) AS x, unnest([1, 2, 3]) AS pos FROM s),
  j AS (SELECT e.id, string_agg(x, ',' ORDER BY pos) FILTER (doc_id IS NOT NULL) AS ids, count(*) FILTER (doc_id IS NULL) AS unresolved FROM e LEFT JOIN documents ON doc_id = x AND doc_id % 2 = 0 GROUP BY e.id) SELECT id, coalesce(ids, '') AS failure_ids, unresolved FROM j""")
def skill_reviews(spark, d):
    k = F.col("n_nationkey").cast("long")
    s = views.read(spark, d, "nation").select(k.alias("id"), F.array(k * 5, k * 5 + 1, k + 100000).alias("failure_ids"))
    f = views.read(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("long").alias("id"), F.lit("p").alias("problem"))
    return skills.review(s, f).withColumn("failure_ids", F.array_join("failure_ids", ","))


@query("event_hashes", """SELECT event_id AS id, sha256('{"k":' || json_extract_string(props, '$.k') || ',"n":"' || event_type || '"}') AS sha256 FROM events""")
def event_hashes(spark, d):
    """Hashes of canonical JSON: keys in order, no blanks."""
    from ..operators import redaction

    e = views.read(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit('{ "n": "'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}")).alias("p"))
    return e.select("id", F.sha2(redaction.canonical_json(F.col("p")), 256).alias("sha256"))


@query("significant_overlap", """WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^a-z0-9_.\\-/]+'), lambda x: length(x) >= 3 AND x NOT IN ('the','and','for','with','that','this','from','not','but','was','were','are','is','it','in','on','to','of','a','an','error','failed','failure','command')) AS w FROM conversations)
  SELECT a.conv_id, a.turn, list_has_any(a.w, b.w) AS overlaps FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def significant_overlap(spark, d):
    from ..functions import extraction

    t = views.read(spark, d, "conversations").select("conv_id", "turn", extraction.significant(F.col("text")).alias("w"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return t.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.arrays_overlap("w", "v").alias("overlaps"))


@query("one_liners", f"""WITH {MEM}, s AS (SELECT id, CASE WHEN length(content) <= 30 THEN content WHEN length(left(content, 30)) - length(regexp_extract(left(content, 30), '([^ ]*)$', 1)) - 1 > 15 THEN rtrim(left(content, CAST(length(left(content, 30)) - length(regexp_extract(left(content, 30), '([^ ]*)$', 1)) - 1 AS INT))) || '…'
  ELSE rtrim(left(content, 30)) || '…' END AS line FROM mem WHERE id % 5 = 0) SELECT id, line FROM s""")
def one_liners(spark, d):
    from ..functions import scopes

    return views.memories(spark, d).where("id % 5 = 0").select("id", scopes.clipped(F.col("content"), 30).alias("line"))


@query("source_texts", """WITH b AS (SELECT page_id, html, octet_length(encode(html)) + CASE page_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS n FROM pages), w AS (SELECT *, CASE WHEN n > 6000 THEN 'too_large' WHEN page_id % 4 = 0 THEN 'binary' END AS skipped FROM b)
  SELECT page_id AS id, skipped, CASE WHEN skipped IS NULL THEN sha256(html) END AS sha256 FROM w""")
def source_texts(spark, d):
    """Texts of files, some with a byte order mark and some with a zero byte."""
    from ..operators import code

    raw = F.encode("html", "UTF-8")
    content = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(b"a\0"), raw)).when(F.col("page_id") % 4 == 1, F.concat(F.lit(b"\xef\xbb\xbf"), raw)).otherwise(raw)
    got = views.read(spark, d, "pages").select(F.col("page_id").alias("id"), code.source_text(content, 6000).alias("s"))
    return got.select("id", F.col("s.skipped").alias("skipped"), F.sha2("s.text", 256).alias("sha256"))

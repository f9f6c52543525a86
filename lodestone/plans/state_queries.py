"""Queries over mutable tables: each makes one of the given tables, changes it and returns what is then in force."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import temporal, text
from ..operators import mutations, passes
from ..operators.lineage import new_path
from ..operators.versions import Versioned
from ..sources import views

from .registry import oracle_of, query
from .views_sql import EVENTS, MEM, RECENCY, STATEMENTS

_POINTED = "m AS (SELECT id, content_hash, access_count, CASE WHEN id % 9 = 0 THEN 'archived' ELSE status END AS status, CASE WHEN status = 'superseded' THEN (id // 20) * 20 + 18 END AS superseded_by FROM mem), gone AS (SELECT id FROM m WHERE status = 'archived' AND id % 20 >= 17 AND id % 3 <> 0)"


def _memories(spark, d):
    """Memories as a mutable table; superseded ones point to an archived one."""
    to = F.when(F.col("status") == "superseded", F.floor(F.col("id") / 20) * 20 + 18).cast("long")
    return views.memories(spark, d).withColumn("id", F.col("id").cast("long")).withColumn("superseded_by", to).withColumn("last_accessed_at", F.lit(None).cast("timestamp_ntz"))


def _archived(spark, d) -> Versioned:
    table = Versioned.create(_memories(spark, d), new_path(spark, "memories"), buckets=8)
    wanted = _memories(spark, d).where("id % 9 = 0").select("id", F.lit("archived").alias("new"), temporal.at(views.NOW).alias("at"))
    mutations.set_status(table, wanted, "user")
    return table


@query("purged_state", f"""WITH {MEM}, {_POINTED} SELECT id, status, CASE WHEN superseded_by NOT IN (FROM gone) THEN superseded_by END AS superseded_by FROM m WHERE id NOT IN (FROM gone)""")
def purged_state(spark, d):
    """Memories after status changes, a purge that clears the pointers to what it removes, and compaction."""
    table = _archived(spark, d)
    mutations.purge(table, _memories(spark, d).where("id % 20 >= 17 AND id % 3 <> 0").select("id"), "user", temporal.at(views.NOW))
    table.compact()
    return table.read().select("id", "status", "superseded_by")


@query("purge_audit", f"""WITH {MEM}, {_POINTED} SELECT id AS memory_id, 'archived' AS action, status AS from_status, 'archived' AS to_status, 0 AS cleared FROM mem WHERE id % 9 = 0 AND status <> 'archived'
  UNION ALL SELECT id, 'purged', 'archived', NULL, (SELECT count(*) FROM m WHERE superseded_by = gone.id AND m.id NOT IN (FROM gone)) FROM gone""")
def purge_audit(spark, d):
    """The audit that outlives a purge, with the pointers that each purge cleared."""
    table = _archived(spark, d)
    mutations.purge(table, _memories(spark, d).where("id % 20 >= 17 AND id % 3 <> 0").select("id"), "user", temporal.at(views.NOW))
    return table.log("audit", mutations.AUDIT).select("memory_id", "action", "from_status", "to_status", "cleared")


@query("accesses_absorbed", f"""WITH {MEM}, a AS (SELECT l_partkey AS id, count(*) AS n, max(l_shipdate) AS latest FROM lineitem GROUP BY l_partkey)
  SELECT id, CAST(access_count + coalesce(n, 0) AS BIGINT) AS access_count, latest AS last_accessed_at FROM mem LEFT JOIN a USING (id)""")
def accesses_absorbed(spark, d):
    """Access counts after a log of accesses was written in two parts and absorbed in between."""
    table = Versioned.create(_memories(spark, d), new_path(spark, "memories"), buckets=8)
    log = views.read(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("id"), F.col("l_shipdate").cast("timestamp_ntz").alias("at"), F.col("l_linenumber").alias("n"))
    table.commit(logs={"access": log.where("n <= 3").drop("n")})
    mutations.absorb_accesses(table)
    table.commit(logs={"access": log.where("n > 3").drop("n")})
    return mutations.with_accesses(table).select("id", F.col("access_count").cast("long").alias("access_count"), "last_accessed_at")


_RAW = "e AS (SELECT *, kind || ' ' || content_hash AS payload, id % 7 = 0 OR id % 11 = 0 OR id % 13 = 0 AS blocked FROM ev)"


@query("events_compacted", f"""WITH {EVENTS}, {_RAW}, p AS (SELECT *, occurred_at < TIMESTAMP '2024-04-15' - INTERVAL 85 DAY AS old FROM e)
  SELECT id, 'event' AS what, NULL AS bytes FROM p WHERE NOT old OR blocked UNION ALL SELECT id, 'digest', octet_length(encode(payload)) FROM e WHERE occurred_at < TIMESTAMP '2024-04-15' - INTERVAL 80 DAY AND (occurred_at >= TIMESTAMP '2024-04-10' - INTERVAL 85 DAY OR NOT blocked)""")
def events_compacted(spark, d):
    """Raw events and digests that are left by two compactions, the second five days after the first."""
    raw = views.events(spark, d).withColumn("id", F.col("id").cast("long")).select(
        "*", F.concat_ws(" ", "kind", "content_hash").alias("payload"), F.expr("CASE WHEN id % 7 <> 0 THEN occurred_at END AS processed_at"), F.expr("id % 11 = 0 AS needs_review"), F.expr("CASE WHEN id % 13 = 0 THEN 'x' END AS process_error"))
    events = Versioned.create(raw, new_path(spark, "events"), buckets=8)
    for day in ("2024-04-10", "2024-04-15"):
        mutations.compact_events(events, temporal.at(f"{day} 00:00:00"), 80, 85)
    left = events.read().select("id", F.lit("event").alias("what"), F.lit(None).cast("long").alias("bytes"))
    return left.unionByName(events.log("digests", mutations.DIGESTS).select("id", F.lit("digest").alias("what"), F.col("payload_bytes").alias("bytes")))


_SKILLS = "s AS (SELECT s_suppkey AS id, (['candidate','verified','promoted','deprecated'])[s_suppkey % 4 + 1] AS status, (['candidate','verified','promoted','deprecated'])[s_suppkey % 5 % 4 + 1] AS expected, (['verified','promoted','deprecated'])[s_suppkey % 3 + 1] AS new FROM supplier)"
_EDGE = "(status || '>' || new IN ('candidate>verified', 'candidate>deprecated', 'verified>promoted', 'verified>deprecated', 'promoted>deprecated'))"


@query("skill_flips", f"WITH {_SKILLS} SELECT id, CASE WHEN status <> expected THEN 'moved' WHEN NOT {_EDGE} THEN 'illegal' ELSE 'flipped' END AS outcome, CASE WHEN status = expected AND {_EDGE} THEN new ELSE status END AS status FROM s")
def skill_flips(spark, d):
    """Guarded status flips of skills, and their statuses afterwards."""
    k = F.col("s_suppkey").cast("long")
    names = ("candidate", "verified", "promoted", "deprecated")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    rows = views.read(spark, d, "supplier").select(
        k.alias("id"), F.col("s_name").alias("name"), pick(names, k % 4).alias("status"), F.array(k).alias("failure_ids"), F.lit("d").alias("description"), temporal.at("2024-01-01 00:00:00").alias("updated_at"), pick(names, k % 5 % 4).alias("expected"), pick(names[1:], k % 3).alias("new"))
    table = Versioned.create(rows.drop("expected", "new"), new_path(spark, "skills"), buckets=4)
    out = mutations.flip_skills(table, rows.select("id", "expected", "new"), "review", temporal.at(views.NOW))
    return out.join(table.read().select("id", "status"), "id")


@query("entities_created", """WITH n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'p' || c_nationkey END AS project_id, lower(trim(regexp_replace(c_mktsegment || ' ' || (c_custkey % 10), '\\s+', ' ', 'g'))) AS normal FROM customer),
  f AS (SELECT project_id, normal, min(CASE WHEN id % 2 = 0 THEN id END) AS first, min(CASE WHEN id % 2 = 1 THEN id END) AS second FROM n GROUP BY ALL)
  SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN first END, first, second) AS entity_id, CASE WHEN id = CASE WHEN id % 2 = 0 THEN first ELSE coalesce(first, second) END THEN 'created' ELSE 'exists' END AS outcome FROM n JOIN f ON n.project_id IS NOT DISTINCT FROM f.project_id AND n.normal = f.normal""")
def entities_created(spark, d):
    """What becomes of new entities, made in two batches: one stands for each scope and normal name."""
    k = F.col("c_custkey").cast("long")
    rows = views.read(spark, d, "customer").select(
        k.alias("id"), F.when(k % 3 != 0, F.concat(F.lit("p"), F.col("c_nationkey").cast("string"))).alias("project_id"), F.lit("concept").alias("kind"),
        F.concat(F.when(k % 4 == 0, F.upper("c_mktsegment")).otherwise(F.col("c_mktsegment")), F.lit("  "), (k % 10).cast("string")).alias("name"), F.array().cast("array<string>").alias("aliases"))
    empty = rows.limit(0).withColumn("normal", F.lit("")).withColumn("merged_into", F.lit(None).cast("long"))
    table = Versioned.create(empty, new_path(spark, "entities"), buckets=4)
    return mutations.create_entities(table, rows.where("id % 2 = 0")).unionByName(mutations.create_entities(table, rows.where("id % 2 = 1")))


_FADED = f"sqrt(CASE WHEN type = 'decision' THEN greatest(importance, 0.5) ELSE importance END) * confidence * {RECENCY} * (1.0 + ln(1.0 + access_count)) < 0.05"


#: How contradictions of the open active statements are settled, as a table ``done``.
_OPEN = STATEMENTS.removesuffix(")") + " WHERE status = 'active' AND valid_until IS NULL)"
_DONE = oracle_of("contradiction_resolution").replace(STATEMENTS, _OPEN, 1).replace("\n  SELECT unnest(CASE", ",\n  done AS (SELECT unnest(CASE", 1) + ")"


@query("pass_statuses", _DONE + f""" SELECT id, coalesce(outcome, CASE WHEN status = 'active' AND valid_until IS NULL AND {_FADED} THEN 'archived' END, status) AS status, winner AS superseded_by
  FROM (SELECT mem.*, d.outcome, d.winner FROM mem LEFT JOIN done d USING (id))""")
def pass_statuses(spark, d):
    """Statuses after a consolidation pass without vectors that is run again and again: the second settles nothing."""
    rows = views.statements(spark, d).withColumn("id", F.col("id").cast("long")).withColumn("superseded_by", F.lit(None).cast("long"))
    table = Versioned.create(rows, new_path(spark, "claims"), buckets=8)
    now = datetime.fromisoformat(views.NOW)
    passes.consolidate(table, now, stages=("contradiction",))
    passes.consolidate(table, now)
    passes.consolidate(table, now)
    return table.read().select("id", "status", "superseded_by")


_LETTERS = (("\u00e9", "e\u0301"), ("\u00e8", "e\u0300"), ("\u00fc", "u\u0308"), ("\u00f1", "n\u0303"), ("\u00e7", "c\u0327"))
_SPLIT = "text"
for _one, _two in _LETTERS:
    _SPLIT = f"replace({_SPLIT}, '{_one}', '{_two}')"


@query("composed_hashes", f"""WITH t AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN {_SPLIT} ELSE text END AS text FROM documents) SELECT id, sha256(lower(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')))) AS content_hash, text <> nfc_normalize(text) AS changed FROM t""")
def composed_hashes(spark, d):
    """Hashes of contents of which half have their letters and marks apart."""
    apart = F.col("text")
    for one, two in _LETTERS:
        apart = F.replace(apart, F.lit(one), F.lit(two))
    rows = views.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, apart).otherwise(F.col("text")).alias("text"))
    return rows.select("id", text.canonical_hash(F.col("text")).alias("content_hash"), (F.col("text") != text.composed(F.col("text"))).alias("changed"))

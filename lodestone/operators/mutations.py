"""Writes to versioned tables: purges, access counts, compaction of events, guarded skills, entities.

Each write is one commit: rows, audit and whatever else belongs to it are published together or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import RETENTION_WINDOW_DAYS, SUMMARY_WINDOW_DAYS
from ..functions import temporal, text
from . import lifecycle, skills
from .versions import Versioned

AUDIT = "memory_id long, action string, from_status string, to_status string, actor string, at timestamp_ntz, cleared long"
ACCESS = "id long, at timestamp_ntz"
DIGESTS = "id long, kind string, summary string, payload_bytes long, at timestamp_ntz"


def set_status(table: Versioned, wanted: DataFrame, actor: str) -> DataFrame:
    """Status changes (id, new, at) that the status machine allows, with their audit. Returns id and outcome of all:
    changed, illegal or gone."""
    state = table.state()
    rows = table.read(wanted, state)
    asked = wanted.join(rows.select("id", F.col("status").alias("old")), "id", "left")
    asked = asked.withColumn("outcome", F.when(F.col("old").isNull(), "gone").when(temporal.may_become(F.col("old"), F.col("new")), "changed").otherwise("illegal"))
    legal = asked.where("outcome = 'changed'")
    changes = rows.join(legal.select("id", "new"), "id").withColumn("status", F.col("new")).drop("new")
    audit = legal.select(F.col("id").alias("memory_id"), temporal.audit_action(F.col("old"), F.col("new")).alias("action"), F.col("old").alias("from_status"), F.col("new").alias("to_status"),
                         F.lit(actor).alias("actor"), F.col("at").cast("timestamp_ntz").alias("at"), F.lit(0).cast("long").alias("cleared"))
    table.commit(changes, {"audit": audit}, since=state)
    return asked.select("id", "outcome")


def purge(table: Versioned, wanted: DataFrame, actor: str, at: Column, working: Versioned | None = None) -> DataFrame:
    """Remove archived memories (id) for good; others are refused. Pointers to a purged one (superseded_by) are
    cleared in the same commit, and the audit row that outlives it tells how many.

    Scratch rows that were promoted to it lose their link first, so that no crash leaves a link to nothing.
    Returns id and outcome: purged, refused or gone. The rows themselves go from the files with the next
    compaction and vacuum.
    """
    state = table.state()
    rows = table.read(state=state)
    asked = wanted.select("id").distinct().join(rows.select("id", "status"), "id", "left")
    asked = asked.withColumn("outcome", F.when(F.col("status").isNull(), "gone").when(F.col("status") == "archived", "purged").otherwise("refused"))
    gone = asked.where("outcome = 'purged'").select("id", "status")
    if working is not None:
        linked = working.read().join(gone.select(F.col("id").alias("promoted_memory_id")), "promoted_memory_id", "left_semi")
        working.commit(linked.withColumn("promoted_memory_id", F.lit(None).cast("long")))
    pointing = rows.join(gone.select(F.col("id").alias("superseded_by")), "superseded_by", "left_semi").join(gone.select("id"), "id", "left_anti")
    cleared = pointing.groupBy(F.col("superseded_by").alias("id")).agg(F.count("*").alias("cleared"))
    audit = gone.join(cleared, "id", "left").select(
        F.col("id").alias("memory_id"), F.lit("purged").alias("action"), F.col("status").alias("from_status"), F.lit(None).cast("string").alias("to_status"), F.lit(actor).alias("actor"), at.cast("timestamp_ntz").alias("at"), F.coalesce("cleared", F.lit(0)).cast("long").alias("cleared"))
    changes = rows.join(gone.select("id"), "id", "left_semi").withColumn("gone", F.lit(True)).unionByName(
        pointing.withColumn("superseded_by", F.lit(None).cast("long")).withColumn("gone", F.lit(False)))
    table.commit(changes, {"audit": audit}, since=state)
    return asked.select("id", "outcome")


def with_accesses(table: Versioned, state: dict | None = None) -> DataFrame:
    """Memories with the access log folded in: access_count and last_accessed_at."""
    state = state or table.state()
    rows, log = table.read(state=state), table.log("access", ACCESS, state)
    folded = log.groupBy("id").agg(F.count("*").alias("more"), F.max("at").alias("latest"))
    return rows.join(folded, "id", "left").withColumns({
        "access_count": (F.col("access_count") + F.coalesce("more", F.lit(0))).cast(dict(rows.dtypes)["access_count"]),
        "last_accessed_at": F.greatest("last_accessed_at", "latest")}).select(*rows.columns)


def absorb_accesses(table: Versioned) -> int:
    """Write the access log into the rows it counts; each folder of the log is counted once. Returns the version."""
    state = table.state()
    folders = state["logs"].get("access", {"folders": []})["folders"]
    hit = table.log("access", ACCESS, state).select("id").distinct()
    return table.commit(with_accesses(table, state).join(hit, "id", "left_semi"), since=state, used={"access": folders}) if folders else state["version"]


def compact_events(events: Versioned, now: Column, summary_days: int = SUMMARY_WINDOW_DAYS, retention_days: int = RETENTION_WINDOW_DAYS, dry_run: bool = False) -> DataFrame:
    """Summarise aging events and purge old ones that are processed and clean, in one commit: an event goes only
    with its digest. Returns the plan (action, reason, n), also for a dry run; a second run finds only what has
    aged since."""
    state = events.state()
    rows = events.read(state=state)
    plan = lifecycle.compaction(rows, events.log("digests", DIGESTS, state).select("id"), now, summary_days, retention_days)
    counts = plan.groupBy("action", "reason").agg(F.count("*").alias("n"))
    if dry_run:
        return counts
    short = F.trim(F.regexp_replace(F.col("payload"), r"\s+", " "))
    line = F.when(F.char_length(short) > 400, F.concat(F.left(short, F.lit(399)), F.lit("…"))).when(short == "", F.concat("kind", F.lit(" (empty payload)"))).otherwise(short)
    digests = plan.where("action IN ('summarize', 'summarize_and_purge')").select(
        F.col("id").cast("long").alias("id"), "kind", line.alias("summary"), F.octet_length("payload").cast("long").alias("payload_bytes"), now.cast("timestamp_ntz").alias("at"))
    gone = plan.where("action IN ('purge', 'summarize_and_purge')").select(*rows.columns, F.lit(True).alias("gone"))
    events.commit(gone, {"digests": digests}, since=state)
    return counts


def _skill_audit(rows: DataFrame, action: str, actor: str, at: Column) -> DataFrame:
    column = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select("id", F.lit(action).alias("action"), column("old").alias("from_status"), F.col("status").alias("to_status"), F.lit(actor).alias("actor"), at.cast("timestamp_ntz").alias("at"))


def add_skills(table: Versioned, rows: DataFrame, actor: str, at: Column) -> DataFrame:
    """New skills; only candidates may be made, an id that is there stays. Returns id and outcome."""
    state = table.state()
    asked = rows.join(table.read(rows, state).select("id", F.lit(True).alias("there")), "id", "left")
    asked = asked.withColumn("outcome", F.when(F.col("there"), "exists").when(F.col("status") != "candidate", "refused").otherwise("created"))
    made = asked.where("outcome = 'created'").drop("there", "outcome")
    table.commit(made, {"audit": _skill_audit(made, "created", actor, at)}, since=state)
    return asked.select("id", "outcome")


def flip_skills(table: Versioned, wanted: DataFrame, actor: str, at: Column) -> DataFrame:
    """Status flips (id, expected, new): done only where the skill still has the expected status and its machine has
    the edge. Returns id and outcome: flipped, moved, illegal or gone."""
    state = table.state()
    edges = F.create_map(*(x for k, v in skills.EDGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    rows = table.read(wanted, state)
    asked = wanted.join(rows.select("id", F.col("status").alias("old")), "id", "left")
    may = F.coalesce(F.array_contains(F.try_element_at(edges, F.col("old")), F.col("new")), F.lit(False))
    asked = asked.withColumn("outcome", F.when(F.col("old").isNull(), "gone").when(F.col("old") != F.col("expected"), "moved").when(~may, "illegal").otherwise("flipped"))
    done = rows.join(asked.where("outcome = 'flipped'").select("id", "old", "new"), "id").withColumn("status", F.col("new")).withColumn("updated_at", at.cast("timestamp_ntz"))
    table.commit(done.drop("old", "new"), {"audit": _skill_audit(done, "status_changed", actor, at)}, since=state)
    return asked.select("id", "outcome")


def refresh_skills(table: Versioned, evidence: DataFrame, actor: str, at: Column) -> DataFrame:
    """New evidence (id, failure_ids, description) of candidates: failures are added in order, the description is
    replaced. Later stages keep theirs. Returns id and outcome: refreshed, frozen or gone."""
    state = table.state()
    rows = table.read(evidence, state)
    asked = evidence.select("id", F.col("failure_ids").alias("more"), F.col("description").alias("text")).join(rows.select("id", "status"), "id", "left")
    asked = asked.withColumn("outcome", F.when(F.col("status").isNull(), "gone").when(F.col("status") == "candidate", "refreshed").otherwise("frozen"))
    done = rows.join(asked.where("outcome = 'refreshed'").select("id", "more", "text"), "id").withColumns({
        "failure_ids": F.array_union("failure_ids", "more"), "description": F.col("text"), "updated_at": at.cast("timestamp_ntz")}).drop("more", "text")
    table.commit(done, {"audit": _skill_audit(done.withColumn("old", F.col("status")), "edited", actor, at)}, since=state)
    return asked.select("id", "outcome")


def create_entities(table: Versioned, rows: DataFrame) -> DataFrame:
    """New entities (id, project_id, kind, name, aliases), one for each scope and normal name: the earliest id of
    several. Returns id, entity_id (what stands for it) and outcome: created or exists."""
    state = table.state()
    named = rows.withColumn("normal", text.normal_form(F.col("name")))
    there = table.read(state=state).groupBy(F.col("project_id").alias("p"), F.col("normal").alias("n")).agg(F.min("id").alias("there"))
    first = named.groupBy(F.col("project_id").alias("q"), F.col("normal").alias("m")).agg(F.min("id").alias("first"))
    asked = named.join(first, F.col("project_id").eqNullSafe(F.col("q")) & (F.col("normal") == F.col("m"))).join(there, F.col("project_id").eqNullSafe(F.col("p")) & (F.col("normal") == F.col("n")), "left")
    asked = asked.withColumn("outcome", F.when(F.col("there").isNull() & (F.col("id") == F.col("first")), "created").otherwise("exists")).withColumn("entity_id", F.coalesce("there", "first"))
    out = asked.select("id", "entity_id", "outcome")
    made = asked.where("outcome = 'created'").withColumn("merged_into", F.lit(None).cast("long"))
    table.commit(made.select(*table.schema(state).fieldNames()), since=state)
    return out


def merge_entities(table: Versioned, wanted: DataFrame) -> DataFrame:
    """Entities (id, into) that become pointers to others; one merged before keeps its pointer. Returns id and
    outcome: merged, already, same or gone."""
    state = table.state()
    rows = table.read(wanted, state)
    asked = wanted.join(rows.select("id", "merged_into", F.lit(True).alias("there")), "id", "left")
    asked = asked.withColumn("outcome", F.when(F.col("id") == F.col("into"), "same").when(F.col("there").isNull(), "gone").when(F.col("merged_into").isNotNull(), "already").otherwise("merged"))
    done = rows.drop("merged_into").join(asked.where("outcome = 'merged'").select("id", F.col("into").alias("merged_into")), "id")
    table.commit(done, since=state)
    return asked.select("id", "outcome")


def bind_entities(table: Versioned, bindings: DataFrame) -> int:
    """Bindings (memory_id, entity_id, role, weight) that aren't there yet, one for each pair (the greatest weight);
    the table's key is ``id``, made of both. Returns the version."""
    state = table.state()
    key = F.concat_ws("/", F.col("memory_id").cast("string"), F.col("entity_id").cast("string"))
    once = bindings.groupBy("memory_id", "entity_id").agg(F.max(F.struct(F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("role", F.lit("context")).alias("role"))).alias("b"))
    rows = once.select(key.alias("id"), "memory_id", "entity_id", "b.role", "b.weight")
    return table.commit(rows.join(table.read(state=state).select("memory_id", "entity_id"), ["memory_id", "entity_id"], "left_anti"), since=state)


def get_or_create(table: Versioned, rows: DataFrame, by: list[str]) -> DataFrame:
    """Sources, projects or users (id and what else the table has) by their natural key ``by``, null equal to null:
    one that is there stands, else the least id of the new ones is made. Returns id, stands and outcome."""
    state = table.state()
    there = table.read(state=state).groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.min("id").alias("there"))
    first = rows.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.min("id").alias("first"))
    same = lambda mark: [F.col(c).eqNullSafe(F.col(f"{mark}{c}")) for c in by]
    asked = rows.join(first, same("_")).join(there, same("__"), "left")
    asked = asked.withColumn("outcome", F.when(F.col("there").isNull() & (F.col("id") == F.col("first")), "created").otherwise("exists")).withColumn("stands", F.coalesce("there", "first"))
    table.commit(asked.where("outcome = 'created'").select(*table.schema(state).fieldNames()), since=state)
    return asked.select("id", "stands", "outcome")

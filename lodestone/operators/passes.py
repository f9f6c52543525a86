"""Periodic consolidation over a versioned table of memories: resumable, with chosen stages and a report.

Each stage is one commit: status changes, new rows, their audit and the note that the stage is done. A run that was
cut off goes on with the stages that its note lacks; a run whose stages are all done changes nothing.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import consolidation, contradiction, lifecycle
from .lineage import cut
from .mutations import AUDIT
from .versions import Versioned

STAGES = ("contradiction", "derivation", "merge", "decay")
DERIVED = "fact_id long, id long"


def _closed(rows: DataFrame, outcome: DataFrame, now: Column, actor: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the status, end and successor that an outcome (id, status, valid_until, superseded_by) gives them."""
    names = ("status", "valid_until", "superseded_by")
    new = outcome.select("id", *(F.col(c).alias(f"__{c}") for c in names))
    met = rows.join(new, "id")
    audit = met.select(F.col("id").alias("memory_id"), F.when(F.col("__status") == "archived", "archived").otherwise("status_changed").alias("action"), F.col("status").alias("from_status"), F.col("__status").alias("to_status"),
                       F.lit(actor).alias("actor"), now.alias("at"), F.lit(0).cast("long").alias("cleared"))
    keep = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in names}
    return met.withColumns(keep).select(*rows.columns), audit


def _stage(name: str, table: Versioned, state: dict, rows: DataFrame, pool: DataFrame, vectors: DataFrame | None, primary: DataFrame | None, now: Column, actor: str):
    """Changes, logs and the number of outcomes of one stage."""
    none = pool.select(F.col("id").alias("id_a"), F.col("id").alias("id_b")).limit(0)
    gap = F.lit(None)
    if name == "contradiction":
        out = cut(contradiction.settled(pool).select("id", F.col("outcome").alias("status"), "valid_until", F.col("winner").alias("superseded_by")))
    elif name == "merge":
        merged = consolidation.merges(pool, vectors, none, now).where("outcome = 'merged'")
        out = cut(merged.select("id", F.lit("superseded").alias("status"), now.alias("valid_until"), F.col("keeper").alias("superseded_by")))
    elif name == "decay":
        out = cut(lifecycle.decayed(pool, now).select("id", F.lit("archived").alias("status"), gap.cast("timestamp_ntz").alias("valid_until"), gap.cast("long").alias("superseded_by")))
    else:
        return _derived(table, state, rows, pool, vectors, primary, none, now, actor)
    changes, audit = _closed(rows, out, now, actor)
    counts = {r["status"]: r["n"] for r in out.groupBy("status").agg(F.count("*").alias("n")).collect()}
    return changes, {"audit": audit}, counts


def _derived(table: Versioned, state: dict, rows: DataFrame, pool: DataFrame, vectors: DataFrame, primary: DataFrame, none: DataFrame, now: Column, actor: str):
    """A semantic memory for each cluster of episodes, and which rows it rests on; those rest on no second one."""
    group = ["project_id", "user_id", "entity_id"]
    done = table.log("derived", DERIVED, state).select("id").distinct()
    episodes = pool.where("type = 'episodic'")
    facts = cut(consolidation.derivations(episodes, vectors, primary, done, none))
    pairs = consolidation.near_links(episodes.join(done, "id", "left_anti").join(primary, "id").select(*group, "id").join(vectors, "id"), group, consolidation.DERIVE_COSINE)
    members = consolidation.components(consolidation._joined(pairs[0], cut(pairs[1])))
    key = F.xxhash64(F.lit("fact"), "representative", now)
    made = facts.select(key.alias("fact_id"), "component", "representative", "importance", "confidence", "observed_at", "valid_from")
    base = rows.join(made.withColumnRenamed("representative", "id").select("id", "fact_id", *(F.col(c).alias(f"__{c}") for c in ("importance", "confidence", "observed_at", "valid_from"))), "id")
    new = {"id": F.col("fact_id"), "type": F.lit("semantic"), "status": F.lit("active"), "source_kind": F.lit("derived"), "access_count": F.lit(0), "superseded_by": F.lit(None), "valid_until": F.lit(None)}
    new |= {c: F.col(f"__{c}") for c in ("importance", "confidence", "observed_at", "valid_from")}
    kinds = dict(rows.dtypes)
    changes = base.select(*((new[c] if c in new else F.col(c)).cast(kinds[c]).alias(c) for c in rows.columns))
    rests = members.join(made.select("component", "fact_id"), "component").select("fact_id", "id")
    audit = made.select(F.col("fact_id").alias("memory_id"), F.lit("created").alias("action"), F.lit(None).cast("string").alias("from_status"), F.lit("active").alias("to_status"), F.lit(actor).alias("actor"), now.alias("at"), F.lit(0).cast("long").alias("cleared"))
    return changes, {"audit": audit, "derived": rests}, {"derived": facts.count()}


def consolidate(table: Versioned, now: datetime, vectors: DataFrame | None = None, primary: DataFrame | None = None, stages: tuple[str, ...] = STAGES, pool_limit: int | None = None, project: str | None = None, actor: str = "job:consolidate") -> dict:
    """One pass over the active memories; returns its report.

    A pass is known by its moment and its scope. Stages run in the order of ``STAGES`` and see what the earlier
    ones left. ``pool_limit`` takes the newest rows only and says so (``truncated``); without it the pass is over
    all. Without vectors the stages that need them are left out, with a warning; a stage that fails leaves its
    error there, and is tried again when the pass is.
    """
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"no such stages: {sorted(unknown)}")
    moment, name = F.lit(now).cast("timestamp_ntz"), f"pass:{project or ''}"
    note = table.state()["notes"].get(name, {})
    if note.get("at") != now.isoformat():
        note = {"at": now.isoformat(), "done": {}}
    warnings = []
    if vectors is None and {"derivation", "merge"} & set(stages):
        warnings.append("no vectors: derivation and merge are left out")
    pool = None
    for stage in (s for s in STAGES if s in stages):
        if stage in note["done"] or (vectors is None and stage in ("derivation", "merge")):
            continue
        state = table.state()
        rows = table.read(state=state)
        pool = rows.where("status = 'active' AND valid_until IS NULL")
        if project is not None:
            pool = pool.where(F.col("project_id") == project)
        if pool_limit is not None:
            pool = cut(pool.orderBy(F.col("observed_at").desc(), F.col("id").desc()).limit(pool_limit))
        if "considered" not in note:
            note["considered"] = pool.count()
            note["truncated"] = pool_limit is not None and note["considered"] >= pool_limit
        try:
            changes, logs, counts = _stage(stage, table, state, rows, pool, vectors, primary, moment, actor)
            note = note | {"done": note["done"] | {stage: counts}}
            table.commit(changes, logs, {name: note}, since=state)
        except Exception as e:  # a stage's failure is the report's, not the run's
            note["done"].pop(stage, None)
            warnings.append(f"{stage} failed: {type(e).__name__}: {str(e)[:200]}")
    return note | {"warnings": warnings}


def due(table: Versioned, now: datetime, every: timedelta, project: str | None = None) -> bool:
    """Whether the last pass of a scope began at least ``every`` ago, or is not complete."""
    note = table.state()["notes"].get(f"pass:{project or ''}")
    return note is None or now - datetime.fromisoformat(note["at"]) >= every


def periodically(table: Versioned, now: datetime, every: timedelta, **options) -> dict | None:
    """A pass if one is due. Otherwise the last one goes on, if a stage of it is open, and else nothing is done."""
    name = f"pass:{options.get('project') or ''}"
    if due(table, now, every, options.get("project")):
        return consolidate(table, now, **options)
    note = table.state()["notes"][name]
    wanted = options.get("stages", STAGES)
    open_ = [s for s in wanted if s not in note["done"] and (options.get("vectors") is not None or s not in ("derivation", "merge"))]
    return consolidate(table, datetime.fromisoformat(note["at"]), **options) if open_ else None

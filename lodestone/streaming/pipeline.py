"""Ingest to memories as micro-batches: validated, redacted, stored once, extracted, gated and inserted.

Each batch is a few jobs over the batch and what it meets in the logs; a batch that is retried adds nothing. Logs are
Parquet folders. Sessions that end in a batch promote their scratch rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_hash, is_excluded
from ..operators import consolidation, extraction, lifecycle, redaction, store
from ..operators.lineage import file_system
from .ingest import KEYS, inserted

MEMORY = "id long, project_id string, user_id string, type string, content string, content_hash string, status string, importance double, confidence double, observed_at timestamp_ntz"
EVENT = "id long, project_id string, session_id string, kind string, payload string, content_hash string, redactions int, occurred_at timestamp_ntz"


def _log(spark, path: str, schema: str) -> DataFrame:
    """A log as it is, empty where nothing was written yet."""
    fs, at = file_system(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(at) else spark.createDataFrame([], schema)


def accepted(raw: DataFrame, project: str | None = None) -> DataFrame:
    """Raw events (id, project_id, session_id, kind, payload, occurred_at) with their outcome: dead_letter, excluded
    (a path that is kept out), foreign (another project's) or stored, and for stored ones the redacted payload and
    its hash."""
    rows = extraction.validated(raw, typed=True).withColumn("kind", F.col("stored_kind"))
    path = F.get_json_object("payload", "$.path")
    foreign = F.lit(False) if project is None else F.coalesce(F.col("project_id") != project, F.lit(False))
    outcome = F.when(F.size("issues") > 0, "dead_letter").when(F.coalesce(is_excluded(path), F.lit(False)), "excluded").when(foreign, "foreign").otherwise("stored")
    rows = rows.withColumn("outcome", outcome)
    clean = redaction.redacted_json(F.when(F.col("outcome") == "stored", F.col("payload")))
    rows = rows.withColumn("r", clean)
    return rows.select("id", "project_id", "session_id", "kind", F.col("r.json").alias("payload"), F.col("r.sha256").alias("content_hash"), F.size("r.records").alias("redactions"), "occurred_at", "outcome", "issues")


def remembered(events: DataFrame, memories: DataFrame) -> DataFrame:
    """New memories out of a batch of stored events, in order of occurrence: extracted, gated, one a statement, none
    that is there already."""
    found = extraction.extracted(events).join(events.select("id", "occurred_at"), "id")
    gated = lifecycle.gate(found.withColumn("evidence", F.size("cited")).withColumn("future", F.col("rationale"))).where("reason IS NULL")
    once = consolidation.gate_merged(gated.select(F.col("project_id").alias("group"), "type", "content", "importance", "confidence", F.col("id").alias("position"), "entities", F.array("id").alias("evidence")))
    at = events.select(F.col("id").alias("first"), "occurred_at")
    rows = once.withColumn("first", F.array_min("evidence")).join(at, "first").select(
        F.xxhash64("first", "group", "type", "content").bitwiseAND(F.lit((1 << 63) - 1)).alias("id"), F.col("group").alias("project_id"), F.lit(None).cast("string").alias("user_id"), extraction.durable_type(F.col("type"), F.lit("")).alias("type"), "content",
        canonical_hash(F.col("content")).alias("content_hash"), F.lit("active").alias("status"), "importance", "confidence", F.col("occurred_at").alias("observed_at"))
    return store.inserted(rows, memories)[0].where("outcome = 'inserted'").drop("outcome", "stands")


def ingested(stream: DataFrame, folder: str, project: str | None = None, every: str | None = None):
    """A query that turns a stream of raw events into the logs ``folder``/events, /memories and /outcomes. It runs
    once over what there is, or ``every`` so often."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = accepted(batch, project).persist()
        try:
            events = _log(spark, f"{folder}/events", EVENT)
            fresh = inserted(rows.where("outcome = 'stored'").select(*events.columns), events, KEYS).persist()
            memories = remembered(fresh, _log(spark, f"{folder}/memories", MEMORY)).select(*(f.name for f in spark.createDataFrame([], MEMORY).schema)).persist()
            memories.count()
            memories.write.mode("append").parquet(f"{folder}/memories")
            fresh.write.mode("append").parquet(f"{folder}/events")
            rows.groupBy("outcome").agg(F.count("*").alias("n")).withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/outcomes")
            for x in (fresh, memories):
                x.unpersist()
        finally:
            rows.unpersist()

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(**trigger)


def session_ends(stream: DataFrame, folder: str, working: str, now: str):
    """A query that, for each session that ends, promotes its scratch rows (a Parquet folder ``working``) to
    ``folder``/memories; running again promotes nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        ended = batch.where("kind = 'session.end'").select("session_id").distinct()
        rows = spark.read.parquet(working).join(ended, "session_id", "left_semi")
        memories = _log(spark, f"{folder}/memories", MEMORY)
        promoted, _, _ = store.session_end(rows, memories, F.lit(now).cast("timestamp_ntz"))
        new = promoted.where("outcome = 'inserted'").select(*(F.col(c) if c in promoted.columns else F.lit(0.5).alias(c) for c in memories.columns)).persist()
        new.count()
        new.write.mode("append").parquet(f"{folder}/memories")
        new.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/ends").trigger(availableNow=True)

"""Structured Streaming forms of ingest: unbounded or bounded dedupe, sessions' windows, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.memory import inserted

KEYS = ["project_id", "kind", "content_hash"]


BUCKETS = 256  #: of the log, by content hash: a batch reads only those that its own hashes fall into


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("content_hash"), F.lit(BUCKETS)).cast("int"))


def appended(stream: DataFrame, log_path: str, checkpoint: str):
    """Write a stream of events to a log, each (project, kind, hash) once however late a copy comes.

    Each micro-batch is compared with the log itself, so the horizon has no end and state doesn't grow; a
    batch that is retried adds nothing, since its rows are in the log then. The log is partitioned by a bucket of
    the hash, and only a batch's buckets are read. Of a batch's events the earliest of each key is kept,
    whatever the order of arrival.
    """
    columns = stream.columns
    empty = _bucketed(stream.sparkSession.createDataFrame([], stream.schema))
    empty.write.partitionBy("bucket").mode("append").parquet(log_path)  # so that there is a log to read
    schema = empty.schema

    def add(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch = _bucketed(batch)
        hit = [r.bucket for r in batch.select("bucket").distinct().collect()]
        log = spark.read.schema(schema).parquet(log_path).where(F.col("bucket").isin(hit))
        new = inserted(batch, log, KEYS)
        new.select(*columns, "bucket").repartition("bucket").write.partitionBy("bucket").mode("append").parquet(log_path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def bounded(stream: DataFrame, horizon: str = "2 days") -> DataFrame:
    """The same within a horizon: copies that come later than that pass (an extension, not the log's rule)."""
    return stream.withWatermark("occurred_at", horizon).dropDuplicatesWithinWatermark(KEYS)


def activity(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user by gaps in activity, with their number of events."""
    timed = stream.withWatermark("occurred_at", late)
    by = timed.groupBy("user_id", F.session_window("occurred_at", gap).alias("session")).agg(F.count("*").alias("events"))
    return by.select("user_id", F.col("session.start").alias("started_at"), F.col("session.end").alias("ended_at"), "events")


def unexpired(working: DataFrame, late: str = "1 hour", ttl: str = "24 hours") -> DataFrame:
    """Scratch rows a session and day, kept until a day after their last event."""
    timed = working.withWatermark("occurred_at", late)
    by = timed.groupBy("session_id", F.session_window("occurred_at", ttl).alias("life")).agg(F.max("occurred_at").alias("last_at"), F.count("*").alias("rows"))
    return by.select("session_id", F.col("life.end").alias("expires_at"), "last_at", "rows")

"""The driver's tables seen as memories, edges, entities, events and the like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MEMORY_TYPES, SOURCE_KINDS
from ..functions.text import content_hash

NOW = "2024-07-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key + 1).cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    status = (F.when(d % 20 < 12, "active").when(d % 20 < 14, "stale").when(d % 20 < 17, "superseded")
              .when(d % 20 == 17, "disputed").otherwise("archived"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    observed = F.timestamp_add("HOUR", (d % 4000).cast("int"), start)
    until = (F.when(status.isin("superseded", "archived"), F.timestamp_add("DAY", (1 + d % 60).cast("int"), observed))
             .when(d % 20 == 11, F.lit("2024-12-31 00:00:00").cast("timestamp_ntz")))
    return read(spark, sf_dir, "documents").select(
        d.alias("id"), F.col("text").alias("content"), _pick(MEMORY_TYPES, d % 6).alias("type"), status.alias("status"),
        F.when(d % 10 != 9, F.concat(F.lit("p"), (d % 4).cast("string"))).alias("project_id"),
        F.when(d % 10 == 9, F.concat(F.lit("u"), (d % 3).cast("string"))).alias("user_id"),
        ((d * 37) % 101 / 100.0).alias("importance"), ((d * 53) % 101 / 100.0).alias("confidence"), (d % 13).alias("access_count"),
        observed.alias("observed_at"), observed.alias("valid_from"), until.alias("valid_until"),
        content_hash(F.col("text")).alias("content_hash"), _pick(SOURCE_KINDS, d % 8).alias("source_kind"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "documents").agg(F.count("*").alias("nd"))
    ends = read(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n)).select(
        (F.col("l_orderkey") % F.col("nd")).alias("src"), (F.col("l_partkey") % F.col("nd")).alias("dst"),
        F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("relation"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.col("l_shipdate").alias("valid_from"))
    return ends.where("src <> dst").groupBy("src", "dst", "relation").agg(F.min("id").alias("id"), F.min("valid_from").alias("valid_from"))


def memory_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"))
    return d.select("id", F.explode(F.array_distinct(F.array((F.col("id") % 25), (F.col("id") * 7 + 3) % 25))).alias("entity_id"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic version claims on memories' ids, so that templates collide with other numbers."""
    claim = F.concat(F.lit("Version:  tool "), F.chr(F.lit(97) + (F.col("id") % 26)), F.lit(" "), (F.col("id") % 7).cast("string"), F.lit("."), (F.col("id") % 3).cast("string"), F.concat(F.lit(" in group g"), F.substring(F.md5(F.floor(F.col("id") / 40).cast("string")), 1, 4)))
    return memories(spark, sf_dir).withColumn("content", claim)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events with kind, content hash and session."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project_id"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"), F.col("ts").alias("occurred_at"),
        F.col("user_id"), F.get_json_object("props", "$.k").alias("k"), F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("content_hash"))

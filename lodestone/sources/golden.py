"""Golden datasets of the benchmark: JSON documents, and the references in them that lead nowhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "id string, base_time string, now string, projects array<struct<key:string,name:string>>, "
    "events array<struct<kind:string,project:string,session:string,offset_seconds:long,content:string,command:string>>, facts array<struct<key:string,description:string>>, "
    "queries array<struct<id:string,project:string,query:string,max_tokens:long,expected:array<string>,forbidden:array<string>,query_type:string,oracle_min_tokens:long>>, "
    "contradictions array<struct<id:string,project:string,outcome:string,authority:string,contradicted:array<string>>>, consolidation array<struct<id:string,observations:long,facts:array<string>>>"
)
GLOBAL = "global"  # Fixed value: the project that stands for none.


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each JSON document of a folder."""
    return spark.read.schema(SCHEMA).json(folder, multiLine=True)


def issues(data: DataFrame) -> DataFrame:
    """What is wrong with datasets (id, place, what): unknown projects and facts, keys given twice, typed queries that
    expect nothing, events that don't lie before ``now``."""
    of = lambda column, *fields: data.select("id", F.explode(column).alias("x")).select("id", *(F.col(f"x.{f}").alias(f"_{f}") for f in fields))
    facts = of("facts", "key").select("id", F.col("_key").alias("ref"))
    projects = of("projects", "key").select("id", F.col("_key").alias("ref")).union(data.select("id", F.lit(GLOBAL)))
    uses = lambda column, place, field: of(column, place, field).select("id", F.concat(F.lit(f"{column} "), F.col(f"_{place}")).alias("place"), F.explode(f"_{field}").alias("ref"))
    named = [uses("queries", "id", "expected"), uses("queries", "id", "forbidden"), uses("contradictions", "id", "contradicted"), uses("consolidation", "id", "facts"),
             of("contradictions", "id", "authority").where("_authority IS NOT NULL").select("id", F.concat(F.lit("contradictions "), "_id").alias("place"), F.col("_authority").alias("ref"))]
    lost = reduce(DataFrame.union, named).join(facts, ["id", "ref"], "left_anti").select("id", "place", F.concat(F.lit("unknown fact "), "ref").alias("what"))
    at = [of("events", "kind", "project").select("id", F.concat(F.lit("events "), "_kind").alias("place"), F.col("_project").alias("ref")), *(of(c, "id", "project").where("_project IS NOT NULL").select("id", F.concat(F.lit(f"{c} "), "_id").alias("place"), F.col("_project").alias("ref")) for c in ("queries", "contradictions"))]
    strays = reduce(DataFrame.union, at).join(projects, ["id", "ref"], "left_anti").select("id", "place", F.concat(F.lit("unknown project "), "ref").alias("what"))
    twice = [of(c, k).groupBy("id", f"_{k}").agg(F.count("*").alias("n")).where("n > 1").select("id", F.concat(F.lit(f"{c} "), f"_{k}").alias("place"), F.lit("given twice").alias("what")) for c, k in (("facts", "key"), ("queries", "id"))]
    typed = of("queries", "id", "query_type", "oracle_min_tokens", "expected").where("(_query_type IS NOT NULL OR _oracle_min_tokens IS NOT NULL) AND coalesce(size(_expected), 0) <= 0")
    late = data.select("id", "base_time", "now", F.explode("events").alias("x")).where(F.timestamp_add("SECOND", F.col("x.offset_seconds").cast("int"), F.col("base_time").cast("timestamp")) >= F.col("now").cast("timestamp"))
    rest = [typed.select("id", F.concat(F.lit("queries "), "_id").alias("place"), F.lit("expects nothing").alias("what")), late.select("id", F.concat(F.lit("events "), "x.kind").alias("place"), F.lit("not before now").alias("what"))]
    return reduce(DataFrame.union, [lost, strays, *twice, *rest]).distinct()

"""Reads and writes of memories: ranked search, pages, duplicates, histories, transitions, the version log."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring, temporal, text


def lexical(memories: DataFrame, terms: list[str], limit: int = 50) -> DataFrame:
    """Memories that match any of the terms, ranked by token counts, then the newest, then the largest id.

    A term of several tokens matches where all of them are; the rank adds up the distinct tokens of all terms.
    Only contents that hold a term's first token as a substring are split, once each. The rank is over the top
    ``limit`` rows: Spark keeps that many of each task before the one that numbers them. Adds lexical_rank and
    ts_rank. A null content has no terms.
    """
    parts = [re.findall("[a-z0-9.]+", t.lower()) for t in terms]
    parts = [p for p in parts if p]
    if not parts:
        return memories.limit(0).withColumn("ts_rank", F.lit(0.0)).withColumn("lexical_rank", F.lit(0))
    distinct = sorted({x for p in parts for x in p})
    count = lambda words, t: F.size(F.filter(words, lambda x: x == F.lit(t)))

    def rank(words):
        return text.once(F.array(*(count(words, t) for t in distinct)), lambda n: F.when(
            reduce(or_, (reduce(and_, (n[distinct.index(x)] > 0 for x in p)) for p in parts)),
            sum((scoring.ts_rank(n[k], len(distinct)) for k in range(len(distinct))), F.lit(0.0))).otherwise(0.0))

    low = F.lower("content")
    near = memories.where(reduce(or_, (low.contains(p[0]) for p in parts)))
    order = [F.col("ts_rank").desc(), F.col("observed_at").desc(), F.col("id").desc()]
    hits = near.withColumn("ts_rank", F.round(text.once(text.tokens(F.col("content")), rank), 9)).where("ts_rank > 0").orderBy(*order).limit(limit)
    return hits.withColumn("lexical_rank", F.row_number().over(Window.orderBy(*order)))


def scored(candidates: DataFrame, factors: dict[str, Column], mass: float) -> DataFrame:
    """Adds score, relevance (score by active mass, 0 to 1) and explain (factors that add something, by name)."""
    total = sum(factors.values(), F.lit(0.0))
    explain = F.array_sort(F.filter(F.array(*(F.struct(F.lit(k).alias("factor"), F.round(v, 6).alias("value")) for k, v in factors.items())), lambda x: x["value"] > 1e-9))
    return candidates.withColumn("score", total).withColumn("relevance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / mass))).withColumn("explain", explain)


def nearest(vectors: DataFrame, query: DataFrame, k: int = 50, least: float = 0.05) -> DataFrame:
    """The k vectors nearest a one-row query by cosine; exact. The query's row is sent to every task."""
    near = vectors.crossJoin(F.broadcast(query.limit(1).select(F.col("embedding").alias("wanted"))))
    near = near.withColumn("cosine", scoring.cosine(F.col("embedding"), F.col("wanted"))).where(F.col("cosine") >= least)
    order = [F.round("cosine", 9).desc(), F.col("id").asc()]
    top = near.orderBy(*order).limit(k)
    return top.withColumn("vector_rank", F.row_number().over(Window.orderBy(*order))).drop("wanted")


def merged_channels(*channels: DataFrame) -> DataFrame:
    """Candidates of several channels as one row an id: least rank of each channel, greatest graph boost."""
    names = ("lexical_rank", "vector_rank", "graph_boost")
    rows = None
    for c in channels:
        c = c.select("id", *(F.col(n) if n in c.columns else F.lit(None).cast("double").alias(n) for n in names))
        rows = c if rows is None else rows.unionByName(c)
    return rows.groupBy("id").agg(F.min("lexical_rank").alias("lexical_rank"), F.min("vector_rank").alias("vector_rank"), F.max("graph_boost").alias("graph_boost"))


def page(memories: DataFrame, before: tuple[str, int] | None, size: int) -> DataFrame:
    """The next ``size`` + 1 rows after a cursor, newest first (the extra row tells whether more follow)."""
    if before:
        at, key = F.lit(before[0]).cast("timestamp_ntz"), before[1]
        memories = memories.where((F.col("observed_at") < at) | ((F.col("observed_at") == at) & (F.col("id") < key)))
    return memories.orderBy(F.col("observed_at").desc(), F.col("id").desc()).limit(size + 1)


def authority(source: Column, kind: Column) -> Column:
    return (F.when(source == "explicit", 4).when(kind == "decision", 3).when(kind.isin("semantic", "procedural", "failure", "preference"), 2)
            .when(kind == "episodic", 1).otherwise(0))


def collapsed(memories: DataFrame, scope: list[str]) -> DataFrame:
    """One row for each content hash in a scope: the one of most authority, then confidence, then the newest,
    then the smallest id; with the group's size. Two aggregations, so a hash that a third of all rows share
    is combined before it is moved."""
    key = F.struct(authority(F.col("source_kind"), F.col("type")).alias("rank"), "confidence", "observed_at", (-F.col("id")).alias("minus"))
    kept = memories.groupBy(*scope, "content_hash").agg(F.max(key).alias("best"), F.count("*").alias("copies"))
    return kept.select(*scope, "content_hash", (-F.col("best.minus")).alias("id"), F.col("best.rank").alias("authority"), "copies")


def history(chain: DataFrame, limit: int = 100) -> DataFrame:
    """Each memory's newest successor and its distance from it, by doubling the steps until none is open.

    ``chain`` has id and superseded_by. A cycle or a chain longer than ``limit`` keeps what was reached.
    """
    at = chain.select("id", F.coalesce("superseded_by", "id").alias("tip"), F.when(F.col("superseded_by").isNull(), 0).otherwise(1).alias("steps"))
    reach = 1
    while reach < limit:
        up = at.select(F.col("id").alias("tip"), F.col("tip").alias("next"), F.col("steps").alias("more"))
        at = at.join(up, "tip", "left").select("id", F.coalesce("next", "tip").alias("tip"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        reach *= 2
    return at


def transitions(changes: DataFrame) -> DataFrame:
    """Status changes (id, old, new) with whether they are legal and their audit action."""
    return changes.select("id", "old", "new", temporal.may_become(F.col("old"), F.col("new")).alias("legal"), temporal.audit_action(F.col("old"), F.col("new")).alias("action"))


def folded(log: DataFrame, fields: list[str], until: str | None = None) -> DataFrame:
    """Current rows of an append-only version log (id, seq, op, at, fields), or those as of a moment.

    Of each field the last value that isn't null counts; an id whose last op is 'purge' is gone.
    """
    if until:
        log = log.where(F.col("at") <= F.lit(until).cast("timestamp_ntz"))
    last = [F.max(F.when(F.col(f).isNotNull(), F.struct("seq", f))).getField(f).alias(f) for f in fields]
    return log.groupBy("id").agg(F.max(F.struct("seq", "op")).getField("op").alias("op"), F.max("seq").alias("seq"), *last).where("op <> 'purge'").drop("op")


def inserted(rows: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are new by ``keys`` (null equals null), one for each key: what an append may add."""
    first = F.min(F.struct("occurred_at", "id", F.struct(*(c for c in rows.columns if c not in (*keys, "occurred_at", "id"))).alias("rest"))).alias("first")
    once = rows.groupBy(*keys).agg(first)  # combined before it is moved, so a hot key is no hot task
    once = once.select(*(F.col(c) if c in keys else F.col(f"first.{c}" if c in ("occurred_at", "id") else f"first.rest.{c}").alias(c) for c in rows.columns))
    known = present.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return once.join(known, same, "left_anti")


def stats(memories: DataFrame, statuses: tuple[str, ...], types: tuple[str, ...]) -> DataFrame:
    """Rows of each status and type, 0 where there are none."""
    spark = memories.sparkSession
    cells = spark.createDataFrame([(s, t) for s in statuses for t in types], "status string, type string")
    found = memories.groupBy("status", "type").agg(F.count("*").alias("n"))
    return cells.join(found, ["status", "type"], "left").select("status", "type", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def chains(chain: DataFrame, limit: int = 100) -> DataFrame:
    """Each chain of successors by its newest member: ids from the oldest on, the ``limit`` nearest the tip."""
    reached = history(chain, limit)
    near = Window.partitionBy("tip").orderBy("steps", "id")
    kept = reached.withColumn("k", F.row_number().over(near)).where(F.col("k") <= limit)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("steps", "id")), False), lambda x: x["id"])
    return kept.groupBy("tip").agg(ids.alias("ids"))

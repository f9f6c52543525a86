"""Graph operators over directed edges (src, dst, id, valid_from)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_edges(edges: DataFrame, at: Column | None) -> DataFrame:
    """Edges whose validity window holds the moment; all of them for None. A null end, or none, is open."""
    if at is None:
        return edges
    end = F.col("valid_until") if "valid_until" in edges.columns else F.lit(None)
    return edges.where((F.col("valid_from") <= at) & (end.isNull() | (end > at)))


def both_ways(edges: DataFrame, at: Column | None = None) -> DataFrame:
    edges = valid_edges(edges, at)
    return edges.select("src", "dst", "id").union(edges.select("dst", "src", "id")).toDF("src", "dst", "id")


def expanded(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.8, cap: int | None = None, at: Column | None = None) -> DataFrame:
    """Nodes within ``hops`` edges of the seeds (id), either way: id, hop, boost (decay ** hop).

    A node has the hop at which it is met first. ``cap`` keeps so many of a hop's nodes, by the least edge
    that meets them (a limit on expansion that is part of search; None keeps all). Only edges valid ``at`` the
    moment count, all of them for None.
    """
    edges = both_ways(edges, at)
    found = seeds.select(F.col("id").alias("node"), F.lit(0).alias("hop")).distinct()
    front = found.select("node")
    for hop in range(1, hops + 1):
        met = edges.join(front.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.min("id").alias("edge"))
        met = met.withColumnRenamed("dst", "node").join(found.select("node"), "node", "left_anti")
        if cap is not None:
            met = met.orderBy("edge", "node").limit(cap)
        front = met.select("node")
        found = found.union(front.select("node", F.lit(hop).alias("hop")))
    return found.select(F.col("node").alias("id"), "hop", F.pow(F.lit(decay), F.col("hop")).alias("boost"))


def neighbours(edges: DataFrame, memories: DataFrame, node: int, relations: tuple[str, ...] | None = None, direction: str = "both",
               at: Column | None = None, most: int | None = None) -> DataFrame:
    """Memories one edge from a node with the relation and direction, most important first, then by id.

    Edges are filtered by relation, direction (out, in, both) and validity. ``most`` keeps so many of the oldest
    edges before memories are looked up, so the order by importance is one among those.
    """
    edges = valid_edges(edges, at)
    if relations is not None:
        edges = edges.where(F.col("relation").isin(*relations))
    out = edges.where(F.col("src") == node).select(F.col("id").alias("edge"), F.col("dst").alias("id"), "relation", F.lit("out").alias("direction"))
    into = edges.where(F.col("dst") == node).select(F.col("id").alias("edge"), F.col("src").alias("id"), "relation", F.lit("in").alias("direction"))
    rows = {"out": out, "in": into, "both": out.union(into)}[direction]
    if most is not None:
        rows = rows.orderBy("edge", "direction").limit(most)
    found = rows.join(memories.select("id", "type", "importance"), "id")
    return found.orderBy(F.col("importance").desc(), "id", "edge").select("id", "relation", "direction", "type", "importance")


def interleaved(bindings: DataFrame, memories: DataFrame, entities: list[int], each: int = 30, cap: int = 60) -> DataFrame:
    """Round robin over entities: each one's newest memories in turn, a memory once, ``cap`` in all."""
    order = F.create_map(*(x for k, e in enumerate(entities) for x in (F.lit(e).cast("long"), F.lit(k))))
    bound = bindings.where(F.col("entity_id").isin(*entities)).join(memories, "id")
    newest = Window.partitionBy("entity_id").orderBy(F.col("observed_at").desc(), F.col("id").desc())
    bound = bound.withColumn("pos", F.row_number().over(newest)).where(F.col("pos") <= each)
    turn = F.struct("pos", F.element_at(order, F.col("entity_id").cast("long")).alias("turn"))
    once = bound.groupBy("id").agg(F.min(turn).alias("turn"))
    top = once.orderBy("turn", "id").limit(cap)
    return top.select("id", F.col("turn.pos").alias("pos"), F.col("turn.turn").alias("entity_index"), F.row_number().over(Window.orderBy("turn", "id")).alias("rank"))

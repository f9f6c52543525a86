"""Retrieval metrics over outcomes: query_id, returned, expected and forbidden id arrays, used tokens, budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval(outcomes: DataFrame, k: int = 5) -> DataFrame:
    """Precision and recall at k, reciprocal rank and whether a forbidden id came back, for each query."""
    top = F.slice("returned", 1, k)
    hits = F.size(F.array_intersect(top, "expected"))
    first = F.array_min(F.filter(F.transform("expected", lambda x: F.array_position("returned", x)), lambda p: p > 0))
    return outcomes.select(
        "query_id", (hits / F.greatest(F.least(F.size("returned"), F.lit(k)), F.lit(1))).alias("precision_at_k"),
        F.when(F.size("expected") > 0, hits / F.size("expected")).otherwise(1.0).alias("recall_at_k"),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"), F.arrays_overlap("returned", "forbidden").alias("leaked"))


def mean_interval(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Mean of a share with its 95 % interval, kept between 0 and 1; one row has no width."""
    g = rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = F.when(F.col("n") > 1, 1.96 * F.col("sd") / F.sqrt("n")).otherwise(0.0)
    return g.select(by, "n", "mean", F.greatest(F.lit(0.0), F.col("mean") - half).alias("low"), F.least(F.lit(1.0), F.col("mean") + half).alias("high"))


def tokens(outcomes: DataFrame) -> DataFrame:
    """Budget compliance, mean, greatest and nearest-rank 95th percentile of used tokens."""
    rank = "percentile_disc(0.95) WITHIN GROUP (ORDER BY used)"
    return outcomes.agg(F.avg((F.col("used") <= F.col("budget")).cast("double")).alias("compliance"), F.avg("used").alias("mean"), F.max("used").alias("most"), F.expr(rank).cast("long").alias("p95"))


def leakage(returned: DataFrame) -> DataFrame:
    """Share of returned rows of another project, and of queries whose first row is (query_id, pos, project_id, wanted)."""
    other = F.col("project_id").isNotNull() & (F.col("project_id") != F.col("wanted"))
    return returned.agg(F.avg(other.cast("double")).alias("leakage"), F.avg(F.when(F.col("pos") == 1, other.cast("double"))).alias("top1"))


def gated(values: DataFrame, bounds: dict[str, tuple[str, float]]) -> DataFrame:
    """Values (metric, value) with whether each keeps its bound; a metric without one is left out."""
    table = F.create_map(*(x for k, (side, bound) in bounds.items() for x in (F.lit(k), F.struct(F.lit(side).alias("side"), F.lit(float(bound)).alias("bound")))))
    rows = values.withColumn("gate", F.try_element_at(table, "metric")).where("gate IS NOT NULL")
    kept = F.when(F.col("gate.side") == "min", F.col("value") >= F.col("gate.bound")).otherwise(F.col("value") <= F.col("gate.bound"))
    return rows.select("metric", "value", kept.alias("passed"))


def token_efficiency(queries: DataFrame, by: str) -> DataFrame:
    """Of each kind of query: budget compliance, and how many times the fewest tokens that would do (oracle) were
    used, on average, at most, and on average where all that was expected came back."""
    gap = F.col("used") / F.col("oracle")
    return queries.groupBy(by).agg(
        F.count("*").alias("queries"), F.round(F.avg((F.col("used") <= F.col("budget")).cast("double")), 4).alias("compliance"), F.round(F.avg(gap), 4).alias("gap"),
        F.round(F.max(gap), 4).alias("most"), F.round(F.coalesce(F.avg(F.when(F.col("satisfied"), gap)), F.lit(0.0)), 4).alias("gap_when_satisfied"))


def stale_cited(memories: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Archived memories that were cited in the last days."""
    age = F.timestamp_diff("SECOND", F.col("last_accessed_at"), now) / 86400.0
    return memories.where((F.col("status") == "archived") & (age >= 0) & (age <= days))


def unresolved(sides: DataFrame, memories: DataFrame) -> DataFrame:
    """Sides of declared contradictions (id, expected) that are neither superseded nor disputed."""
    return sides.join(memories.select("id", "status"), "id").where(~F.col("status").isin("superseded", "disputed")).dropDuplicates(["id"])


# The bounds that a run of the benchmark must keep.
GATES = {
    "temporal_accuracy": ("min", 1.0), "token_budget_compliance": ("min", 1.0), "cross_project_top1_rate": ("max", 0.0), "retrieval_precision_at_k": ("min", 0.7),
    "retrieval_recall_at_k": ("min", 0.9), "irrelevant_leakage_rate": ("max", 0.2), "contradiction_accuracy": ("min", 0.8), "consolidation_quality": ("min", 0.3),
    "retrieval_precision_procedural": ("min", 0.6), "retrieval_precision_decision": ("min", 0.9), "retrieval_precision_failure": ("min", 0.4), "retrieval_recall_procedural": ("min", 0.9),
    "retrieval_recall_decision": ("min", 0.9), "retrieval_recall_failure": ("min", 0.9), "token_budget_compliance_procedural": ("min", 1.0), "token_budget_compliance_decision": ("min", 1.0),
    "token_budget_compliance_failure": ("min", 1.0), "token_oracle_gap_mean": ("max", 2.5), "stale_cited_memories": ("max", 1), "duplicate_surfaced_pairs": ("max", 1),
    "unresolved_contradicted_memories": ("max", 1),
}


KINDS = ("procedural", "decision", "failure")


def gate_values(outcomes: DataFrame, returned: DataFrame, answers: DataFrame, conflicts: DataFrame, merges: DataFrame, counts: DataFrame, k: int = 5) -> DataFrame:
    """The value of each gate of ``GATES`` (metric, value), from what a run of the benchmark left.

    ``outcomes`` are as at the top, with kind, oracle (the fewest tokens that would do) and satisfied; ``returned``
    as for ``leakage``; ``answers`` are temporal questions (correct), ``conflicts`` declared groups (correct),
    ``merges`` expected merges (done); ``counts`` has the audits' rows (metric, n). Each table is read once and
    leaves a few rows; a metric without rows is 0.
    """
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    rows = retrieval(outcomes, k).join(outcomes.select("query_id", "kind", "oracle", "satisfied", (F.col("used") <= F.col("budget")).alias("kept"), "used"), "query_id")
    of = lambda kind, c: F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col(c).cast("double"))), F.lit(0.0))
    typed = {f"{name}_{kind}": of(kind, c) for kind in KINDS for name, c in (("retrieval_precision", "precision_at_k"), ("retrieval_recall", "recall_at_k"), ("token_budget_compliance", "kept"))}
    gap = F.coalesce(F.avg(F.when(F.col("kind").isin(*KINDS) & F.col("satisfied"), F.col("used") / F.col("oracle"))), F.lit(0.0))
    all_ = {"retrieval_precision_at_k": share("precision_at_k"), "retrieval_recall_at_k": share("recall_at_k"), "irrelevant_leakage_rate": share("leaked"), "token_budget_compliance": share("kept"), "token_oracle_gap_mean": gap, **typed}
    wide = [rows.agg(*(v.alias(n) for n, v in all_.items())), leakage(returned).select(F.coalesce("top1", F.lit(0.0)).alias("cross_project_top1_rate"))]
    wide += [df.agg(share(c).alias(name)) for df, c, name in ((answers, "correct", "temporal_accuracy"), (conflicts, "correct", "contradiction_accuracy"), (merges, "done", "consolidation_quality"))]
    out = None
    for w in wide:
        long = w.unpivot([], w.columns, "metric", "value")
        out = long if out is None else out.unionByName(long)
    names = outcomes.sparkSession.createDataFrame([(x,) for x in ("stale_cited_memories", "duplicate_surfaced_pairs", "unresolved_contradicted_memories")], "metric string")
    audits = names.join(counts.groupBy("metric").agg(F.sum("n").cast("double").alias("value")), "metric", "left")
    return out.unionByName(audits.select("metric", F.coalesce("value", F.lit(0.0)).alias("value")))

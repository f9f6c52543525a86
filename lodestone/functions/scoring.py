"""Signals and scores of retrieval and decay as Columns, in double."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FALLBACK_HALF_LIFE_DAYS, HALF_LIFE_DAYS, RESISTANT_FLOOR, RRF_K, TYPE_AFFINITY, WEIGHTS


def rrf(rank: Column, k: int = RRF_K) -> Column:
    return F.coalesce(F.when(rank >= 1, F.lit(k + 1.0) / (F.lit(float(k)) + rank)), F.lit(0.0))


def half_life(kind: Column) -> Column:
    table = F.create_map(*(x for k, v in HALF_LIFE_DAYS.items() for x in (F.lit(k), F.lit(float(v)))))
    return F.coalesce(F.try_element_at(table, kind), F.lit(float(FALLBACK_HALF_LIFE_DAYS)))


def age_days(observed: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", observed, now) / 86400.0)


def recency(observed: Column, kind: Column, now: Column) -> Column:
    return F.pow(F.lit(0.5), age_days(observed, now) / half_life(kind))


def access(count: Column) -> Column:
    return F.least(F.lit(1.0), F.log(1.0 + F.greatest(count, F.lit(0))) / math.log(11))


def project_match(project: Column, wanted: str | None) -> Column:
    if wanted is None:
        return F.when(project.isNull(), 1.0).otherwise(0.7)
    return F.when(project == wanted, 1.0).when(project.isNull(), 0.4).otherwise(0.7)


def affinity(kind: Column, intent: str) -> Column:
    table = F.create_map(*(x for k, v in TYPE_AFFINITY[intent].items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, kind), F.lit(0.0))


def contributions(now: Column, intent: str, project: str | None, *, lexical=None, vector=None, graph=None, entity=None) -> dict[str, Column]:
    """What each factor adds to a memory's score; factors of channels that didn't run are left out."""
    w, out = WEIGHTS, {}
    if vector is not None:
        out["semantic_similarity"] = w["sem"] * rrf(vector)
    if lexical is not None:
        out["lexical_relevance"] = w["lex"] * rrf(lexical)
    if graph is not None:
        out["graph_proximity"] = w["graph"] * F.coalesce(graph, F.lit(0.0))
    if entity is not None:
        out["entity_match"] = w["ent"] * F.coalesce(entity, F.lit(0.0))
    return out | {
        "importance": w["imp"] * F.col("importance"), "confidence": w["conf"] * F.col("confidence"),
        "recency": w["rec"] * recency(F.col("observed_at"), F.col("type"), now), "access_frequency": w["acc"] * access(F.col("access_count")),
        "project_match": w["proj"] * project_match(F.col("project_id"), project), "type_affinity": affinity(F.col("type"), intent),
    }


def active_mass(intent: str, *, lexical: bool, vector: bool) -> float:
    w = WEIGHTS
    return sum(w[x] for x in ("graph", "imp", "conf", "rec", "acc", "proj", "ent")) + lexical * w["lex"] + vector * w["sem"] + max(TYPE_AFFINITY[intent].values())


def prominence(now: Column) -> Column:
    """How much a memory still stands out; decisions have an importance floor."""
    importance = F.when(F.col("type") == "decision", F.greatest("importance", F.lit(RESISTANT_FLOOR))).otherwise(F.col("importance"))
    return F.sqrt(importance) * F.col("confidence") * recency(F.col("observed_at"), F.col("type"), now) * (1.0 + F.log1p(F.greatest("access_count", F.lit(0)).cast("double")))


def ts_rank(tf: Column, n_terms: int) -> Column:
    """Rank of one query term by its count in the document: 0.1 times the sum of 1/j**2 to tf, normalised."""
    steps = F.aggregate(F.sequence(F.lit(1), F.greatest(tf, F.lit(1))), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))
    return F.when(tf > 0, 0.1 * steps / 1.64493406685 / n_terms).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double; 0 where a norm is 0 or lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)

"""Set-at-a-time maintenance: contradictions, decay, compaction, gates, drift, skills, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import ARCHIVE_BELOW, GATE, LEAST_SOLVED, PROMOTION_IMPORTANCE, RETENTION_WINDOW_DAYS, SIMILAR_SOLUTIONS, SUMMARY_WINDOW_DAYS
from ..functions import scoring, text


def contradictions(memories: DataFrame, *carried: str) -> DataFrame:
    """Pairs (a < b) in one scope whose statements have one template, other numbers and overlapping windows.

    A pair needs equal scope and template, so the join is on those; statements without numbers never pair. Columns
    that are ``carried`` come along as structs a and b, so pairs needn't be moved again to find them; ids are distinct.
    """
    m = memories.select(
        "id", F.struct("project_id", "user_id").alias("scope"), text.template(F.col("content")).alias("template"),
        text.numbers(F.col("content")).alias("numbers"), "valid_from", "valid_until", *carried).where(F.size("numbers") > 0)
    sides = [F.struct(*carried)] if carried else []
    a, b = (m.select("scope", "template", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "numbers", "valid_from", "valid_until")), *(x.alias(s) for x in sides)) for s in "ab")
    holds = (
        (F.col("id_a") < F.col("id_b")) & (F.col("numbers_a") != F.col("numbers_b"))
        & (F.col("valid_until_b").isNull() | (F.col("valid_from_a") < F.col("valid_until_b")))
        & (F.col("valid_until_a").isNull() | (F.col("valid_from_b") < F.col("valid_until_a")))
    )
    same = a["scope"].eqNullSafe(b["scope"]) & (a["template"] == b["template"])
    return a.join(b, same).where(holds).select("id_a", "id_b", a["template"], a["scope"], *("ab" if carried else ()))


def authority_rule(a: str, b: str) -> Column:
    """Which rule settles a pair, with + where ``a`` wins and - where ``b`` does; 'tie' if none does."""
    x, y = (lambda c, s=s: F.col(f"{s}.{c}") for s in (a, b))
    explicit = lambda s: s("source_kind") == "explicit"
    decision = lambda s: s("type") == "decision"
    sign = lambda won, name: F.concat(F.when(won, "+").otherwise("-"), F.lit(name))
    return (F.when(explicit(x) != explicit(y), sign(explicit(x), "explicit")).when(decision(x) != decision(y), sign(decision(x), "decision"))
            .when(x("observed_at") != y("observed_at"), sign(x("observed_at") > y("observed_at"), "newer"))
            .when(x("confidence") != y("confidence"), sign(x("confidence") > y("confidence"), "confidence")).otherwise("tie"))


def decayed(memories: DataFrame, now: Column, below: float = ARCHIVE_BELOW) -> DataFrame:
    """Active memories whose prominence has sunk below the threshold."""
    return memories.where("status = 'active'").withColumn("prominence", scoring.prominence(now)).where(F.col("prominence") < below)


def compaction(events: DataFrame, digested: DataFrame, now: Column, summary_days: int = SUMMARY_WINDOW_DAYS, retention_days: int = RETENTION_WINDOW_DAYS) -> DataFrame:
    """What becomes of each raw event: keep, summarize, summarize_and_purge or purge, and why.

    Events have processed_at, needs_review and process_error; ``digested`` has the ids with a summary.
    """
    rows = events.join(digested.select(F.col("id"), F.lit(True).alias("digest")).distinct(), "id", "left").withColumn("digest", F.coalesce("digest", F.lit(False)))
    at = F.col("occurred_at")
    old = at < F.timestamp_add("DAY", F.lit(-retention_days), now) if retention_days else F.lit(False)
    aging = at < F.timestamp_add("DAY", F.lit(-summary_days), now)
    blocked = F.when(F.col("processed_at").isNull(), "unprocessed").when(F.col("needs_review"), "needs_review").when(F.col("process_error").isNotNull(), "process_error")
    action = (F.when(~old & ~aging, "keep").when(~old & F.col("digest"), "keep").when(~old, "summarize").when(blocked.isNotNull(), "keep")
              .when(F.col("digest"), "purge").otherwise("summarize_and_purge"))
    reason = (F.when(~old & ~aging, "recent").when(~old & F.col("digest"), "summarized").when(~old, "aging").when(blocked.isNotNull(), blocked)
              .when(F.col("digest"), "old with summary").otherwise("old and clean"))
    return rows.select("*", action.alias("action"), reason.alias("reason"))


def gate(candidates: DataFrame) -> DataFrame:
    """The first reason for which a candidate has no future value, null if it is kept."""
    reason = (F.when(F.col("evidence") == 0, "no_evidence").when(F.length(F.trim(F.coalesce("rationale", F.lit("")))) == 0, "no_rationale")
              .when(F.char_length(F.trim("content")) < GATE["min_length"], "too_short").when(F.col("importance") < GATE["min_importance"], "importance")
              .when((F.col("type") == "semantic_candidate") & (F.col("confidence") < GATE["min_confidence"]), "confidence"))
    return candidates.withColumn("reason", reason)


def promotion(working: DataFrame) -> DataFrame:
    """The first reason for which a working row is not promoted, 'eligible' if it is."""
    reason = (F.when(F.col("promoted_memory_id").isNotNull(), "already_promoted").when(F.col("source_id").isNull(), "no_source")
              .when(F.col("evidence") == 0, "no_evidence").when(F.col("importance") < PROMOTION_IMPORTANCE, "below_importance_threshold").otherwise("eligible"))
    return working.withColumn("decision", reason)


def first_success_after(events: DataFrame, failure: Column, success: Column, keys: list[str], related: Column | None = None) -> DataFrame:
    """For each failure the first success of its group at a strictly later time, by one sort of the group.

    From the last event to the first, the success met last is carried along: no pairs are made and each event
    is looked at once. At one time failures come first, so they see later successes only, and the smallest id
    of several successes is met last. ``related`` is an array of what a failure and its success must share one
    of; events are then followed once for each entry, and a failure takes the earliest success of all.
    """
    rows = events.withColumn("__failed", failure).withColumn("__passed", success).where("__failed OR __passed")
    by = [*keys]
    if related is not None:
        rows, by = rows.withColumn("__shared", F.explode_outer(F.array_distinct(related))), [*keys, "__shared"]
    order = Window.partitionBy(*by).orderBy(F.col("occurred_at").desc(), F.col("__failed").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = F.last(F.when(F.col("__passed"), F.struct(F.col("occurred_at").alias("at"), F.col("id").alias("id"))), ignorenulls=True).over(order)
    if related is not None:
        later = F.when(F.col("__shared").isNotNull(), later)
    rows = rows.withColumn("fixed", later).where("__failed")
    if related is not None:
        rows = rows.groupBy(*keys, "id").agg(F.min("fixed").alias("fixed"))
    return rows.select(*keys, F.col("id").alias("failure_id"), F.col("fixed.id").alias("success_id"), F.col("fixed.at").alias("success_at"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths (path, blob) of two snapshots: added, deleted, modified or unchanged."""
    both = before.select("path", F.col("blob").alias("old")).join(after.select("path", F.col("blob").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return both.withColumn("change", change)


def renames(diff: DataFrame) -> DataFrame:
    """Deleted and added paths with one blob that no other deleted or added path has."""
    gone = diff.where("change = 'deleted'").groupBy(F.col("old").alias("blob")).agg(F.min("path").alias("from_path"), F.count("*").alias("n")).where("n = 1").drop("n")
    come = diff.where("change = 'added'").groupBy(F.col("new").alias("blob")).agg(F.min("path").alias("to_path"), F.count("*").alias("n")).where("n = 1").drop("n")
    return gone.join(come, "blob")


def drift(refs: DataFrame, diff: DataFrame, moved: DataFrame) -> DataFrame:
    """What became of the file version that a memory rests on, and the path that replaced it, if one did."""
    rows = refs.join(diff.select("path", "change", "new"), "path", "left").join(moved.select(F.col("from_path").alias("path"), "to_path"), "path", "left")
    state = (F.when(F.col("to_path").isNotNull(), "moved").when(F.col("change").isNull() | (F.col("change") == "deleted"), "path_missing")
             .when(F.col("new") != F.col("blob"), "content_changed").otherwise("valid"))
    return rows.select("id", "path", state.alias("state"), "to_path")


def recurring(failures: DataFrame) -> DataFrame:
    """Failure groups (scope, entity, signature) and whether a skill may be made of them, or why not.

    Solved failures must number two, have alike solutions (token Jaccard of every pair) and one proof. The
    pairs of a group are of its distinct solutions, whose number its text bounds.
    """
    keys = ["scope", "entity", "signature"]
    solved = F.coalesce(F.col("solution"), F.lit("")) != ""
    groups = failures.groupBy(*keys).agg(F.count("*").alias("seen"), F.sum(solved.cast("long")).alias("solved"),
                                         F.max((solved & (F.coalesce("verification", F.lit("")) != "")).cast("int")).alias("proved"))
    words = F.array_distinct(F.filter(F.split(F.lower("solution"), "[^a-z0-9]+"), lambda x: x != ""))
    texts = failures.where(solved).select(*keys, "solution").distinct().withColumn("words", words)
    a, b = (texts.select(*keys, F.col("solution").alias(f"solution_{s}"), F.col("words").alias(f"words_{s}")) for s in "ab")
    alike = F.size(F.array_intersect("words_a", "words_b")) / F.greatest(F.size(F.array_union("words_a", "words_b")), F.lit(1))
    weakest = a.join(b, keys).where("solution_a < solution_b").groupBy(*keys).agg(F.min(alike).alias("weakest"))
    reason = (F.when(F.col("solved") < LEAST_SOLVED, "insufficient_solved_failures").when(F.col("weakest") < SIMILAR_SOLUTIONS, "divergent_solutions")
              .when(F.col("proved") == 0, "no_verification_evidence").otherwise("qualified"))
    return groups.join(weakest, keys, "left").withColumn("weakest", F.coalesce("weakest", F.lit(1.0))).withColumn("outcome", reason)

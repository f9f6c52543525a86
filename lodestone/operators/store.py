"""The store as append-only logs: events and their processing, memories and their audit, registry, edges, sessions.

Nothing is updated in place. Writes return the rows to append; reads fold a log by its last values.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import LIVE
from ..functions import temporal, text
from . import lifecycle, memory
from .lineage import cut

SCOPE = ["project_id", "user_id"]


def raw_events(events: DataFrame, project: str | None = None, user: str | None = None) -> DataFrame:
    """How many raw events a scope holds (n); without a project or user, all."""
    for name, value in (("project_id", project), ("user_id", user)):
        if value is not None:
            events = events.where(F.col(name) == value)
    return events.agg(F.count("*").alias("n"))


def pending(events: DataFrame, log: DataFrame, limit: int) -> DataFrame:
    """The oldest events that no processing row (id, seq, processed_at) has marked as processed."""
    done = log.where("processed_at IS NOT NULL").select("id").distinct()
    return events.join(done, "id", "left_anti").orderBy("occurred_at", "id").limit(limit)


def processing(log: DataFrame) -> DataFrame:
    """State of each event by its last processing row: processed_at, needs_review, process_error. A later success
    clears an earlier error."""
    last = F.max_by(F.struct("processed_at", "needs_review", "process_error"), "seq").alias("s")
    return log.groupBy("id").agg(last).select("id", "s.*")


def hydrated(memories: DataFrame, sources: DataFrame, bound: DataFrame, entities: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Memories with their source, their entities in order of weight and id, and a decision's payload."""
    names = bound.join(entities.select("entity_id", "name"), "entity_id").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "entity_id", "name"))), lambda x: F.struct(x["entity_id"].alias("id"), x["name"].alias("name"))).alias("entities"))
    out = memories.join(sources.select("source_id", F.struct("kind", "uri").alias("source")), "source_id").join(names, "id", "left")
    out = out.withColumn("entities", F.coalesce("entities", F.array().cast(names.schema["entities"].dataType)))
    if decisions is not None:
        out = out.join(decisions.select("id", F.struct(*(c for c in decisions.columns if c != "id")).alias("decision")), "id", "left")
    return out


def fetched(memories: DataFrame, wanted: DataFrame) -> DataFrame:
    """Memories by ids (id, pos) in the order in which they were asked for; those not there are left out."""
    return wanted.join(memories, "id").orderBy("pos")


def registry(entities: DataFrame, project: str) -> DataFrame:
    """Unmerged entities of a project, then of none, the newest first."""
    rows = entities.where(F.col("merged_into").isNull() & (F.col("project_id").isNull() | (F.col("project_id") == project)))
    return rows.orderBy(F.col("project_id").isNull(), F.col("created_at").desc(), F.col("entity_id").desc())


def merged_entities(pointers: DataFrame) -> DataFrame:
    """What each entity was merged into in the end (id, merged_into): chains are followed by doubling."""
    return memory.history(pointers.select("id", F.col("merged_into").alias("superseded_by"))).select("id", F.col("tip").alias("entity_id"))


def new_edges(rows: DataFrame, present: DataFrame) -> DataFrame:
    """Edges that an append may add: one for each (src, dst, relation), none that is there already."""
    keys = ["src", "dst", "relation"]
    return rows.groupBy(*keys).agg(F.min("id").alias("id")).join(present.select(*keys).distinct(), keys, "left_anti").select("id", *keys)


def inserted(candidates: DataFrame, memories: DataFrame, actor: str = "system") -> tuple[DataFrame, DataFrame]:
    """What candidates become: (rows, audit). Rows have an outcome, inserted or duplicate, and the id that stands
    for them; a candidate is a duplicate of a memory, or of an earlier candidate, of its scope, type and hash."""
    keys = [*SCOPE, "type", "content_hash"]
    there = memories.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("id").alias("there")).groupBy(*(f"__{k}" for k in keys)).agg(F.min("there").alias("there"))
    first = candidates.groupBy(*keys).agg(F.min("id").alias("first"))
    names = {k: f"_{k}" for k in keys}
    rows = candidates.join(first.withColumnsRenamed(names), [candidates[k].eqNullSafe(F.col(n)) for k, n in names.items()]).drop(*names.values())
    rows = rows.join(there, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*(f"__{k}" for k in keys))
    stands = F.coalesce("there", "first")
    rows = rows.withColumn("outcome", F.when(F.col("there").isNull() & (F.col("id") == F.col("first")), "inserted").otherwise("duplicate")).withColumn("stands", stands).drop("there", "first")
    audit = rows.where("outcome = 'inserted'").select(F.col("id").alias("memory_id"), F.lit("created").alias("action"), F.lit(None).cast("string").alias("from_status"), F.col("status").alias("to_status"), F.lit(actor).alias("actor"), F.col("observed_at").alias("at"))
    return rows, audit


def status_changes(memories: DataFrame, wanted: DataFrame, actor: str) -> tuple[DataFrame, DataFrame]:
    """Status changes (id, new, at): those that the status machine allows as versions, and their audit rows."""
    legal = wanted.join(memories.select("id", F.col("status").alias("old")), "id").where(temporal.may_become(F.col("old"), F.col("new")))
    audit = legal.select(F.col("id").alias("memory_id"), temporal.audit_action(F.col("old"), F.col("new")).alias("action"), F.col("old").alias("from_status"), F.col("new").alias("to_status"), F.lit(actor).alias("actor"), "at")
    return legal.select("id", F.col("new").alias("status"), "at"), audit


def superseded(memories: DataFrame, winners: DataFrame) -> DataFrame:
    """Two versions for each winner (id, loser_id, observed_at): the winner, active, and its loser, whose window
    closes when the winner was observed.

    A loser must be able to become superseded, and have begun before; the outcome says why not ('not_later',
    'illegal', 'gone').
    """
    loser = memories.select(F.col("id").alias("loser_id"), F.col("status").alias("old"), F.col("valid_from").alias("since"))
    rows = winners.join(loser, "loser_id", "left")
    why = (F.when(F.col("old").isNull(), "gone").when(F.col("since") >= F.col("observed_at"), "not_later")
           .when(~temporal.may_become(F.col("old"), F.lit("superseded")), "illegal").otherwise("superseded"))
    rows = rows.withColumn("outcome", why)
    version = lambda i, status, until, by: F.struct(i.alias("id"), F.lit(status).alias("status"), until.alias("valid_until"), by.alias("superseded_by"))
    none = F.lit(None)
    both = F.array(version(F.col("id"), "active", none.cast("timestamp_ntz"), none.cast("long")), version(F.col("loser_id"), "superseded", F.col("observed_at"), F.col("id")))
    kept = rows.where("outcome = 'superseded'").select(F.explode(both).alias("v"), "outcome").select("v.*", "outcome")
    return kept.unionByName(rows.where("outcome <> 'superseded'").select("id", F.lit(None).cast("string").alias("status"), none.cast("timestamp_ntz").alias("valid_until"), F.col("loser_id").alias("superseded_by"), "outcome"))


def revised(memories: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates (id, revision, content) against the rows' own revision: 'updated', 'conflict' or 'gone'."""
    rows = updates.join(memories.select("id", F.col("revision").alias("current")), "id", "left")
    return rows.withColumn("outcome", F.when(F.col("current").isNull(), "gone").when(F.col("current") != F.col("revision"), "conflict").otherwise("updated"))


def served_changes(memories: DataFrame, asked: DataFrame) -> DataFrame:
    """What a call (id, call: forget, restore or purge) does to a memory: its new status, null once purged, and
    whether it is done. Forgetting archives, restoring makes an archived one active, purging needs an archived
    one."""
    rows = asked.join(memories.select("id", "status"), "id", "left")
    new = F.when(F.col("call") == "forget", "archived").when(F.col("call") == "restore", "active")
    done = (F.when(F.col("status").isNull(), False).when(F.col("call") == "purge", F.col("status") == "archived")
            .when(F.col("call") == "restore", F.col("status") == "archived").otherwise(temporal.may_become(F.col("status"), new)))
    return rows.select("id", "call", done.alias("done"), F.when(done, new).otherwise(F.col("status")).alias("new_status"))


def sessions(upserts: DataFrame) -> DataFrame:
    """Sessions from upserts (id, seq, started_at, ended_at, summary): the first start, the last end and summary that
    aren't null."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c))).getField(c).alias(c)
    return upserts.groupBy("id").agg(F.min_by("started_at", "seq").alias("started_at"), last("ended_at"), last("summary"))


def session_end(working: DataFrame, memories: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A session-end pass over scratch rows of ended sessions: (promoted, counts, kept).

    Eligible rows become episodic memories or are linked to the copy there is; counts are by outcome or by the
    reason of a row left out; kept are the rows that the sweep of expired ones leaves.
    """
    decided = lifecycle.promotion(working)
    new = decided.where("decision = 'eligible'").select(
        "id", "project_id", F.lit(None).cast("string").alias("user_id"), F.lit("episodic").alias("type"), text.content_hash(F.col("content")).alias("content_hash"), "content",
        F.lit("active").alias("status"), F.col("created_at").alias("observed_at"))
    promoted, _ = inserted(new, memories)
    outcome = decided.join(promoted.select("id", "outcome", "stands"), "id", "left").withColumn("outcome", F.coalesce("outcome", "decision"))
    counts = outcome.groupBy("outcome").agg(F.count("*").alias("n"))
    marked = outcome.withColumn("promoted_memory_id", F.coalesce("stands", "promoted_memory_id"))
    return promoted, counts, marked.where(F.col("promoted_memory_id").isNotNull() | (F.col("expires_at") > now)).drop("decision", "outcome", "stands")


def recurrence_pool(failures: DataFrame, memories: DataFrame, sources: DataFrame, now: Column, limit: int) -> DataFrame:
    """Failures of current memories with their sources, by signature, last seen and id."""
    rows = failures.join(memories.where(temporal.is_current(now)).select("id", "source_id", "project_id"), "id").join(sources.select("source_id", "kind"), "source_id")
    return rows.orderBy("signature", "last_seen_at", "id").limit(limit)


def current_digests(memories: DataFrame, subtype: str, tag: str) -> DataFrame:
    """Digest memories of a kind that are in force: live, without an end, and tagged."""
    return memories.where(F.col("status").isin(*LIVE) & F.col("valid_until").isNull() & (F.col("subtype") == subtype) & F.array_contains("tags", tag))


def digest_merged(digest: Column, owned: Column, prefix: str) -> Column:
    """A digest map with the keys of one owner's namespace replaced by that owner's new ones."""
    return F.map_concat(F.map_filter(digest, lambda k, _: ~F.startswith(k, F.lit(prefix))), F.map_filter(owned, lambda k, _: F.startswith(k, F.lit(prefix))))


def digest_rewrite(current: DataFrame, built: DataFrame) -> DataFrame:
    """What becomes of built digests (project_id, content_hash): 'unchanged', 'supersedes' the one in force, 'first'."""
    rows = built.join(current.select("project_id", F.col("content_hash").alias("old"), F.col("id").alias("old_id")), "project_id", "left")
    return rows.select("project_id", "content_hash", "old_id", F.when(F.col("old").isNull(), "first").when(F.col("old") == F.col("content_hash"), "unchanged").otherwise("supersedes").alias("outcome"))


def event_digests(events: DataFrame, anchored: DataFrame, most: int = 400) -> DataFrame:
    """Digests that outlive compacted events (id, kind, line, payload): a bounded line, the payload's bytes and the
    sources (event_id, source_id) whose evidence rests on the event."""
    plain = F.trim(F.regexp_replace("line", r"\s+", " "))
    short = F.when(F.char_length(plain) > most, F.concat(F.left(plain, F.lit(most - 1)), F.lit("…"))).otherwise(plain)
    sources = anchored.groupBy(F.col("event_id").alias("id")).agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    rows = events.join(sources, "id", "left")
    return rows.select("id", "kind", F.when(short == "", F.concat("kind", F.lit(" (empty payload)"))).otherwise(short).alias("summary"),
                       F.octet_length("payload").cast("long").alias("payload_bytes"), F.coalesce("source_ids", F.array().cast("array<long>")).alias("source_ids"))


def upserted_vectors(log: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Vectors in force from a log (id, seq, model, embedding; a null embedding removes), and rows that were refused
    for a wrong length or an entry that is no finite number."""
    bad = (F.size("embedding") != dim) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    refused = log.where(F.col("embedding").isNotNull() & bad)
    good = log.where(F.col("embedding").isNull() | ~bad)
    last = good.groupBy("id").agg(F.max_by(F.struct("model", "embedding"), "seq").alias("v")).select("id", "v.*")
    return last.where("embedding IS NOT NULL"), refused


def to_embed(memories: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Distinct contents that want a vector of a model (content_hash, content, copies, first): a content is embedded
    once, however many memories share it; ``reembedded`` gives it to each by the hash."""
    have = vectors.where(F.col("model") == model).select("id")
    return memories.join(have, "id", "left_anti").groupBy("content_hash").agg(F.min("content").alias("content"), F.count("*").alias("copies"), F.min("id").alias("first"))


class StaleJob(Exception):
    """A job is for another model or revision than the embedder's."""


def by_batches(embed: Callable[[list[str]], list[list[float]]], size: int = 32) -> Callable[[DataFrame], DataFrame]:
    """An embedder of lists of texts as a step over contents (content_hash, content), so many at a time."""

    def run(frames):
        for frame in frames:
            for k in range(0, len(frame), size):
                part = frame.iloc[k : k + size]
                got = embed([x or "" for x in part["content"]])
                if len(got) != len(part):
                    raise ValueError(f"the embedder gave {len(got)} vectors for {len(part)} texts")
                yield pd.DataFrame({"content_hash": part["content_hash"], "embedding": [[float(v) for v in x] for x in got]})

    return lambda contents: contents.select("content_hash", "content").mapInPandas(run, "content_hash string, embedding array<double>")


def reembedded(memories: DataFrame, vectors: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str, revision: str | None, dim: int, wanted: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors of a model and revision for memories that have none: (rows to write, refused).

    ``vectors`` are what there is (id, model, revision); ``embed`` turns distinct contents (content_hash, content)
    into (content_hash, embedding). A job that wants another model or revision is stale and writes nothing.
    Vectors of another size than ``dim``, or with entries that are no finite numbers, are refused with a reason.
    """
    wanted = wanted or {}
    for name, is_ in (("model", model), ("revision", revision)):
        if name in wanted and wanted[name] != is_:
            raise StaleJob(f"the job is for {name} {wanted[name]!r}, the embedder has {is_!r}")
    have = vectors.where((F.col("model") == model) & F.col("revision").eqNullSafe(F.lit(revision))).select("id")
    open_ = memories.join(have, "id", "left_anti").select("id", "content_hash", "content")
    contents = open_.groupBy("content_hash").agg(F.min("content").alias("content"))
    made = cut(embed(contents))
    bad = F.coalesce((F.size("embedding") != dim), F.lit(True))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = F.when(bad, "dimension").when(odd, "not finite").alias("reason")
    each = open_.select("id", "content_hash").join(made.select("content_hash", "embedding", reason), "content_hash")
    good = each.where("reason IS NULL").select("id", F.lit(model).alias("model"), F.lit(revision).cast("string").alias("revision"), "embedding")
    return good, each.where("reason IS NOT NULL").select("id", "content_hash", "reason")


def hashed_vector(content: Column, dim: int = 64) -> Column:
    """A vector of unit length from a text's words, each on the axis and with the sign of its hash: the same text
    has the same vector everywhere. A text without words is all 0."""
    words = F.filter(F.split(F.lower(content), "[^a-z0-9]+"), lambda x: x != "")
    hits = F.transform(words, lambda x: F.struct(F.pmod(F.xxhash64(x), F.lit(dim)).cast("int").alias("axis"), F.when(F.pmod(F.xxhash64(x, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))

    def unit(found):
        raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.aggregate(F.filter(found, lambda h: h["axis"] == k), F.lit(0.0), lambda s, h: s + h["sign"]))
        return text.once(raw, lambda v: text.once(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))

    return text.once(hits, unit)


def audit_of(log: DataFrame, limit: int) -> DataFrame:
    """The newest audit rows of each memory, with their positions."""
    order = Window.partitionBy("memory_id").orderBy(F.col("at").desc(), F.col("seq").desc())
    return log.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def ordered_id(at: Column, key: Column) -> Column:
    """A version 7 identifier: milliseconds of a moment, then bits of a key's hash. Order by text is order by time."""
    millis = F.lpad(F.lower(F.hex(F.unix_millis(at.cast("timestamp")))), 12, "0")
    tail = F.sha2(key.cast("string"), 256)
    return F.concat_ws("-", F.substring(millis, 1, 8), F.substring(millis, 9, 4), F.concat(F.lit("7"), F.substring(tail, 1, 3)), F.concat(F.lit("8"), F.substring(tail, 4, 3)), F.substring(tail, 7, 12))

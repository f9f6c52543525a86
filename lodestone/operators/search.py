"""Search from a request to packed results: understanding and policy on the driver, one plan for the candidates.

Channels (words, vectors, graph, working memory) are DataFrames of at most some dozens of rows each; they are
merged by id, checked against the request's time and scope once more, rid of copies, scored and packed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import INTENTS, LIVE, STATUSES, STOPWORDS
from ..functions import extraction, scoring, scopes, temporal, text
from . import graph, memory, packing, postings, similarity, vector_index
from .mutations import ACCESS
from .versions import Versioned

# How much each channel may bring.
LEXICAL, VECTORS, LEAST_COSINE = 50, 50, 0.05
MOST_REFS, RERANKED = 5, 50
PER_ENTITY, ENTITIES, EXPANSION, SEEDS, SHORTCUTS, SHORTCUT_BOOST = 30, 60, 40, 5, 10, 0.9
MATCHES = 8  #: entities of a question


@dataclass
class Request:
    query: str
    now: datetime
    project_id: str | None = None
    user_id: str | None = None
    session_id: str | None = None
    entities: tuple[str, ...] = ()
    types: tuple[str, ...] | None = None
    as_of: datetime | None = None
    mode: str = "current"
    include: tuple[str, ...] = ()
    max_tokens: int = 800
    max_memories: int = 10
    warnings: list[str] = field(default_factory=list)


@dataclass
class Sources:
    """Tables that are searched; those that are None bring nothing. With an index of the vectors or postings of the
    contents, their channel reads that in the place of the table."""

    memories: DataFrame
    vectors: DataFrame | None = None
    edges: DataFrame | None = None
    bound: DataFrame | None = None
    entities: DataFrame | None = None
    working: DataFrame | None = None
    decisions: DataFrame | None = None
    failures: DataFrame | None = None
    index: vector_index.Index | None = None
    postings: postings.Postings | None = None
    refs: DataFrame | None = None  #: code references: id, repository, path, commit, blob
    symbols: DataFrame | None = None  #: repository, path, name, line_start
    projects: DataFrame | None = None  #: project_id, name, description, digest (a map)


def intent_of(query: str) -> str:
    """``text.intent`` of one question."""
    hits = {name: sum(bool(re.search(r"(?i)\b" + r"\s+".join(map(re.escape, p.split())) + r"\b", query)) for p in phrases) for name, phrases in INTENTS.items()}
    best = max(hits, key=lambda k: hits[k])
    return best if hits[best] else "fact"


def keywords_of(query: str, limit: int = 32) -> list[str]:
    return list(dict.fromkeys(x for x in re.split(r"[^a-z0-9.]+", query.lower()) if x and x not in STOPWORDS))[:limit]


def entities_in(texts: DataFrame, registry: DataFrame, most: int = MATCHES) -> DataFrame:
    """Entities (entity_id, name, aliases) that texts (id, text) name in whole words: id, entity_id, form, place.

    A form of several tokens is found by its first one: a text's tokens are looked up among those, and only
    what meets there is tested. Of each entity the longest form counts; the ``most`` longest of a text are kept.
    """
    form = F.explode(F.array_distinct(F.filter(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.trim(x) != ""))).alias("form")
    forms = registry.select("entity_id", "name", form).withColumn("token", F.regexp_extract(F.lower("form"), r"[\p{L}\p{N}_]+", 0))
    tokens = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1))).alias("token")
    met = texts.select("id", "text", tokens).join(forms, "token")
    whole = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])\Q"), F.col("form"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    best = met.where(F.rlike("text", whole)).groupBy("id", "entity_id", "name").agg(F.max_by("form", F.struct(F.char_length("form"), "form")).alias("form"))
    order = Window.partitionBy("id").orderBy(F.char_length("form").desc(), "name", "entity_id")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("id", "entity_id", "form", "place")


def resolved_names(names: DataFrame, registry: DataFrame) -> DataFrame:
    """The entity of each name (name): by normal name first, else by an alias; null for none, the least id of several."""
    wanted = names.select("name", text.normal_form(F.col("name")).alias("normal")).distinct()
    by_name = registry.groupBy(text.normal_form(F.col("name")).alias("normal")).agg(F.min("entity_id").alias("own"))
    alias = registry.select("entity_id", F.explode("aliases").alias("alias")).groupBy(text.normal_form(F.col("alias")).alias("normal")).agg(F.min("entity_id").alias("other"))
    return wanted.join(by_name, "normal", "left").join(alias, "normal", "left").select("name", F.coalesce("own", "other").alias("entity_id"))


def policy(request: Request, intent: str, scope: dict | None) -> dict:
    """Which rows a request may see: statuses, and a moment ('at') or a range ('from', 'until').

    A moment of its own comes first, then history (asked for, or by the question's intent), else now.
    """
    history = tuple(s for s in STATUSES if s != "disputed" or s in request.include)
    if request.as_of is not None:
        return {"statuses": history, "at": request.as_of}
    if request.mode == "historical" or intent == "history":
        bounds = {k: (scope or {}).get(k) for k in ("from", "until")}
        return {"statuses": history, **(bounds if any(bounds.values()) else {"from": None, "until": request.now})}
    return {"statuses": tuple(dict.fromkeys((*LIVE, *request.include))), "at": request.now}


def admitted(allowed: dict) -> Column:
    """A policy as a predicate, which reaches the scan of each channel."""
    moment = lambda x: F.lit(x).cast("timestamp_ntz")
    holds = F.col("status").isin(*allowed["statuses"])
    if "at" in allowed:
        return holds & temporal.window_holds(moment(allowed["at"]))
    if allowed["until"] is not None:
        holds &= F.col("valid_from") < moment(allowed["until"])
    if allowed["from"] is not None:
        holds &= F.col("valid_until").isNull() | (F.col("valid_until") > moment(allowed["from"]))
    return holds


def planned(request: Request, allowed: dict, required: list[int], sources: Sources) -> DataFrame:
    """Memories that a request may return: time, status, scope, types and all of the required entities."""
    rows = sources.memories.where(admitted(allowed))
    if request.project_id is not None:
        rows = rows.where(temporal.in_scope(request.project_id, request.user_id))
    if request.types is not None:
        rows = rows.where(F.col("type").isin(*request.types))
    for entity in required:
        rows = rows.join(sources.bound.where(F.col("entity_id") == entity).select("id"), "id", "left_semi")
    return rows


def reached(edges: DataFrame, seeds: DataFrame, at: Column, hops: int = 2, cap: int = EXPANSION) -> DataFrame:
    """The first ``cap`` nodes that a search along edges, breadth first, meets from seeds (id, pos): id, hop.

    Seeds go in order, and the edges of a node in theirs; only edges valid at the moment count, either way.
    """
    both = graph.both_ways(edges, at)
    seen, front, found = seeds.select("id"), seeds.select(F.col("id").alias("src"), "pos"), None
    for hop in range(1, hops + 1):
        met = both.join(front, "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("pos", F.col("id").alias("edge"))).alias("first"))
        met = met.join(seen.select(F.col("id").alias("node")), "node", "left_anti").orderBy("first", "node").limit(cap)
        met = met.withColumn("pos", F.row_number().over(Window.orderBy("first", "node")))
        rows = met.select(F.col("node").alias("id"), F.lit(hop).alias("hop"), "pos")
        found = rows if found is None else found.union(rows)
        seen, front = seen.union(rows.select("id")), met.select(F.col("node").alias("src"), "pos")
    return found.orderBy("hop", "pos").limit(cap).select("id", "hop")


def graph_channel(sources: Sources, allowed: DataFrame, request: Request, intent: str, matched: list[int], lexical: DataFrame, vector: DataFrame | None, at: Column) -> DataFrame:
    """Memories bound to the question's entities, those near them and near the best of other channels along
    edges, and for two intents the latest decisions or the most frequent failures: id, graph_boost.

    The greatest boost of a memory counts; it is 1 for a bound one, 0.8 a hop, and 0.9 for a shortcut.
    """
    parts = []
    heads = [lexical.where(F.col("lexical_rank") <= SEEDS).select("id", (F.col("lexical_rank") + ENTITIES).alias("pos"))]
    if vector is not None:
        heads.append(vector.where(F.col("vector_rank") <= SEEDS).select("id", (F.col("vector_rank") + ENTITIES + SEEDS).alias("pos")))
    if sources.bound is not None and matched:
        own = graph.interleaved(sources.bound, allowed.select("id", "observed_at"), matched, PER_ENTITY, ENTITIES).select("id", F.col("rank").alias("pos"))
        parts.append(own.select("id", F.lit(1.0).alias("graph_boost")))
        heads.insert(0, own)
    if sources.edges is not None:
        seeds = reduce(DataFrame.unionByName, heads).groupBy("id").agg(F.min("pos").alias("pos"))
        near = reached(sources.edges, seeds, at)
        parts.append(near.select("id", F.pow(F.lit(0.8), F.col("hop")).alias("graph_boost")))
    shortcut = {"decision": sources.decisions, "failure": sources.failures}.get(intent)
    if shortcut is not None:
        order = [F.col("decided_at").desc()] if intent == "decision" else [F.col("occurrences").desc(), F.col("last_seen_at").desc()]
        rows = shortcut.where("status = 'accepted'") if intent == "decision" else shortcut
        parts.append(rows.drop("status").join(allowed.select("id"), "id").orderBy(*order, F.col("id").desc()).limit(SHORTCUTS).select("id", F.lit(SHORTCUT_BOOST).alias("graph_boost")))
    if not parts:
        return allowed.limit(0).select("id", F.lit(0.0).alias("graph_boost"))
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.max("graph_boost").alias("graph_boost"))


def without_copies(rows: DataFrame, near: float | None = None) -> DataFrame:
    """One candidate of each content hash, by authority; it takes the best ranks and boost of its copies. With
    ``near``, candidates (embedding, entity, type) as near to one that is kept go as well."""
    key = F.struct(memory.authority(F.col("source_kind"), F.col("type")).alias("rank"), "confidence", "observed_at", (-F.col("id")).alias("minus"))
    by = Window.partitionBy("content_hash")
    best = {c: F.min(c).over(by).alias(c) for c in ("lexical_rank", "vector_rank")} | {"graph_boost": F.max("graph_boost").over(by).alias("graph_boost")}
    kept = rows.select(*(best.get(c, F.col(c)) for c in rows.columns), (key == F.max(key).over(by)).alias("__kept")).where("__kept").drop("__kept")
    if near is not None:
        few = kept.select("id", "entity", "type", memory.authority(F.col("source_kind"), F.col("type")).alias("authority"), "confidence", "observed_at", "embedding")
        kept = kept.join(similarity.collapsed_near(few, ["entity", "type"], near), "id", "left_semi")
    return kept


def indexed(index: vector_index.Index, query_vector: DataFrame) -> DataFrame:
    """The vectors nearest a question, exactly, from the cells that can hold them."""
    one = query_vector.limit(1).select(F.lit(0).cast("long").alias("id"), "embedding")
    return vector_index.nearest(index, one, VECTORS, exact=True, least=LEAST_COSINE)


def ranked(request: Request, sources: Sources, query_vector: DataFrame | None = None, matched: list[int] = (), required: list[int] = (), near: float | None = None) -> DataFrame:
    """Candidates of a request with score, relevance and explain, best first.

    ``query_vector`` is a row with the question's embedding (none, or one of length 0: no vector channel).
    ``matched`` are the entities that the question names, ``required`` those that each result must have.
    """
    intent = intent_of(request.query)
    scope = scopes.time_scope(request.query, request.now)
    may = policy(request, intent, scope)
    allowed = planned(request, may, list(required), sources)
    now = F.lit(request.now).cast("timestamp_ntz")
    words = keywords_of(request.query) or [request.query]
    hits = memory.lexical(allowed, words, LEXICAL) if sources.postings is None else postings.lexical(sources.postings, allowed, words, LEXICAL)
    lexical = hits.select("id", "lexical_rank")
    vector = None
    if query_vector is not None and (sources.vectors is not None or sources.index is not None):
        nearest = indexed(sources.index, query_vector) if sources.index is not None else memory.nearest(sources.vectors, query_vector, VECTORS, LEAST_COSINE)
        nearest = nearest.select("id", F.col("vector_rank").alias("r"))
        vector = nearest.join(allowed.select("id"), "id", "left_semi").select("id", F.row_number().over(Window.orderBy("r")).alias("vector_rank"))
    at = F.lit(may["at"] if "at" in may else may["until"] or request.now).cast("timestamp_ntz")
    near_by = graph_channel(sources, allowed, request, intent, list(matched), lexical, vector, at)
    merged = memory.merged_channels(lexical, near_by, *([vector] if vector is not None else []))
    rows = merged.join(allowed, "id").withColumn("matched", F.lit(0.0))
    if sources.bound is not None and matched:
        share = sources.bound.where(F.col("entity_id").isin(*matched)).groupBy("id").agg((F.count("*") / len(matched)).alias("matched"))
        rows = rows.drop("matched").join(share, "id", "left").withColumn("matched", F.coalesce("matched", F.lit(0.0)))
    if near is not None:
        first = sources.bound.groupBy("id").agg(F.min("entity_id").alias("entity"))
        rows = rows.join(first, "id", "left").join(sources.vectors.select("id", "embedding"), "id", "left")
    rows = without_copies(rows, near)
    factors = scoring.contributions(now, intent, request.project_id, lexical=F.col("lexical_rank"), vector=F.col("vector_rank") if vector is not None else None, graph=F.col("graph_boost"), entity=F.col("matched"))
    out = memory.scored(rows, factors, scoring.active_mass(intent, lexical=True, vector=vector is not None))
    note = F.lit("currently valid" if may.get("at") == request.now else "valid at the moment asked for" if "at" in may else "valid within the range asked for")
    return out.withColumn("temporal_note", note).orderBy(F.col("score").desc(), "id")


def working_candidates(sources: Sources, request: Request) -> DataFrame | None:
    """A session's scratch rows that have neither expired nor been promoted."""
    if sources.working is None or request.session_id is None or request.entities or (request.types is not None and "working" not in request.types):
        return None
    live = (F.col("session_id") == request.session_id) & F.col("promoted_memory_id").isNull() & (F.col("expires_at") > F.lit(request.now).cast("timestamp_ntz"))
    return sources.working.where(live)


def referenced(rows: DataFrame, refs: DataFrame, symbols: DataFrame | None, most: int = MOST_REFS) -> DataFrame:
    """Code references of each row (id, content): id, code_refs, by repository and path.

    A reference has the first symbol of its file, by line and name, that the content names as a whole word. Beyond
    ``most`` there is one more entry that counts the rest. References are cut to so many before contents are
    joined, and each name is looked for once in a content, however many of its files have it or however often one has
    it: a file's names are told apart before they go to its references.
    """
    order, none = Window.partitionBy("id").orderBy("repository", "path"), F.lit(None).cast("string")
    mine = refs.join(rows.select("id"), "id", "left_semi")
    mine = mine.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("id"))).where(F.col("k") <= most + 1)
    real = F.col("k") <= most
    if symbols is None:
        mine = mine.withColumn("names", F.array().cast("array<string>"))
    else:
        files = mine.where(real).select("repository", "path").distinct()
        first = symbols.join(files, ["repository", "path"], "left_semi").groupBy("repository", "path", "name").agg(F.min("line_start").alias("line_start"))
        named = first.groupBy("repository", "path").agg(F.array_sort(F.collect_list(F.struct("line_start", "name"))).alias("named"))
        mine = mine.join(named, ["repository", "path"], "left").withColumn("names", F.when(real, F.transform("named", lambda x: x["name"])))
    more = F.concat(F.lit("<"), (F.col("n") - most).cast("string"), F.lit(" more refs>"))
    entry = F.struct(
        F.col("k").alias("k"), F.col("repository").alias("repository"), F.when(real, F.col("commit")).otherwise("").alias("commit"), F.when(real, F.col("path")).otherwise(more).alias("path"),
        F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.when(real, F.col("blob")).otherwise(none).alias("evidence"))
    each = mine.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("entries")).join(rows.select("id", "content"), "id")
    whole = lambda n: F.contains("content", n) & extraction.names_in(F.col("content"), n)
    found = F.filter(F.array_distinct(F.flatten(F.transform("entries", lambda x: x["names"]))), whole)

    def shaped(there):  # what is found is computed once for all entries
        told = lambda x: F.get(F.filter(x["names"], lambda n: F.array_contains(there, n)), F.lit(0))
        return F.transform("entries", lambda x: F.struct(x["repository"].alias("repository"), x["commit"].alias("commit"), x["path"].alias("path"), told(x).alias("symbol"), x["evidence"].alias("evidence")))

    return each.select("id", text.once(found, shaped).alias("code_refs"))


def attached(rows: DataFrame, sources: Sources, most: int = MOST_REFS) -> DataFrame:
    """Candidates with code_refs and conflicts (ids and what they mean); both are empty arrays where there are none."""
    if sources.refs is not None:
        rows = rows.join(referenced(rows, sources.refs, sources.symbols, most), "id", "left")
        rows = rows.withColumn("code_refs", F.coalesce("code_refs", F.array().cast(rows.schema["code_refs"].dataType)))
    if sources.edges is not None and "relation" in sources.edges.columns:
        disputed = conflict_labels(rows.where("status = 'disputed'").select("id"), sources.edges)
        told = F.lit("contradicts this memory"), F.lit("disputed; nothing that contradicts it is linked")
        note = lambda i, n: F.struct(i.alias("memory_id"), n.alias("note"))
        named = F.when(F.size("conflicts") > 0, F.transform("conflicts", lambda x: note(x, told[0]))).otherwise(F.array(note(F.col("id").cast("long"), told[1])))
        rows = rows.join(disputed.select("id", named.alias("conflicts")), "id", "left")
        rows = rows.withColumn("conflicts", F.coalesce("conflicts", F.array().cast(rows.schema["conflicts"].dataType)))
    return rows


def project_digest(request: Request, sources: Sources, intent: str) -> dict | None:
    """The digest of the request's project, for questions about context."""
    if intent != "context" or request.project_id is None or sources.projects is None:
        return None
    found = sources.projects.where(F.col("project_id") == request.project_id).limit(1).collect()
    if not found:
        return None
    if not found[0]["digest"]:
        request.warnings.append("the project's digest is not built yet")
    return {"name": found[0]["name"], "description": found[0]["description"], "digest": found[0]["digest"] or {}}


def reordered(found: list[dict], request: Request, rerank: Callable[[str, list[str]], list[float]], most: int = RERANKED) -> list[dict]:
    """The first ``most`` results by a reranker's scores, the rest as they were. One that fails changes nothing."""
    try:
        scores = rerank(request.query, [x["content"] for x in found[:most]])
        order = sorted(range(len(scores)), key=lambda k: (-scores[k], k))
        return [found[k] for k in order] + found[len(scores) :]
    except Exception as e:  # the order that there is stands
        request.warnings.append(f"rerank failed: {e}; the fused order is kept")
        return found


def search(request: Request, sources: Sources, query_vector: DataFrame | None = None, rerank: Callable[[str, list[str]], list[float]] | None = None, accessed: Versioned | None = None) -> dict:
    """The packed response of one request. Rows that reach the driver are a request's candidates, which the
    channels' limits bound (some two hundred). ``accessed`` is the table of memories whose log gets a row for each
    one returned; a log that can't be written is a warning."""
    spark = sources.memories.sparkSession
    matched, required = [], []
    if sources.entities is not None:
        asked = spark.createDataFrame([(0, request.query)], "id long, text string")
        matched = [r.entity_id for r in entities_in(asked, sources.entities).orderBy("place").collect()]
        if request.entities:
            names = resolved_names(spark.createDataFrame([(x,) for x in request.entities], "name string"), sources.entities).collect()
            required = [r.entity_id for r in names if r.entity_id is not None]
            request.warnings += [f"entity '{r.name}' is not known: nothing can match" for r in names if r.entity_id is None]
    intent, scope = intent_of(request.query), scopes.time_scope(request.query, request.now)
    head = {"intent": intent, "keywords": keywords_of(request.query), "entities": matched, "time_scope": scope, "warnings": request.warnings}
    digest = project_digest(request, sources, intent)
    if digest is not None:
        head["project_digest"] = digest
    if len(required) < len(set(request.entities)):
        return head | {"memories": [], "used": 0, "budget": request.max_tokens}
    rows = attached(ranked(request, sources, query_vector, matched, required), sources)
    parts = ("valid_from", "valid_until", "source_kind", "code_refs", "conflicts")
    shown = rows.orderBy(F.col("score").desc(), "id").select(
        "id", "type", "status", "content", "score", "relevance", "explain", "temporal_note", scopes.label(F.col("content")).alias("title"), scopes.summary(F.col("content")).alias("summary"), *(c for c in parts if c in rows.columns))
    found = [r.asDict(recursive=True) for r in shown.collect()]
    if rerank is not None:
        found = reordered(found, request, rerank)
    working = working_candidates(sources, request)
    if working is not None:
        found += [{"id": f"w{r.id}", "type": "working", "status": "active", "content": r.content, "title": r.content[:60], "summary": r.content[:160], "score": 0.0, "relevance": 0.0, "explain": [], "temporal_note": "of this session"} for r in working.orderBy("id").limit(LEXICAL).collect()]
    packed, used = packing.pack(found, request.max_tokens, request.max_memories)
    if len(packed) < len(found):
        request.warnings.append(f"{len(found) - len(packed)} matches did not fit")
    durable = [x["id"] for x in packed if x["type"] != "working"]
    if accessed is not None and durable:
        try:
            accessed.commit(logs={"access": spark.createDataFrame([(i, request.now) for i in durable], ACCESS)})
        except Exception as e:  # a search never fails for its log
            request.warnings.append(f"accesses were not logged: {e}")
    return head | {"memories": packed, "used": used, "budget": request.max_tokens}


def reinforced(log: DataFrame) -> DataFrame:
    """Access counts and last accesses from an append-only log of returned ids (id, at)."""
    return log.groupBy("id").agg(F.count("*").alias("accesses"), F.max("at").alias("last_accessed_at"))


def conflict_labels(disputed: DataFrame, edges: DataFrame) -> DataFrame:
    """For disputed memories (id) the ids at the other end of their 'contradicts' edges, in order; a memory without
    one is labelled by an empty list."""
    of = edges.where("relation = 'contradicts'")
    both = of.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(of.select("dst", "src"))
    ends = both.join(disputed.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("conflicts"))
    return disputed.select("id").join(ends, "id", "left").select("id", F.coalesce("conflicts", F.array().cast("array<long>")).alias("conflicts"))

"""Queries over stored indexes: vectors by cells, words by postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal
from ..operators import postings, search, vector_index
from ..sources import views
from .memory_queries import CURRENT
from .registry import oracle_of, query
from .search_queries import ASKED
from .views_sql import MEM


def _vectors(spark, d):
    return views.read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "embedding")


_EXACT = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  c AS (SELECT q.id AS query, v.id, round(list_cosine_similarity(q.e, v.e), 9) AS cosine FROM v q, v WHERE q.id % 50 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS vector_rank FROM c QUALIFY vector_rank <= 50)"""


@query("vector_index_exact", f"WITH {_EXACT} SELECT query, id, round(cosine, 6) AS cosine, CAST(vector_rank AS INT) AS vector_rank FROM r")
def vector_index_exact(spark, d):
    """The 50 rows nearest to every 50th vector: a few cells first, then those that the bounds leave."""
    vectors = _vectors(spark, d)
    found = vector_index.nearest(vector_index.build(vectors), vectors.where("id % 50 = 0"), 50, probes=4, exact=True)
    return found.withColumn("cosine", F.round("cosine", 6))


@query("vector_index_recall")
def vector_index_recall(spark, d):
    """Of the 50 rows nearest to every 50th vector, how many a search of some cells finds; how many cells are read
    is measured first, for 0.95 of the nearest of up to 100 other rows."""
    vectors = _vectors(spark, d)
    index, asked = vector_index.build(vectors), vectors.where("id % 50 = 0")
    probes = vector_index.probes_for(index, vectors.where("id % 50 <> 0"))
    true = vector_index.nearest(index, asked, 50, probes=len(index.centres)).select("query", "id")
    few = vector_index.nearest(index, asked, 50, probes=probes).select("query", "id", F.lit(1).alias("found"))
    rows = true.join(few, ["query", "id"], "left").groupBy("query").agg(F.count("*").alias("nearest"), F.count("found").alias("found"))
    return rows.select("query", "nearest", "found", (F.col("found") / F.col("nearest")).alias("recall"), F.lit(len(index.centres)).alias("cells"), F.lit(probes).alias("probes"))


#: Searches of one word, of frequent and rare words, of a term of two tokens and of none that occurs.
SEARCHES = (("one", ["thatin"]), ("some", ["ononst", "inoran", "die", "que"]), ("common", ["the", "of", "and"]), ("both", ["in.the", "that the", "of"]), ("none", ["zzzz qqqq"]))
_TOKENS = "toks AS (SELECT *, string_split_regex(lower(content), '[^a-z0-9.]+') AS toks FROM mem WHERE " + CURRENT + ")"


def _search_sql(name: str, terms: list[str]) -> str:
    parts = postings.split_terms(terms)
    tokens = sorted({t for p in parts for t in p})
    count = lambda t: f"len(list_filter(toks, lambda x: x = '{t}'))"
    rank = " + ".join(f"CASE WHEN {count(t)} > 0 THEN 0.1::DOUBLE * list_sum(list_transform(range(1, {count(t)} + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493406685::DOUBLE / {len(tokens)} ELSE 0 END" for t in tokens)
    matched = " OR ".join("(" + " AND ".join(f"list_contains(toks, '{t}')" for t in p) + ")" for p in parts)
    return f"SELECT '{name}' AS search, id, ts_rank, row_number() OVER (ORDER BY ts_rank DESC, observed_at DESC, id DESC) AS lexical_rank FROM (SELECT id, observed_at, round({rank}, 9) AS ts_rank FROM toks WHERE {matched}) QUALIFY lexical_rank <= 50"


@query("postings_search", f"WITH {MEM}, {_TOKENS} SELECT search, id, round(ts_rank, 6) AS ts_rank, CAST(lexical_rank AS INT) AS lexical_rank FROM (" + " UNION ALL ".join(f"({_search_sql(*x)})" for x in SEARCHES) + ")")
def postings_search(spark, d):
    """Some searches over the current memories, from stored postings of all memories."""
    memories = views.memories(spark, d)
    index = postings.build(memories)
    out = None
    for name, terms in SEARCHES:
        hits = postings.lexical(index, memories.where(temporal.is_current(temporal.at(views.NOW))), terms)
        rows = hits.select(F.lit(name).alias("search"), "id", F.round("ts_rank", 6).alias("ts_rank"), F.col("lexical_rank").cast("int").alias("lexical_rank"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("hybrid_search_indexed", oracle_of("hybrid_search"))
def hybrid_search_indexed(spark, d):
    """``hybrid_search`` with both indexes in the place of scans."""
    memories, vectors = views.memories(spark, d), _vectors(spark, d)
    sources = search.Sources(memories, vectors, views.edges(spark, d), views.memory_entities(spark, d), index=vector_index.build(vectors), postings=postings.build(memories))
    out = search.ranked(ASKED, sources, vectors.where("id = 0"), matched=[3])
    return out.select("id", "type", F.col("lexical_rank").cast("long").alias("lexical_rank"), F.col("vector_rank").cast("long").alias("vector_rank"), F.round("graph_boost", 6).alias("graph_boost"), F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"))

"""Stored postings for text search: terms by impact layers and segments, read from the highest layer down.

Documents are dealt to segments of about ``SEGMENT`` documents by a hash of their id. A row holds the documents of
one segment in which a term occurs a like number of times (a layer: once, 2 to 3, 4 to 7 times and so on), with
the counts and the greatest of them. A frequent term is thus many rows of bounded size. The table is partitioned by
a hash of the term, so a search reads the folders of its terms and nothing of the contents.

A search reads the highest layers of its terms, looks up the other counts of the documents met there in their
segments only, and stops once no document that wasn't met can reach the last rank: what a term adds grows with its
count, so the sum over the terms' unread layers bounds it. Lower layers are read only as far as that needs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring, text
from .lineage import cut, new_path

SEGMENT = 4096
FOLDERS = 64
_ROWS = "term string, layer int, segment long, most int, ids array<long>, counts array<int>, folder int"


@dataclass
class Postings:
    """``table`` is the Parquet folder of postings, ``terms`` one of (term, layer, documents, most, folder)."""

    spark: SparkSession
    table: str
    terms: str

    def of(self, terms: list[str]) -> DataFrame:
        """Rows of these terms; only their folders are read."""
        return self._named(self.spark.read.schema(_ROWS).parquet(self.table), terms)

    def layers(self, terms: list[str]) -> dict[tuple[str, int], tuple[int, int]]:
        """Documents and the greatest count of each layer of these terms."""
        rows = self._named(self.spark.read.parquet(self.terms), terms).select("term", "layer", "documents", "most").collect()
        return {(r["term"], r["layer"]): (r["documents"], r["most"]) for r in rows}

    def _named(self, df: DataFrame, terms: list[str]) -> DataFrame:
        folders = self.spark.createDataFrame([(t,) for t in terms], "term string").select(_folder()).distinct().collect()
        return df.where(F.col("folder").isin(*(r["folder"] for r in folders)) & F.col("term").isin(*terms))


def _folder() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int").alias("folder")


def build(documents: DataFrame, segment: int = SEGMENT) -> Postings:
    """Postings of the contents of ``documents`` (id, content). A null content has no terms; ids are distinct.

    Contents are shuffled once, by segment, to as many partitions as there are segments, so a task's memory doesn't
    grow with the table; counts and rows are formed within segments. A term's rows are as many as the segments it
    occurs in, so no term is one group.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("id").cast("long").alias("id"), "content")
    segments = max(1, -(-rows.count() // segment), spark.sparkContext.defaultParallelism)  # of few documents too, all tasks get some
    dealt = rows.withColumn("segment", F.pmod(F.xxhash64("id"), F.lit(segments))).repartition(segments, "segment")
    words = dealt.select("segment", "id", F.explode(text.tokens(F.col("content"))).alias("term"))
    counts = words.groupBy("segment", "id", "term").agg(F.count("*").cast("int").alias("n"))
    layer = F.floor(F.log2("n")).cast("int").alias("layer")
    of = F.array_sort(F.collect_list(F.struct("id", "n")))
    blocks = counts.groupBy("segment", "term", layer).agg(F.max("n").alias("most"), of.alias("of"))
    blocks = blocks.select("term", "layer", "segment", "most", F.col("of.id").alias("ids"), F.col("of.n").alias("counts"), _folder())
    table, terms = new_path(spark, "postings"), new_path(spark, "postings-terms")
    blocks.repartitionByRange("folder", "term", "layer", "segment").sortWithinPartitions("folder", "term", "layer", "segment").write.partitionBy("folder").parquet(table)
    stored = spark.read.schema(_ROWS).parquet(table)
    totals = stored.groupBy("folder", "term", "layer").agg(F.sum(F.size("ids")).alias("documents"), F.max("most").alias("most"))
    totals.repartition("folder").sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(terms)
    return Postings(spark, table, terms)


def split_terms(terms: list[str]) -> list[list[str]]:
    """Tokens of each search term."""
    return [p for t in terms if (p := re.findall("[a-z0-9.]+", t.lower()))]


def _ranks(parts: list[list[str]], tokens: list[str]) -> Column:
    """The rank of a row with a count for each token (n0, n1, ...): 0 where no term has all of its tokens."""
    n = {t: F.col(f"n{k}") for k, t in enumerate(tokens)}
    total = sum((scoring.ts_rank(n[t], len(tokens)) for t in tokens), F.lit(0.0))
    return F.round(F.when(reduce(or_, (reduce(and_, (n[t] > 0 for t in p)) for p in parts)), total).otherwise(0.0), 9)


def _bound(layers: dict, tokens: list[str], below: int) -> float:
    """What a document can reach at most that is in no layer from ``below`` on."""
    total = 0.0
    for t in tokens:
        most = max((m for (term, layer), (_, m) in layers.items() if term == t and layer < below), default=0)
        total += 0.1 * sum(1.0 / (j * j) for j in range(1, most + 1)) / 1.64493406685 / len(tokens)
    return total


def scored(index: Postings, parts: list[list[str]], tokens: list[str], layer: int) -> DataFrame:
    """Ranks (id, ts_rank) of all documents that have some token in a layer from ``layer`` on.

    Their other counts are read in their own segments only.
    """
    rows = index.of(tokens)
    if layer > 0:
        met = rows.where(F.col("layer") >= layer).select("segment", F.explode("ids").alias("id")).distinct()
        rows = rows.join(met.select("segment").distinct(), "segment", "left_semi")
    each = rows.select("term", F.explode(F.arrays_zip("ids", "counts")).alias("x")).select("term", F.col("x.ids").alias("id"), F.col("x.counts").alias("n"))
    if layer > 0:
        each = each.join(met.select("id"), "id", "left_semi")
    counts = (F.coalesce(F.max(F.when(F.col("term") == t, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, t in enumerate(tokens))
    return each.groupBy("id").agg(*counts).select("id", _ranks(parts, tokens).alias("ts_rank")).where("ts_rank > 0")


def lexical(index: Postings, memories: DataFrame, terms: list[str], limit: int = 50, first: int = 8) -> DataFrame:
    """What ``memory.lexical`` gives for ``memories`` (rows of the index that a search may see), from postings.

    Layers are taken down from the one with which about ``first`` times the limit documents are met, until the
    last of ``limit`` ranks beats all that an unmet document can reach. Equal ranks are ordered by the newest and
    the largest id, so a bound that is only reached goes on. Documents that aren't in ``memories`` don't count.
    """
    parts = split_terms(terms)
    tokens = sorted({t for p in parts for t in p})
    layers = index.layers(tokens) if tokens else {}
    order = [F.col("ts_rank").desc(), F.col("observed_at").desc(), F.col("id").desc()]
    top, layer = None, max((k for _, k in layers), default=-1)
    while layer > 0 and sum(n for (_, k), (n, _) in layers.items() if k >= layer) < first * limit:
        layer -= 1
    while layer >= 0 and top is None:
        seen = memories.select("id", "observed_at").join(scored(index, parts, tokens, layer), "id")
        best = cut(seen.orderBy(*order).limit(limit))
        found = best.agg(F.count("*"), F.min("ts_rank")).first()
        if layer == 0 or found[0] == limit and found[1] > _bound(layers, tokens, layer) + 1e-9:
            top = best
        layer -= 1
    if top is None:
        return memories.limit(0).withColumn("ts_rank", F.lit(0.0)).withColumn("lexical_rank", F.lit(0))
    ranked = top.select("id", "ts_rank", F.row_number().over(Window.orderBy(*order)).alias("lexical_rank"))
    return memories.join(ranked, "id")

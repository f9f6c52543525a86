"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the documents it keeps.

The stages but the last return the columns of documents; the last one returns pieces. Every stage works on all
rows that it is given. Rows are told apart by keys of their own where a doc_id is null or repeated, so such rows
are judged like any others: the operators see a unique doc_id, and decisions are by it. An empty table passes
through as one, and columns of any other names are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokenizers_at
from .decontaminate import find_leaks
from .gam import quality_scores
from .lines import dedup_lines
from .minhash import near_duplicates
from .pieces import encoded
from .tables import written


class Keyed:
    """``rows``: documents under a doc_id that is unique and not null, other columns under plain names.

    A doc_id that one row has stays; rows without one, or that share one, get keys after all others, in any
    order. Only such rows are written again. ``back`` gives the columns of the documents again.
    """

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.names = {c: "text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)}
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).alias(n) for c, n in self.names.items()))
        odd = written(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("odd")), "odd")
        if odd.isEmpty():
            self.rows = rows
            return
        ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
        low, high = ends["low"] or 0, ends["high"] or 0
        if high >= 1 << 62 and low <= -(1 << 62):
            raise ValueError("doc_ids leave no room for keys")
        place = F.lit(high + 1) + F.monotonically_increasing_id() if high < 1 << 62 else F.lit(low - 1) - F.monotonically_increasing_id()
        moved = rows.join(odd, rows["doc_id"].eqNullSafe(odd["odd"]), "left_semi").withColumn("doc_id", place)
        plain = rows.where("doc_id IS NOT NULL").join(odd, rows["doc_id"] == odd["odd"], "left_anti")
        self.rows = plain.unionByName(written(moved, "keyed"))

    def back(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(n).alias(c) for c, n in self.names.items()))

    def without(self, gone: DataFrame) -> DataFrame:
        return self.back(self.rows.join(gone.select("doc_id").distinct(), "doc_id", "left_anti"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    names = {c: c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_scores(docs.select(*(F.col(c).alias(n) for c, n in names.items())), labels, threshold=0.7)
    return scored.where("predicted = 1").select(*(F.col(n).alias(c) for c, n in names.items()))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks of earlier ones; those of which nothing is left go."""
    keyed = Keyed(docs)
    left = keyed.back(dedup_lines(keyed.rows).where("n_removed = 0 OR trim(text) <> ''"))
    return left.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else left


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), that with the smallest doc_id."""
    keyed = Keyed(docs)
    return keyed.without(near_duplicates(keyed.rows, shingle=5, percent=80).where("NOT kept"))


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = Keyed(docs)
    return keyed.without(find_leaks(keyed.rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document, its next best segmentations, and whether the best decodes to it."""
    return encoded(docs, tokenizers_at("piece_bpe_32k.model"), n=3)

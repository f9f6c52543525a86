"""A corpus pipeline of five stages over ``documents``: quality, lines, near copies, benchmark leaks, pieces.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, in the columns of documents; the
last one returns their pieces. Each works on all that the one before it kept, and reads the tables beside
the documents (labels, benchmark) from ``sf_dir``. The stages are in ``lodestone.llm.stages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import stages
from lodestone.llm.tables import written

STAGES = [
    ("quality", stages.good),
    ("lines", stages.unrepeated_lines),
    ("near duplicates", stages.distinct_documents),
    ("decontamination", stages.unleaked),
    ("pieces", stages.in_pieces),
]

#: Boosted trees, patience diff, MinHash, a singular value decomposition and A* search are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each stage's documents as a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs

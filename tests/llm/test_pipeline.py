from __future__ import annotations

import hashlib
import random

import __spark_entry__
import corpus_pipeline
from lodestone.llm import queries, stages


def test_pipeline_keeps_clean_documents_once(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf)
        assert left.columns == docs.columns
        left = left.cache()
        seen[name] = {r.doc_id for r in left.select("doc_id").collect()}
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = ids - seen["quality"]
    assert all(labels.get(k, 0) == 0 for k in gone) and gone
    order = list(seen.values())
    assert all(b <= a for a, b in zip(order, order[1:], strict=False))
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.collect()} == order[-1]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, kept boolean, n_removed long, doc string, c1 string, row string, `comp` string"


def table(spark, rows):
    more = ("en", "s", 1, 0.5, 0, True, 3, "x", "y", "z", "w")
    return spark.createDataFrame([(*r, *more) for r in rows], CLASHING).repartition(3)


def words(seed, n=60):
    return " ".join(f"{random.Random(seed * 1000 + k).choice('abcdefgh')}{random.Random(seed * 977 + k).randrange(500)}" for k in range(n))


def kept(stage, spark, rows):
    """What a stage keeps, by doc_id and text, and the columns of the table it was given."""
    docs = table(spark, rows)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
    got = out.collect()
    assert all((r.predicted, r.kept, r.n_removed, r.doc, r.row) == (0, True, 3, "x", "z") for r in got)
    return sorted(((r.doc_id, r.text) for r in got), key=repr)


def test_near_copies_with_null_and_repeated_ids(spark):
    long = words(1, 30_000)
    rows = [(None, words(7)), (None, words(7)), (4, words(7)), (5, words(8)), (5, words(8)), (5, words(9)), (6, None), (None, None), (7, ""), (8, long), (None, long + " more"), (9, "one"), (9, "one")]
    got = kept(stages.distinct_documents, spark, rows)
    assert got == sorted([(4, words(7)), (5, words(8)), (5, words(9)), (6, None), (None, None), (7, ""), (8, long), (9, "one")], key=repr)


def test_leaks_with_null_and_repeated_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean, leak = words(3), f"{words(4)} {item} {words(5)}"
    rows = [(None, leak), (None, clean), (1, clean), (1, leak), (1, leak), (2, None), (3, ""), (4, item.upper())]
    assert kept(stages.unleaked, spark, rows) == sorted([(None, clean), (1, clean), (2, None), (3, "")], key=repr)


def test_lines_with_null_and_repeated_ids(spark):
    shared = "this is a line of text that documents share"
    rows = [(3, f"{shared}\nown line of the third document"), (None, f"{shared}\nown line of no document id"), (None, shared), (5, shared), (5, f"a second row of the same id\n{shared}"), (6, None), (7, "")]
    got = kept(stages.unrepeated_lines, spark, rows)
    assert got == sorted([(3, rows[0][1]), (None, "own line of no document id"), (5, "a second row of the same id"), (6, None), (7, "")], key=repr)


def test_quality_and_pieces_with_null_and_repeated_ids(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows = [*docs, *((None, t) for _, t in docs), *docs[:5], (None, None), (-1, "")]
    got = kept(stages.good, spark, rows)
    assert {t for k, t in got if k is None and t} == {t for k, t in got if k is not None and k >= 0} and len(got) > 60
    out = stages.in_pieces(spark, table(spark, rows), SF)
    assert sorted((r.doc_id is None, r.decoded_sha256) for r in out.collect()) == sorted((k is None, hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)
    assert "ids" in out.columns


def test_every_operator_has_a_query():
    names = {n.split("_")[0] for n in queries.queries()}
    assert names == {f"op{k}" for k in range(1, 14)}
    assert set(queries.queries()) | {"pipeline"} <= set(__spark_entry__.queries())

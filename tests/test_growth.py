"""Steps whose work must grow with their rows, on inputs that made it grow with pairs of them."""

from __future__ import annotations

import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import code, postings, redaction, search, similarity, skills, vector_index


def test_many_memories_of_one_path_meet_one_candidate(spark):
    n = 20_000
    kind = [F.lit("p").alias("path"), F.lit("fact").alias("type")]
    stale = spark.range(n).select("id", *kind, F.concat(F.lit("h"), F.col("id").cast("string")).alias("content_hash"))
    made = spark.range(n - 5, 2 * n).select(*kind, F.concat(F.lit("h"), F.col("id").cast("string")).alias("content_hash"), F.col("id").cast("string").alias("content"), (F.col("id") % 7 / 10).alias("importance"), F.lit(0.5).alias("confidence"))
    start = time.monotonic()
    got = code.renewed(stale, made).groupBy("outcome", "successor").agg(F.count("*").alias("n")).collect()
    assert {(r.outcome, r.n) for r in got} == {("refreshed", 5), ("superseded", n - 5)}
    best = max((k % 7, str(k)) for k in range(n - 5, 2 * n))[1]
    assert {r.successor for r in got} == {None, f"h{best}"}
    assert time.monotonic() - start < 60


def test_a_memory_of_several_paths_takes_the_best_of_all(spark):
    stale = spark.createDataFrame([(1, "a", "t", "x"), (1, "b", "t", "x"), (2, "a", "t", "h1"), (3, "c", "t", "x")], "id long, path string, type string, content_hash string")
    made = spark.createDataFrame([("a", "t", "h1", "aa", 0.5, 0.5), ("b", "t", "h2", "bb", 0.5, 0.5), ("b", "t", "h3", "zz", 0.4, 0.9)], "path string, type string, content_hash string, content string, importance double, confidence double")
    got = {r.id: (r.outcome, r.successor) for r in code.renewed(stale, made).collect()}
    assert got == {1: ("superseded", "h2"), 2: ("refreshed", None), 3: ("deferred", None)}


def test_pivots_that_separate_nothing_move_few_copies(spark):
    x = np.random.default_rng(5).normal(size=(6000, 64))
    table = spark.createDataFrame([(k, v.tolist(), "g") for k, v in enumerate(x)], "id long, embedding array<double>, of string")
    assert similarity._placed(similarity.classes(table, ["of"]), 0.97, None).count() <= 8 * 6000


def test_pivots_are_chosen_before_they_are_sorted(spark):
    rows = spark.range(100_000).withColumn("embedding", F.array(F.lit(1.0)))
    first = similarity._lowest_hashes(rows, 1000, 100_000).collect()
    assert [r.id for r in first] == [r.id for r in rows.orderBy(F.xxhash64("id"), "id").limit(1000).collect()]
    assert similarity._lowest_hashes(rows, 100_000, 100_000).count() == 100_000
    plan = similarity._lowest_hashes(rows, 1000, 100_000)._jdf.queryExecution().optimizedPlan()
    assert "Filter (xxhash64(" in plan.toString()


def test_texts_are_not_sent_to_the_driver_to_find_skills(spark):
    events = spark.createDataFrame([(1, "ran skills/x/y"), (2, "nothing"), (3, "use skill-one")], "event_id long, text string")
    known = spark.createDataFrame([(7, "skill-one", "skills/x/"), (8, "tiny", "q/")], "id long, name string, path string")
    got = skills.mentioned(events.hint("broadcast"), known)
    assert sorted(map(tuple, got.collect())) == [(7, 1), (7, 3)]
    small = spark.range(10).select(F.col("id").alias("event_id"), F.col("id").cast("string").alias("text"))  # far below the size that Spark broadcasts
    assert "BuildLeft" not in skills.mentioned(small, known)._jdf.queryExecution().executedPlan().toString()


def test_a_name_that_a_file_has_often_goes_along_once(spark):
    rows = spark.createDataFrame([(1, "calls run and stop")], "id long, content string")
    refs = spark.createDataFrame([(1, "r", "f", "c", "b")], "id long, repository string, path string, commit string, blob string")
    symbols = spark.range(3000).select(F.lit("r").alias("repository"), F.lit("f").alias("path"), F.when(F.col("id") % 2 == 0, "stop").otherwise("run").alias("name"), (3000 - F.col("id")).alias("line_start"))
    rows = search.referenced(rows, refs, symbols)
    assert rows.first()["code_refs"][0]["symbol"] == "run"
    shown = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [repository#" in shown and "min(line_start" in shown


def test_a_search_of_all_cells_holds_few_rows_at_once(spark, monkeypatch):
    n, cells = 3000, 60
    x = np.random.default_rng(3).normal(size=(n, 8))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>").coalesce(1)
    index = vector_index.build(table, cells)
    sizes = []
    whole = type(table).mapInArrow

    def watched(self, run, schema, *more):
        def counted(batches):
            for b in run(batches):
                assert b.num_rows <= vector_index.SLICE
                yield b

        sizes.append(schema)
        return whole(self, counted, schema, *more)

    monkeypatch.setattr(type(table), "mapInArrow", watched)
    asked = vector_index._asked(index, table, cells, None)
    assert asked.select(F.sum(F.size("asked"))).first()[0] == n * int((index.far >= 0).sum()) and sizes


def test_texts_are_redacted_the_same_in_slices(spark):
    texts = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("password=abcdefgh"), F.col("id").cast("string"))).alias("text")).coalesce(1)
    plan = texts.select(redaction.redacted(F.col("text")).alias("r"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and redaction.SLICE < 1000
    got = texts.select("id", redaction.redacted(F.col("text")).alias("r")).select("id", "r.text", F.size("r.records").alias("n")).collect()
    assert all((r.text, r.n) == (("password=[REDACTED:password]", 1) if r.id % 3 else (None, 0)) for r in got) and len(got) == 1000


def test_segments_of_postings_are_partitions_of_their_own(spark, monkeypatch):
    docs = spark.range(4000).select("id", F.lit("one two").alias("content"))
    kind, seen = type(docs), []
    whole = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: seen.append(a) or whole(self, *a))
    postings.build(docs, segment=100)
    assert (40, "segment") in seen


def test_a_whole_pass_equals_its_sql_where_vectors_are_near(spark, tmp_path):
    import duckdb

    from lodestone.plans import registry

    n, rng = 1200, np.random.default_rng(8)
    middle = rng.normal(size=(40, 16))
    rows = [(k, (middle[k // 360 * 3 + k % 3] + rng.normal(size=16) * (0.0, 0.1, 0.35)[k // 60 % 3]).tolist(), 0) for k in range(n)]
    docs = [(k, f"text {k}", "en", "s", 8) for k in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    for name in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(db.execute(registry.oracle_sql()["consolidation_pass"]).fetchall())
    got = registry.queries()["consolidation_pass"](spark, str(tmp_path)).select("step", "outcome", "n").collect()
    assert sorted(map(tuple, got)) == want
    assert {x[:2] for x in want} >= {("merge", "merged"), ("merge", "keeper"), ("merge", "not_near"), ("derivation", "derivation")}


def test_pairs_of_statements_are_moved_once(spark):
    from lodestone.plans import registry

    plan = registry.queries()["authority_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_texts_of_one_language_are_compared_without_joining_their_trigrams(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789é"), rng.integers(3, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(2000)]
    texts += [f"{texts[k]} {words[k]}" for k in range(50)] + [texts[k].upper() for k in range(20)] + [" ".join([texts[7]] * 3), "", "...", "ab"]
    table = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(texts)] + [(len(texts), None, 0)], "id long, content string, of int")
    plain = [re.sub("[^a-z0-9]+", " ", t.lower()).strip() for t in texts]
    grams = [Counter(f"  {t}  "[k : k + 3] for k in range(len(t) + 2)) for t in plain]
    known = {g: k for k, g in enumerate(sorted(set().union(*grams)))}
    x = np.zeros((len(texts), len(known)))
    for k, found in enumerate(grams):
        x[k, [known[g] for g in found]] = list(found.values())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.9), strict=True) if a < b and (b - a) % 2 == 0}
    assert len(want) >= 70 and len(known) > similarity.OWN
    start = time.monotonic()
    for tile in (similarity.TILE, 300):
        got = similarity.text_pairs(table, ["of"], 0.9, tile).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert time.monotonic() - start < 60


def test_links_stay_where_they_are_when_copies_are_added(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 4)], "id long, representative long")
    links = spark.createDataFrame([(1, 3, 0.98), (3, 4, 0.97), (1, 4, 0.99)], "a long, b long, cosine double")
    pairs = similarity._expanded(members, links, 0.97)
    want = {(1, 3, 0.98), (2, 3, 0.98), (3, 4, 0.97), (3, 5, 0.97), (3, 6, 0.97), (1, 2, 1.0), (4, 5, 1.0), (4, 6, 1.0), (5, 6, 1.0)}
    want |= {(a, b, 0.99) for a in (1, 2) for b in (4, 5, 6)}
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2


def test_many_vectors_are_written_at_most_three_times_by_pivots(spark, monkeypatch):
    monkeypatch.setattr(similarity, "COPY_BYTES", 2**20, raising=False)  # as for many vectors
    x = np.random.default_rng(5).normal(size=(6000, 12))
    table = spark.createDataFrame([(k, v.tolist(), "g") for k, v in enumerate(x)], "id long, embedding array<double>, of string")
    assert similarity._placed(similarity.classes(table, ["of"]), 0.97, None).count() <= 3 * 6000


def test_equal_vectors_are_found_without_moving_them(spark):
    rows = [(1, [0.0, 1.0], "g"), (2, [-0.0, 1.0], "g"), (3, [0.0, 1.0], "h"), (4, [0.0, 1.0], None), (5, [0.0, 1.0], None), (6, [0.0, 1.0, 0.0], "g")]
    rows += [(7, [0.0, 0.0], "g"), (8, None, "g"), (9, [], "g"), (10, [1.0, None], "g"), (11, [1.0, float("nan")], "g")]
    found = similarity.classes(spark.createDataFrame(rows, "id long, embedding array<double>, of string"), ["of"])
    assert {r.id: r.representative for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    members, links = similarity.near_links(spark.createDataFrame(rows, "id long, embedding array<double>, of string"), ["of"], 0.9)
    assert len(members.collect()) == 6 and links.count() == 0
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") - plan.count("BroadcastExchange ") == 1 and "SortMergeJoin" not in plan


def test_many_near_texts_are_one_product_and_few_are_not(monkeypatch):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(60)]
    texts = [" ".join(rng.choice(words, 200)).encode() for _ in range(40)] + [b"a" * 9000 + b" bcd " * k for k in range(1, 9)] + [b"", b"..", "é1".encode()]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts)), pa.array(range(len(texts))), pa.array([t.decode() for t in texts])], ["of", "id", "text"])
    made = similarity._Profiles(pa.Table.from_batches(similarity._profiled([batch])))
    assert made.norm.max() ** 2 > 2**24 and made.n.max() > 255
    calls, plain = [], made.cosines
    monkeypatch.setattr(made, "cosines", lambda i, others: calls.append(i) or plain(i, others))
    rows, others = np.arange(len(texts))[::-1], np.arange(len(texts))
    one = np.outer(rows == 47, others == 40)
    for wanted, few in ((np.ones_like(one), False), (one, True)):
        a, b, cosine = made.among(rows, others, wanted)
        assert bool(calls) == few and len(a) == wanted.sum()
        assert all(abs(c - plain(i, np.array([j]))[0]) < 1e-12 for i, j, c in zip(a, b, cosine, strict=True))
    a, b, cosine = made.among(rows, others[:5], np.ones((len(texts), 5), bool))  # fewer others than rows
    assert len(a) == 5 * len(texts) and all(abs(c - plain(i, np.array([j]))[0]) < 1e-12 for i, j, c in zip(a, b, cosine, strict=True))


def test_angles_with_some_texts_tell_vocabularies_apart():
    rng = np.random.default_rng(7)
    texts = [" ".join("".join(rng.choice(list(letters), 4)) for _ in range(300)) for letters in ("abcdef", "uvwxyz") for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 120), pa.array(range(120)), pa.array(texts)], ["of", "id", "text"])
    made = similarity._Profiles(pa.Table.from_batches(similarity._profiled([batch])))
    angles, some = made.angles(), np.argsort(made.norm, kind="stable")[:: 120 // similarity.CENTRES][: similarity.CENTRES]
    want = np.arccos(np.minimum(1, [made.cosines(k, some) for k in range(120)]))
    assert angles.shape == want.shape and np.abs(angles - want).max() < 1e-6
    one, two = angles[:60], angles[60:]
    assert (np.maximum(one.min(0) - two.max(0), two.min(0) - one.max(0)) > np.arccos(0.97)).any()


def test_profiles_of_texts_are_moved_once(spark):
    table = spark.createDataFrame([(k, f"text {k} of some", k % 2) for k in range(20)] + [(30, "Text 3, of some.", 1)], "id long, content string, of int")
    members, links = similarity.text_links(table, ["of"], 0.97)
    assert {tuple(r) for r in members.collect()} >= {(3, 3), (30, 3), (4, 4)}
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") - plan.count("BroadcastExchange ") == 1 and "SortMergeJoin" not in plan


def test_vectors_of_one_cell_are_not_checkpointed(spark, monkeypatch):
    cuts, plain = [], similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df: cuts.append(df.columns) or plain(df))
    x = np.random.default_rng(5).normal(size=(300, 64))
    table = spark.createDataFrame([(k, v.tolist(), "g") for k, v in enumerate(x)], "id long, embedding array<double>, of string")
    assert similarity.near_links(table, ["of"], 0.97, pivots=1)[1].count() == 0
    assert cuts and not any({"embedding", "unit"} & set(columns) for columns in cuts)
    assert similarity.near_links(table, ["of"], 0.97, pivots=4)[1].count() == 0
    assert any("unit" in columns for columns in cuts)

"""Versioned tables, their writes, periodic passes, keyed state with timers and composed texts."""

from __future__ import annotations

import unicodedata
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import mutations, passes
from lodestone.operators.versions import Conflict, Versioned
from lodestone.streaming.scratchpad import scratchpad

NOW = datetime(2024, 7, 1)
FIELDS = "id long, status string, superseded_by long, access_count int, last_accessed_at timestamp_ntz"


def at(moment=NOW):
    return F.lit(moment).cast("timestamp_ntz")


@pytest.fixture
def table(spark, tmp_path):
    rows = [(k, ["active", "archived", "superseded"][k % 3], 10 if k in (2, 5) else 4 if k == 8 else None, k, None) for k in range(40)]
    return Versioned.create(spark.createDataFrame(rows, FIELDS), f"file://{tmp_path}/t", buckets=4)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_reads_take_the_newest_row_and_compaction_keeps_it(spark, table):
    table.commit(spark.createDataFrame([(1, "stale", None, 0, None), (100, "active", None, 0, None)], FIELDS))
    table.commit(spark.createDataFrame([(1, "active", None, 5, None), (2, "x", None, 0, None)], FIELDS).withColumn("gone", F.col("id") == 2))
    want = sorted([k for k in range(40) if k != 2] + [100])
    for _ in range(2):
        assert ids(table.read()) == want
        one = table.read(spark.createDataFrame([(1,), (2,), (77,)], "id long")).collect()
        assert [(r["id"], r["status"], r["access_count"]) for r in one] == [(1, "active", 5)]
        table.compact()
    assert table.state()["deltas"] == []
    assert table.vacuum() > 0 and ids(table.read()) == want


def test_compaction_rewrites_only_the_buckets_that_changed(spark, table):
    before = table.state()["base"]
    table.commit(spark.createDataFrame([(1, "stale", None, 0, None)], FIELDS))
    hit = {str(b) for b in table.state()["deltas"][0]["buckets"]}
    table.compact()
    after = table.state()["base"]
    assert len(hit) == 1 and {b for b in before if before[b] != after.get(b)} == hit


def test_a_writer_that_dies_leaves_the_old_state(spark, table, monkeypatch):
    def dies(self, state):
        raise RuntimeError("killed")

    before, version = ids(table.read()), table.version()
    with monkeypatch.context() as m:
        m.setattr(Versioned, "_publish", dies)
        for act in (lambda: table.commit(spark.createDataFrame([(500, "active", None, 0, None)], FIELDS)), lambda: mutations.purge(table, spark.createDataFrame([(10,)], "id long"), "user", at()), table.compact):
            with pytest.raises(RuntimeError, match="killed"):
                act()
    assert table.version() == version and ids(table.read()) == before
    assert table.log("audit", mutations.AUDIT).count() == 0
    assert table.vacuum() == 3 and ids(table.read()) == before  # the purge and commit wrote folders, compaction had nothing to do


def test_of_two_writers_one_gets_a_conflict(spark, table):
    state = table.state()
    row = spark.createDataFrame([(1, "stale", None, 0, None)], FIELDS)
    table.commit(row, since=state)
    with pytest.raises(Conflict):
        table.commit(row.withColumn("status", F.lit("lost")), since=state)
    assert table.read().where("id = 1").first()["status"] == "stale"


def test_purge_clears_pointers_and_leaves_its_audit(spark, table, tmp_path):
    working = Versioned.create(spark.createDataFrame([(1, 10), (2, 13), (3, None)], "id long, promoted_memory_id long"), f"file://{tmp_path}/w", buckets=2)
    out = mutations.purge(table, spark.createDataFrame([(10,), (4,), (3,), (999,)], "id long"), "user", at(), working)
    assert {(r["id"], r["outcome"]) for r in out.collect()} == {(10, "purged"), (4, "purged"), (3, "refused"), (999, "gone")}
    table.compact()
    rows = {r["id"]: r["superseded_by"] for r in table.read().collect()}
    assert 10 not in rows and 4 not in rows and 3 in rows and not any(rows.values())
    assert {(r["memory_id"], r["action"], r["cleared"]) for r in table.log("audit", mutations.AUDIT).collect()} == {(10, "purged", 2), (4, "purged", 1)}
    assert {r["id"]: r["promoted_memory_id"] for r in working.read().collect()} == {1: None, 2: 13, 3: None}


def test_accesses_count_once(spark, table):
    for _ in range(2):
        table.commit(logs={"access": spark.createDataFrame([(1, NOW), (1, NOW - timedelta(days=1)), (7, NOW), (999, NOW)], mutations.ACCESS)})
        mutations.absorb_accesses(table)
        mutations.absorb_accesses(table)
    rows = {r["id"]: r for r in mutations.with_accesses(table).collect()}
    assert rows[1]["access_count"] == 5 and rows[7]["access_count"] == 9 and rows[2]["access_count"] == 2
    assert rows[1]["last_accessed_at"] == NOW and rows[2]["last_accessed_at"] is None


def test_compaction_purges_only_with_a_digest(spark, tmp_path):
    day = timedelta(days=1)
    rows = [(1, "k", "a  b", NOW - 10 * day, NOW, False, None), (2, "k", "", NOW - 40 * day, None, False, None), (3, "k", "x" * 500, NOW - 100 * day, NOW, False, None),
            (4, "k", "y", NOW - 100 * day, NOW, True, None), (5, "k", "z", NOW - 100 * day, None, False, None), (6, "k", "w", NOW - 100 * day, NOW, False, "bad")]
    events = Versioned.create(spark.createDataFrame(rows, "id long, kind string, payload string, occurred_at timestamp_ntz, processed_at timestamp_ntz, needs_review boolean, process_error string"), f"file://{tmp_path}/e", buckets=2)
    plan = lambda df: {(r["action"], r["reason"]): r["n"] for r in df.collect()}
    dry = plan(mutations.compact_events(events, at(), 30, 90, dry_run=True))
    assert dry == plan(mutations.compact_events(events, at(), 30, 90))
    assert dry == {("keep", "recent"): 1, ("summarize", "aging"): 1, ("summarize_and_purge", "old and clean"): 1, ("keep", "needs_review"): 1, ("keep", "unprocessed"): 1, ("keep", "process_error"): 1}
    assert ids(events.read()) == [1, 2, 4, 5, 6]
    digests = {r["id"]: r for r in events.log("digests", mutations.DIGESTS).collect()}
    assert set(digests) == {2, 3} and digests[2]["summary"] == "k (empty payload)" and len(digests[3]["summary"]) == 400 and digests[3]["payload_bytes"] == 500
    again = plan(mutations.compact_events(events, at(), 30, 90))
    assert not any(a.startswith("summarize") or a == "purge" for a, _ in again)


SKILLS = "id long, name string, status string, failure_ids array<long>, description string, updated_at timestamp_ntz"


def test_skill_writes_are_guarded(spark, tmp_path):
    table = Versioned.create(spark.createDataFrame([(1, "a", "candidate", [1], "d", NOW), (2, "b", "verified", [2], "d", NOW)], SKILLS), f"file://{tmp_path}/s", buckets=2)
    said = lambda df: {r["id"]: r["outcome"] for r in df.collect()}
    assert said(mutations.add_skills(table, spark.createDataFrame([(1, "x", "candidate", [9], "d", NOW), (3, "c", "candidate", [3], "d", NOW), (4, "e", "promoted", [4], "d", NOW)], SKILLS), "gen", at())) == {1: "exists", 3: "created", 4: "refused"}
    flips = [(1, "candidate", "verified"), (2, "candidate", "promoted"), (3, "candidate", "promoted"), (9, "candidate", "verified")]
    assert said(mutations.flip_skills(table, spark.createDataFrame(flips, "id long, expected string, new string"), "rev", at())) == {1: "flipped", 2: "moved", 3: "illegal", 9: "gone"}
    more = spark.createDataFrame([(1, [7], "new"), (3, [3, 8], "new"), (9, [1], "new")], "id long, failure_ids array<long>, description string")
    assert said(mutations.refresh_skills(table, more, "gen", at())) == {1: "frozen", 3: "refreshed", 9: "gone"}
    rows = {r["id"]: r for r in table.read().collect()}
    assert rows[1]["status"] == "verified" and rows[3]["failure_ids"] == [3, 8] and rows[1]["failure_ids"] == [1] and 4 not in rows
    audit = table.log("audit", "id long, action string, from_status string, to_status string, actor string, at timestamp_ntz").collect()
    assert {(r["id"], r["action"], r["to_status"]) for r in audit} == {(3, "created", "candidate"), (1, "status_changed", "verified"), (3, "edited", "candidate")}


def test_entities_are_made_merged_and_bound_once(spark, tmp_path):
    fields = "id long, project_id string, kind string, name string, aliases array<string>"
    empty = spark.createDataFrame([], fields + ", normal string, merged_into long")
    table = Versioned.create(empty, f"file://{tmp_path}/n", buckets=2)
    make = lambda rows: {r["id"]: (r["entity_id"], r["outcome"]) for r in mutations.create_entities(table, spark.createDataFrame(rows, fields)).collect()}
    assert make([(2, "p", "k", "Redis", []), (1, "p", "k", " redis ", []), (3, None, "k", "redis", [])]) == {1: (1, "created"), 2: (1, "exists"), 3: (3, "created")}
    assert make([(0, "p", "k", "REDIS", []), (5, "q", "k", "redis", [])]) == {0: (1, "exists"), 5: (5, "created")}
    merge = lambda rows: {r["id"]: r["outcome"] for r in mutations.merge_entities(table, spark.createDataFrame(rows, "id long, into long")).collect()}
    assert merge([(5, 1), (3, 3), (9, 1)]) == {5: "merged", 3: "same", 9: "gone"}
    assert merge([(5, 3)]) == {5: "already"}
    bound = Versioned.create(spark.createDataFrame([], "id string, memory_id long, entity_id long, role string, weight double"), f"file://{tmp_path}/b", buckets=2)
    for _ in range(2):
        mutations.bind_entities(bound, spark.createDataFrame([(1, 1, None, 0.2), (1, 1, "subject", 0.9), (2, 1, None, None)], "memory_id long, entity_id long, role string, weight double"))
    assert {(r["memory_id"], r["entity_id"], r["role"], r["weight"]) for r in bound.read().collect()} == {(1, 1, "subject", 0.9), (2, 1, "context", 1.0)}


# ---- passes

CLAIMS = "id long, content string, type string, status string, project_id string, user_id string, importance double, confidence double, access_count long, observed_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, content_hash string, source_kind string, superseded_by long"


@pytest.fixture
def claims(spark, tmp_path):
    row = lambda k, content, kind="semantic", days=1, importance=0.9: (k, content, kind, "active", "p", None, importance, 0.9, 3, NOW - timedelta(days=days), NOW - timedelta(days=days), None, f"h{k}", "tool", None)
    rows = [row(1, "Node 20", days=9), row(2, "Node 22", days=5), row(3, "old thing", days=3000, importance=0.1)]
    rows += [row(k, f"seen {'abcdef'[k % 6]}", "episodic", days=k - 9) for k in range(10, 14)] + [row(20, "twin", days=4), row(21, "twin!", days=3)]
    table = Versioned.create(spark.createDataFrame(rows, CLAIMS), f"file://{tmp_path}/c", buckets=4)
    rng = np.random.default_rng(0)
    middle = rng.normal(0, 1, 8)
    near = lambda v, s: [float(x) for x in v + rng.normal(0, s, 8)]
    twin = rng.normal(0, 1, 8)
    vectors = [(k, near(middle, 0.35)) for k in range(10, 14)] + [(20, near(twin, 0.001)), (21, near(twin, 0.001))]
    return table, spark.createDataFrame(vectors, "id long, embedding array<double>"), spark.createDataFrame([(k, 1) for k in range(10, 14)], "id long, entity_id long")


def test_a_whole_pass_and_a_second_that_settles_nothing(spark, claims):
    table, vectors, primary = claims
    report = passes.consolidate(table, NOW, vectors, primary)
    assert report["done"] == {"contradiction": {"superseded": 1}, "derivation": {"derived": 1}, "merge": {"superseded": 1}, "decay": {"archived": 1}} and report["warnings"] == []
    rows = {r["id"]: r for r in table.read().collect()}
    assert (rows[1]["status"], rows[1]["superseded_by"]) == ("superseded", 2) and rows[3]["status"] == "archived" and {rows[20]["status"], rows[21]["status"]} == {"active", "superseded"}
    fact = next(r for k, r in rows.items() if k not in {1, 2, 3, 10, 11, 12, 13, 20, 21})
    assert (fact["type"], fact["status"], fact["source_kind"]) == ("semantic", "active", "derived")
    assert {r["id"] for r in table.log("derived", passes.DERIVED).collect()} == {10, 11, 12, 13}
    version, before = table.version(), sorted(map(str, table.read().collect()))
    assert passes.consolidate(table, NOW, vectors, primary)["done"] == report["done"] and table.version() == version
    later = passes.consolidate(table, NOW + timedelta(hours=1), vectors, primary)
    assert all(not sum(n.values()) for n in later["done"].values())
    assert sorted(map(str, table.read().collect())) == before


def test_a_pass_goes_on_where_it_was_cut_off(spark, claims, monkeypatch):
    table, vectors, primary = claims
    with monkeypatch.context() as m:
        m.setattr(passes.consolidation, "merges", lambda *a: 1 / 0)
        report = passes.consolidate(table, NOW, vectors, primary)
    assert set(report["done"]) == {"contradiction", "derivation", "decay"} and "merge failed: ZeroDivisionError" in report["warnings"][0]
    assert passes.periodically(table, NOW + timedelta(minutes=5), timedelta(hours=1), vectors=vectors, primary=primary)["done"]["merge"] == {"superseded": 1}
    assert passes.periodically(table, NOW + timedelta(minutes=6), timedelta(hours=1), vectors=vectors, primary=primary) is None
    assert passes.due(table, NOW + timedelta(hours=1), timedelta(hours=1))


def test_stages_pool_and_degradations(spark, claims):
    table, _, _ = claims
    report = passes.consolidate(table, NOW, stages=("merge", "decay"), pool_limit=3)
    assert report["considered"] == 3 and report["truncated"] and report["done"] == {"decay": {}} and report["warnings"] == ["no vectors: derivation and merge are left out"]
    assert passes.consolidate(table, NOW, stages=("decay",), project="q")["considered"] == 0
    with pytest.raises(ValueError, match="no such stages"):
        passes.consolidate(table, NOW, stages=("tidy",))


# ---- keyed state and composed texts

ROWS = "session_id string, id long, content string, importance double, kind string, at timestamp"


def test_scratch_rows_expire_a_day_after_the_last_event(spark, tmp_path):
    hour = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    batches = [
        [("A", 1, "a", 0.9, "note", hour(0)), ("A", 2, "b", 0.1, "note", hour(2)), ("B", 3, "c", 0.9, "note", hour(0))],
        [("A", 4, "d", 0.9, "note", hour(20)), ("C", 5, "e", 0.9, "note", hour(21)), ("C", 6, "f", 0.1, "note", hour(21)), ("C", 7, None, None, "session.end", hour(22))],
        [("D", 8, "x", 0.9, "note", hour(40))],
        [("D", 9, "x", 0.9, "note", hour(60))],
    ]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
        out = scratchpad(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        out.trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema("session_id string, id long, outcome string, at timestamp").parquet(f"{tmp_path}/out").collect()
        seen.append({(r["session_id"], r["id"], r["outcome"], r["at"]) for r in got})
    ended = {("C", 5, "promoted", hour(22)), ("C", 6, "dropped", hour(22))}
    assert seen[0] == set() and seen[1] == ended
    assert seen[2] == ended | {("B", 3, "expired", hour(24))}  # A was heard of again at 20 h
    assert seen[3] == seen[2] | {("A", k, "expired", hour(44)) for k in (1, 2, 4)}


def test_only_texts_that_may_change_leave_the_jvm(spark):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    risky = [c for c in every if unicodedata.normalize("NFC", c) != c or unicodedata.combining(c)]
    seconds = {chr(int(d[1], 16)) for c in every if len(d := unicodedata.decomposition(c).split()) == 2 and not d[0].startswith("<")}
    rows = spark.createDataFrame([(c,) for c in {*risky, *seconds, *map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])}], "c string")
    assert rows.where(~text.may_compose(F.col("c"))).collect() == []
    assert spark.createDataFrame([("Straße äöü, 日本語 naïve",)], "c string").where(text.may_compose(F.col("c"))).count() == 0


def test_hashes_of_both_forms_are_equal(spark):
    words = ["Éa  naïve", "한국어", "Å ﬁ", "ẛ̣", "plain", "", None]
    rows = [(k, unicodedata.normalize(form, w) if w is not None else None) for k, w in enumerate(words) for form in ("NFC", "NFD")]
    got = spark.createDataFrame(rows, "id long, content string").groupBy("id").agg(F.countDistinct(text.canonical_hash(F.col("content"))).alias("n")).collect()
    assert {r["id"]: r["n"] for r in got} == {**dict.fromkeys(range(6), 1), 6: 0}

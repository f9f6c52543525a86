"""Searches, similarity joins, extraction, the store and its streams on small tables."""

from __future__ import annotations

import json
import math
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import extraction as rules
from lodestone.functions import scopes, text
from lodestone.operators import code, consolidation, extraction, redaction, search, similarity, skills, store
from lodestone.sources import export, views
from lodestone.streaming import pipeline

NOW = datetime(2024, 7, 1)


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'binary' if isinstance(values[n], bytes) else 'string'}" for n in names))
    return row.select(column.alias("x")).first().x


def test_time_scopes_of_a_table_equal_those_of_one_question(spark):
    asked = ["last year", "in the last 3 weeks", "2 months ago", "past 10 day", "in 2023", "during 2023-12", "in 2024-02-30", "in 2024-13", "before 2024-03", "until 2023-05-06", "since 2024", "after 2023-02 and before 2024",
             "now", "currently", "nothing", "before long since 2022-11-30", "LAST YEAR in 2020", ""]
    table = spark.createDataFrame([(x,) for x in asked], "q string").select("q", scopes.time_scopes(F.col("q"), F.lit(NOW).cast("timestamp_ntz")).alias("s"))
    for r in table.collect():
        got = {k: v for k, v in (r.s.asDict() if r.s else {}).items() if v is not None}
        assert got == (scopes.time_scope(r.q, NOW) or {}), r.q
    assert scopes.time_scope("in 2024-13", NOW)["from"] == datetime(2025, 1, 1)  # months run on


def test_intent_counts_phrases_that_begin_alike(spark):
    for q in ("when did it run", "what is this project", "why did we choose error", "how do I deploy", "no words", "errors ERROR  Out of\n memory", "used to run before"):
        assert one(spark, text.intent(F.col("q")), q=q) == search.intent_of(q)


@pytest.mark.parametrize(("said", "want"), [
    ("We decided to use Postgres because it is simple. Bye", {"decision": "use Postgres", "rationale": "it is simple", "alternatives": []}),
    ("we chose Bun over Node because Node is slow. We ruled out Deno because of tooling.", {"decision": "Bun", "rationale": "Node is slow", "alternatives": [("Node", "Node is slow"), ("Deno", "of tooling")]}),
    ("Decision: to ship it, and then rest", {"decision": "ship it", "rationale": None, "alternatives": []}),
    ("let's use it over there", {"decision": "it over there", "rationale": None, "alternatives": []}),
    ("we decided to wait", None), ("nothing here", None),
])
def test_decisions(spark, said, want):
    got = one(spark, extraction.decision(F.col("t")), t=said)
    plain = got and {"decision": got.decision, "rationale": got.rationale, "alternatives": [(a.option, a.why_rejected) for a in got.alternatives]}
    if want:
        want = want | {"alternatives": [(o, w) for o, w in want["alternatives"]]}
    assert plain == want


def test_decision_content_and_sentences(spark):
    said = "First. We picked Bun over Npm because Npm is old! Rest"
    assert one(spark, extraction.decision_content(extraction.decision(F.col("t"))), t=said) == "Decision: Bun over Npm — because Npm is old"
    assert one(spark, extraction.sentence_around(F.col("t"), F.col("p")), t="One. Two  is\there? Three", p="is") == "Two is here?"
    assert one(spark, extraction.sentence_around(F.col("t"), F.col("p")), t="alone", p="alone") == "alone"


def test_incidents(spark):
    rows = [(1, "error.raised", '{"origin":"tool","message":"m","context":"c"}'), (2, "terminal.output", '{"command":"x","exit_code":2}'), (3, "terminal.output", '{"command":"x","exit_code":0}'),
            (4, "test.results", '{"passed":1,"failed":2,"framework":"v"}'), (5, "conversation.tool_result", '{"call_id":"c","ok":false,"tool":"t","output_digest":" "}'), (6, "file.changed", '{"path":"p","change":"c"}')]
    e = spark.createDataFrame([(*r, "s", "p", "2024-01-01") for r in rows], "id long, kind string, payload string, session_id string, project_id string, at string").withColumn("occurred_at", F.col("at").cast("timestamp_ntz"))
    got = {r.id: (r.i.origin, r.i.message) if r.i else None for r in extraction.normalized(e).select("id", extraction.incident().alias("i")).collect()}
    assert got == {1: ("tool", "m c"), 2: ("command", "$ x → exit 2 "), 3: None, 4: ("test", "v: 2 failed"), 5: ("tool", "tool call failed"), 6: None}


def test_redacted_json_walks_and_hashes(spark):
    event = {"b": [1, {"x y": "token=abcdef123456", "ok": True}], "a": "password=hunter2", "n": 2.0, "z": None, "author": "author: Jane"}
    got = one(spark, redaction.redacted_json(F.col("j")), j=json.dumps(event))
    assert json.loads(got.json) == {"a": "password=[REDACTED:password]", "author": "author: Jane", "b": [1, {"ok": True, "x y": "token=[REDACTED:token]"}], "n": 2, "z": None}
    assert got.json.startswith('{"a":') and '"n":2,' in got.json
    assert sorted((r.kind, r.location, r.length) for r in got.records) == [("password", "$.a", 7), ("token", '$.b[1]["x y"]', 12)]
    assert one(spark, redaction.redacted_json(F.col("j")), j="no json: pwd=x1")["json"] == '"no json: pwd=[REDACTED:password]"'
    assert one(spark, redaction.canonical_json(F.col("j")), j='{"é": 1, "a": [1.5, "x"]}') == '{"a":[1.5,"x"],"é":1}'
    assert one(spark, redaction.canonical_json(F.col("j")), j="{") is None


def test_vector_pairs_in_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.standard_normal(6).tolist() for _ in range(40)] + [[0.0] * 6, None]
    rows = [(k, v, None if k % 3 == 0 else "g") for k, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>, of string")
    near = lambda a, b: float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300))
    want = {(a, b) for a, x, g in rows for b, y, h in rows if a < b and g == h and x and y and any(x) and any(y) and near(x, y) >= 0.5}
    for tile in (3, 7, 2000):
        got = similarity.vector_pairs(table, ["of"], 0.5, tile).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_text_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"], 6)) for _ in range(30)]
    texts += [texts[0] + "!", "", texts[1].upper()]

    def counts(t):
        plain = "".join(c if c.isalnum() else " " for c in t.lower())
        padded = f"  {' '.join(plain.split())}  "
        return Counter(padded[k : k + 3] for k in range(len(padded) - 2))

    def cosine(a, b):
        a, b = counts(a), counts(b)
        return sum(a[k] * b[k] for k in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    table = spark.createDataFrame([(k, t, "g") for k, t in enumerate(texts)], "id long, content string, of string")
    for least in (0.8, 0.97):
        want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if cosine(texts[a], texts[b]) >= least}
        assert {(r.a, r.b) for r in similarity.text_pairs(table, ["of"], least).collect()} == want


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(20, 60)] + [(100, k) for k in range(101, 140)] + [(7, 3), (9, 9)]
    got = dict(map(tuple, similarity.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[k] for k in range(20, 61)} == {20} and {got[k] for k in range(100, 140)} == {100} and (got[7], got[3], got[9]) == (3, 3, 9)
    assert similarity.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_candidates_collapse_to_the_first_by_authority(spark):
    rows = [(1, "e", 1, 0.5, "2024-01-01", [1.0, 0.0]), (2, "e", 3, 0.1, "2024-01-01", [1.0, 0.01]), (3, "e", 2, 0.9, "2024-01-01", [0.0, 1.0]), (4, "f", 1, 0.9, "2024-01-01", [1.0, 0.0]), (5, "e", 1, 0.9, "2024-01-01", None)]
    table = spark.createDataFrame(rows, "id long, entity string, authority int, confidence double, observed_at string, embedding array<double>")
    assert sorted(r.id for r in similarity.collapsed_near(table, ["entity"]).collect()) == [2, 3, 4, 5]


def memories(spark, rows):
    more = {"project_id": "p", "user_id": None, "type": "semantic", "status": "active", "importance": 0.5, "confidence": 0.5, "access_count": 0, "observed_at": datetime(2024, 6, 1), "valid_from": datetime(2024, 1, 1), "valid_until": None, "source_kind": "tool"}
    schema = "id long, content string, project_id string, user_id string, type string, status string, importance double, confidence double, access_count int, observed_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, source_kind string"
    fields = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(({"id": k, "content": c} | more | extra)[f] for f in fields) for k, c, extra in rows], schema).withColumn("content_hash", text.content_hash(F.col("content")))


def test_search_from_question_to_packed_results(spark):
    m = memories(spark, [(1, "The cache runs on Redis. It is fast.", {}), (2, "the cache runs on  redis. it is fast.", {"source_kind": "explicit"}), (3, "Redis was replaced.", {"valid_until": datetime(2024, 2, 1), "status": "superseded"}),
                         (4, "Other project's Redis", {"project_id": "q"}), (5, "Bound but silent", {}), (6, "Two hops away", {})])
    entities = spark.createDataFrame([(70, "redis cluster", ["main cache"]), (71, "nobody", [])], "entity_id long, name string, aliases array<string>")
    bound = spark.createDataFrame([(5, 70)], "id long, entity_id long")
    edges = spark.createDataFrame([(5, 6, 1, datetime(2024, 1, 1))], "src long, dst long, id long, valid_from timestamp_ntz")
    working = spark.createDataFrame([(9, "s", "note", None, datetime(2024, 8, 1)), (10, "s", "old", None, datetime(2024, 1, 1))], "id long, session_id string, content string, promoted_memory_id long, expires_at timestamp_ntz")
    sources = search.Sources(m, edges=edges, bound=bound, entities=entities, working=working)
    got = search.search(search.Request("which redis does the main cache use", NOW, project_id="p", session_id="s"), sources)
    ids = [x["id"] for x in got["memories"]]
    assert set(ids[:2]) == {2, 5} and set(ids) == {2, 5, 6, "w9"} and got["entities"] == [70] and got["used"] <= 800
    assert got["intent"] == "fact" and "temporal_note" in got["memories"][0] and got["memories"][0]["explain"]
    past = search.search(search.Request("redis", NOW, project_id="p", as_of=datetime(2024, 1, 15)), search.Sources(m))
    assert 3 in [x["id"] for x in past["memories"]]
    none = search.search(search.Request("redis", NOW, entities=("unheard of",)), sources)
    assert none["memories"] == [] and none["warnings"]
    assert search.search(search.Request("of the", NOW), search.Sources(m.limit(0)))["memories"] == []


def test_terms_of_several_tokens_need_them_all(spark):
    from lodestone.operators import memory

    m = memories(spark, [(1, "node version 20", {}), (2, "node only", {}), (3, None, {}), (4, "version twenty", {})])
    assert [r.id for r in memory.lexical(m, ["Node 20", "twenty"]).orderBy("lexical_rank").collect()] == [1, 4] or {r.id for r in memory.lexical(m, ["Node 20", "twenty"]).collect()} == {1, 4}
    assert memory.lexical(m, ["??"]).count() == 0


def test_consolidation_settles_a_row_once(spark):
    m = memories(spark, [(1, "Version: a 1", {"observed_at": datetime(2024, 5, 1)}), (2, "Version: a 2", {}), (3, "Uses x", {"source_kind": "explicit"}), (4, "Uses  x now", {}), (5, "faint", {"importance": 0.0})])
    vectors = spark.createDataFrame([(k, v) for k, v in ((1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 1.0]), (5, [-1.0, 0.0]))], "id long, embedding array<double>")
    steps = consolidation.consolidated(m, vectors, m.select("id", F.lit(1).alias("entity_id")), m.select("id").limit(0), F.lit(NOW).cast("timestamp_ntz"))
    assert [(r.id, r.outcome) for r in steps["contradiction"].collect()] == [(1, "superseded")]
    assert {r.id: r.outcome for r in steps["merge"].collect()} == {3: "keeper", 4: "merged"}
    assert {r.id for r in steps["decay"].collect()} == {5}


def test_session_end_promotes_once(spark):
    rows = [(1, "p", "kept note", None, 5, 1, 0.9), (2, "p", "kept note", None, 5, 1, 0.9), (3, "p", "weak", None, 5, 1, 0.1), (4, "p", "done", 8, 5, 1, 0.9)]
    working = spark.createDataFrame(rows, "id long, project_id string, content string, promoted_memory_id long, source_id long, evidence int, importance double").withColumn("created_at", F.lit(NOW).cast("timestamp_ntz")).withColumn("expires_at", F.lit(NOW).cast("timestamp_ntz"))
    promoted, counts, kept = store.session_end(working, memories(spark, [(50, "other", {})]), F.lit(NOW).cast("timestamp_ntz"))
    assert dict(map(tuple, counts.collect())) == {"inserted": 1, "duplicate": 1, "below_importance_threshold": 1, "already_promoted": 1}
    assert sorted((r.id, r.promoted_memory_id) for r in kept.collect()) == [(1, 1), (2, 1), (4, 8)]
    again = store.session_end(kept, memories(spark, []), F.lit(NOW).cast("timestamp_ntz"))
    assert again[0].count() == 0


def test_stored_vectors_ids_and_sources(spark):
    same = [one(spark, store.hashed_vector(F.col("t")), t=t) for t in ("Alpha beta", "beta, ALPHA", "", "gamma")]
    assert same[0] == same[1] and sum(x * x for x in same[0]) == pytest.approx(1) and not any(same[2]) and same[3] != same[0]
    at = [one(spark, store.ordered_id(F.lit(datetime(2024, 1, d)), F.col("k")), k="k") for d in (1, 2)]
    assert at[0] < at[1] and at[0][14] == "7" and len(at[0]) == 36
    read = lambda raw, most=100: one(spark, code.source_text(F.col("b"), most), b=raw)
    assert read(b"\xef\xbb\xbfx = 1").text == "x = 1" and read(b"a\0b").skipped == "binary" and read(b"long", 2).skipped == "too_large" and read(b"\xff\xfe").skipped == "not_utf8" and read("é".encode()).text == "é"


def test_digests_stay_below_their_budget(spark):
    files = spark.createDataFrame([("r", f"src/{k % 40}/f{k}.ts") for k in range(200)], "repository string, path string")
    symbols = spark.createDataFrame([("r", f"src/{k % 40}/f{k}.ts", "function", f"name{k}") for k in range(200)], "repository string, path string, kind string, name string")
    got = code.architecture_digests(files, symbols, 120).first()
    assert got.tokens < 120 and got.truncated and got.text.startswith("code: 40 module(s), 200 file(s), 200 symbol(s)\nlanguages: ts 200\n- src/")


def test_skill_documents(spark):
    said = "Run the tests.\n$ bun test; then wait\nUse `npm ci` first. Use `npm ci` first.\nrun the tests."
    assert one(spark, skills.steps(F.col("t")), t=said) == ["Run the tests.", "$ bun test; then wait", "Use `npm ci` first."]
    assert one(spark, skills.shell_commands(F.col("t")), t=said) == ["bun test", "npm ci"]
    doc = spark.createDataFrame([("fix-it", "Fix:  it", "1", ["a", " "], None, ["x", "y"], ["bun test"], [], None)], "name string, description string, version string, when_to_use array<string>, prerequisites array<string>, procedure array<string>, commands array<string>, validation array<string>, known_failure_modes array<string>")
    got = skills.rendered(doc).first().markdown
    assert got.startswith("---\nname: fix-it\ndescription: Fix: it\nversion: 1\n---\n\n## When to use\n- a\n\n## Prerequisites\nNone recorded.") and "1. x\n2. y" in got and "```bash\nbun test\n```" in got
    pack = spark.createDataFrame([("p", 1, "aa", "b" * 30), ("p", 2, "cc", "d" * 400), ("p", 3, "e" * 80, "f")], "project_id string, position int, name string, description string")
    assert [(r.position, r.kind) for r in skills.serving_pack(pack, 12).orderBy("position").collect()] == [(1, "summary"), (2, "title-only"), (3, "dropped")]


def test_versions_and_technologies(spark):
    say = lambda t: one(spark, rules.version(F.col("t")), t=t)
    assert (say("api is now on v1.2.3"), say("now running Node 22"), say("see version 3 of the docs, now on x 1"), say("none")) == ("api 1.2.3", "Node 22", None, None)
    assert one(spark, rules.technologies(F.col("t")), t="golang and gRPC, then LM Studio on next.js; Grpc-like rest") == ["Go", "gRPC", "LMStudio", "Next.js", "REST"]


def test_export_pages_keep_their_caps(spark):
    m = views.memories(spark, "/root/testdata/sf0.001")
    lines = export.pages(m, page_bytes=600).collect()
    for page in {r.page for r in lines}:
        mine = [r.line for r in lines if r.page == page]
        assert sum(len(x.encode()) + 1 for x in mine[:-1]) <= 600 and mine[-1].endswith(" more")
    assert len(export.index(m).collect()) == 6
    assert all(len(r.body.encode()) <= 700 for r in export.records(m, 700).collect())


def test_stream_from_events_to_memories(spark, tmp_path):
    at = "2024-01-01 00:00:0"
    rows = [(1, "p", "s", "conversation.message", '{"role":"user","content":"I prefer tabs over spaces. password=hunter22"}', f"{at}2"), (2, "p", "s", "conversation.message", '{"role":"user","content":"I prefer tabs over spaces. password=hunter22"}', f"{at}1"),
            (3, "p", "s", "file.changed", '{"path":"a/.env","change":"modified"}', f"{at}3"), (4, "p", "s", "terminal.output", "{}", f"{at}4"), (5, "q", "s", "terminal.output", '{"command":"ls"}', f"{at}5"), (6, "p", "s", "strange", '{"x":1}', f"{at}6")]
    table = spark.createDataFrame(rows, "id long, project_id string, session_id string, kind string, payload string, at string").withColumn("occurred_at", F.col("at").cast("timestamp_ntz")).drop("at")
    table.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        pipeline.ingested(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), project="p").start().awaitTermination()
    table.write.mode("append").parquet(str(tmp_path / "in"))  # the same events once more
    pipeline.ingested(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), project="p").start().awaitTermination()
    events = spark.read.parquet(str(tmp_path / "out" / "events")).collect()
    assert sorted(r.id for r in events) == [2, 6] and all("hunter" not in r.payload for r in events) and {r.kind for r in events} == {"conversation.message", "raw.unknown"}
    found = spark.read.parquet(str(tmp_path / "out" / "memories")).collect()
    assert [(r.type, r.content) for r in found] == [("preference", "Preference: tabs over spaces")]
    outcomes = spark.read.parquet(str(tmp_path / "out" / "outcomes")).where("batch = 0")
    assert dict(outcomes.select("outcome", "n").collect()) == {"stored": 3, "excluded": 1, "dead_letter": 1, "foreign": 1}


def test_golden_datasets_and_what_is_wrong_with_them(spark, tmp_path):
    from lodestone.sources import golden

    good = {"id": "good", "base_time": "2024-01-01T00:00:00Z", "now": "2024-02-01T00:00:00Z", "projects": [{"key": "a", "name": "A"}], "events": [{"kind": "error.raised", "project": "global", "session": "s", "offset_seconds": 5}],
            "facts": [{"key": "f", "description": "d"}], "queries": [{"id": "q", "project": "a", "query": "x", "max_tokens": 5, "expected": ["f"], "forbidden": []}], "contradictions": [], "consolidation": []}
    bad = good | {"id": "bad", "events": [{"kind": "error.raised", "project": "z", "session": "s", "offset_seconds": 99_999_999}], "facts": [{"key": "f"}, {"key": "f"}],
                  "queries": [{"id": "q", "query": "x", "max_tokens": 5, "expected": [], "forbidden": ["g"], "query_type": "decision"}]}
    for x in (good, bad):
        (tmp_path / f"{x['id']}.json").write_text(json.dumps(x))
    got = {(r.id, r.place, r.what) for r in golden.issues(golden.datasets(spark, str(tmp_path))).collect()}
    assert got == {("bad", "queries q", "unknown fact g"), ("bad", "events error.raised", "unknown project z"), ("bad", "facts f", "given twice"), ("bad", "queries q", "expects nothing"), ("bad", "events error.raised", "not before now")}

"""What goes with search results, extracted payloads, typed validation, git records, embeddings and benchmark gates."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.operators import context, extraction, metrics, mutations, search, skills, store
from lodestone.operators.versions import Versioned
from lodestone.sources import repository

NOW = datetime(2024, 7, 1)
MEMORY = "id long, content string, type string, status string, project_id string, user_id string, importance double, confidence double, access_count int, observed_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, content_hash string, source_kind string, last_accessed_at timestamp_ntz"


def memories(spark, rows):
    base = {"type": "semantic", "status": "active", "project_id": "p", "user_id": None, "importance": 0.5, "confidence": 0.5, "access_count": 0, "observed_at": NOW - timedelta(days=9), "valid_from": NOW - timedelta(days=9), "valid_until": None, "source_kind": "tool", "last_accessed_at": None}
    names = [x.split()[0] for x in MEMORY.split(", ")]
    full = [{**base, "id": k, "content": c, "content_hash": f"h{k}", **more} for k, c, more in rows]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], MEMORY)


@pytest.fixture
def sources(spark):
    m = memories(spark, [(1, "verifyCredentials runs on redis", {}), (2, "redis is disputed", {"status": "disputed"}), (3, "redis alone", {"status": "disputed"}), (4, "redis plain", {})])
    edges = spark.createDataFrame([(2, 1, "contradicts", 7, NOW - timedelta(days=3))], "src long, dst long, relation string, id long, valid_from timestamp_ntz")
    refs = spark.createDataFrame([(1, "r", f"src/{k}.ts", "c", f"b{k}") for k in "gfedcba"] + [(4, "r", "src/none.ts", None, "x")], "id long, repository string, path string, commit string, blob string")
    symbols = spark.createDataFrame([("r", "src/a.ts", "Credentials", 1), ("r", "src/a.ts", "verifyCredentials", 9), ("r", "src/a.ts", "redis", 20), ("r", "src/b.ts", "Redis", 1)], "repository string, path string, name string, line_start int")
    projects = spark.createDataFrame([("p", "Pea", "a project", {"stack": "redis"}), ("q", "Queue", None, None)], "project_id string, name string, description string, digest map<string,string>")
    return search.Sources(m, edges=edges, refs=refs, symbols=symbols, projects=projects)


def test_results_carry_references_and_conflicts(sources):
    got = search.search(search.Request("redis", NOW, project_id="p", include=("disputed",)), sources)
    by = {x["id"]: x for x in got["memories"]}
    refs = by[1]["code_refs"]
    assert [r["path"] for r in refs] == [*(f"src/{k}.ts" for k in "abcde"), "<2 more refs>"]
    assert [r["symbol"] for r in refs] == ["verifyCredentials", None, None, None, None, None] and refs[0]["evidence"] == "ba" and refs[-1]["commit"] == ""
    assert by[4]["code_refs"] == [{"repository": "r", "commit": None, "path": "src/none.ts", "symbol": None, "evidence": "x"}] and by[2]["code_refs"] == []
    assert [c["memory_id"] for c in by[2]["conflicts"]] == [1] and by[1]["conflicts"] == []
    assert by[3]["conflicts"] == [{"memory_id": 3, "note": "disputed; nothing that contradicts it is linked"}]
    assert by[1]["source_kind"] == "tool" and by[1]["valid_from"] == NOW - timedelta(days=9)


def test_digest_goes_with_questions_about_context(sources):
    ask = lambda q, p: search.search(search.Request(q, NOW, project_id=p), sources)
    intent = "what is this project"
    assert search.intent_of(intent) == "context"
    assert ask(intent, "p")["project_digest"] == {"name": "Pea", "description": "a project", "digest": {"stack": "redis"}}
    empty = ask(intent, "q")
    assert empty["project_digest"]["digest"] == {} and "the project's digest is not built yet" in empty["warnings"]
    assert "project_digest" not in ask("redis", "p") and "project_digest" not in ask(intent, "zzz")


def test_rerank_changes_the_order_or_says_why_not(sources):
    request = lambda: search.Request("redis", NOW, project_id="p", include=("disputed",))
    plain = [x["id"] for x in search.search(request(), sources)["memories"]]
    turned = search.search(request(), sources, rerank=lambda q, texts: list(range(len(texts))))
    assert [x["id"] for x in turned["memories"]] == plain[::-1]
    failed = search.search(request(), sources, rerank=lambda q, texts: 1 / 0)
    assert [x["id"] for x in failed["memories"]] == plain and any("rerank failed" in w for w in failed["warnings"])


def test_search_logs_what_it_returned(spark, sources, tmp_path, monkeypatch):
    table = Versioned.create(sources.memories, f"file://{tmp_path}/m", buckets=2)
    got = search.search(search.Request("redis", NOW, project_id="p"), sources, accessed=table)
    ids = sorted(x["id"] for x in got["memories"])
    assert ids == [1, 4] and sorted(r["id"] for r in table.log("access", mutations.ACCESS).collect()) == ids
    mutations.absorb_accesses(table)
    assert {r["id"]: r["access_count"] for r in table.read().collect()} == {1: 1, 2: 0, 3: 0, 4: 1}
    monkeypatch.setattr(Versioned, "commit", lambda *a, **k: 1 / 0)
    assert any("accesses were not logged" in w for w in search.search(search.Request("redis", NOW, project_id="p"), sources, accessed=table)["warnings"])


def test_a_session_opens_with_the_digest(spark, sources):
    current = memories(spark, [(1, "We use redis", {"type": "decision"})])
    projects = spark.createDataFrame([("p", "Pea", "words " * 60, {"b_key": "x" * 10, "a": "", "c": None}), ("empty", "Nothing", "", None)], "project_id string, name string, description string, digest map<string,string>")
    got = {r["project_id"]: r for r in context.contexts(current, 750, projects).collect()}
    lines = got["p"]["text"].split("\n")
    assert lines[0] == "project: Pea" and lines[1].startswith("description: words words") and lines[1].endswith("words…") and len(lines[1]) <= len("description: ") + 200
    assert lines[2] == "b key: xxxxxxxxxx" and lines[3:] == ["", "- We use redis"]
    assert got["empty"]["text"] == "project: Nothing"
    assert [r["text"] for r in context.contexts(current).collect()] == ["- We use redis"]


# ---- extraction

EVENTS = "id long, project_id string, session_id string, kind string, payload string, occurred_at timestamp_ntz"


def events(spark, rows):
    return spark.createDataFrame([(k, "p", "s", kind, json.dumps(payload), NOW + timedelta(minutes=k)) for k, kind, payload in rows], EVENTS)


def test_failures_are_open_mitigated_or_verified(spark):
    run = lambda c, code, out="": {"command": c, "exit_code": code, "output_digest": out}
    e = events(spark, [
        (1, "terminal.output", run("bun test", 1)), (2, "terminal.output", run("bun test --only x", 0)), (3, "terminal.output", run(" bun test ", 0, "5 pass")),
        (4, "error.raised", {"origin": "build", "message": "bad", "context": "codex: make all in ./src/a"}), (5, "terminal.output", run("make all", 0)),
        (6, "test.results", {"framework": "pytest", "passed": 1, "failed": 2}), (7, "test.results", {"framework": "jest", "passed": 1, "failed": 0}), (8, "test.results", {"framework": "pytest", "passed": 0, "failed": 0}), (9, "test.results", {"framework": "pytest", "passed": 3, "failed": 0}),
        (10, "conversation.tool_result", {"call_id": "c", "ok": False, "tool": "read", "output_digest": "no"}), (11, "conversation.tool_result", {"call_id": "d", "ok": True, "tool": "read", "output_digest": "  "}),
        (12, "terminal.output", run("never again", 2)), (13, "conversation.tool_result", {"call_id": "c", "ok": False, "output_digest": "unnamed"}), (14, "conversation.tool_result", {"call_id": "c", "ok": True, "output_digest": "unnamed"}),
    ])
    got = {r["id"]: r for r in extraction.failure_payloads(e).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "verified", 4: "verified", 6: "verified", 10: "mitigated", 12: "open", 13: "open"}
    assert got[1]["solution"] == "Successful retry:  bun test " and got[1]["verification"] == "Command  bun test  exited 0: 5 pass"
    assert got[6]["solution"] == "Successful pytest test rerun" and got[6]["verification"] == "pytest: 3 passed, 0 failed"
    assert got[10]["verification"] == "Tool read reported ok: true" and got[12]["solution"] is None
    assert json.loads(got[4]["context"])["detail"] == "codex: make all in ./src/a" and "detail" not in json.loads(got[12]["context"])
    assert len(got[1]["signature"]) == 16 and got[1]["first_seen_at"] == NOW + timedelta(minutes=1)


def test_decisions_are_proposed(spark):
    got = extraction.decision_payloads(events(spark, [(1, "conversation.message", {"role": "user", "content": "we chose Bun over Node because Node is slow."}), (2, "conversation.message", {"role": "user", "content": "hello"})])).collect()
    assert [(r["id"], r["decision"], r["rationale"], [a["option"] for a in r["alternatives"]], r["status"]) for r in got] == [(1, "Bun", "Node is slow", ["Node"], "proposed")]


def test_candidates_say_where_they_come_from(spark):
    e = events(spark, [(1, "conversation.message", {"role": "user", "content": "I prefer tabs over spaces."}), (2, "git.commit", {"sha": "abcdef0123", "message": "use Postgres", "author_name": "x", "files": []}),
                       (3, "error.raised", {"origin": "build", "message": "cannot find zlib"}), (4, "terminal.output", {"command": "install zlib", "exit_code": 0})])
    got = {(r["rule"], r["id"]): [(s["kind"], s["locator"]) for s in r["evidence"]] for r in extraction.with_evidence(extraction.extracted(e), e).collect()}
    assert got["preference", 1] == [("message", "event:1")] and got["stack", 2] == [("commit", "commit:abcdef0123")] and got["failure", 3] == [("event", "event:3"), ("event", "event:4")]


@pytest.mark.parametrize(("kind", "payload", "issues"), [
    ("conversation.message", {"role": "user", "content": "x"}, []), ("conversation.message", {"role": "robot", "content": 5}, ["payload.content", "payload.role"]),
    ("terminal.output", {"command": "", "exit_code": None}, ["payload.command"]), ("terminal.output", {"command": "x", "exit_code": 1.5, "output_digest": "y" * 2001}, ["payload.exit_code", "payload.output_digest"]),
    ("test.results", {"passed": 1, "failed": -1}, ["payload.failed"]), ("test.results", {"passed": True, "failed": 0}, ["payload.passed"]), ("conversation.tool_result", {"call_id": "c", "ok": "yes"}, ["payload.ok"]),
    ("explicit.remember", {"content": "x", "importance": 1.5, "type": "semantic", "tags": ["a"]}, ["payload.importance"]), ("explicit.remember", {"content": "x", "importance": 1}, []),
    ("document.added", {"path": "a", "uri": "b", "mime": "m"}, ["payload.path or uri"]), ("document.added", {"path": "a", "mime": "m", "content_digest": ""}, []), ("file.changed", {"path": "a", "change": "touched"}, ["payload.change"]), ("raw.unknown", {"x": 1}, []),
])
def test_fields_of_a_wrong_type_are_issues(spark, kind, payload, issues):
    row = spark.createDataFrame([(1, kind, json.dumps(payload), NOW)], "id long, kind string, payload string, occurred_at timestamp_ntz")
    assert extraction.validated(row, typed=True).first()["issues"] == issues


def test_texts_that_are_no_json_are_one_issue(spark):
    rows = spark.createDataFrame([(1, "file.changed", "{", NOW), (2, "session.start", None, NOW)], "id long, kind string, payload string, occurred_at timestamp_ntz")
    assert all("payload" in r["issues"] for r in extraction.validated(rows, typed=True).collect())


# ---- git records, embeddings, rows by natural keys

@pytest.mark.parametrize(("listing", "want"), [
    ("", []), ("M\0a b.py\0R100\0old.py\0new.py\0A\0x\0", [("old.py", "new.py")]), ("C75\0a\0b\0R1\0c\0d/e\0", [("c", "d/e")]), ("R100\0old.py\0", None), ("M\0a", None), ("Z\0a\0", None), ("M\0../a\0", None), ("R\0/a\0b\0", None), ("M\0", None),
])
def test_renames_of_a_diff(spark, listing, want):
    got = spark.createDataFrame([(listing,)], "t string").select(repository.rename_entries(F.col("t")).alias("r")).first()["r"]
    assert (None if got is None else [tuple(x) for x in got]) == want


@pytest.mark.parametrize(("listing", "want"), [("", []), ("a\0b c/d\n\0", ["a", "b c/d\n"]), ("a", None), ("a\0\0", None), ("a/./b\0", None), ("C:x\0", None), ("..a\0.b\0", ["..a", ".b"])])
def test_paths_of_a_listing(spark, listing, want):
    assert spark.createDataFrame([(listing,)], "t string").select(repository.path_entries(F.col("t")).alias("r")).first()["r"] == want


def test_contents_are_embedded_once_and_refusals_told(spark):
    rows = [(1, "h1", "one"), (2, "h1", "one"), (3, "h2", "bad"), (4, "h3", "nan"), (5, "h4", "there"), (6, "h5", None)]
    m = spark.createDataFrame(rows, "id long, content_hash string, content string")
    have = spark.createDataFrame([(5, "m", "r"), (1, "m", "old"), (2, "other", "r")], "id long, model string, revision string")
    embed = store.by_batches(lambda texts: [[1.0] if t == "bad" else [float("nan"), 1.0] if t == "nan" else [float(len(t)), 1.0] for t in texts], size=2)
    good, refused = store.reembedded(m, have, embed, "m", "r", 2)
    assert {r["id"]: r["embedding"] for r in good.collect()} == {1: [3.0, 1.0], 2: [3.0, 1.0], 6: [0.0, 1.0]}
    assert {(r["id"], r["reason"]) for r in refused.collect()} == {(3, "dimension"), (4, "not finite")}
    for wanted in ({"model": "x"}, {"revision": "x"}):
        with pytest.raises(store.StaleJob):
            store.reembedded(m, have, embed, "m", "r", 2, wanted)
    with pytest.raises(Exception, match="gave 1 vectors for 2 texts"):
        store.reembedded(m, have, store.by_batches(lambda texts: [[1.0, 2.0]], 2), "m", "r", 2)


def test_rows_by_their_natural_key(spark, tmp_path):
    fields = "id long, kind string, uri string"
    table = Versioned.create(spark.createDataFrame([(1, "file", "a")], fields), f"file://{tmp_path}/s", buckets=2)
    out = mutations.get_or_create(table, spark.createDataFrame([(5, "file", "a"), (6, "file", None), (7, "file", None), (8, "tool", "a")], fields), ["kind", "uri"])
    assert {(r["id"], r["stands"], r["outcome"]) for r in out.collect()} == {(5, 1, "exists"), (6, 6, "created"), (7, 6, "exists"), (8, 8, "created")}
    assert sorted(r["id"] for r in table.read().collect()) == [1, 6, 8]
    assert store.raw_events(spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "id long, project_id string"), "p").first()["n"] == 1


# ---- gates

def test_all_gates_have_a_value_and_empty_runs_too(spark):
    outcome = "query_id long, kind string, returned array<long>, expected array<long>, forbidden array<long>, used int, budget int, oracle int, satisfied boolean"
    rows = [(1, "decision", [1, 2, 3, 4, 5], [1], [9], 50, 100, 25, True), (2, "failure", [7, 1, 2, 3, 4], [1, 8], [7], 150, 100, 10, False)]
    returned = spark.createDataFrame([(1, 1, "p", "p"), (1, 2, "q", "p"), (2, 1, "q", "p")], "query_id long, pos int, project_id string, wanted string")
    flag = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} boolean")
    counts = spark.createDataFrame([("stale_cited_memories", 2)], "metric string, n long")
    run = spark.createDataFrame(rows, outcome)
    got = {r["metric"]: (round(r["value"], 4), r["passed"]) for r in metrics.gated(metrics.gate_values(run, returned, flag("correct", True), flag("correct", True, False), flag("done", False), counts), metrics.GATES).collect()}
    assert set(got) == set(metrics.GATES) and len(got) == 21
    assert got["retrieval_precision_decision"] == (0.2, False) and got["retrieval_recall_failure"] == (0.5, False) and got["token_budget_compliance_failure"] == (0.0, False)
    assert got["token_oracle_gap_mean"] == (2.0, True) and got["cross_project_top1_rate"] == (0.5, False) and got["stale_cited_memories"] == (2.0, False) and got["duplicate_surfaced_pairs"] == (0.0, True)
    none = metrics.gate_values(run.limit(0), returned.limit(0), flag("correct"), flag("correct"), flag("done"), counts.limit(0)).collect()
    assert len(none) == 21 and all(r["value"] == 0 for r in none)


def test_skill_invariants(spark):
    good = "title\n" + "\n\n".join(f"## {s}\nabout {s}" for s in skills.SECTIONS) + "\n"
    cases = spark.createDataFrame([("a", None, "fix-a"), ("b", "divergent_solutions", None)], "key string, reason string, name string")
    docs = spark.createDataFrame([("fix-a", good, good)], "name string, markdown string, again string")
    probes = spark.createDataFrame([("fix-a", "Commands", "about Commands"), ("fix-a", "Procedure", "about Procedure")], "name string, section string, text string")
    said = lambda *a: {r["metric"]: (r["value"], r["passed"]) for r in skills.evaluation(*a).collect()}
    assert set(said(cases, cases, docs, probes).values()) == {(1.0, True)} and len(said(cases, cases, docs, probes)) == 6
    wrong = said(cases, cases.limit(0), docs.withColumn("again", F.lit("x")), probes.withColumn("text", F.lit("about Procedure")))
    assert wrong["gate_accuracy"] == (0.0, False) and wrong["canonical_stability"] == (0.0, False) and wrong["content_grounding"] == (0.5, False) and wrong["compactness"] == (1.0, True)
    assert set(said(cases.limit(0), cases.limit(0), docs.limit(0), probes.limit(0)).values()) == {(1.0, True)}

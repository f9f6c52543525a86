from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring, text
from lodestone.operators import contradiction, graph, lifecycle, memory, packing


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_failure_messages_lose_trivial_variation(spark):
    say = lambda m: one(spark, text.failure_message(F.col("m")), m=m)
    assert say("Error at /a/b.ts:12:5 in 30ms  x") == say("error at ./c/d.ts:1:99 in 1.5s x")
    assert say("host 10.0.0.1:8080 gone") == "host <host>:<port> gone"
    assert say("id 0xdeadbeef") == "id <hex>"
    assert len(say("x" * 400)) == 299


@pytest.mark.parametrize(("query", "intent"), [
    ("how to fix the error when it failed", "failure"), ("why did we choose this", "decision"), ("nothing here", "fact"), ("", "fact"),
    ("the error before", "history"),
])
def test_intents_and_ties(spark, query, intent):
    assert one(spark, text.intent(F.col("q")), q=query) == intent


def test_templates_and_numbers(spark):
    assert one(spark, text.template(F.col("s")), s=" Node  v20.1 runs ") == "node v<#> runs"
    assert one(spark, text.numbers(F.col("s")), s="a 20.1 b 3") == ["20.1", "3"]


def test_excluded_paths(spark):
    for path, out in (("a/.env.local", True), ("deploy/aws_credentials.json", True), ("src/main.py", False), ("C:\\k\\id_rsa", True), ("keys.pem.txt", False)):
        assert one(spark, text.is_excluded(F.col("p")), p=path) is out


def test_cosine_of_odd_vectors(spark):
    c = lambda a, b: one(spark, scoring.cosine(F.col("a"), F.col("b")), a=a, b=b)
    assert c([1.0, 0.0], [0.0, 0.0]) == 0.0
    assert c([1.0], [1.0, 2.0]) == 0.0
    assert c([1.0, 1.0], [2.0, 2.0]) == pytest.approx(1.0)


def test_history_follows_chains_and_survives_cycles(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, None), (8, 9), (9, 8), (5, 77)], "id long, superseded_by long")
    got = {r.id: r.tip for r in memory.history(chain, 8).collect()}
    assert (got[1], got[2], got[3], got[5]) == (3, 3, 3, 77)
    assert got[8] in (8, 9)


def test_version_log_as_of(spark):
    log = spark.createDataFrame([(1, 1, "create", "2024-01-01", "a"), (1, 2, "update", "2024-02-01", "b"), (1, 3, "purge", "2024-03-01", None), (2, 1, "create", "2024-01-05", None)], "id long, seq long, op string, at string, status string")
    log = log.withColumn("at", F.col("at").cast("timestamp_ntz"))
    assert {r.id: r.status for r in memory.folded(log, ["status"]).collect()} == {2: None}
    assert {r.id: r.status for r in memory.folded(log, ["status"], "2024-02-15").collect()} == {1: "b", 2: None}


def test_inserts_compare_nulls_and_batches(spark):
    rows = spark.createDataFrame([(1, None, "x", 1), (2, None, "x", 0), (3, "p", "x", 0), (4, "p", "y", 0)], "id long, project string, h string, occurred_at long")
    present = spark.createDataFrame([("p", "y")], "project string, h string")
    assert sorted(r.id for r in memory.inserted(rows, present, ["project", "h"]).collect()) == [2, 3]


def test_expansion_caps_and_hops(spark):
    edges = spark.createDataFrame([(1, 2, 10), (2, 3, 11), (3, 4, 12), (1, 5, 9)], "src long, dst long, id long")
    seeds = spark.createDataFrame([(1,)], "id long")
    assert {(r.id, r.hop) for r in graph.expanded(edges, seeds).collect()} == {(1, 0), (2, 1), (5, 1), (3, 2)}
    assert {(r.id, r.hop) for r in graph.expanded(edges, seeds, cap=1).collect()} == {(1, 0), (5, 1)}


def test_renames_need_single_copies(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2")], "path string, blob string")
    after = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, blob string")
    diff = lifecycle.snapshot_diff(before, after)
    assert [(r.from_path, r.to_path) for r in lifecycle.renames(diff).collect()] == [("a", "x")]


def test_resolution_closes_a_chain_and_ties(spark):
    m = spark.createDataFrame(
        [(1, "tool 20", "2024-01-01", 0.5), (2, "tool 22", "2024-02-01", 0.5), (3, "tool 24", "2024-03-01", 0.5), (7, "lib 1", "2024-01-01", 0.5), (8, "lib 2", "2024-01-01", 0.5)],
        "id long, content string, at string, confidence double")
    m = m.select("id", "content", "confidence", F.lit("semantic").alias("type"), F.lit("tool").alias("source_kind"), F.col("at").cast("timestamp_ntz").alias("observed_at"),
                 F.col("at").cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_until"), F.lit("p").alias("project_id"), F.lit(None).cast("string").alias("user_id"))
    got = {r.id: (r.outcome, r.winner) for r in contradiction.settled(m).collect()}
    assert got == {1: ("superseded", 2), 2: ("superseded", 3), 7: ("disputed", None), 8: ("disputed", None)}


def test_packing_never_passes_the_budget():
    rng = random.Random(11)
    for _ in range(200):
        items = [{"id": k, "title": "t" * rng.randint(0, 60), "summary": "s" * rng.randint(0, 200), "content": "c" * rng.randint(0, 900), "score": rng.random()} for k in range(rng.randint(0, 30))]
        budget = rng.randint(0, 400)
        out, used = packing.pack(items, budget, heads=10, overflow=5)
        assert used == sum(x["tokens"] for x in out) <= budget
        assert [x["id"] for x in out] == sorted(x["id"] for x in out)
        assert sum(x["kind"] == "title-only" for x in out) <= 5


def test_empty_tables(spark):
    none = spark.createDataFrame([], "src long, dst long, id long")
    assert graph.expanded(none, spark.createDataFrame([], "id long")).count() == 0
    assert memory.history(spark.createDataFrame([], "id long, superseded_by long")).count() == 0


def test_secrets_are_redacted_by_exact_spans():
    from lodestone.operators import redaction

    key = "AKIA" + "A" * 16
    assert redaction.redact(f"use {key} now") == "use [REDACTED:api-key] now"
    assert redaction.redact("--password hunter2 and PASSWORD='x y'") == "--password [REDACTED:password] and PASSWORD=[REDACTED:password]"
    assert redaction.redact("postgres://u:p@h/db next") == "[REDACTED:connection-string] next"
    assert redaction.redact("color = red; API_KEY=abc123") == "color = red; API_KEY=[REDACTED:api-key]"
    once = redaction.redact("GITHUB_TOKEN: abcdef Bearer " + "z" * 20)
    assert redaction.redact(once) == once and "abcdef" not in once


@pytest.mark.parametrize(("query", "scope"), [
    ("what last year", ("2023-01-01", "2024-01-01")), ("3 weeks ago", ("2024-06-10", "2024-07-01")), ("in 2025-03-15", ("2025-03-01", "2025-03-15")),
    ("before 2025", (None, "2026-01-01")), ("since 2024-12", ("2024-12-01", None)), ("in 2023-12", ("2023-12-01", "2024-01-01")),
])
def test_time_scopes(query, scope):
    from datetime import datetime

    from lodestone.functions.scopes import time_scope

    got = time_scope(query, datetime(2024, 7, 1))
    assert tuple(got.get(k) and got[k].strftime("%Y-%m-%d") for k in ("from", "until")) == scope
    assert time_scope("nothing", datetime(2024, 7, 1)) is None and time_scope("now", datetime(2024, 7, 1)) == {"mode": "current"}


def test_summaries_keep_whole_sentences(spark):
    from lodestone.functions import scopes

    say = lambda t: one(spark, scopes.summary(F.col("t"), 20), t=t)
    assert say("One two. Three four. Five six seven.") == "One two. Three four."
    assert say("A sentence that is much too long to fit. B.") == "A sentence that is much too long to fit."
    assert say("  ") == ""
    assert one(spark, scopes.label(F.col("t"), 10), t="alpha beta gamma delta") == "alpha beta…"


def test_redaction_column_keeps_nulls(spark):
    from lodestone.operators import redaction

    rows = spark.createDataFrame([("pwd=abc",), (None,), ("plain",)], "t string").select(redaction.redacted(F.col("t")).alias("r")).collect()
    assert [(x.r.text, len(x.r.records)) for x in rows] == [("pwd=[REDACTED:password]", 1), (None, 0), ("plain", 0)]


def test_contexts_and_digests_keep_their_budget():
    from lodestone.operators import context

    rng = random.Random(3)
    for _ in range(100):
        lines = {k: ["- " + "x" * rng.randint(0, 200) for _ in range(rng.randint(0, 8))] for k, _, _ in context.SECTIONS}
        budget = rng.randint(20, 800)
        parts, used = context.packed_sections(lines, budget)
        assert used == sum(packing.estimate(x) for _, p in parts for x in p) <= budget
        text, used = context.packed_digest("p", lines, budget)
        assert packing.estimate(text) <= used <= budget
        assert all(t not in text.split("\n") or text.split("\n").index(t) + 1 < len(text.split("\n")) for _, _, t in context.DIGEST)


def test_extraction_expressions(spark):
    from lodestone.functions import extraction as e

    say = lambda c, t: one(spark, c, t=t)
    t = F.col("t")
    assert say(e.command(t), "git commit -m x") == "git commit" and say(e.command(t), "/bin/ls a") == "" and say(e.command(t), "a b c d") == "a b c"
    assert say(e.is_denied(t), "git log") and not say(e.is_denied(t), "git push")
    assert say(e.technologies(t), "We moved from Next.js to golang, with postgres") == ["Next.js", "Go", "PostgreSQL"]
    assert say(e.technologies(t), "postgresqlx") == []
    assert say(e.slug(t), "The build (v2) FAILED: a -- twice again and again") == "the-build-v2-failed----twice"
    assert say(e.module_of(t), "a/b/c.py") == "a/b" and say(e.module_of(t), "c.py") == "(root)"
    assert say(e.first_symbol(t, F.array(F.lit("Credentials"), F.lit("verify"))), "verifyCredentials then verify()") == "verify"
    assert say(e.event_text(F.lit("git.commit"), t), '{"sha":"0123456789","message":"fix"}') == "commit 01234567: fix"

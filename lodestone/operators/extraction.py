"""Heuristic extraction of memories from events, rule by rule, as DataFrames.

Events have id, kind, payload (JSON), occurred_at, session_id and project_id. ``normalized`` reads what the rules
need once; each rule is a projection, or a grouping by project and session, of those rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import extraction as rules
from ..functions import text
from ..functions.extraction import CLAUSE_BREAK, DECISION_NOISE, DECISIONS, OPTION_NOISE, RATIONALE, REJECTION
from .lifecycle import first_success_after
from .lineage import cut

# Known kinds of events, and the fields that a payload of each must have.
REQUIRED = {
    "conversation.message": ("role", "content"), "conversation.tool_call": ("tool",), "conversation.tool_result": ("call_id", "ok"), "terminal.output": ("command",),
    "error.raised": ("origin", "message"), "test.results": ("passed", "failed"), "file.changed": ("path", "change"), "git.commit": ("sha", "message"),
    "pull_request": ("number", "title"), "document.added": (), "explicit.remember": ("content",), "explicit.forget": ("memory_id",),
    "session.start": (), "session.end": (), "raw.unknown": (),
}
# What payload fields may be. A tuple lists choices; a number is the most characters of a text.
TYPES = {
    "conversation.message": {"role": ("user", "assistant"), "content": "text", "mentions": "list", "summary": "text"},
    "conversation.tool_call": {"tool": "filled", "call_id": "filled", "arguments_digest": 400},
    "conversation.tool_result": {"call_id": "filled", "ok": "flag", "output_digest": 2000, "tool": 80},
    "terminal.output": {"command": "filled", "exit_code": "whole", "output_digest": 2000, "shell": "text"},
    "error.raised": {"origin": ("terminal", "test", "build", "runtime", "tool"), "message": "filled", "context": 500, "stack_digest": "text"},
    "test.results": {"framework": "text", "passed": "count", "failed": "count", "skipped": "count", "failures": "list"},
    "file.changed": {"path": "filled", "change": ("created", "modified", "deleted", "renamed"), "old_path": "text", "lines_added": "whole", "lines_removed": "whole"},
    "git.commit": {"sha": "filled", "message": "text", "author_name": "text", "files": "list"},
    "pull_request": {"number": "whole", "title": "text", "state": ("opened", "merged", "closed"), "repo": "text", "review_digest": 1000},
    "document.added": {"path": "text", "uri": "text", "mime": "text", "title": "text", "content_digest": "text"},
    "explicit.remember": {"content": "filled", "type": ("semantic", "procedural", "decision", "preference", "failure"), "importance": "share", "tags": "list", "scope": ("project", "user", "global")},
    "explicit.forget": {"purge": "flag", "reason": "text"},
    "session.start": {"cwd": "filled", "project_hint": "text", "summary": "text"},
    "session.end": {"cwd": "filled", "project_hint": "text", "summary": "text"},
}
MOST_ALTERNATIVES, LONGEST_DECISION, LONGEST_OPTION, LONGEST_RATIONALE, WINDOW = 3, 200, 120, 200, 400
EVIDENCE, STACK = 200, 3


def _holds(value: Column, rule) -> Column:
    """Whether a payload's field, as a variant, is what it may be."""
    kind = F.schema_of_variant(value)
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    if isinstance(rule, tuple):
        return (kind == "STRING") & text.isin(*rule)
    if isinstance(rule, int):
        return (kind == "STRING") & (F.char_length(text) <= rule)
    whole = (kind == "BIGINT") | (kind.rlike("^(?:DECIMAL|DOUBLE)") & (number == F.floor(number)))
    return {
        "text": kind == "STRING", "filled": (kind == "STRING") & (text != ""), "flag": kind == "BOOLEAN", "list": kind.startswith("ARRAY"), "whole": whole, "count": whole & (number >= 0),
        "share": kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE)") & number.between(0, 1),
    }[rule]


def mistyped(kind: Column, payload: Column) -> Column:
    """Payload fields that are there and not what they may be, as issues, by name; a field that is null counts as
    absent, and a document needs one of path and uri."""

    def found(v):
        field = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
        there = lambda name: field(name).isNotNull() & ~F.is_variant_null(field(name))
        wrong = {k: [F.when(there(n) & ~F.coalesce(_holds(field(n), rule), F.lit(False)), f"payload.{n}") for n, rule in sorted(fields.items())] for k, fields in TYPES.items()}
        wrong["document.added"].append(F.when(there("path") == there("uri"), "payload.path or uri"))
        out = None
        for k, issues in wrong.items():
            case = F.array_compact(F.array(*issues))
            out = F.when(kind == k, case) if out is None else out.when(kind == k, case)
        return out.otherwise(F.array().cast("array<string>"))

    return F.coalesce(text.once(F.try_parse_json(payload), found), F.array().cast("array<string>"))


def validated(events: DataFrame, typed: bool = False) -> DataFrame:
    """Events with stored_kind and issues: an unknown kind becomes raw.unknown; what an envelope (id, occurred_at) or
    a payload lacks is an issue, and an event with issues is a dead letter. With ``typed``, fields of a wrong type,
    length or choice are issues too."""
    known = F.col("kind").isin(*REQUIRED)
    kind = F.when(known, F.col("kind")).otherwise("raw.unknown")
    lacks = lambda name: F.get_json_object("payload", f"$.{name}").isNull()
    wants = [F.when((F.col("kind") == k) & lacks(name), f"payload.{name}") for k, names in REQUIRED.items() for name in names]
    issues = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in ("id", "occurred_at")), F.when(F.col("payload").isNull() | ~F.get_json_object("payload", "$").isNotNull(), "payload"), *wants))
    if typed:
        issues = F.array_union(issues, mistyped(F.col("kind"), F.col("payload")))
    return events.withColumn("stored_kind", kind).withColumn("issues", issues)


def normalized(events: DataFrame) -> DataFrame:
    """Events with their matching text, prose (with its role), command, exit code, error, tests, tool result, file
    and document, each null where the kind has none."""
    of = lambda *kinds: F.col("kind").isin(*kinds)
    get = lambda name, *kinds: F.when(of(*kinds), F.get_json_object("payload", f"$.{name}"))
    role = F.when(of("conversation.message"), F.when(F.get_json_object("payload", "$.role") == "user", "user").otherwise("assistant")).when(of("document.added"), "document").when(of("session.end"), "session")
    prose = F.coalesce(get("content", "conversation.message"), get("content_digest", "document.added"), get("summary", "session.end"))
    command = get("command", "terminal.output")
    return events.select(
        "*", rules.event_text(F.col("kind"), F.col("payload")).alias("text"), role.alias("role"), prose.alias("prose"), command.alias("command"), rules.command(command).alias("normal"),
        get("exit_code", "terminal.output").cast("int").alias("exit_code"), get("origin", "error.raised").alias("origin"), get("message", "error.raised").alias("error"), get("context", "error.raised").alias("context"),
        get("passed", "test.results").cast("int").alias("passed"), get("failed", "test.results").cast("int").alias("failed"), get("framework", "test.results").alias("framework"),
        get("tool", "conversation.tool_result").alias("tool"), get("ok", "conversation.tool_result").cast("boolean").alias("ok"), get("error.message", "conversation.tool_result").alias("tool_error"),
        get("output_digest", "conversation.tool_result", "terminal.output").alias("output"), get("path", "file.changed").alias("path"), get("change", "file.changed").alias("change"))


def incident() -> Column:
    """What failed in an event (origin, message, label), null if nothing did."""
    part = lambda origin, message, label: F.struct(F.lit(origin).alias("origin"), message.alias("message"), label.alias("label"))
    detail = F.trim(F.coalesce("tool_error", "output", F.lit("")))
    named = F.concat(F.coalesce("framework", F.lit("tests")), F.lit(": "), F.col("failed").cast("string"), F.lit(" failed"))
    said = F.when(detail == "", "tool call failed").otherwise(detail)
    return (F.when(F.col("error").isNotNull(), F.struct(F.coalesce("origin", F.lit("runtime")).alias("origin"), F.concat_ws(" ", "error", "context").alias("message"), F.col("error").alias("label")))
            .when(F.col("exit_code") != 0, part("command", F.col("text"), F.concat(F.lit("`"), "command", F.lit("` failed"))))
            .when(F.col("failed") > 0, part("test", named, F.lit("tests failed")))
            .when(F.col("ok") == F.lit(False), part("tool", said, F.concat_ws(" failed: ", F.coalesce("tool", F.lit("tool call")), said))))


def succeeded() -> Column:
    return F.coalesce((F.col("exit_code") == 0) | (F.col("failed") == 0) | F.col("ok"), F.lit(False))


def _clean(phrase: Column, most: int) -> Column:
    """A phrase in one line without the marks around it."""
    plain = F.trim(F.regexp_replace(phrase, r"\s+", " "))
    plain = F.regexp_replace(F.regexp_replace(plain, "^[\\s'\"`(\\[{<—–]+", ""), "[\\s'\"`)\\]}>—–.,;:!?]+$", "")
    return F.trim(F.left(plain, F.lit(most)))


def _split(phrase: Column) -> tuple[Column, Column]:
    """An option and the reason after a connective, if no other clause stands between them."""
    before = F.split(phrase, rf"(?i)\s+{RATIONALE}\s+", 2)
    head = F.get(before, F.lit(0))
    alone = ~head.rlike(f"(?i){CLAUSE_BREAK}")
    return F.get(F.split(head, f"(?i){CLAUSE_BREAK}", 2), F.lit(0)), F.when(alone, F.get(before, F.lit(1)))


def decision(prose: Column) -> Column:
    """The decision in a text: decision, rationale, and alternatives (option, why_rejected); null for none.

    The first pattern that matches gives the chosen option and maybe one it was chosen over; a reason is looked for
    in the rest of the clause; options said to be ruled out in what follows are alternatives as well.
    """
    cases = [(prose.rlike(f"(?i){p}"), F.struct(*(F.regexp_extract(prose, f"(?i){p}", k if k < 2 or k == 2 and p.count("([^") > 1 else 0).alias(n) for k, n in enumerate(("all", "chosen", "over"))))) for p in DECISIONS]
    two = [p.count("([^") > 1 for p in DECISIONS]
    cases = [(c, F.struct(s["all"].alias("all"), s["chosen"].alias("chosen"), F.when(F.lit(t), s["over"]).alias("over"))) for (c, s), t in zip(cases, two, strict=True)]
    match = reduce(lambda a, c: a.when(*c), cases[1:], F.when(*cases[0]))

    def built(m):
        option, reason = _split(m["chosen"])
        other, other_reason = _split(m["over"])
        at = F.instr(prose, m["all"])
        clause = F.get(F.split(F.substr(prose, at + F.char_length(m["all"])), r"[.!?\n]", 2), F.lit(0))
        found = F.nullif(F.regexp_extract(clause, rf"(?i)\b{RATIONALE}\s+([^.!?\n]{{3,200}})", 1), F.lit(""))
        rationale = F.nullif(_clean(F.get(F.split(F.coalesce(found, reason, other_reason), f"(?i){CLAUSE_BREAK}", 2), F.lit(0)), LONGEST_RATIONALE), F.lit(""))
        chosen = _clean(F.regexp_replace(option, r"(?i)^to\s+", ""), LONGEST_DECISION)
        window = F.substr(prose, F.greatest(at, F.lit(1)), F.lit(WINDOW))
        ruled_out = F.arrays_zip(F.regexp_extract_all(window, F.lit(f"(?i){REJECTION}"), 1).alias("o"), F.regexp_extract_all(window, F.lit(f"(?i){REJECTION}"), 2).alias("w"))
        names = lambda r, o: F.coalesce(F.arrays_overlap(rules.significant(r), rules.significant(o)), F.lit(False))

        def alternatives(z):
            first = F.when(z["over"].isNotNull(), F.array(F.struct(_clean(z["over"], LONGEST_OPTION).alias("option"), F.when(names(z["why"], z["over"]), z["why"]).alias("why_rejected"))))
            more = F.transform(ruled_out, lambda x: F.struct(_clean(x["o"], LONGEST_OPTION).alias("option"), F.nullif(_clean(F.get(F.split(x["w"], f"(?i){CLAUSE_BREAK}", 2), F.lit(0)), LONGEST_RATIONALE), F.lit("")).alias("why_rejected")))
            usable = F.filter(F.concat(F.coalesce(first, F.array().cast("array<struct<option:string,why_rejected:string>>")), more), lambda x: (F.char_length(x["option"]) >= 2) & ~F.lower(x["option"]).isin(*OPTION_NOISE) & (F.lower(x["option"]) != F.lower(z["chosen"])))
            once = F.filter(usable, lambda x, k: F.array_position(F.transform(usable, lambda y: F.lower(y["option"])), F.lower(x["option"])) == k + 1)
            return F.when(F.char_length(z["chosen"]) >= 2, F.struct(z["chosen"].alias("decision"), z["why"].alias("rationale"), F.slice(once, 1, MOST_ALTERNATIVES).alias("alternatives")))

        return text.once(F.struct(chosen.alias("chosen"), rationale.alias("why"), other.alias("over")), alternatives)

    return F.when(~rules.matched(prose, DECISION_NOISE) & match.isNotNull(), text.once(match, built))


def decision_content(d: Column) -> Column:
    """The statement of a decision: the option, the first alternative, the reason, other alternatives."""
    options = F.transform(d["alternatives"], lambda x: x["option"])
    rest = F.slice(options, 2, MOST_ALTERNATIVES)
    return F.concat(
        F.lit("Decision: "), d["decision"], F.coalesce(F.concat(F.lit(" over "), F.get(options, F.lit(0))), F.lit("")), F.coalesce(F.concat(F.lit(" — because "), d["rationale"]), F.lit("")),
        F.when(F.size(rest) > 0, F.concat(F.lit(" — also rejected: "), F.array_join(rest, ", "))).otherwise(""))


def sentence_around(prose: Column, part: Column, most: int = 300) -> Column:
    """The sentence of a text that holds a part, in one line."""
    at = F.instr(prose, part)
    before = F.regexp_extract(F.substr(prose, F.lit(1), at - 1), r"([^.!?\n]*)$", 1)
    after = F.regexp_extract(F.substr(prose, at + F.char_length(part)), r"^([^.!?\n]*[.!?\n]?)", 1)
    return F.left(F.trim(F.regexp_replace(F.concat(before, part, after), r"\s+", " ")), F.lit(most))


def evidence(source: Column, excerpt: Column) -> Column:
    """Where a candidate comes from: source, kind and locator of its event, and a short excerpt."""
    plain = F.trim(F.regexp_replace(excerpt, r"\s+", " "))
    short = F.when(F.char_length(plain) > EVIDENCE, F.concat(F.left(plain, F.lit(EVIDENCE - 1)), F.lit("…"))).otherwise(plain)
    commit = F.col("kind") == "git.commit"
    locator = F.when(commit, F.concat(F.lit("commit:"), F.coalesce(F.get_json_object("payload", "$.sha"), F.col("id").cast("string")))).otherwise(F.concat(F.lit("event:"), F.col("id").cast("string")))
    kind = F.when(commit, "commit").when(F.col("kind") == "conversation.message", "message").otherwise("event")
    return F.struct(source.alias("source_id"), kind.alias("kind"), locator.alias("locator"), short.alias("excerpt"))


def with_evidence(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Candidates with ``evidence``: where each event that they cite is and an excerpt of it, in order of events."""
    key = F.xxhash64("project_id", "session_id", "id", "rule", "content").alias("key")
    rows = candidates.withColumn("key", key)
    said = events.select(F.col("id").alias("event_id"), evidence(F.concat(F.lit("source:"), F.col("id").cast("string")), rules.event_text(F.col("kind"), F.col("payload"))).alias("span"))
    each = rows.select("key", F.explode("cited").alias("event_id")).join(said, "event_id")
    spans = each.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "span"))), lambda x: x["span"]).alias("evidence"))
    return rows.join(spans, "key", "left").drop("key")


def recoveries(e: DataFrame) -> DataFrame:
    """Failures of normalised events with the first later success of their session that repeats the same thing: the
    command word for word (an error names it in its context), the framework's tests, or the tool."""
    context = F.trim(F.regexp_replace(F.regexp_replace(F.trim("context"), r"(?i)^codex:\s*", ""), r"\s+in\s+(?=[./~]|[\w.-]+/)[\w.@~/-]+$", ""))
    ran = F.when(F.col("command").isNotNull(), F.trim("command")).otherwise(F.when(F.col("error").isNotNull(), context))
    rows = e.withColumn("incident", incident())
    passed = F.coalesce(((F.col("exit_code") == 0) | ((F.col("failed") == 0) & (F.col("passed") > 0)) | F.col("ok")), F.lit(False))
    key = lambda name, value: F.concat(F.lit(name), F.nullif(value, F.lit("")))
    of = F.array_compact(F.array(
        key("run ", F.when(F.col("incident").isNotNull(), ran).otherwise(F.trim("command"))),
        key("tests ", F.when(F.col("failed").isNotNull(), F.col("framework"))), key("tool ", F.when(F.col("ok").isNotNull(), F.col("tool")))))
    return first_success_after(rows.select("project_id", "session_id", "id", "occurred_at", "incident", passed.alias("good"), of.alias("of")), F.col("incident").isNotNull(), F.col("good") & F.col("incident").isNull(), ["project_id", "session_id"], F.col("of"))


def failure_payloads(events: DataFrame) -> DataFrame:
    """What is stored with a failure: problem, context, solution, verification, status, signature and times.

    A command that ran again, or tests that passed again, verify the solution; a tool that answered again only
    mitigates the failure; without a success it is open. The context has observed fields only.
    """
    e = cut(normalized(events))
    good = e.select(F.col("id").alias("success_id"), F.col("command").alias("ran"), F.col("output").alias("said"), F.col("framework").alias("suite"), F.col("passed").alias("n"), F.col("tool").alias("by"))
    rows = e.withColumn("incident", incident()).where("incident IS NOT NULL").join(recoveries(e).select(F.col("failure_id").alias("id"), "success_id"), "id").join(good, "success_id", "left")
    message = text.failure_message(F.col("incident.message"))
    kind = text.failure_class(message, F.col("incident.origin"))
    more = F.when(F.trim(F.coalesce("said", F.lit(""))) != "", F.concat(F.lit(": "), "said")).otherwise("")
    by_run, by_tests, by_tool = F.col("ran").isNotNull(), F.col("suite").isNotNull(), F.col("by").isNotNull()
    solution = (F.when(by_run, F.concat(F.lit("Successful retry: "), "ran")).when(by_tests, F.concat(F.lit("Successful "), "suite", F.lit(" test rerun")))
                .when(by_tool, F.concat(F.lit("Observed successful "), "by", F.lit(" call"))))
    proof = (F.when(by_run, F.concat(F.lit("Command "), "ran", F.lit(" exited 0"), more)).when(by_tests, F.concat("suite", F.lit(": "), F.col("n").cast("string"), F.lit(" passed, 0 failed")))
             .when(by_tool, F.concat(F.lit("Tool "), "by", F.lit(" reported ok: true"), more)))
    status = F.when(F.col("success_id").isNull(), "open").when(by_run | by_tests, "verified").otherwise("mitigated")
    context = F.to_json(F.struct(kind.alias("type"), message.alias("normalized_message"), F.col("incident.origin").alias("origin"), F.col("origin").alias("error_origin"), "tool", "command", F.col("context").alias("detail")))
    return rows.select("id", F.col("incident.label").alias("problem"), context.alias("context"), solution.alias("solution"), proof.alias("verification"), status.alias("status"), text.failure_signature(kind, message).alias("signature"),
                       F.col("occurred_at").alias("first_seen_at"), F.col("occurred_at").alias("last_seen_at"), F.lit(1).alias("occurrences"))


def decision_payloads(events: DataFrame) -> DataFrame:
    """What is stored with a decision: title, decision, alternatives, rationale, decided_at and status, which is
    proposed until a later step accepts it."""
    prose = normalized(events).where("prose IS NOT NULL")
    d = cut(prose.select("id", "occurred_at", decision(F.col("prose")).alias("d"))).where("d IS NOT NULL")
    return d.select("id", F.col("d.decision").alias("title"), "d.decision", "d.alternatives", "d.rationale", F.col("occurred_at").alias("decided_at"), F.lit("proposed").alias("status"))


def subtype(kind: Column, content: Column) -> Column:
    """A candidate's subtype by its type and wording."""
    return (F.when(kind == "decision", F.when(content.rlike(r"(?i)\bover\b|\balternativ"), "decision.choice").otherwise("decision.statement"))
            .when(kind == "preference", "preference.statement")
            .when(kind == "procedural", F.when(content.rlike(r"(?i)\brun|execut|install|deploy|migrat|test"), "procedural.command").otherwise("procedural.sequence"))
            .when(kind == "failure", "failure.observed").when(kind == "semantic_candidate", "semantic.candidate").otherwise("episodic.observation"))


def durable_type(kind: Column, sub: Column) -> Column:
    """The type a candidate is stored as: semantic candidates wait as episodic ones unless a user stated them."""
    return F.when(kind.isin("semantic", "semantic_candidate"), F.when(sub == "semantic.explicit", "semantic").otherwise("episodic")).otherwise(kind)


def _candidate(rows: DataFrame, rule: str, kind: str, sub, content: Column, importance, confidence, about: Column, because: str, also: str | None = None) -> DataFrame:
    """Candidates of a rule; ``also`` is a column with another event that they rest on."""
    cited = F.array_distinct(F.array_compact(F.array("id", also))) if also else F.array("id")
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        "project_id", "session_id", "id", F.lit(rule).alias("rule"), F.lit(kind).alias("type"), lit(sub).alias("subtype"), content.alias("content"),
        lit(importance).cast("double").alias("importance"), lit(confidence).cast("double").alias("confidence"), rules.technologies(about).alias("entities"), F.lit(because).alias("rationale"), cited.alias("cited"))


def extracted(events: DataFrame, repeats: int = 2) -> DataFrame:
    """Candidates of all rules (project_id, session_id, id of the event, rule, type, subtype, content, scores,
    entities, rationale, cited). Groups' candidates carry their first event's id and cite it and the last one; an
    error cites what resolved it."""
    e = cut(normalized(events))  # read by every rule
    user = F.col("role") == "user"
    out = []

    told = e.where("kind = 'explicit.remember'").withColumn("said", F.get_json_object("payload", "$.content")).withColumn("as", F.get_json_object("payload", "$.type"))
    declared = F.when(F.col("as").isin("procedural", "decision", "preference", "failure"), F.col("as")).otherwise("semantic_candidate")
    weight = F.coalesce(F.get_json_object("payload", "$.importance").try_cast("double"), F.lit(0.9))
    row = _candidate(told.withColumn("__type", declared), "explicit", "x", F.when(declared == "semantic_candidate", "semantic.explicit").otherwise(subtype(declared, F.col("said"))), F.col("said"), weight, 0.95, F.col("said"), "stated by the user")
    out.append(row.join(told.select("id", declared.alias("t")), "id").select(*(F.col("t").alias("type") if c == "type" else F.col(c) for c in row.columns)))

    prose = e.where("prose IS NOT NULL")
    decided = cut(prose.select("project_id", "session_id", "id", "role", decision(F.col("prose")).alias("d"))).where("d IS NOT NULL")
    out.append(_candidate(decided, "decision", "decision", F.when(F.size("d.alternatives") > 0, "decision.choice").otherwise("decision.statement"), decision_content(F.col("d")), 0.8, F.when(user, 0.85).otherwise(0.6), decision_content(F.col("d")), "a settled choice"))

    preferred = prose.withColumn("s", preference(F.col("prose"))).where("char_length(trim(s)) >= 3")
    out.append(_candidate(preferred, "preference", "preference", "preference.statement", F.concat(F.lit("Preference: "), "s"), 0.6, F.when(user, 0.7).otherwise(0.5), F.col("s"), "how future work should be done"))

    stated = prose.withColumn("s", rules.version(F.col("prose"))).where("s RLIKE '[0-9]'")
    out.append(_candidate(stated, "version", "semantic_candidate", "semantic.version", F.concat(F.lit("Version: "), "s"), 0.65, F.when(user, 0.7).otherwise(0.6), F.col("s"), "which version is in use"))

    fixed = resolutions(e).where("success_id IS NOT NULL")
    signature = text.failure_class(text.failure_message(F.col("message")), F.col("origin"))
    out.append(_candidate(fixed, "failure", "failure", "failure.resolved", F.concat(signature, F.lit(": "), F.left("label", F.lit(200)), F.lit(" — resolved by event "), F.col("success_id").cast("string")), 0.75, 0.7, F.col("label"), "an error and what resolved it", "success_id"))

    runs = e.where(F.col("normal").isNotNull() & ~rules.is_denied(F.col("normal")))
    by = Window.partitionBy("project_id", "session_id").orderBy("occurred_at", "id")
    pairs = runs.withColumn("pair", F.when(F.lead("normal").over(by).isNotNull(), F.concat("normal", F.lit(" → "), F.lead("normal").over(by)))).where("pair IS NOT NULL")
    sequences = pairs.groupBy("project_id", "session_id", "pair").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.max("id").alias("last")).where(F.col("n") >= repeats)
    out.append(_candidate(sequences, "sequence", "procedural", "procedural.sequence", F.concat(F.lit("Recurring command sequence: `"), "pair", F.lit("` ("), F.col("n").cast("string"), F.lit(" times)")), 0.55, 0.65, F.col("pair"), "a repeatable procedure", "last"))
    inside = sequences.select("project_id", F.explode(F.split("pair", " → ")).alias("normal")).distinct()
    commands = runs.groupBy("project_id", "normal").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.max("id").alias("last")).where(F.col("n") >= repeats)
    commands = commands.join(inside, ["project_id", "normal"], "left_anti").withColumn("session_id", F.lit(None).cast("string"))
    out.append(_candidate(commands, "command", "procedural", "procedural.command", F.concat(F.lit("Recurring command: `"), "normal", F.lit("` (used "), F.col("n").cast("string"), F.lit(" times)")), 0.55, 0.65, F.col("normal"), "a repeatable procedure", "last"))

    label = F.when(F.col("kind") == "git.commit", F.concat(F.lit("commit "), F.substring(F.get_json_object("payload", "$.sha"), 1, 8))).when(F.col("kind") == "pull_request", F.concat(F.lit("PR #"), F.get_json_object("payload", "$.number"))).when(F.col("kind") == "document.added", F.concat(F.lit("document "), F.coalesce(F.get_json_object("payload", "$.title"), F.lit(""))))
    about = F.concat_ws(" ", F.get_json_object("payload", "$.title"), F.get_json_object("payload", "$.message"), F.get_json_object("payload", "$.files"), F.get_json_object("payload", "$.content_digest"))
    stack = e.withColumn("label", label).where("label IS NOT NULL").select("project_id", "session_id", "id", "label", F.explode(F.slice(rules.technologies(about), 1, STACK)).alias("tech"))
    stack = stack.groupBy("project_id", "label", "tech").agg(F.min("id").alias("id"), F.max("id").alias("last")).withColumn("session_id", F.lit(None).cast("string"))
    out.append(_candidate(stack, "stack", "episodic", "episodic.stack", F.concat(F.lit("Uses "), "tech", F.lit(" ("), "label", F.lit(")")), 0.5, 0.5, F.col("tech"), "what the project is made of", "last"))
    return reduce(DataFrame.unionByName, out)


def preference(prose: Column) -> Column:
    """A stated preference, with what it is preferred over; null for none or for noise."""
    hits = [F.when(prose.rlike(f"(?i){p}"), F.concat_ws(" over ", *(F.regexp_extract(prose, f"(?i){p}", k) for k in range(1, p.count("([^") + 1)))) for p in rules.PREFERENCES]
    return F.when(~rules.matched(prose, rules.PREFERENCE_NOISE), F.coalesce(*hits))


def resolutions(e: DataFrame) -> DataFrame:
    """Failures of normalised events with the first later success of their session that is related: the same command,
    a test run, the same tool, or a token in common that isn't the executable."""
    run = F.element_at(F.split("normal", " "), 1)
    tokens = rules.significant(F.coalesce(F.when(F.col("error").isNotNull(), F.concat_ws(" ", "error", "context")), "command", F.lit("")))
    shared = F.concat(
        F.array_compact(F.array(F.concat(F.lit("run "), "normal"), F.when(F.col("failed").isNotNull() | (F.col("origin") == "test"), "tests"), F.concat(F.lit("tool "), "tool"))),
        F.coalesce(F.filter(tokens, lambda x: x != F.coalesce(run, F.lit(""))), F.array().cast("array<string>")))
    rows = e.withColumn("incident", incident())
    found = first_success_after(rows.select("project_id", "session_id", "id", "occurred_at", "incident", succeeded().alias("good"), shared.alias("shared")), F.col("incident").isNotNull(), F.col("good") & F.col("incident").isNull(), ["project_id", "session_id"], F.col("shared"))
    failures = rows.where("incident IS NOT NULL").select("id", "incident.*")
    return found.withColumnRenamed("failure_id", "id").join(failures, "id")


def working_signals(events: DataFrame, most: int = 5) -> DataFrame:
    """Scratch notes of a session, at most ``most`` of a kind: open questions, else hypotheses, else tasks of each
    message, edited files and failures that nothing resolved."""
    e = cut(normalized(events).where("session_id IS NOT NULL"))
    talk = e.where("role IN ('user', 'assistant')")
    asked, guessed, planned = (rules.statement(F.col("prose"), p, group=0) for p in (rules.QUESTIONS, rules.HYPOTHESES, rules.TASKS))
    kind = F.when(asked.isNotNull(), "open_question").when(guessed.isNotNull(), "hypothesis").when(planned.isNotNull(), "task")
    notes = talk.withColumn("signal", kind).where("signal IS NOT NULL").select("session_id", "id", "occurred_at", "signal", F.when(kind == "task", planned).otherwise(sentence_around(F.col("prose"), F.coalesce(asked, guessed))).alias("content"))
    files = e.where("path IS NOT NULL").select("session_id", "id", "occurred_at", F.lit("edited_file").alias("signal"), F.concat(F.lit("Editing "), "path").alias("content"))
    open_ = resolutions(e).where("success_id IS NULL").join(e.select("id", "occurred_at"), "id").select("session_id", "id", "occurred_at", F.lit("unresolved_error").alias("signal"), F.concat(F.lit("Unresolved error: "), "label").alias("content"))
    rows = notes.unionByName(files).unionByName(open_)
    first = Window.partitionBy("session_id", "signal").orderBy("occurred_at", "id")
    return rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).drop("n", "occurred_at")

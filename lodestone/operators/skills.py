"""Skills and derived facts: usage, serving order, status edges, corroborated scores, code references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Legal status changes of a skill.
EDGES = {"candidate": ("verified", "deprecated"), "verified": ("promoted", "deprecated"), "promoted": ("deprecated",), "deprecated": ()}


def may_become(old, new):
    table = F.create_map(*(x for k, v in EDGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    return F.coalesce(F.array_contains(F.try_element_at(table, old), new), F.lit(False))


def usage(events: DataFrame, skills: DataFrame) -> DataFrame:
    """Mentions, distinct sessions and last use of each skill whose name is a token of an event's text.

    Names are looked up among tokens, so no pairs of events and skills are made; a skill nobody mentions
    has zeros.
    """
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\w.-]+"))).alias("name")
    found = events.select("session_id", "occurred_at", words).join(skills.select(F.lower("name").alias("name"), "id"), "name")
    used = found.groupBy("id").agg(F.count("*").alias("mentions"), F.count_distinct("session_id").alias("sessions"), F.max("occurred_at").alias("last_used_at"))
    return skills.select("id").join(used, "id", "left").select("id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("mentions", "sessions")), "last_used_at")


def served(skills: DataFrame, limit: int) -> DataFrame:
    """Promoted before verified skills, the most used, the newest, then by id."""
    rank = F.when(F.col("status") == "promoted", 0).otherwise(1)
    order = [rank, F.col("usage").desc(), F.col("updated_at").desc(), F.col("id")]
    top = skills.where(F.col("status").isin("promoted", "verified")).orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def corroborated(sources: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Scores and times of a fact that several memories state: a little above the strongest, at most 0.95."""
    up = lambda c, by: F.round(F.least(F.lit(0.95), F.max(c) + by), 4)
    g = sources.groupBy(*keys).agg(
        F.count("*").alias("sources"), up("importance", 0.05).alias("importance"), up("confidence", 0.1).alias("confidence"),
        F.max("observed_at").alias("observed_at"), F.min("valid_from").alias("valid_from"))
    return g.where(F.col("sources") >= least)


def code_refs(refs: DataFrame, most: int = 5) -> DataFrame:
    """The first references (id, repository, path) of each memory and one row that counts the rest."""
    order = Window.partitionBy("id").orderBy("repository", "path")
    rows = refs.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("id"))).where(F.col("k") <= most + 1)
    rest = F.concat(F.lit("<"), (F.col("n") - most).cast("string"), F.lit(" more refs>"))
    return rows.select("id", F.col("k").alias("position"), "repository", F.when(F.col("k") <= most, F.col("path")).otherwise(rest).alias("path"))


def project_of(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """The project with the deepest root that holds each path (id, path), whole segments only.

    A path's own prefixes are looked up among the roots; a path without a project has null.
    """
    parts = F.split("path", "/")
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("root")))).alias("p")
    found = paths.select("id", ends).select("id", "p.*").join(projects.select("root", "project"), "root")
    best = found.groupBy("id").agg(F.max_by("project", "depth").alias("project"))
    return paths.select("id").join(best, "id", "left")


def reranked(ranked: DataFrame, order: DataFrame) -> DataFrame:
    """Reranked ids first in their new order, then the rest as they were (id, rank; id, position)."""
    rows = ranked.join(order, "id", "left")
    return rows.select("id", F.row_number().over(Window.orderBy(F.col("position").asc_nulls_last(), "rank")).alias("rank"))


def freshness(skills: DataFrame, failures: DataFrame) -> DataFrame:
    """Whether a served skill's signatures (id, signatures) still recur among the failures (signature, at).

    A skill is stale if it has signatures and none recurs; without any it can't be judged.
    """
    seen = failures.groupBy("signature").agg(F.max("at").alias("at"))
    each = skills.select("id", F.explode_outer(F.array_distinct("signatures")).alias("signature")).join(seen, "signature", "left")
    got = each.groupBy("id").agg(F.count("signature").alias("signatures"), F.count("at").alias("recurring"), F.max("at").alias("last_seen_at"))
    state = F.when(F.col("signatures") == 0, "unresolved").when(F.col("recurring") == 0, "stale").otherwise("fresh")
    return got.withColumn("state", state)


def hydrated(refs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Code references (id, path, blob) with the file's commit if its version is still the one cited, and the
    file's symbols in order. Symbols are gathered a file before the join, so each is moved once."""
    names = symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_start", "name"))).alias("s"))
    rows = refs.join(files.select("path", F.col("blob").alias("current"), "commit"), "path", "left").join(names, "path", "left")
    return rows.select("id", "path", F.when(F.col("current") == F.col("blob"), F.col("commit")).alias("commit"), F.coalesce(F.transform("s", lambda x: x["name"]), F.array().cast("array<string>")).alias("symbols"))


# First words of shell commands, sections of a skill document.
COMMANDS = (
    "apt", "aws", "brew", "bun", "bunx", "cargo", "curl", "docker", "gcloud", "git", "go", "helm",
    "jq", "kubectl", "make", "node", "npm", "npx", "pg_dump", "pnpm", "psql", "pip",
    "python", "ssh", "tar", "terraform", "tsc", "uv", "yarn",
)
SECTIONS = ("When to use", "Prerequisites", "Procedure", "Commands", "Validation", "Known failure modes")


def steps(text):
    """A text's lines and sentences, each once in order (case aside)."""
    parts = F.filter(F.transform(F.split(text, r"\n+|(?<=[.!?])\s+(?=[A-Z0-9`])"), lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(parts, lambda x: F.lower(x))
    return F.filter(parts, lambda x, k: F.array_position(low, F.lower(x)) == k + 1)


def shell_commands(text, most: int = 6):
    """Commands in prose: lines that begin with a known program, up to their sentence's end, then quoted spans."""
    lines = F.transform(F.split(text, r"\n+"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^\$\s+", ""), "^`+|`+$", "")))
    known = F.filter(lines, lambda x: F.regexp_extract(x, r"^([a-z][\w.-]*)", 1).isin(*COMMANDS))
    found = F.concat(F.transform(known, lambda x: F.trim(F.regexp_extract(x, "^([^.;!?]*)", 1))), F.transform(F.regexp_extract_all(text, F.lit("`([^`\n]+)`"), 1), lambda x: F.trim(x)))
    found = F.filter(found, lambda x: x != "")
    low = F.transform(found, lambda x: F.lower(x))
    return F.slice(F.filter(found, lambda x, k: F.array_position(low, F.lower(x)) == k + 1), 1, most)


def rendered(docs: DataFrame) -> DataFrame:
    """Skill documents (name, description, version, and an array of lines for each section) as Markdown."""
    line = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    clean = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), line), lambda x: x != "")
    none = F.lit("None recorded.")
    bullets = lambda c: F.when(F.size(clean(c)) > 0, F.array_join(F.transform(clean(c), lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(none)
    numbered = lambda c: F.when(F.size(clean(c)) > 0, F.array_join(F.transform(clean(c), lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x)), "\n")).otherwise(none)
    block = lambda c: F.when(F.size(clean(c)) > 0, F.concat(F.lit("```bash\n"), F.array_join(clean(c), "\n"), F.lit("\n```"))).otherwise(none)
    form = {"Procedure": numbered, "Commands": block}
    parts = [F.concat(F.lit(f"## {s}\n"), form.get(s, bullets)(s.lower().replace(" ", "_"))) for s in SECTIONS]
    head = F.concat(F.lit("---\nname: "), line(F.col("name")), F.lit("\ndescription: "), line(F.col("description")), F.lit("\nversion: "), line(F.col("version")), F.lit("\n---"))
    return docs.select("name", F.concat_ws("\n\n", head, *parts, ).alias("body")).select("name", F.concat("body", F.lit("\n")).alias("markdown"))


def generated(groups: DataFrame, skills: DataFrame) -> DataFrame:
    """What becomes of qualified groups (scope, signature, problem, failure_ids): 'unchanged' or 'refreshed' where a
    skill (id, scope, name, failure_ids) shares a failure, else 'created' under a name of its own.

    A name that another skill of the scope has is told apart by the signature's first eight characters.
    """
    from ..functions.extraction import slug

    old = skills.select(F.col("scope").alias("s"), F.col("id").alias("skill_id"), F.col("failure_ids").alias("had"), F.explode("failure_ids").alias("f"))
    new = groups.select("scope", "signature", F.explode("failure_ids").alias("f"))
    hit = new.join(old, (F.col("scope") == F.col("s")) & (new["f"] == old["f"])).groupBy("scope", "signature").agg(F.min_by("skill_id", "skill_id").alias("skill_id"), F.min_by("had", "skill_id").alias("had"))
    rows = groups.withColumn("base", slug(F.col("problem"))).join(hit, ["scope", "signature"], "left")
    taken = skills.select("scope", F.col("name").alias("base"), F.lit(True).alias("taken")).distinct()
    rows = rows.join(taken, ["scope", "base"], "left")
    first = F.row_number().over(Window.partitionBy("scope", "base").orderBy("signature")) == 1
    name = F.when(F.col("taken").isNull() & first, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.regexp_replace(F.substring("signature", 1, 8), "[^a-z0-9]+$", "")))
    outcome = F.when(F.col("skill_id").isNull(), "created").when(F.size(F.array_except("failure_ids", "had")) == 0, "unchanged").otherwise("refreshed")
    return rows.select("scope", "signature", "skill_id", outcome.alias("outcome"), F.when(outcome == "created", name).alias("name"))


def serving_pack(rows: DataFrame, budget: int) -> DataFrame:
    """Served skills (project_id, position, name, description) as summaries while they fit, then as names alone."""
    import pandas as pd

    from .packing import estimate

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        used, out = 0, []
        for r in g.sort_values("position").itertuples():
            for kind, text in (("summary", r.description), ("title-only", r.name)):
                cost = estimate(f"{r.name}{text}" if kind == "summary" else text)
                if used + cost <= budget:
                    out.append((r.project_id, r.position, kind, cost))
                    used += cost
                    break
            else:
                out.append((r.project_id, r.position, "dropped", 0))
        return pd.DataFrame(out, columns=["project_id", "position", "kind", "tokens"])

    return rows.groupBy("project_id").applyInPandas(fold, "project_id string, position int, kind string, tokens long")


def mentioned(events: DataFrame, skills: DataFrame, least: int = 6) -> DataFrame:
    """Skills (id, name, path) whose path, or whose name of ``least`` characters or more, stands anywhere in an
    event's text (event_id, text): id, event_id.

    Names and paths are posted under their first ``least`` characters (a shorter path under all of it, and of its
    length), and texts' runs of those lengths are looked up, so only what begins alike is compared. Every task holds
    the skills' forms; runs of texts are neither moved nor sent to the driver.
    """
    wanted = skills.select("id", F.explode(F.array_compact(F.array(F.when(F.char_length("name") >= least, F.col("name")), F.when(F.col("path") != "", F.col("path"))))).alias("form"))
    wanted = wanted.withColumn("key", F.left("form", F.lit(least))).withColumn("size", F.char_length("key"))
    found = None
    for size in [r["size"] for r in wanted.select("size").distinct().collect()]:  # at most ``least`` of them
        forms = wanted.where(F.col("size") == size)
        starts = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{size}}}))"), 1))).alias("key")
        met = events.where(F.char_length("text") >= size).select("event_id", "text", starts).join(F.broadcast(forms), "key").where(F.contains("text", "form"))
        found = met.select("id", "event_id") if found is None else found.union(met.select("id", "event_id"))
    return wanted.select("id", F.lit(None).cast("long").alias("event_id")).limit(0) if found is None else found.distinct()


def review(skills: DataFrame, failures: DataFrame) -> DataFrame:
    """For each skill (id, failure_ids) its failures that can still be read, in order, and how many cannot."""
    each = skills.select("id", F.posexplode("failure_ids").alias("pos", "failure_id")).join(failures.select(F.col("id").alias("failure_id"), "problem"), "failure_id", "left")
    there = F.sort_array(F.collect_list(F.when(F.col("problem").isNotNull(), F.struct("pos", "failure_id", "problem"))))
    got = each.groupBy("id").agg(there.alias("t"), F.count_if(F.col("problem").isNull()).alias("unresolved"))
    return skills.select("id").join(got, "id", "left").select(
        "id", F.coalesce(F.transform("t", lambda x: x["failure_id"]), F.array().cast("array<long>")).alias("failure_ids"), F.coalesce("unresolved", F.lit(0).cast("long")).alias("unresolved"))


def evaluated(documents: DataFrame, most_chars: int = 8000) -> DataFrame:
    """Of skill documents (name, markdown): the share with all sections in order, and that within the bound."""
    places = [F.instr("markdown", f"\n## {s}\n") for s in SECTIONS]
    in_order = places[0] > 0
    for a, b in zip(places, places[1:], strict=False):
        in_order &= a < b
    return documents.agg(F.avg(in_order.cast("double")).alias("section_completeness"), F.avg((F.char_length("markdown") <= most_chars).cast("double")).alias("compactness"))


def _section(markdown, name):
    """A section's body, up to the next heading."""
    head = F.concat(F.lit("## "), name, F.lit("\n"))
    return F.split_part(F.split_part(markdown, head, F.lit(2)), F.lit("\n## "), F.lit(1))


def evaluation(cases: DataFrame, outcomes: DataFrame, documents: DataFrame, probes: DataFrame, most_chars: int = 8000) -> DataFrame:
    """The six invariants of skill generation (metric, value, passed), each of which must be 1.

    ``cases`` (key, reason, name) say why a group must be refused or what its skill is called; ``outcomes`` (key,
    reason, name) what became of it. ``documents`` (name, markdown, again) are what was rendered, twice; ``probes``
    (name, section, text) what a section must hold. A metric without cases is 1.
    """
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(1.0))
    met = cases.select("key", F.col("reason").alias("want"), F.col("name").alias("called")).join(outcomes.select("key", "reason", "name"), "key", "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    groups = met.agg(share(F.when(F.col("want").isNotNull(), same("want", "reason"))).alias("gate_accuracy"), share(F.when(F.col("called").isNotNull(), same("called", "name"))).alias("generation_accuracy"))
    shape = evaluated(documents, most_chars).select(*(F.coalesce(c, F.lit(1.0)).alias(c) for c in ("section_completeness", "compactness")))
    stable = documents.agg(share(same("markdown", "again")).alias("canonical_stability"))
    grounded = probes.join(documents.select("name", "markdown"), "name", "left")
    held = grounded.agg(share(F.coalesce(F.contains(_section(F.col("markdown"), F.col("section")), "text"), F.lit(False))).alias("content_grounding"))
    out = None
    for w in (groups, shape, stable, held):
        long = w.unpivot([], w.columns, "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out.select("metric", "value", (F.col("value") == 1).alias("passed"))

"""What heuristic extraction reads out of events: commands, matching text, technologies, statements, names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Technologies and their names in prose (a technology's own name in lower case is one as well),
# statement patterns, commands whose repetition says nothing.
TECHNOLOGIES = {
    "PostgreSQL": ("postgres", "postgresql", "psql", "pglite"),
    "pgvector": ("pgvector",),
    "SQLite": ("sqlite", "sqlite-vec"),
    "MySQL": ("mysql", "mariadb"),
    "Redis": ("redis",),
    "Docker": ("docker", "dockerfile", "compose"),
    "Kubernetes": ("kubernetes", "k8s", "helm"),
    "Node": ("node", "nodejs", "node.js"),
    "Bun": ("bun",),
    "Deno": ("deno",),
    "TypeScript": ("typescript", "tsc"),
    "JavaScript": ("javascript",),
    "Python": ("python", "pytest"),
    "Go": ("golang",),
    "Rust": ("rust", "cargo"),
    "React": ("react", "reactjs"),
    "Next.js": ("next.js", "nextjs"),
    "Vue": ("vue", "vuejs"),
    "Svelte": ("svelte", "sveltekit"),
    "Tailwind": ("tailwind", "tailwindcss"),
    "Vite": ("vite",),
    "Vitest": ("vitest",),
    "Jest": ("jest",),
    "ESLint": ("eslint",),
    "Biome": ("biome",),
    "Drizzle": ("drizzle",),
    "Prisma": ("prisma",),
    "Kysely": ("kysely",),
    "Hono": ("hono",),
    "Fastify": ("fastify",),
    "Express": ("express",),
    "Zod": ("zod",),
    "GraphQL": ("graphql",),
    "tRPC": ("trpc",),
    "REST": ("rest", "openapi", "swagger"),
    "gRPC": ("grpc",),
    "Kafka": ("kafka",),
    "RabbitMQ": ("rabbitmq",),
    "Temporal": ("temporal",),
    "Terraform": ("terraform",),
    "AWS": ("aws", "s3", "lambda", "ec2", "cloudrun", "cloud-run"),
    "GCP": ("gcp", "google-cloud", "bigquery"),
    "Azure": ("azure",),
    "Ollama": ("ollama",),
    "LMStudio": ("lm studio", "lmstudio"),
    "llama": ("llama.cpp", "llamacpp"),
    "vLLM": ("vllm",),
    "pgBoss": ("pg-boss", "pgboss"),
    "TreeSitter": ("tree-sitter", "treesitter"),
    "WebAuthn": ("webauthn",),
    "OAuth": ("oauth", "oauth2"),
    "JWT": ("jwt",),
}
DECISIONS = (
    r"\b(?:we|i)\s+(?:have\s+)?decided\s+(?:to\s+)?([^.!?\n]{5,200})",
    r"\b(?:we|i)\s+(?:chose|choose|picked|selected|went\s+with|going\s+with)\s+([^.!?\n]{2,120}?)\s+over\s+([^.!?\n]{2,120})",
    r"\b(?:we|i)\s+(?:settled\s+on|settle\s+on)\s+([^.!?\n]{2,160})",
    r"\blet'?s\s+(?:go\s+with|use)\s+([^.!?\n]{2,160})",
    r"\bdecision:\s*([^.!?\n]{5,300})",
    r"\bthe\s+decision\s+is\s+([^.!?\n]{5,200})",
)
DECISION_NOISE = (r"\bdecided\s+(?:to\s+)?(?:skip|stop|wait|sleep|eat|take\s+a\s+break)\b",)
RATIONALE = r"(?:because|since|due\s+to|owing\s+to|given\s+that|so\s+that)"
CLAUSE_BREAK = r"[,;]\s+(?:and|but|so|then|while|plus)\b|[,;]|—"
REJECTION = r"\b(?:rejected|ruled\s+out|decided\s+against|dropped|excluded|avoided)\s+([^.!?\n]{2,120}?)(?:\s+because\s+([^.!?\n]{3,200}))?(?:[.!?\n]|$)"
OPTION_NOISE = ("it", "this", "that", "them", "those", "these", "both", "either", "neither", "nothing", "anything", "the other", "the alternative", "something else")
PREFERENCES = (
    r"\b(?:i|we)\s+prefer\s+([^.!?\n]{3,160})",
    r"\bprefer\s+([^.!?\n]{2,120}?)\s+over\s+([^.!?\n]{2,120})",
    r"\b(?:i|we)\s+always\s+([^.!?\n]{3,160})",
    r"\b(?:i|we)\s+never\s+([^.!?\n]{3,160})",
    r"\b(?:always|never)\s+(?:use|write|commit|push|run|name|prefer)\s+([^.!?\n]{2,160})",
    r"\b(?:make\s+sure|be\s+sure|remember)\s+to\s+([^.!?\n]{3,160})",
    r"\b(?:don'?t|do\s+not)\s+(?:ever\s+)?(?:use|commit|push|edit|touch|modify)\s+([^.!?\n]{2,160})",
)
PREFERENCE_NOISE = (
    r"\b(?:always|never)\s+(?:forget|forgot|worry|worried|know|knew|think|thought|wanted|want|liked|like|seem|seemed|have|had|do|did)\b",
    r"\bprefer\s+(?:to\s+)?(?:talk|discuss|think|say|hear)\b",
    r"\b(?:make\s+sure|be\s+sure)\s+to\s+(?:have|be|do)\b",
)
VERSIONS = (
    r"\b(?:upgraded|downgraded|bumped|pinned|moved|switched)\s+(?:us\s+)?to\s+([A-Za-z][\w.+-]*(?:\s+v?\d[\w.+-]*)?)",
    r"\b(?:now|currently)\s+(?:on|using|running)\s+([A-Za-z][\w.+-]*\s+v?\d[\w.+-]*)",
    r"\b([A-Za-z][\w.+-]*)\s+(?:is\s+)?(?:now\s+)?(?:at|on)\s+v?(\d+\.\d+(?:\.\d+)?)\b",
)
VERSION_NOISE = (r"\bversion\s+\d+\s+of\s+the\s+docs?\b",)
HYPOTHESES = (
    r"\b(?:hypothesis|i\s+think\s+the\s+(?:issue|problem|cause)|maybe\s+the|my\s+guess\s+is)\b",
    r"\blet\s+me\s+try\b",
)
TASKS = (
    r"\b(?:next|now|then)\s+(?:i'?ll|we'?ll|let'?s)\s+([^.!?\n]{3,200})",
    r"\b(?:todo|next\s+step):\s*([^.!?\n]{3,200})",
)
QUESTIONS = (r"\b(?:should\s+we|how\s+do\s+we|why\s+(?:is|does)|what\s+if)\b[^.!?\n]{0,200}\?",)
PLAIN_TOKENS = (
    "the", "and", "for", "with", "that", "this", "from", "not", "but", "was", "were", "are",
    "is", "it", "in", "on", "to", "of", "a", "an", "error", "failed", "failure", "command",
)
DENIED_COMMANDS = ("ls", "cd", "pwd", "cat", "echo", "which", "head", "tail", "open", "code", "clear", "export", "git status", "git diff", "git log", "git add", "git stash", "node -e")


def command(text: Column, most: int = 3) -> Column:
    """The leading bare words of a command line: up to three before a flag, path, quote, assignment or pipe."""
    words = F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), 1, most)
    stops = F.transform(words, lambda x: x.rlike(r"""^(?:-|/|\./|~|"|')|[=<>|&;]"""))
    first = F.array_position(stops, True)
    return F.array_join(F.when(first > 0, F.slice(words, F.lit(1), (first - 1).cast("int"))).otherwise(words), " ")


def is_denied(normal: Column) -> Column:
    plain = F.lower(F.trim(normal))
    return reduce(lambda a, b: a | b, ((plain == d) | plain.startswith(f"{d} ") for d in DENIED_COMMANDS), plain == "")


def event_text(kind: Column, payload: Column) -> Column:
    """An event's text for matching, from its kind and JSON payload."""
    get = lambda k: F.coalesce(F.get_json_object(payload, f"$.{k}"), F.lit(""))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    forms = {
        "conversation.message": say("[", get("role"), "] ", get("content")),
        "conversation.tool_call": say("tool call ", get("tool"), " ", get("arguments_digest")),
        "conversation.tool_result": say("tool result ok=", get("ok"), " ", get("output_digest")),
        "terminal.output": say("$ ", get("command"), " → exit ", get("exit_code"), " ", get("output_digest")),
        "error.raised": say("error(", get("origin"), "): ", get("message"), " ", get("context")),
        "test.results": say("tests ", get("passed"), " passed / ", get("failed"), " failed"),
        "file.changed": say("file ", get("change"), " ", get("path")),
        "git.commit": say("commit ", F.left(get("sha"), F.lit(8)), ": ", get("message")),
        "pull_request": say("PR #", get("number"), " (", get("state"), "): ", get("title")),
        "explicit.remember": say("explicit remember: ", get("content")),
        "document.added": say("document ", F.coalesce(*(F.get_json_object(payload, f"$.{k}") for k in ("title", "path", "uri")), F.lit("")), ": ", get("content_digest")),
        **{k: say(f"{k} cwd=", get("cwd"), " ", get("summary")) for k in ("session.start", "session.end")},
    }
    out = None
    for name, form in forms.items():
        out = F.when(kind == name, form) if out is None else out.when(kind == name, form)
    return out.otherwise(F.left(payload, F.lit(400)))


def technologies(text: Column) -> Column:
    """Technologies that a text names, in order of first mention.

    One scan finds every name; a technology counts where its first name stands.
    """
    names = {x: name for name, aliases in TECHNOLOGIES.items() for x in (name.lower(), *aliases)}
    longest = sorted(names, key=lambda x: (-len(x), x))
    pattern = r"(?<![a-z0-9])(" + "|".join(map(re.escape, longest)) + r")(?![a-z0-9])"
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), 1), lambda x: F.element_at(table, x)))


def matched(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any of the patterns is in the text."""
    return reduce(lambda a, b: a | b, (text.rlike(f"(?i){p}") for p in patterns))


def statement(text: Column, patterns: tuple[str, ...], noise: tuple[str, ...] = (), group: int = 1) -> Column:
    """What the first pattern that matches captures (0: all of it), null for none or for noise."""
    hits = [F.when(text.rlike(f"(?i){p}"), F.trim(F.regexp_extract(text, f"(?i){p}", group))) for p in patterns]
    found = F.coalesce(*hits)
    return F.when(~matched(text, noise), found) if noise else found


def version(text: Column) -> Column:
    """A stated version: a name with its number, null for none. The third form has them apart."""
    *first, last = (f"(?i){p}" for p in VERSIONS)
    hits = [F.when(text.rlike(p), F.trim(F.regexp_extract(text, p, 1))) for p in first]
    hits.append(F.when(text.rlike(last), F.concat_ws(" ", F.regexp_extract(text, last, 1), F.regexp_extract(text, last, 2))))
    return F.when(~matched(text, VERSION_NOISE), F.coalesce(*hits))


def significant(text: Column) -> Column:
    """Tokens that tell texts apart: of three characters at least and none of the plain ones."""
    plain = F.array(*map(F.lit, PLAIN_TOKENS))
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9_.\-/]+"), lambda x: (F.char_length(x) >= 3) & ~F.array_contains(plain, x)))


def slug(problem: Column, most: int = 6) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(problem), r"[^a-z0-9\s-]", " "), r"\s+"), lambda x: F.char_length(x) > 1)
    out = F.regexp_replace(F.array_join(F.slice(words, 1, most), "-"), r"^-+|-+$", "")
    return F.when(out == "", "recurring-failure").otherwise(out)


def names_in(content: Column, name: Column) -> Column:
    """Whether the content holds a name as a whole identifier."""
    return F.rlike(content, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), name, F.lit(r"\E(?![\p{L}\p{N}_])")))


def first_symbol(content: Column, names: Column) -> Column:
    """The first of the names that the content holds as a whole identifier."""
    return F.get(F.filter(names, lambda n: names_in(content, n)), F.lit(0))


def module_of(path: Column) -> Column:
    return F.when(path.rlike("^.+/"), F.regexp_extract(path, "^(.+)/[^/]*$", 1)).otherwise("(root)")


def symbols_hash(symbols: Column, domain: str = "symbols/1") -> Column:
    """A hash over an ordered array of symbol structs: kind, name, signature, line_start, line_end, span_hash."""
    line = lambda x: F.concat_ws("\0", x["kind"], x["name"], x["signature"], x["line_start"].cast("string"), x["line_end"].cast("string"), x["span_hash"])
    return F.sha2(F.concat(F.lit(f"{domain}\n"), F.array_join(F.transform(symbols, line), "\n")), 256)

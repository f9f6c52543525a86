"""Vocabularies, weights and tables of the memory model."""

from __future__ import annotations

# They must be these for results to be right.
MEMORY_TYPES = ("episodic", "semantic", "procedural", "decision", "failure", "preference")
STATUSES = ("active", "stale", "superseded", "disputed", "archived")
LIVE = ("active", "stale")
SOURCE_KINDS = ("conversation", "tool", "file", "commit", "document", "explicit", "derived", "import")
HALF_LIFE_DAYS = {"episodic": 30, "semantic": 400, "procedural": 180, "decision": 400, "failure": 180, "preference": 400, "working": 7}
FALLBACK_HALF_LIFE_DAYS = 180
WEIGHTS = {"sem": 0.2, "lex": 0.16, "graph": 0.08, "imp": 0.12, "conf": 0.08, "rec": 0.1, "acc": 0.05, "proj": 0.1, "ent": 0.1}
RRF_K = 60
TYPE_AFFINITY = {
    "fact": {"semantic": 0.1, "episodic": 0.03, "decision": 0.04, "failure": 0.02, "procedural": 0.04, "preference": 0.04, "working": 0.02},
    "how_to": {"procedural": 0.15, "failure": 0.09, "decision": 0.03, "semantic": 0.06, "episodic": 0.02, "preference": 0.03, "working": 0.05},
    "decision": {"decision": 0.15, "semantic": 0.06, "episodic": 0.03, "failure": 0.03, "procedural": 0.03, "preference": 0.03, "working": 0.03},
    "failure": {"failure": 0.15, "procedural": 0.11, "decision": 0.03, "semantic": 0.05, "episodic": 0.03, "preference": 0.02, "working": 0.06},
    "preference": {"preference": 0.15, "decision": 0.05, "semantic": 0.05, "procedural": 0.03, "episodic": 0.02, "failure": 0.02, "working": 0.03},
    "history": {"episodic": 0.15, "decision": 0.09, "semantic": 0.06, "failure": 0.06, "procedural": 0.05, "preference": 0.05, "working": 0.02},
    "context": {"working": 0.09, "decision": 0.09, "semantic": 0.08, "procedural": 0.08, "preference": 0.08, "failure": 0.05, "episodic": 0.05},
}
TRANSITIONS = {
    "active": ("stale", "superseded", "disputed", "archived"),
    "stale": ("active", "superseded", "archived"),
    "superseded": ("archived",),
    "disputed": ("active", "stale", "superseded", "archived"),
    "archived": ("active",),
}
EXCLUDED_GLOBS = (
    ".env*", "*.pem", "*.key", "*.p12", "*.pfx", "*.jks", "*.keystore", "*.kdbx", "id_rsa*", "id_dsa*", "id_ecdsa*", "id_ed25519*", "*_rsa", "*_dsa",
    "*_ed25519", "*credentials*", "*secrets*", "*.tfvars", "*.tfvars.*", "*.tfstate", "*.tfstate.*", ".npmrc", ".netrc", ".git-credentials",
    ".htpasswd", "authorized_keys*", "*service_account*.json",
)
INTENTS = {  # in the order that settles ties
    "history": ("last year", "last month", "last week", "yesterday", "previously", "before", "history", "used to", "last time", "ago", "when did", "back in", "earlier", "original"),
    "failure": ("error", "errors", "failed", "failing", "fails", "fail", "oom", "out of memory", "crash", "crashes", "crashed", "exception", "bug", "broken", "panic", "traceback", "stack trace", "segfault", "timeout", "denied"),
    "how_to": ("how do", "how to", "how can", "how does", "steps to", "run", "deploy", "deploying", "configure", "install", "set up", "setup", "debug", "fix", "command to", "script to", "procedure for"),
    "decision": ("why did", "why do", "why does", "why are", "decision", "decided", "decide", "choose", "chose", "chosen", "rationale", "alternative", "alternatives", "adr", "trade-off", "tradeoff", "architectural"),
    "preference": ("prefer", "prefers", "preference", "style", "convention", "conventions", "guideline", "guidelines", "formatting", "lint", "standard for"),
    "context": ("context", "overview", "summarize", "summary", "onboard", "catch up", "project digest", "what is this project", "what are we building", "tell me about the project"),
    "fact": ("what", "which", "when", "where", "who", "how many", "version", "uses", "running on", "does the project"),
}
STOPWORDS = (
    "a", "an", "the", "this", "that", "these", "those", "is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "have", "has",
    "had", "i", "we", "you", "he", "she", "it", "they", "me", "us", "him", "her", "them", "my", "our", "your", "his", "its", "their", "of", "in",
    "on", "at", "to", "for", "with", "by", "from", "up", "down", "out", "off", "over", "under", "again", "and", "or", "but", "if", "then", "than",
    "so", "because", "as", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "too", "very", "can", "will", "just", "should", "now", "into", "about", "there", "here", "what", "which", "who", "whom", "whose", "when", "where",
    "why", "how",
)
ERROR_CLASSES = (  # in order: the first that matches names the class
    ("NETWORK_ERROR", r"\b(?:econnrefused|econnreset|econnaborted|etimedout|ehostunreach|enetunreach|eai_again|enotfound|socket\s+hang\s+up|connection\s+refused)\b"),
    ("PERMISSION_DENIED", r"\b(?:eacces|eperm|permission\s+denied|access\s+denied|operation\s+not\s+permitted)\b"),
    ("FILE_NOT_FOUND", r"\b(?:enoent|no\s+such\s+file\s+or\s+directory)\b"),
    ("MODULE_NOT_FOUND", r"\b(?:module_not_found|cannot\s+find\s+module|cannot\s+find\s+package|cannot\s+resolve|failed\s+to\s+resolve\s+import|is\s+not\s+exported\s+by|does\s+not\s+provide\s+an\s+export)\b"),
    ("TYPECHECK_ERROR", r"\berror\s+ts\d{3,5}\b"),
    ("SYNTAX_ERROR", r"\b(?:syntaxerror|unexpected\s+token|unexpected\s+end\s+of\s+input|unterminated|parse\s+error)\b"),
    ("TYPE_ERROR", r"\btypeerror\b"),
    ("REFERENCE_ERROR", r"\breferenceerror\b"),
    ("RANGE_ERROR", r"\brangeerror\b"),
    ("ASSERTION_FAILURE", r"\b(?:assertionerror|assertion\s+failed|expected\s+.{0,80}\s+to\s+(?:be|equal|match|contain|throw|have))\b"),
    ("OUT_OF_MEMORY", r"\b(?:out\s+of\s+memory|heap\s+out\s+of\s+memory|javascript\s+heap|\boom\b)\b"),
    ("CONSTRAINT_VIOLATION", r"\b(?:duplicate\s+key\s+value\s+violates\s+unique\s+constraint|unique\s+constraint|foreign\s+key\s+constraint|null\s+value\s+in\s+column)\b"),
    ("DEADLOCK", r"\bdeadlock\b"),
    ("TIMEOUT", r"\b(?:timeout|timed\s+out|exceeded\s+.{0,20}time)\b"),
)
FALLBACK_CLASS = {"command": "NONZERO_EXIT", "build": "BUILD_ERROR", "test": "TEST_FAILURE", "tool": "TOOL_ERROR", "terminal": "COMMAND_FAILURE", "runtime": "RUNTIME_ERROR"}
PROMOTION_IMPORTANCE = 0.5
GATE = {"min_importance": 0.45, "min_confidence": 0.5, "min_length": 8}
SUMMARY_WINDOW_DAYS, RETENTION_WINDOW_DAYS = 30, 90
ARCHIVE_BELOW, RESISTANT_FLOOR = 0.05, 0.5
SIMILAR_SOLUTIONS, LEAST_SOLVED = 0.6, 2

"""Text expressions: normal form, hashes, tokens, intents, templates, failure signatures, path rules."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ERROR_CLASSES, EXCLUDED_GLOBS, FALLBACK_CLASS, INTENTS, STOPWORDS


#: Characters that composition (NFC) can change or join to another: marks, parts of syllables, and those with a
#: composed form of their own. Any that the JVM doesn't know is among them. What has none of these is composed.
_DECOMPOSED = (
    r"[\p{M}\p{Cn}\u0374\u037E\u0387\u0958-\u0A5E\u0B5C\u0B5D\u0F43-\u0F69\u1161-\u1175\u11A8-\u11C2\u1F71-\u1FFD\u2000\u2001\u2126\u212A\u212B"
    r"\u2329\u232A\u2ADC\uF900-\uFAFF\uFB1D-\uFB4E\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1F}]"
)


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def may_compose(text: Column) -> Column:
    """Whether a text may change by composition: a quick check in the JVM."""
    return text.rlike(_DECOMPOSED)


def composed(text: Column) -> Column:
    """A text in composed form (NFC). Only texts that fail the quick check are sent to Python."""
    return F.coalesce(F.pandas_udf(_composed, "string")(F.when(may_compose(text), text)), text)


def canonical_hash(text: Column) -> Column:
    """``content_hash`` of the composed form: equal for a letter with its mark and for both in one."""
    return content_hash(composed(text))


def normal_form(text: Column) -> Column:
    """White space collapsed, ends trimmed, lower case (texts are taken to be NFC; ``composed`` makes them so)."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def content_hash(text: Column) -> Column:
    return F.sha2(normal_form(text), 256)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4).cast("long")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9.]+"), lambda x: x != "")


def keywords(text: Column, limit: int = 32) -> Column:
    """Tokens without stop words, once each in order of first occurrence."""
    words = F.array(*map(F.lit, STOPWORDS))
    return F.slice(F.array_distinct(F.filter(tokens(text), lambda x: ~F.array_contains(words, x))), 1, limit)


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def phrases_in(text: Column, phrases: list[str]) -> Column:
    """The distinct phrases that a text holds, by one scan: at each word the longest phrase that begins there
    and, with it, those that are its beginnings."""
    ordered = sorted(phrases, key=lambda p: -len(p))
    pattern = r"(?i)\b(?=(" + "|".join(r"\s+".join(map(re.escape, p.split())) for p in ordered) + r")\b)"
    within = F.create_map(*(x for p in phrases for x in (F.lit(p), F.array(*(F.lit(q) for q in phrases if f"{p} ".startswith(f"{q} "))))))
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.lower(F.regexp_replace(x, r"\s+", " "))))
    return F.array_distinct(F.flatten(F.transform(found, lambda x: F.try_element_at(within, x))))


def intent(text: Column) -> Column:
    """The intent with most phrases in the text; the earlier in the table wins a tie, none is 'fact'."""

    def best(found):
        scores = [
            F.struct(F.size(F.array_intersect(found, F.array(*map(F.lit, phrases)))).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name"))
            for k, (name, phrases) in enumerate(INTENTS.items())
        ]
        return once(F.greatest(*scores), lambda x: F.when(x["n"] > 0, x["name"]).otherwise("fact"))

    return F.coalesce(once(phrases_in(text, [p for phrases in INTENTS.values() for p in phrases]), best), F.lit("fact"))


def template(text: Column) -> Column:
    """A statement with its numbers blanked."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+(?:\.\d+)*", "<#>"), r"\s+", " "))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)*)"), 1)


# Rewrites, in order, that make trivially different failure messages equal.
_REWRITES = (
    (r"\x1b\[[0-9;?]*[ -/]*[@-~]", " "), (r"\s+", " "), None,
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"), (r"\b0x[0-9a-f]+\b|\b[0-9a-f]{16,}\b", "<hex>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<host>"), (r"(?<![\w.-])(?:\.{1,2}/|/)[\w.@~-]+(?:/[\w.@~-]+)*(?:\.[a-z0-9]{1,8})?", "<path>"),
    (r"(?<![\w./-])(?:[\w.@~-]+/)+[\w.@-]+(?:\.[a-z0-9]{1,8})?", "<path>"), (r":(\d+):(\d+)\b", ":<line>:<col>"), (r":\d{2,5}\b", ":<port>"),
    (r"\b\d+(?:\.\d+)?\s?(?:ms|s|min|h)\b", "<duration>"), (r"\b\d+(?:\.\d+)?\b", "<n>"), (r"\s+", " "),
)


def failure_message(text: Column, cap: int = 300) -> Column:
    out = text
    for rewrite in _REWRITES:
        out = F.lower(F.trim(out)) if rewrite is None else F.regexp_replace(out, *rewrite)
    out = F.trim(out)
    return F.when(F.char_length(out) > cap, F.left(out, F.lit(cap - 1))).otherwise(out)


def failure_class(message: Column, origin: Column) -> Column:
    """The first error class whose pattern the normalised message matches, else by the failure's origin.

    Origins are error origins (build, test, tool, terminal, runtime) and incidents (command, test, tool); a null
    one is a runtime error's.
    """
    first = reduce(lambda c, x: c.when(message.rlike(x[1]), x[0]), ERROR_CLASSES[1:], F.when(message.rlike(ERROR_CLASSES[0][1]), ERROR_CLASSES[0][0]))
    fallback = F.create_map(*(F.lit(x) for kv in FALLBACK_CLASS.items() for x in kv))
    return first.otherwise(F.coalesce(F.try_element_at(fallback, F.coalesce(origin, F.lit("runtime"))), F.lit("ERROR")))


def failure_signature(kind: Column, message: Column, version: str = "failure-v1") -> Column:
    return F.left(F.sha2(F.concat(F.lit(version), F.lit("\0"), kind, F.lit("\0"), message), 256), F.lit(16))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression; a star also crosses slashes."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)


def is_excluded(path: Column, globs: tuple[str, ...] = EXCLUDED_GLOBS) -> Column:
    """Whether a path or its last part matches a glob, without regard to case."""
    pattern = "(?is)^(?:" + "|".join(map(glob_pattern, globs)) + ")$"
    plain = F.regexp_replace(path, r"\\", "/")
    return plain.rlike(pattern) | F.substring_index(plain, "/", -1).rlike(pattern)

"""Secret redaction with exact spans: every detector's matches, overlaps settled, markers put in."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_VALUE = r"""("[^"\n]{0,400}"|'[^'\n]{0,400}'|[^\s"'\n`;&]{1,400})"""
# What counts as a secret. Kind and patterns, the more specific first; a pattern's group
# ``v`` is the span, if it has one, and a group ``n`` must hold one of the names.
DETECTORS = (
    ("private-key", (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]{0,20000}?-----END [A-Z0-9 ]*PRIVATE KEY-----", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----\s+[A-Za-z0-9+/=\s]{16,}")),
    ("connection-string", (r"""(?i)(?<![A-Za-z0-9])(?:postgres(?:ql)?|mariadb|mongodb(?:\+srv)?|mysql|rediss?|amqps?|ftps?|sftp|smtps?|imaps?|pops?|ldaps?|https?|wss?)://[^\s"'<>@/]+:[^\s"'<>@/]+@[^\s"'<>]*""",)),
    ("api-key", (r"(?<![A-Za-z0-9])sk-ant-[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_-])",)),
    ("api-key", (r"(?<![A-Za-z0-9])sk-(?!ant-)[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])",)),
    ("token", (r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}(?![A-Za-z0-9])", r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{22,}(?![A-Za-z0-9_])")),
    ("api-key", (r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])",)),
    ("api-key", (r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}(?![A-Za-z0-9_-])",)),
    ("token", (r"(?<![A-Za-z0-9])(?:xox[a-z]|xapp)-[0-9A-Za-z-]{10,}(?![0-9A-Za-z-])",)),
    ("token", (r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,}){2,}(?![A-Za-z0-9_-])",)),
    ("token", (r"(?:[Bb]earer|[Tt]oken)\s+(?P<v>[A-Za-z0-9._~+/=-]{16,})",)),
    ("password", (r"(?:[Bb]asic)\s+(?P<v>[A-Za-z0-9+/=]{16,})",)),
    ("token", (r"(?i)(?<![A-Za-z0-9_-])(?:jsessionid|phpsessid|asp\.net_sessionid|session[-_]?token|session(?:[-_]?id)?|connect\.sid|sid|auth[-_]?token|remember[-_]?(?:me|token))\s*=\s*(?P<v>[A-Za-z0-9._~+/%=-]{8,})",)),
    ("password", (r"(?i)(?<![A-Za-z0-9_])(?:password|passwd|pwd)\s*[=:]\s*" + _VALUE.replace("(", "(?P<v>", 1), r"(?i)(?<![^\s\"'\x60])--(?:password|passwd|pwd)\s*[= ]\s*" + _VALUE.replace("(", "(?P<v>", 1))),
    (None, (r"(?<![A-Za-z0-9_-])(?P<n>[A-Za-z][A-Za-z0-9_-]{0,60})\s*[=:]\s*" + _VALUE.replace("(", "(?P<v>", 1),)),
)
NAMES = ("key", "secret", "token", "password", "passwd", "pwd", "credential", "passphrase")
_COMPILED = [(rank, kind, re.compile(p)) for rank, (kind, patterns) in enumerate(DETECTORS) for p in patterns]
_MARKER = re.compile(r"^\[REDACTED:[a-z-]+\]$")
#: What a text without any secret doesn't hold: such texts never leave the JVM.
HINT = r"(?i)-----begin|://|sk-|gh[pousr]_|github_pat_|akia|aiza|xox|xapp-|eyj|bearer|basic|sid|session|remember|auth[-_]?token|" + "|".join(NAMES)


def _kind(name: str) -> str:
    return next((kind for part, kind in (("key", "api-key"), ("token", "token")) if part in name.lower()), "password")


def _candidates(text: str):
    """Every detector's spans as (start, minus length, rank, kind): in this order the earliest, then the longest,
    then the more specific comes first."""
    for rank, kind, pattern in _COMPILED:
        for m in pattern.finditer(text):
            start, end = m.span("v" if "v" in pattern.groupindex else 0)
            named = m["n"].lower() if "n" in pattern.groupindex else None
            if start < end and not _MARKER.match(text[start:end]) and (named is None or any(x in named for x in NAMES)):
                yield start, start - end, rank, kind or _kind(named)


def secrets(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of secrets; of those that overlap, the first in order."""
    out = []
    for start, minus, _, kind in sorted(_candidates(text)):
        if not out or start >= out[-1][1]:
            out.append((start, start - minus, kind))
    return out


def redact(text: str, spans: list[tuple[int, int, str]] | None = None) -> str:
    at, out = 0, []
    for start, end, kind in secrets(text) if spans is None else spans:
        out += [text[at:start], f"[REDACTED:{kind}]"]
        at = end
    return "".join([*out, text[at:]])


_RECORDS = "records array<struct<kind:string,start:int,length:int>>"
_FOUND = pa.struct([("text", pa.string()), ("records", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())])))])
SLICE = 64  #: texts that are searched at once


def redacted(text: Column) -> Column:
    """A struct of the redacted text and the records (kind, start, length). A null text stays null."""

    @F.arrow_udf(f"text string, {_RECORDS}")
    def run(batch: pa.Array) -> pa.Array:
        parts = []
        for k in range(0, len(batch), SLICE):  # few texts at a time are Python objects
            texts = batch.slice(k, SLICE).to_pylist()
            spans = [secrets(x) if x else [] for x in texts]
            rows = [{"text": redact(x, s) if s else None, "records": [{"kind": d, "start": b, "length": e - b} for b, e, d in s]} for x, s in zip(texts, spans, strict=True)]
            parts.append(pa.array(rows, _FOUND))
        return pa.concat_arrays(parts) if parts else pa.array([], _FOUND)

    found = run(F.when(text.rlike(HINT), text))
    return F.struct(F.coalesce(found["text"], text).alias("text"), found["records"].alias("records"))


def redacted_json(payload: Column, root: str = "$") -> Column:
    """A JSON text with every string in it redacted: json (canonical, see ``canonical``), sha256 of that, and
    records (kind, location as a JSON path, length). Text that is no JSON is redacted as one string at the root.
    A null payload stays null."""

    @F.pandas_udf("json string, sha256 string, records array<struct<kind:string,location:string,length:int>>")
    def run(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for x in batch:
            if x is None:
                rows.append((None, None, []))
                continue
            records: list[dict] = []
            text = canonical(_walked(_parsed(x), root, records))
            rows.append((text, hashlib.sha256(text.encode()).hexdigest(), records))
        return pd.DataFrame(rows, columns=["json", "sha256", "records"])

    return run(payload)


def _parsed(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def _walked(value, path: str, records: list[dict]):
    if isinstance(value, str):
        spans = secrets(value)
        records += [{"kind": k, "location": path, "length": e - s} for s, e, k in spans]
        return redact(value, spans)
    if isinstance(value, list):
        return [_walked(x, f"{path}[{k}]", records) for k, x in enumerate(value)]
    if isinstance(value, dict):
        return {k: _walked(x, f"{path}.{k}" if re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", k) else f"{path}[{json.dumps(k, ensure_ascii=False)}]", records) for k, x in value.items()}
    return value


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; whole floats as integers, as in the hash of an event."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def canonical_json(payload: Column) -> Column:
    """``canonical`` of a column of JSON texts; null for a null and for text that is no JSON."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        def each(x):
            try:
                return None if x is None else canonical(json.loads(x))
            except ValueError:
                return None

        return batch.map(each, na_action="ignore")

    return run(payload)

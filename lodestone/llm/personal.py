"""Personal data: expressions propose spans, check digits confirm them, words nearby raise or lower their score.

Texts of a batch are searched together as bytes with a line break between them, which no expression matches;
all expressions are of ASCII characters and take time linear in the text. Positions are turned into code points
where something was found.

Base spans are what the fixed expressions below match, leftmost and not overlapping within a kind, and what
their checks let through. Further spans are proposed within what the checks refused (a card behind a phone
number) and by expressions of other kinds; they need a score of at least ``least``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import slices, utf8

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
SPANS = "array<struct<kind: string, start: int, end: int, score: double, base: boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))

_LOCAL = np.zeros(256, bool)
_LOCAL[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"]] = True
#: What follows the local part of an address; that is found backwards, so a long run of letters is read once.
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(rb"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")

_GROUPS = re.compile(rb"[0-9]+")
_FULL_PHONE = re.compile(rb"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4}(?![0-9]))(?:[ .-][0-9]{2,4}(?![0-9])){1,4}")
_LOCAL_PHONE = re.compile(rb"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9])")
_IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(rb"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")

#: Score without words, words that speak for a kind and words that speak against any.
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.65, "iban": 0.9, "ssn": 0.45}
_FOR = {
    "email": {b"mail", b"email", b"e-mail", b"contact", b"write"},
    "ip": {b"ip", b"address", b"host", b"server", b"client", b"login"},
    "card": {b"card", b"visa", b"mastercard", b"amex", b"credit", b"debit", b"payment", b"cvv", b"cvc"},
    "phone": {b"phone", b"tel", b"telephone", b"call", b"mobile", b"cell", b"fax", b"whatsapp", b"sms"},
    "iban": {b"iban", b"account", b"bank", b"swift", b"bic", b"transfer"},
    "ssn": {b"ssn", b"social", b"security"},
}
_AGAINST = {b"isbn", b"version", b"order", b"invoice", b"sku", b"serial", b"example", b"sample", b"tracking", b"part"}
_WORD = re.compile(rb"[a-z-]+")


def luhn(digits: bytes) -> bool:
    """Whether the last digit is the check digit of those before it."""
    values = [d - 48 for d in digits]
    doubled = [2 * d - 9 * (d > 4) for d in values[-2::-2]]
    return (sum(values[-1::-2]) + sum(doubled)) % 10 == 0


def mod97(account: bytes) -> bool:
    """Whether an account number's two check digits hold."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(chr(c), 36)) for c in moved)) % 97 == 1


def card_number(digits: bytes) -> bool:
    """Whether digits are of the length and start of a card network and pass the check digit."""
    networks = re.fullmatch(rb"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14}", digits)
    return networks is not None and luhn(digits)


def _small(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _cards_within(text: bytes, at: int):
    """Card numbers of whole groups in a run of digits that is none itself: one group, or four and five of 3 to 6."""
    groups = [(m.start(), m.end()) for m in _GROUPS.finditer(text)]
    k = 0
    while k < len(groups):
        for n in (1, 4, 3, 5):
            chosen = groups[k : k + n]
            digits = b"".join(text[i:j] for i, j in chosen)
            if len(chosen) == n and len(digits) <= 19 and (n == 1 or all(3 <= j - i <= 6 for i, j in chosen)) and card_number(digits):
                yield at + chosen[0][0], at + chosen[-1][1]
                k += n - 1
                break
        k += 1


def proposed(blob: bytes, local: np.ndarray) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, base) in bytes; ``local`` tells the bytes that an address's local part may hold."""
    found, free = [], 0
    for m in _DOMAIN.finditer(blob):
        start = m.start()
        while start > free and local[start - 1]:
            start -= 1
        if start < m.start():
            found.append((start, m.end(), "email", True))
            free = m.end()
    found += [(*m.span(), "ip", True) for m in _IP.finditer(blob) if all(map(_small, m[0].split(b".")))]
    for m in _DIGITS.finditer(blob):
        if m.end() - m.start() < 12:
            continue
        digits = m[0].translate(None, b" -")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card", True))
        elif len(digits) > 12:
            found += [(i, j, "card", False) for i, j in _cards_within(m[0], m.start())]
    phones = []
    for m in _PHONE.finditer(blob):
        if 9 <= sum(48 <= c <= 57 for c in m[0]) <= 15:
            phones.append((*m.span(), "phone", True))
        elif (x := _FULL_PHONE.match(m[0])) and 9 <= sum(48 <= c <= 57 for c in x[0]) <= 15:
            phones.append((m.start(), m.start() + x.end(), "phone", False))
    taken = {c for i, j, _, _ in phones for c in range(i, j)}
    found += phones + [(*m.span(), "phone", False) for m in _LOCAL_PHONE.finditer(blob) if m.start() not in taken and m.end() - 1 not in taken]
    for m in _IBAN.finditer(blob):
        account = m[0].replace(b" ", b"")
        if 15 <= len(account) <= 34 and mod97(account):
            found.append((*m.span(), "iban", False))
    found += [(*m.span(), "ssn", False) for m in _SSN.finditer(blob) if m[1] not in (b"000", b"666") and m[1] < b"900" and m[2] != b"00" and m[3] != b"0000"]
    return found


def score(blob: bytes, start: int, end: int, kind: str, local_phone: bool) -> float:
    """The kind's own score, with a third more or less for words before and behind on the same line of a text."""
    before = blob[max(0, start - 48) : start].rpartition(b"\n")[2]
    near = set(_WORD.findall((before + b" " + blob[end : end + 24].partition(b"\n")[0]).lower()))
    value = _PRIOR[kind] - 0.3 * local_phone
    value += 0.3 * bool(near & _FOR[kind]) - 0.3 * bool(near & _AGAINST)
    return min(1.0, max(0.0, value))


def spans_of(column: pa.Array, least: float) -> pa.Array:
    """The spans of each text of a column, by start and then by kind."""
    data, offsets = utf8(column)
    texts = len(offsets) - 1
    data = np.insert(data, offsets[1:], 10) if texts else data
    begins = offsets + np.arange(texts + 1)
    blob = data.tobytes()
    rows = []
    for i, j, kind, base in proposed(blob, _LOCAL[data]):
        value = score(blob, i, j, kind, kind == "phone" and blob[i] != 43)
        if base or value >= least:
            rows.append((i, KINDS.index(kind), j, base, round(value, 2)))
    rows.sort()
    start, kind, end, base, value = (np.array(x) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
    of = np.searchsorted(begins, start, "right") - 1
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    origin = points[begins[of]] if rows else np.zeros(0, np.int64)
    inner = pa.StructArray.from_arrays(
        [pa.array([KINDS[k] for k in kind], pa.string()), pa.array(points[start.astype(np.int64)] - origin, pa.int32()), pa.array(points[end.astype(np.int64)] - origin, pa.int32()),
         pa.array(value, pa.float64()), pa.array(base.astype(bool))], fields=list(_SPAN.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(texts + 1)), pa.int32()), inner)


def find_personal(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """Rows (doc_id, spans) for each document; positions are code points, the end exclusive.

    A span has its kind, a score from 0 to 1 and whether it is a base one; base spans are kept whatever their
    score, others from ``least`` on. A null text is empty and has none. Repeated rows and rows without a doc_id
    are rows of their own; an empty table gives none; other columns are left out. No rows move between tasks.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), spans_of(part.column("text"), least)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def count_of(kind: str) -> Column:
    """How many base spans of a kind there are."""
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

"""Time ranges that questions name, and sentence-wise summaries.

A form of naming a range is one row of ``FORMS``. Its bounds are sums in months and days, so they are written
once and hold for plain numbers (one question, on the driver) and for Columns (a table of questions).
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms in the order in which they win, and the days a unit counts for.
_DATE = r"(20\d{2})(?:-(\d{2}))?(?:-(\d{2}))?"
_SPAN = r"(\d+)\s+(day|week|month|year)s?"
FORMS = (
    ("last year", r"\blast year\b"),
    ("span", rf"\b(?:last|past)\s+{_SPAN}\b"),
    ("span", rf"\b{_SPAN}\s+ago\b"),
    ("within", rf"\b(?:in|during)\s+{_DATE}\b"),
    ("before", rf"\b(?:before|until)\s+{_DATE}\b"),
    ("since", rf"\b(?:after|since)\s+{_DATE}\b"),
    ("current", r"\b(?:now|today|currently|current)\b"),
)
DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


class _Plain:
    """Moments and choices for one question."""

    def __init__(self, now: datetime):
        self.now, self.year = now, now.year

    def number(self, digits, missing: int) -> int:
        return int(digits) if digits else missing

    def days(self, unit) -> int:
        return DAYS[unit]

    def choose(self, part, there, missing):
        return there if part else missing

    def moment(self, months: int, days: int = 0) -> datetime:
        return datetime(months // 12, months % 12 + 1, 1) + timedelta(days=days)

    def ago(self, days: int) -> datetime:
        return self.now - timedelta(days=days)


class _Columns:
    """The same for a table."""

    def __init__(self, now: Column):
        self.now, self.year = now, F.year(now)

    def number(self, digits: Column, missing: int) -> Column:
        return F.coalesce(digits.try_cast("int"), F.lit(missing))

    def days(self, unit: Column) -> Column:
        return F.try_element_at(F.create_map(*(F.lit(x) for kv in DAYS.items() for x in kv)), unit)

    def choose(self, part: Column, there, missing) -> Column:
        return F.when(part != "", there).otherwise(missing)

    def moment(self, months, days=0) -> Column:
        first = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_add("DAY", F.lit(days) if isinstance(days, int) else days, F.timestamp_add("MONTH", months - 12, first))

    def ago(self, days) -> Column:
        return F.timestamp_add("DAY", -days, self.now)


def _bounds(form: str, part, c: _Plain | _Columns):
    """Where the range of a form begins and ends, None where it is open; ``part`` gives the form's groups."""
    if form == "last year":
        return c.moment((c.year - 1) * 12), c.moment(c.year * 12)
    if form == "span":
        return c.ago(c.number(part(1), 0) * c.days(part(2))), c.now
    if form == "current":
        return None, None
    months, days = c.number(part(1), 1) * 12 + c.number(part(2), 1) - 1, c.number(part(3), 1) - 1
    # A year or a month ends where the next begins; a full date ends at itself.
    ahead = c.choose(part(3), 0, c.choose(part(2), 1, 12))
    begin, end = c.moment(months, days), c.moment(months + ahead, days)
    return {"within": (c.moment(months), end), "before": (None, end), "since": (begin, None)}[form]


def time_scope(query: str, now: datetime) -> dict | None:
    """The range a question names (from, until, mode), or None. Days beyond a month's end run on."""
    c, text, found = _Plain(now), query.lower(), None
    for form, pattern in FORMS:
        m = re.search(pattern, text)
        if not m or (found and form != "since"):
            continue
        bounds = dict(zip(("from", "until"), _bounds(form, m.group, c), strict=True))
        found = (found or {"mode": "current" if form == "current" else "historical"}) | {k: v for k, v in bounds.items() if v is not None}
        if form != "before":  # a range may be closed by "since"
            break
    return found


def time_scopes(query: Column, now: Column) -> Column:
    """The same for a table: a struct of mode, from and until, null where a question names no range."""
    c, text = _Columns(now), F.lower(query)
    none = F.lit(None).cast("timestamp_ntz")
    first, froms, untils = F.lit(None).cast("string"), none, none
    for form, pattern in reversed(FORMS):
        there = text.rlike(pattern)
        begin, end = (none if x is None else x for x in _bounds(form, lambda k, p=pattern: F.regexp_extract(text, p, k), c))
        if form == "before":
            begin = F.when(first == "since", froms)
        first, froms, untils = F.when(there, form).otherwise(first), F.when(there, begin).otherwise(froms), F.when(there, end).otherwise(untils)
    mode = F.when(first == "current", "current").when(first.isNotNull(), "historical")
    return F.when(mode.isNotNull(), F.struct(mode.alias("mode"), froms.alias("from"), untils.alias("until")))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def summary(text: Column, most: int = 160) -> Column:
    """Whole sentences while they fit; the first is kept whole even if it alone does not."""

    def grown(state, x):
        longer = F.when(state["text"] == "", x).otherwise(F.concat(state["text"], F.lit(" "), x))
        full = state["full"] | ((F.char_length(longer) > most) & (state["text"] != ""))
        return F.struct(F.when(full, state["text"]).otherwise(longer).alias("text"), full.alias("full"))

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))
    return F.aggregate(sentences(text), start, grown, lambda s: s["text"])


def clipped(text: Column, most: int) -> Column:
    """A text cut at a word's end, or at ``most`` where its later half has none, with an ellipsis."""
    cut = F.left(text, F.lit(most))
    last = F.char_length(cut) - F.char_length(F.substring_index(cut, " ", -1)) - 1
    at = F.when(last > most * 0.5, last).otherwise(F.lit(most))
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.rtrim(F.left(cut, at)), F.lit("…")))


def label(text: Column, most: int = 60) -> Column:
    """The first sentence, cut at a word's end if it is longer than ``most``."""
    return clipped(F.coalesce(F.get(sentences(text), F.lit(0)), F.lit("")), most)

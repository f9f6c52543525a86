"""Contradictions settled by one ordered pass a template, without forming pairs.

Two statements of one scope and template contradict each other if their numbers differ and their windows overlap.
The pass takes a template's statements oldest first and keeps those that nothing has closed yet. Of all pairs of
an arriving statement only those are looked at whose both sides are still live, and each of them closes one, so a
template takes as many steps as it has statements. What is skipped on the way (live statements of the same value
or another time) is skipped by blocks with bounds of ids, windows and values.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .lineage import cut

EVER = np.iinfo(np.int64).max
_OUT = pa.schema([("id", pa.int64()), ("outcome", pa.string()), ("winner", pa.int64()), ("valid_until", pa.timestamp("us"))])


class Live:
    """Statements (id, value, start, end) in blocks of ids; finds the next id that contradicts a statement."""

    SIZE = 512

    def __init__(self):
        self.blocks: list[np.ndarray] = []  #: rows id, value, start, end
        self.bounds = np.zeros((5, 0), np.int64)  #: first and last id, least start, greatest end, the value (-1: several)

    @staticmethod
    def _bounds(block: np.ndarray) -> np.ndarray:
        ids, values, start, end = block
        return np.array([ids[0], ids[-1], start.min(), end.max(), values[0] if (values == values[0]).all() else -1], np.int64)

    def add(self, key: int, value: int, start: int, end: int) -> None:
        column = np.array([[key], [value], [start], [end]], np.int64)
        if not self.blocks:
            self.blocks, self.bounds = [column], self._bounds(column)[:, None]
            return
        k = max(0, bisect_right(self.bounds[0], key) - 1)
        at = bisect_left(self.blocks[k][0], key)
        block = np.concatenate([self.blocks[k][:, :at], column, self.blocks[k][:, at:]], 1)
        parts = [block] if block.shape[1] <= self.SIZE else [block[:, : self.SIZE // 2].copy(), block[:, self.SIZE // 2 :].copy()]
        self.blocks[k : k + 1] = parts
        if len(parts) == 1:
            b = self.bounds[:, k]
            b[0], b[1], b[2], b[3], b[4] = block[0, 0], block[0, -1], min(b[2], start), max(b[3], end), b[4] if b[4] == value else -1
        else:
            self.bounds = np.concatenate([self.bounds[:, :k], *(self._bounds(p)[:, None] for p in parts), self.bounds[:, k + 1 :]], 1)

    def remove(self, key: int) -> None:
        k = bisect_right(self.bounds[0], key) - 1
        at = bisect_left(self.blocks[k][0], key)
        block = np.delete(self.blocks[k], at, 1)
        if block.shape[1]:
            self.blocks[k], self.bounds[:, k] = block, self._bounds(block)
        else:
            del self.blocks[k]
            self.bounds = np.delete(self.bounds, k, 1)

    def next(self, value: int, start: int, end: int, after: int) -> int | None:
        """The least id above ``after`` of another value whose window overlaps."""
        _, last, low, high, same = self.bounds
        for k in np.flatnonzero((last > after) & (low < end) & (high > start) & (same != value)):
            ids, values, starts, ends = self.blocks[k]
            hit = (ids > after) & (values != value) & (starts < end) & (ends > start)
            at = int(hit.argmax())
            if hit[at]:
                return int(ids[at])
        return None


class Pass:
    """One template's statements in the order of their time; ``outcomes`` are the rows that it closes."""

    def __init__(self):
        self.live, self.of, self.codes = Live(), {}, {}

    def arrive(self, rows: list[dict]) -> list[dict]:
        """Statements of one time: pairs with them are settled by the lesser and then the greater id."""
        queue = []
        for r in rows:
            r["value"] = self.codes.setdefault(tuple(r["numbers"]), len(self.codes))
            self.of[r["id"]] = r
            self.live.add(r["id"], r["value"], r["start"], r["end"])
        for r in rows:
            self._ask(queue, r, np.iinfo(np.int64).min)
        out = []
        while queue:
            _, _, new, other = heapq.heappop(queue)
            if new not in self.of:
                continue
            if other in self.of:
                out += self._settle(*sorted((new, other)))
            if new in self.of:
                self._ask(queue, self.of[new], other)
        return out

    def _ask(self, queue: list, r: dict, after: int) -> None:
        other = self.live.next(r["value"], r["start"], r["end"], after)
        if other is not None:
            heapq.heappush(queue, (min(other, r["id"]), max(other, r["id"]), r["id"], other))

    def _close(self, key: int) -> dict:
        self.live.remove(key)
        return self.of.pop(key)

    def _settle(self, a: int, b: int) -> list[dict]:
        """Explicit before decision before newer before more confident; a tie closes both."""
        x, y = self.of[a], self.of[b]
        for c in ("explicit", "decision", "at", "confidence"):
            if x[c] is not None and y[c] is not None and x[c] != y[c]:
                winner, loser = (x, y) if x[c] > y[c] else (y, x)
                self._close(loser["id"])
                until = max(t for t in (winner["at"], loser["start"]) if t is not None)
                return [{"id": loser["id"], "outcome": "superseded", "winner": winner["id"], "valid_until": until}]
        return [{"id": self._close(k)["id"], "outcome": "disputed", "winner": None, "valid_until": None} for k in (a, b)]


def _rows(batch: pa.RecordBatch):
    """Rows as dictionaries, times as microseconds; a window that is open on a side reaches as far as numbers do."""
    columns = {n: c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
    columns |= {"start": columns["start"].fill_null(-EVER), "end": columns["end"].fill_null(EVER)}
    return pa.RecordBatch.from_pydict(columns).to_pylist()


def _swept(batches):
    key, state, held, out = None, None, [], []
    for batch in batches:
        for r in _rows(batch):
            now = (r.pop("project_id"), r.pop("user_id"), r.pop("template"))
            if held and (now != key or r["at"] != held[0]["at"]):
                out += state.arrive(held)
                held = []
            if now != key:
                key, state = now, Pass()
            held.append(r)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)
            out = []
    if held:
        out += state.arrive(held)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_OUT)


def statements(memories: DataFrame) -> DataFrame:
    """Memories with numbers as (project_id, user_id, template, numbers, ...): what may contradict what."""
    return memories.select(
        "project_id", "user_id", text.template(F.col("content")).alias("template"), text.numbers(F.col("content")).alias("numbers"), F.col("id").cast("long").alias("id"),
        (F.col("source_kind") == "explicit").alias("explicit"), (F.col("type") == "decision").alias("decision"), F.col("observed_at").cast("timestamp_ntz").alias("at"), F.col("confidence").cast("double").alias("confidence"),
        F.col("valid_from").cast("timestamp_ntz").alias("start"), F.col("valid_until").cast("timestamp_ntz").alias("end")).where(F.size("numbers") > 0)


def settled(memories: DataFrame) -> DataFrame:
    """Statements that contradictions close: id, outcome (superseded or disputed), winner, valid_until.

    Pairs are settled in the order of their later time, then of the lesser and the greater id; a pair with a closed
    side is passed over. Templates whose statements all have the same numbers are left out before rows move.
    Rows of a template in a scope are sorted by Spark and pass through one task, which holds those still live. Ids
    are distinct; null contents have no template; an unknown time comes first and is not newer or older.
    """
    rows = statements(memories)
    key = ["project_id", "user_id", "template"]
    mixed = cut(rows.groupBy(*key).agg(F.min("numbers").alias("least"), F.max("numbers").alias("most")).where("least <> most").select(*(F.col(c).alias(f"__{c}") for c in key)))
    rows = rows.join(mixed, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], "left_semi")
    found = rows.repartition(*key).sortWithinPartitions(*key, F.col("at").asc_nulls_first(), "id").mapInArrow(_swept, "id long, outcome string, winner long, valid_until timestamp_ntz")
    return found

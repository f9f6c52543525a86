"""Conversation structure repair: cheapest edits that make a conversation's turns follow a grammar.

The grammar is a system turn or none, then pairs of user and assistant, or nothing at all. A cost-to-go is
computed backwards over turns and grammar states; a walk forwards takes, of the edits that keep to it, the one
whose letter is least. Edits: Keep 0, Rerole 1, Delete 2, Insert 5; a truncated turn that stays costs 5 more.

Rows are sorted over the whole table, so a conversation lies in one piece unless it crosses the end of a task's
range or is longer than ``PIECE``. A piece that is a whole conversation is solved where it is. Others are
solved by pieces: each gives the cost between any two states, the costs are chained backwards over a
conversation's pieces (one small row each), the states forwards, and then pieces are solved apart.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

PIECE = 4096  #: rows
PIECE_CHARS = 4 << 20
_BLANK = " \t\n\x0b\x0c\r"
_FAR = 1 << 50
#: States: nothing yet, after system, after user, after assistant; the conversation may end in the first and last.
_END = (0, _FAR, _FAR, 0)
#: Where a user or assistant turn leads, and which of them fits.
_NEXT, _FITS = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})

_TURN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_LINE = pa.struct([("role", pa.string()), ("text", pa.string())])
_COUNTS = ("cost", "blank", "duplicate", "truncated", "illegal")
_SOLVED = pa.schema([
    ("audit", pa.string()), ("repaired", pa.list_(_LINE)), *((c, pa.int64()) for c in _COUNTS), ("first_role", pa.string()), ("last_role", pa.string()),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("n_turns", pa.int64())])
_PIECES = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("turns", pa.list_(_TURN)), *_SOLVED])
_DDL = "audit string, repaired array<struct<role: string, text: string>>, cost long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, first_turn long, last_turn long, n_turns long"
PIECES = f"conv_id long, part long, whole boolean, turns array<struct<turn: long, role: string, text: string>>, {_DDL}"
LEGAL = {"su", "ua", "au"}


def _with_inserts(cost: tuple) -> tuple:
    """The least costs if turns may be inserted first (two at most are of use)."""
    for _ in range(2):
        cost = tuple(min(c, 5 + cost[t]) for c, t in zip(cost, _NEXT, strict=True))
    return cost


@lru_cache(1 << 16)
def _before(kind: tuple, after: tuple) -> tuple[tuple, int]:
    """Costs-to-go before a turn, given those after it; both less a constant, so few tuples occur."""
    required, first, extra = kind
    cost = []
    for s in range(4):
        best = 2 + after[s]
        if not required:
            best = min(best, extra + 1 + after[_NEXT[s]])
            if first in _KEEP[s]:
                best = min(best, extra + after[_KEEP[s][first]])
        cost.append(best)
    cost = _with_inserts(tuple(cost))
    least = min(cost)
    return tuple(min(c - least, _FAR) for c in cost), least


@lru_cache(1 << 16)
def _moves(kind: tuple, after: tuple, s: int) -> tuple[str, tuple, int, int]:
    """Letters of the edits at a turn, roles of the turns they leave (None: deleted, "": kept), state and cost."""
    required, first, extra = kind
    rest, least = _before(kind, after)
    letters, roles, paid = "", [], 0
    while True:
        left = rest[s] + least
        if left == 2 + after[s]:
            return letters + "D", (*roles, None), s, paid + 2
        if left == 5 + rest[_NEXT[s]] + least:
            letters, roles, s, paid = letters + "I", [*roles, _FITS[s]], _NEXT[s], paid + 5
            continue
        if not required and first in _KEEP[s] and left == extra + after[_KEEP[s][first]]:
            return letters + "K", (*roles, ""), _KEEP[s][first], paid + extra
        return letters + "R", (*roles, _FITS[s]), _NEXT[s], paid + extra + 1


def faults(turns: list[tuple], earlier=()) -> list[str]:
    """The first fault of each (turn, role, text), "" for none; at positions ``earlier`` role and text were seen before."""
    seen, out = set(), []
    for k, (_, role, text) in enumerate(turns):
        body = text.strip(_BLANK)
        if not body:
            out.append("blank")
            continue
        same = (role, text)
        out.append("duplicate" if same in seen or k in earlier else "" if body[-1] in ".!?" else "truncated")
        seen.add(same)
    return out


def _kinds(turns: list[tuple], found: list[str]) -> list[tuple]:
    return [(True, "", 0) if f in ("blank", "duplicate") else (False, role[:1] if role[:1] in "sua" else "", 5 * (f == "truncated")) for (_, role, _), f in zip(turns, found, strict=True)]


def _backward(kinds: list[tuple], end: tuple) -> list[tuple]:
    """Costs-to-go after each turn, each less a constant, and those before the first, in full, as the last entry."""
    after, off, out = end, 0, []
    for kind in reversed(kinds):
        out.append(after)
        after, least = _before(kind, after)
        off += least
    return [*out[::-1], tuple(min(c + off, _FAR) for c in after)]


def solve(turns: list[tuple], start: int = 0, end: tuple | None = None, earlier=()) -> dict:
    """Edits of turns in order, from a state to costs-to-go behind the last one (None: the conversation ends)."""
    found = faults(turns, earlier)
    kinds = _kinds(turns, found)
    *after, _ = _backward(kinds, _with_inserts(_END) if end is None else end)
    s, audit, cost, lines = start, [], 0, []
    for (_, role, text), kind, rest in zip(turns, kinds, after, strict=True):
        letters, roles, s, paid = _moves(kind, rest, s)
        cost += paid
        audit.append(letters)
        lines += [{"role": r, "text": ""} for r in roles[:-1]]
        if roles[-1] is not None:
            lines.append({"role": roles[-1] or role, "text": text})
    while end is None and s in (1, 2):
        audit.append("I")
        lines.append({"role": _FITS[s], "text": ""})
        s, cost = _NEXT[s], cost + 5
    first = [role[:1] for _, role, _ in turns]
    numbers = [t for t, _, _ in turns if t is not None]
    return {
        "audit": "".join(audit), "repaired": lines, "cost": cost, **{f: found.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in LEGAL for a, b in zip(first, first[1:])), "first_role": first[0] if first else None, "last_role": first[-1] if first else None,
        "first_turn": numbers[0] if numbers else None, "last_turn": numbers[-1] if numbers else None, "n_turns": len(set(numbers)), "state": s,
    }


def _batches(rows, schema: pa.Schema, each: int = 256, chars: int = 8 << 20):
    """Dictionaries with a size as record batches."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if len(held) >= each or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _cut(piece: int, chars: int):
    """Pieces of sorted rows; those that are surely a whole conversation are solved."""

    def run(batches):
        def pieces():
            task, n, turns, size, now, split, first = TaskContext.get().partitionId() << 32, 0, [], 0, None, False, True

            def closed(whole):
                row = {"conv_id": now, "part": task | n, "whole": whole}
                return (row | solve(turns) if whole else row | {"turns": [{"turn": t, "role": r, "text": x} for t, r, x in turns]}), size

            for batch in batches:
                for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if turns and (conv != now or len(turns) >= piece or size >= chars):
                        yield closed(conv != now and not split and not first)
                        first, split = first and conv == now, conv == now
                        n, turns, size = n + 1, [], 0
                    now = conv
                    turns.append((turn, role, text))
                    size += len(role) + len(text)
            if turns:
                yield closed(False)

        return _batches(pieces(), _PIECES)

    return run


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            row["turns"] = [(t["turn"], t["role"], t["text"]) for t in row["turns"]]
            row["earlier"] = set(row.get("earlier") or ())
            yield row


_M = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("costs", pa.list_(pa.int64()))])
_V = pa.schema([("part", pa.int64()), ("after", pa.list_(pa.int64()))])
_E = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("ends", pa.list_(pa.int64()))])
_S = pa.schema([("part", pa.int64()), ("start", pa.int64())])


def _costs(batches):
    """The least cost of a piece from each state (rows) to each state, as 16 numbers."""
    def rows():
        for x in _read(batches):
            kinds = _kinds(x["turns"], faults(x["turns"], x["earlier"]))
            to = [_backward(kinds, tuple(0 if s == e else _FAR for s in range(4)))[-1] for e in range(4)]
            yield {"conv_id": x["conv_id"], "part": x["part"], "costs": [to[e][s] for s in range(4) for e in range(4)]}, 0

    return _batches(rows(), _M, 4096)


def _chain_back(batches):
    """Costs-to-go behind each piece, less a constant, from a conversation's last piece to its first."""
    def rows():
        now, after = (), None
        for batch in batches:
            for conv, part, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv,) != now:
                    now, after = (conv,), _with_inserts(_END)
                yield {"part": part, "after": list(after)}, 0
                after = [min(costs[4 * s + e] + after[e] for e in range(4)) for s in range(4)]
                after = tuple(min(c - min(after), _FAR) for c in after)

    return _batches(rows(), _V, 4096)


def _ends(batches):
    def rows():
        for x in _read(batches):
            yield {"conv_id": x["conv_id"], "part": x["part"], "ends": [solve(x["turns"], s, tuple(x["after"]), x["earlier"])["state"] for s in range(4)]}, 0

    return _batches(rows(), _E, 4096)


def _chain_on(batches):
    """The state in which each piece starts, from a conversation's first piece to its last."""
    def rows():
        now, s = (), 0
        for batch in batches:
            for conv, part, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv,) != now:
                    now, s = (conv,), 0
                yield {"part": part, "start": s}, 0
                s = ends[s]

    return _batches(rows(), _S, 4096)


def _solved(batches):
    def rows():
        for x in _read(batches):
            end = None if x["last"] else tuple(x["after"])
            yield {"conv_id": x["conv_id"], "part": x["part"], "whole": False, **solve(x["turns"], x["start"], end, x["earlier"])}, sum(len(t) for _, _, t in x["turns"])

    return _batches(rows(), _PIECES)


def _by_pieces(pieces: DataFrame) -> DataFrame:
    """Solutions of conversations in pieces; a piece's rows stay together, what is chained is a small row of each."""
    pieces = pieces.select("conv_id", "part", "turns")
    same = F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("t.role").cast("string"), F.col("t.role"), F.col("t.text")
    key = F.sha2(F.concat_ws(":", *same), 256)
    keys = pieces.select("conv_id", "part", F.posexplode("turns").alias("pos", "t")).select("part", "pos", key.alias("key"))
    each = written(keys.groupBy("key", "part").agg(F.min("pos").alias("pos")), "turn_keys")
    first = written(each.groupBy("key").agg(F.min("part").alias("least")), "first_turns")
    later = each.join(first, "key").where("part > least").groupBy("part").agg(F.collect_list("pos").alias("earlier"))
    pieces = written(pieces.join(later, "part", "left"), "open_pieces")

    costs = pieces.mapInArrow(_costs, "conv_id long, part long, costs array<long>")
    after = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part")).mapInArrow(_chain_back, "part long, after array<long>")
    after = written(after, "costs_to_go")
    ends = pieces.join(after, "part").mapInArrow(_ends, "conv_id long, part long, ends array<long>")
    start = written(ends.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_chain_on, "part long, start long"), "starts")
    last = pieces.groupBy("conv_id").agg(F.max("part").alias("part")).select("part", F.lit(True).alias("ends_here"))
    known = pieces.join(after, "part").join(start, "part").join(last, "part", "left").withColumn("last", F.col("ends_here").isNotNull()).drop("ends_here")
    return known.mapInArrow(_solved, PIECES)


def repaired(turns: DataFrame, piece: int = PIECE, chars: int = PIECE_CHARS) -> DataFrame:
    """Repaired conversations: conv_id, part, whole, audit, repaired (role and text of each turn) and counts.

    A conversation has one row, with ``whole``, or rows in the order of ``part``. Rows of a conversation are
    taken by turn (nulls first), then role, then text. A null role or text counts as one space; rows without a
    conv_id are one conversation. Repeated rows are duplicates of the first. Other columns are left out; an
    empty table gives no rows. Long texts are whole; ``piece`` rows or ``chars`` of text end a piece.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.monotonically_increasing_id().alias("at"))
    #: Nulls sort first in both; the row number splits rows that are equal in all columns.
    order = ["conv_id", "turn", "role", "text", "at"]
    pieces = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("at").mapInArrow(_cut(piece, chars), PIECES)
    pieces = written(pieces, "conversations")
    return pieces.where("whole").unionByName(written(_by_pieces(pieces.where("NOT whole")), "solved_pieces")).drop("turns")


def _digests(batches):
    """One row for each conversation in pieces: the hash takes its turns as they come, the audit is its letters."""
    columns = ("conv_id", "gaps", *_COUNTS, "audit", "repaired_sha256")
    schema = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in columns])

    def rows():
        now = None

        def closed():
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["n"]
            return {**{c: now[c] for c in ("conv_id", *_COUNTS)}, "gaps": gaps, "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}, 0

        for batch in batches:
            for x in batch.to_pylist():
                if now is None or now["conv_id"] != x["conv_id"]:
                    if now:
                        yield closed()
                    now = {"conv_id": x["conv_id"], **dict.fromkeys(_COUNTS, 0), "audit": [], "hash": hashlib.sha256(), "any": False, "low": None, "high": None, "n": 0, "role": None}
                for c in _COUNTS:
                    now[c] += x[c]
                now["illegal"] += now["role"] is not None and now["role"] + x["first_role"] not in LEGAL
                now["role"] = x["last_role"]
                if x["first_turn"] is not None:
                    now["n"] += x["n_turns"] - (now["high"] == x["first_turn"])
                    now["low"], now["high"] = x["first_turn"] if now["low"] is None else now["low"], x["last_turn"]
                now["audit"].append(x["audit"])
                for line in x["repaired"]:
                    now["hash"].update(f"{chr(10) * now['any']}{line['role']}:{line['text']}".encode())
                    now["any"] = True
        if now:
            yield closed()

    return _batches(rows(), schema)


def report(repairs: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation
    of ``conversations``; one without rows in ``repairs`` has zeros, an empty audit and the hash of nothing.

    A hash reads a conversation in order, so the pieces of one in pieces stream through one task; it holds one
    batch of them and the letters of the audit.
    """
    line = lambda x: F.concat(x["role"], F.lit(":"), x["text"])
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
    whole = repairs.where("whole").select("conv_id", gaps, *_COUNTS, "audit", F.sha2(F.array_join(F.transform("repaired", line), "\n"), 256).alias("repaired_sha256"))
    cut = repairs.where("NOT whole").drop("whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    cut = cut.mapInArrow(_digests, "conv_id long, gaps long, cost long, blank long, duplicate long, truncated long, illegal long, audit string, repaired_sha256 string")
    found = whole.unionByName(cut).withColumnRenamed("conv_id", "of")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", *(none(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults put in by crc32 of ``conv_id:turn`` (a null is one space) modulo 20: 0 drops the row,
    1 empties its text, 2 takes its ends of sentences, 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault: Column = F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "utf-8")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")

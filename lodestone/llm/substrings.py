"""Substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice it.

The first level looks at ``start`` words, and only at the least hash among the short windows inside each
full window (equal full windows choose equal short ones, so none is missed). Full windows around a short
one that repeats are the candidates of the next level, at twice the length, and so on up to ``length``.
At each level the owners of hash ranges are asked which windows repeat; a batch of documents asks once
for a window, however often it holds it. Two windows are equal if a 64-bit hash and, on the last level, a
second one of 32 bits are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, Words, utf8
from .packing import bucket_count, deltas, ids_of, pack, planes, ranges, strings, text_bytes, undeltas, unpack, unplanes
from .tables import bucketed, written

_ASKS = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary()), ("checks", pa.binary())])
_TOLD = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("found", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def levels_of(length: int, start: int) -> list[int]:
    if not 1 <= start <= length:
        raise ValueError("start must be from 1 to length")
    levels = [start]
    while levels[-1] < length:
        levels.append(min(2 * levels[-1], length))
    return levels


def dedup_substrings(docs: DataFrame, length: int = 13, start: int = 7) -> DataFrame:
    """Remove each word inside a window of ``length`` words that also occurs under a smaller doc_id.

    Returns doc_id, n_words, n_removed and text (the kept words, joined by one space). Windows are judged on
    the input. A null text has no words; a null doc_id counts as larger than any other; rows that share a
    doc_id don't remove each other's words. An empty table gives no rows. Other columns are left out.
    """
    levels = levels_of(length, start)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = bucket_count(total := text_bytes(docs))
    packed = bucketed(pack(docs), "batch", bucket_count(total, 24 << 20), "substrings")
    kept = None
    for k, size in enumerate(levels):
        asks = _with(packed, kept=kept).mapInArrow(_asker(levels[: k + 1], length, buckets), "bucket int, batch long, hashes binary, owners binary, checks binary")
        told = written(asks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_owner(size == length), "batch long, bucket int, found binary"), "repeats")
        told = told.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("bucket", "found"))).alias("told"))
        if size < length:
            kept = told
    return _with(packed, kept=kept, last=told).mapInArrow(_remover(levels, length, buckets), "doc_id long, n_words long, n_removed long, text string")


def _with(packed: DataFrame, **told: DataFrame | None) -> DataFrame:
    for name in ("kept", "last"):
        if (more := told.get(name)) is not None:
            packed = packed.join(more.withColumnRenamed("told", name).hint("shuffle_hash"), "batch", "left")
    return packed


class _Batch:
    """The windows of a batch that are candidates at the last of ``levels``, by sorted hash."""

    def __init__(self, row: dict, levels: list[int], length: int):
        table = unpack(row["blob"])
        self.ids = ids_of(table["doc_id"])
        self.valid = table["doc_id"].is_valid().to_numpy()
        self.words = Words(*utf8(table["text"]))
        at = self.words.whole(length)
        if len(levels) > 1:
            known = np.concatenate([np.zeros(0, U), *(undeltas(x["found"]) for x in row.get("kept") or [] if x["found"])])
            least = self._least(levels[-2], length, at)
            where = np.searchsorted(known, least)
            at = at[known[np.minimum(where, len(known) - 1)] == least] if len(known) else at[:0]
        values = self._least(levels[-1], length, at)
        order = np.argsort(values, kind="stable")
        self.at, values = at[order], values[order]
        self.begin = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
        self.hashes = values[self.begin]
        self.of = self.ids[self.words.rows[self.at]]
        self.owners = np.minimum.reduceat(self.of, self.begin) if len(values) else self.of

    def _least(self, size: int, length: int, at: np.ndarray) -> np.ndarray:
        every = self.words.every(size)
        if not len(at):
            return np.zeros(0, U)
        n = len(every) - (length - size)
        least = every[:n].copy()
        for k in range(1, length - size + 1):
            np.minimum(least, every[k : k + n], out=least)
        return least[at]


def _asker(levels, length, buckets):
    last = levels[-1] == length

    def run(batches):
        for got in batches:
            for row in got.to_pylist():
                b = _Batch(row, levels, length)
                if last:
                    owners, checks = b.owners, b.words.every(length, 1)[b.at[b.begin]].astype(np.uint32)
                else:  # whether the batch itself has it in two documents
                    owners = (b.owners < np.maximum.reduceat(b.of, b.begin)).astype(np.uint8) if len(b.of) else b.of
                    checks = None
                edge = ranges(b.hashes, buckets)
                out = [
                    (k, row["batch"], deltas(b.hashes[i:j]), planes(owners[i:j]), planes(checks[i:j]) if last else None)
                    for k, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if i < j
                ]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ASKS, strict=True)], schema=_ASKS)

    return run


def _owner(last: bool):
    """Of a hash range's windows, those that a batch must hear of: on the last level those with a smaller
    doc_id elsewhere (as bits in the order asked), else those in two documents (as hashes)."""

    def run(table: pa.Table) -> pa.Table:
        asked = [undeltas(x) for x in table["hashes"].to_pylist()]
        owners = np.concatenate([unplanes(x, np.int64 if last else np.uint8) for x in table["owners"].to_pylist()])
        hashes = np.concatenate(asked)
        checks = np.concatenate([unplanes(x, np.uint32) for x in table["checks"].to_pylist()]) if last else np.zeros(len(hashes), np.uint8)
        order = np.lexsort((checks, hashes)) if last else np.argsort(hashes, kind="stable")
        h, c = hashes[order], checks[order]
        begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        size = np.diff(np.append(begin, len(h)))
        found = np.empty(len(h), bool)
        if last:
            found[order] = np.repeat(np.minimum.reduceat(owners[order], begin), size) < owners[order]
        else:
            found[order] = np.repeat((size > 1) | (np.maximum.reduceat(owners[order], begin) > 0), size)
        ends = np.cumsum([len(x) for x in asked])
        told = [np.packbits(x).tobytes() if last else deltas(a[x]) for a, x in zip(asked, np.split(found, ends[:-1]), strict=True)]
        has = [bool(x.any()) for x in np.split(found, ends[:-1])]
        out = pa.table([table["batch"], table["bucket"], pa.array(told, pa.binary())], schema=_TOLD)
        return out.filter(pa.array(has))

    return run


def _remover(levels, length, buckets):
    def run(batches):
        for got in batches:
            for row in got.to_pylist():
                b = _Batch(row, levels, length)
                w = b.words
                elsewhere = np.zeros(len(b.hashes), bool)
                edge = ranges(b.hashes, buckets)
                for x in row.get("last") or []:
                    i, j = edge[x["bucket"]], edge[x["bucket"] + 1]
                    elsewhere[i:j] = np.unpackbits(np.frombuffer(x["found"], np.uint8), count=j - i)
                size = np.diff(np.append(b.begin, len(b.at)))
                gone = b.at[(b.of > np.repeat(b.owners, size)) | np.repeat(elsewhere, size)]
                step = np.zeros(len(w.hash) + 1, np.int32)
                np.add.at(step, gone, 1)
                np.add.at(step, gone + length, -1)
                keep = np.cumsum(step[:-1]) == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.ids, mask=~b.valid),
                        pa.array(np.diff(w.first)),
                        pa.array(np.diff(w.first) - np.diff(np.append(0, np.cumsum(keep))[w.first])),
                        joined(w, keep),
                    ],
                    schema=_OUT,
                )

    return run


def joined(w: Words, keep: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    at = np.flatnonzero(keep)
    follows = np.append(w.rows[at][1:] == w.rows[at][:-1], False) if len(at) else np.zeros(0, bool)
    step = np.zeros(len(w.data) + 2, np.int8)
    step[w.start[at]] += 1
    step[w.end[at] + follows] -= 1  # where a word follows, the byte after this one is made a space
    data = w.data.copy()
    data[w.end[at[follows]]] = 0x20
    mask = np.cumsum(step[: len(data)], dtype=np.int8) > 0
    return strings(data[mask], np.append(0, np.cumsum(mask))[w.offsets])

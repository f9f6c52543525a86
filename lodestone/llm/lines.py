"""Line dedup by pairwise alignment: partners share rare lines, patience diff aligns them, and the aligned
blocks go from the later document.

A line's owner is the earliest document that has it, and so is the owner of two lines in a row and of a whole
text. A document's partners are the owners of what it shares, so their number is bounded by its lines however
many documents share one, and a copy meets its original even where that owns no line. Partners are aligned in
order of their rarest shared part (fewest documents first), each against the lines that earlier partners
left unaligned, until every shared line has been tried.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import U, mix, slices
from .packing import LAST
from .tables import written


def split_lines(text: str) -> list[str]:
    return text.split("\n") if text else []


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two sequences: lines found once in both, in their longest increasing order, and
    what grows from them by equal neighbours; the gaps between are aligned the same way."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        where = {x: n for n, x in enumerate(b[k:m], k) if once_b[x] == 1 and once_a.get(x) == 1}
        pairs = [(n, where[x]) for n, x in enumerate(a[i:j], i) if x in where]
        tops, tails, back = [], [], []
        for n, (_, y) in enumerate(pairs):
            at = bisect_left(tops, y)
            back.append(tails[at - 1] if at else -1)
            if at == len(tops):
                tops.append(y)
                tails.append(n)
            else:
                tops[at], tails[at] = y, n
        chain, n = [], tails[-1] if tails else -1
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        if not chain:
            continue
        last_i, last_k = j, m
        for x, y in chain:  # from the end: what lies behind each anchor, up to the next one
            todo.append((x, last_i, y, last_k))
            last_i, last_k = x, y
        todo.append((i, last_i, k, last_k))
    return sorted(out)


def aligned(lines: np.ndarray, long_enough: np.ndarray, partners: list[np.ndarray]) -> np.ndarray:
    """Which lines lie in blocks common with a partner; a block counts if one of its lines is long enough."""
    gone = np.zeros(len(lines), bool)
    for other in partners:
        left = np.flatnonzero(~gone)
        theirs = other.tolist()
        pairs = patience(lines[left].tolist(), theirs)
        block: list[int] = []
        for n, (x, y) in enumerate(pairs):
            if block and not (x == pairs[n - 1][0] + 1 and y == pairs[n - 1][1] + 1):
                gone[block] |= long_enough[block].any()
                block = []
            block.append(left[x])
        if block:
            gone[block] |= long_enough[block].any()
    return gone


_LINES = pa.schema([("doc", pa.int64()), ("lines", pa.binary()), ("long", pa.binary())])


def _hash(column, least: int):
    import xxhash

    ids, lines, longs = [], [], []
    for text in column.to_pylist():
        parts = [x.strip() for x in split_lines(text or "")]
        lines.append(np.array([xxhash.xxh3_64_intdigest(x) for x in parts], U).tobytes())
        longs.append(np.array([len(x) >= least for x in parts], np.uint8).tobytes())
    return lines, longs


def dedup_lines(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """Delete from each document the line blocks that it shares, in order, with an earlier document.

    Lines are compared without outer white space; a block needs a line of ``min_chars`` characters, so blank
    and short lines go only beside one. Returns the columns of ``docs`` with text replaced and n_lines,
    n_removed added (columns of these names are replaced). A null text stays null, a null doc_id counts as
    later than any other. Rows that share a doc_id are not aligned with each other. A document of which
    nothing is left has an empty text. An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_removed")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))

    def hashed(batches):
        for got in batches:
            for part in slices(got, "text"):
                yield pa.RecordBatch.from_arrays([part["doc"], *(pa.array(x, pa.binary()) for x in _hash(part["text"], min_chars))], schema=_LINES)

    lined = written(docs.select(key.alias("doc"), "text").mapInArrow(hashed, "doc long, lines binary, long binary"), "lines")
    shared = _shared(lined)
    owners = lined.join(shared.select(F.col("owner").alias("doc")).distinct(), "doc").dropDuplicates(["doc"]).select(F.col("doc").alias("owner"), F.col("lines").alias("theirs"))
    owners = written(owners, "owners")  # likewise for an owner of very many
    partners = (shared.join(owners, "owner").groupBy("doc")
                .agg(F.sort_array(F.collect_list(F.struct("df", "owner", "theirs"))).alias("partners")))

    def removed(batches):
        for got in (part for batch in batches for part in slices(batch, "text")):
            texts, counts, gones = [], [], []
            for text, partners in zip(got["text"].to_pylist(), got["partners"].to_pylist(), strict=True):
                parts = split_lines(text or "")
                counts.append(len(parts))
                gones.append(0)
                if parts and partners:
                    a, b = (x[0] for x in _hash(pa.array([text]), min_chars))
                    gone = aligned(np.frombuffer(a, U), np.frombuffer(b, np.uint8) > 0, [np.frombuffer(x["theirs"], U) for x in partners])
                    gones[-1] = int(gone.sum())
                    text = "\n".join(x for x, y in zip(parts, gone, strict=True) if not y)
                texts.append(text)
            rest = got.drop_columns(["text", "partners"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gones, pa.int64())], [*rest.schema.names, "text", "n_lines", "n_removed"])

    row = docs.select(F.struct(*docs.columns).alias("row"), "text", key.alias("doc"))
    kept = row.join(partners, "doc", "left").select("row", "text", "partners")
    kept = kept.select(F.struct(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "text")).alias("row"), "text", "partners")
    fields = [kept.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]
    out = kept.mapInArrow(removed, T.StructType(fields))
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns), "n_lines", "n_removed")


def _parts(lines: np.ndarray, long_enough: np.ndarray) -> np.ndarray:
    """Distinct keys of a document's long lines, of its pairs of neighbours with a long one, and of the whole."""
    if not long_enough.any():
        return np.zeros(0, U)
    pairs = mix(mix(lines[:-1] + U(1)) + lines[1:])[long_enough[:-1] | long_enough[1:]]
    whole = mix(mix(lines + np.arange(len(lines), dtype=U) * U(0x9E3779B97F4A7C15)).sum(keepdims=True) + U(len(lines)))
    return np.unique(np.concatenate([lines[long_enough], pairs, whole]))


def _shared(lined: DataFrame) -> DataFrame:
    """Rows (doc, owner, df): earlier documents that own parts of a document, with their rarest such part."""

    def each(batches):
        for got in batches:
            for doc, lines, longs in zip(got["doc"].to_pylist(), got["lines"].to_pylist(), got["long"].to_pylist(), strict=True):
                found = _parts(np.frombuffer(lines, U), np.frombuffer(longs, np.uint8) > 0).view(np.int64)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), doc)), pa.array(found)], ["doc", "line"])

    lines = lined.mapInArrow(_merged(each), "doc long, line long")
    owned = lines.groupBy("line").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count("*").alias("df")).where("owner < last").drop("last")
    #: A table, so that both sides of the join are shuffled for it alone: Spark then splits a line that very many share.
    shared = lines.join(written(owned, "owned"), "line").where("owner < doc")
    return written(shared.groupBy("doc", "owner").agg(F.min("df").alias("df")), "shared")


def _merged(each, rows: int = 50_000):
    """Larger batches from many small ones."""

    def run(batches):
        held, n = [], 0
        for x in each(batches):
            held.append(x)
            n += x.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run



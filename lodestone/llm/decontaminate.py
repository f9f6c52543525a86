"""Benchmark decontamination by latent semantic retrieval.

Passages are overlapping word windows of the documents, as TF-IDF vectors over the benchmark's terms. A
randomised SVD of all passages, whose passes are distributed and whose results are summed by term, gives
a latent space of far fewer dimensions than there are items. Passages near an item by cosine there are
candidates, and so is every place that shares a few consecutive words with an item, whatever their weight; a
candidate is a match if the longest common subsequence of words covers enough of the item, its answer included.
"""

from __future__ import annotations

import re
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, Words, mix, slices, utf8
from .packing import LAST, ids_of, planes, unplanes
from .tables import written

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_PLAIN = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
BLOCK = 2000  #: benchmark items for each pass over the documents, which bounds what tasks and the driver hold
RANK, EXTRA = 128, 8  #: most dimensions of the latent space, and how many more the sketch has
SHORT = 8  #: items of fewer words are found where all their words stand in a row
RUN, WEAK_RUN = 3, 2  #: consecutive words that make a candidate; fewer for items whose words weigh little
FREQUENT = 256  #: terms that are summed by a matrix product, the others one by one


def folded(column: pa.Array) -> Words:
    """Words in lower case, cut at every ASCII character but letters and digits."""
    data, offsets = utf8(pc.utf8_lower(column.cast(pa.string())))
    return Words(_PLAIN[data], offsets)


def answer_start(text: str) -> int:
    """The word at which an item's answer begins: its last sentence or line, at most its later half."""
    text = text.lower()
    words = list(_WORD.finditer(text))
    half = len(words) // 2
    for k in range(len(words) - 1, half, -1):
        if re.search(r"[.?!:\n]", text[words[k - 1].end() : words[k].start()]):
            return k
    return half


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, by a table over the shorter side's bits."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full, state, states = (1 << len(a)) - 1, (1 << len(a)) - 1, []
    for y in b:
        hit = state & where.get(y, 0)
        state = ((state + hit) | (state - hit)) & full
        states.append(state)
    length = lambda s, i: (~s & (1 << i) - 1).bit_count()  # noqa: E731  common length of a[:i] with a prefix of b
    out, i, j = [], len(a), len(b)
    while i and j:
        now = length(states[j - 1], i)
        if not now:
            break
        if j > 1 and length(states[j - 2], i) == now:
            j -= 1
        elif length(states[j - 1], i - 1) == now:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


class _Terms:
    """Benchmark words as numbers from 1 on, and items' words as numbers."""

    def __init__(self, items: list[tuple]):
        w = folded(pa.array([x or "" for _, x in items], pa.string()))
        self.items = [k for k in range(len(items)) if w.first[k + 1] > w.first[k]]
        self.hashes = np.unique(np.concatenate([np.zeros(0, U), *(w.hash[w.first[k] : w.first[k + 1]] for k in self.items)]))
        self.words = [self.number(w.hash[w.first[k] : w.first[k + 1]]) for k in self.items]
        self.answer = [answer_start(items[k][1]) for k in self.items]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0).astype(np.int32)


def _passages(first: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each passage: from every ``stride``-th word of a text, up to ``size`` words; one
    that would only repeat the end of the passage before it is left out."""
    counts = np.diff(first)
    n = np.where(counts > size, -(-(counts - size) // stride) + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = first[row] + k * stride
    return begin, np.minimum(begin + size, first[row + 1]), row


def _stretches(first: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and row of each stretch of ``stride`` words, and each row's first stretch."""
    n = -(-np.diff(first) // stride)
    row = np.repeat(np.arange(len(n)), n)
    base = np.cumsum(n) - n
    return first[row] + (np.arange(len(row)) - base[row]) * stride, row, base


def _counts(numbers: np.ndarray, start: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """How often each frequent term is in each stretch."""
    column = np.full(max(int(frequent.max(initial=0)), int(numbers.max(initial=0))) + 1, -1)
    column[frequent] = np.arange(len(frequent))
    column = column[numbers]
    at = np.flatnonzero(column >= 0)
    cell = (np.searchsorted(start, at, "right") - 1) * len(frequent) + column[at]
    return np.bincount(cell, minlength=len(start) * len(frequent)).reshape(len(start), len(frequent)).astype(np.float32)


def _latent(numbers: np.ndarray, first: np.ndarray, size: int, stride: int, table: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over each passage's words: over stretches of ``stride`` words, then over those
    that make up a passage. Words of zero rows are passed over."""
    begin, _, row = _passages(first, size, stride)
    start, block_row, base = _stretches(first, stride)
    n = np.bincount(block_row, minlength=len(first) - 1)
    single = table.any(axis=1)
    single[frequent] = False
    used = np.flatnonzero(single[numbers])
    edge = np.searchsorted(used, start)
    blocks = np.zeros((len(start) + size // stride, table.shape[1]), np.float32)
    blocks[: len(start)] = _counts(numbers, start, frequent) @ table[frequent]
    full = np.flatnonzero(np.diff(np.append(edge, len(used))))
    if len(full):
        blocks[full] += np.add.reduceat(table[numbers[used]], edge[full])
    at = base[row] + (begin - first[row]) // stride
    out = blocks[at]
    for k in range(1, size // stride):
        out += blocks[at + k] * (at + k < base[row] + n[row])[:, None]
    return out


def _runs(numbers: np.ndarray, length: int) -> np.ndarray:
    """A key for the ``length`` words from each position on."""
    n = max(0, len(numbers) - length + 1)
    total = np.zeros(n, U)
    for k in range(length):
        total = mix(total + numbers[k : k + n].astype(U) + U(1))
    return total


class _Anchors:
    """Runs of consecutive words of items, by length, and where they are found."""

    def __init__(self, words: list[np.ndarray], lengths: list[int]):
        self.by_length = {}
        for length in sorted(set(lengths)):
            mine = [q for q, n in enumerate(lengths) if n == length]
            keys = [_runs(words[q], length) for q in mine]
            item = np.repeat(mine, [len(x) for x in keys])
            offset = np.concatenate([np.arange(len(x)) for x in keys])
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            self.by_length[length] = keys[order], item[order], offset[order]

    def found(self, numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Row, item, position and offset in the item of each run that lies in one text, in order."""
        out = [np.zeros((0, 4), np.int64)]
        for length, (keys, item, offset) in self.by_length.items():
            got = _runs(numbers, length)
            at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, got), len(keys) - 1)] == got) if len(keys) else np.zeros(0, int)
            at = at[rows[at] == rows[at + length - 1]]
            low, n = np.searchsorted(keys, got[at]), np.searchsorted(keys, got[at], "right")
            n = n - low
            which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at = np.repeat(at, n)
            out.append(np.stack([rows[at], item[which], at, offset[which]], axis=1))
        found = np.concatenate(out)
        return found[np.lexsort(found.T[::-1])]


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 48, stride: int = 24, cosine: float = 0.55,
               cover: float = 0.7, answer_cover: float = 0.5) -> DataFrame:
    """Documents that hold a benchmark item, literally or reworded.

    Returns a row for each document and item: doc_id, item_id, cosine (in the latent space), lcs_share,
    answer_share and the word range first_word, last_word. Words are compared in lower case, without ASCII
    punctuation. An item of fewer than ``SHORT`` words is found where it stands word for word; null ones and
    those without words are never found. Null texts hold nothing. Null and repeated doc_ids are kept, of rows
    equal in all columns one is returned. Empty tables give no rows. Other columns are left out.

    A text that shares three consecutive words with an item is compared with it whatever the cosine, two where
    the item's words are so frequent that they weigh little, so only rewordings that keep no such run depend
    on the cosine. The benchmark is read in blocks of ``BLOCK`` items, each with its own passes.
    """
    if size % stride:
        raise ValueError("size must be a multiple of stride")
    items = (tuple(x) for x in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id long, item_id {kind}, cosine double, lcs_share double, answer_share double, first_word long, last_word long"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in batched(items, BLOCK):
        found = found.unionByName(_leaks(docs, list(block), size, stride, cosine, cover, answer_cover, schema))
    return found.dropDuplicates()


def _leaks(docs, items, size, stride, cosine, cover, answer_cover, schema):
    terms = _Terms(items)
    if not terms.items:
        return docs.sparkSession.createDataFrame([], schema)
    n_terms = len(terms.hashes) + 1

    def numbered(batches):
        for got in batches:
            for part in slices(got, "text", 1 << 20):
                w = folded(part["text"])
                numbers = terms.number(w.hash)
                begin, end, _ = _passages(w.first, size, stride)
                counts = np.bincount(_distinct(numbers, begin, end, n_terms), minlength=n_terms)
                row = {"n": len(begin), "ids": planes(ids_of(part["doc_id"])), "first": planes(w.first.astype(np.int64)), "numbers": planes(numbers), "df": planes(counts.astype(np.int64))}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("n", pa.int64()), *((x, pa.binary()) for x in ("ids", "first", "numbers", "df"))]))

    #: Words as numbers of benchmark terms (0: none), read again by each later pass in the place of texts.
    table = written(docs.mapInArrow(numbered, "n long, ids binary, first binary, numbers binary, df binary"), "terms")
    total = table.agg(F.sum("n")).first()[0] or 0
    df = np.zeros(n_terms)
    got = _summed(table.select("df"), lambda row: unplanes(row["df"], np.int64).astype(float)[:, None], 1)
    df[got[0]] = got[1][:, 0]
    idf = np.log((total + 1) / (df + 1)) + 0.05
    idf[0] = 0
    heavy = idf > 0
    frequent = 1 + np.argsort(-df[1:], kind="stable")[:FREQUENT]
    #: Items as passages too: a long item is so many of them, and a short one is not searched by cosine.
    longest = [x if len(x) >= SHORT else x[:0] for x in terms.words]
    query_begin, query_end, query_item = _passages(np.cumsum([0, *map(len, longest)]), size, stride)
    words = np.concatenate(longest)
    items_by_term = np.zeros((len(query_begin), n_terms))
    for k, (i, j) in enumerate(zip(query_begin, query_end, strict=True)):
        np.add.at(items_by_term[k], words[i:j], 1.0)
    items_by_term *= idf
    rank = min(n_terms - 1, max(8, min(RANK, len(query_begin) // 2)))
    width = min(n_terms - 1, rank + EXTRA)
    probe = np.random.default_rng(7).standard_normal((n_terms, width)) * heavy[:, None]
    projected = (probe * idf[:, None]).astype(np.float32)

    def range_of(row):  # A'A times the probe: each word adds its passages' projections to its term
        first, numbers = unplanes(row["first"], np.int64), unplanes(row["numbers"], np.int32)
        begin, end, _ = _passages(first, size, stride)
        y = _latent(numbers, first, size, stride, projected, frequent)
        start, _, _ = _stretches(first, stride)
        z = np.zeros((len(start), width), np.float32)  # of each stretch, the sum over the passages that hold it
        at = np.searchsorted(begin, start, "right") - 1
        for back in range(size // stride):
            p = np.maximum(at - back, 0)
            inside = (at >= back) & (begin[p] <= start) & (start < end[p])
            z[inside] += y[p[inside]]
        out = np.zeros((n_terms, width))
        out[frequent] = _counts(numbers, start, frequent).T @ z
        single = heavy.copy()
        single[frequent] = False
        used = np.flatnonzero(single[numbers])
        term = numbers[used]
        order = np.argsort(term, kind="stable")
        if len(order):
            starts = np.flatnonzero(np.append(True, np.diff(term[order]) > 0))
            out[term[order][starts]] += np.add.reduceat(z[np.searchsorted(start, used[order], "right") - 1], starts)
        return out * idf[:, None]

    got = _summed(table, range_of, width)
    sketch = np.zeros((n_terms, width))
    sketch[got[0]] = got[1]
    #: The benchmark's own passages weigh as much as the corpus's, so the space holds what tells items apart.
    sketch += (max(total, 1) / max(1, len(query_begin))) * (items_by_term.T @ (items_by_term @ probe))
    space = _eigenvectors(sketch, probe, rank)
    in_space = items_by_term @ space
    in_space = (in_space / np.maximum(np.linalg.norm(in_space, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    folding = (space * idf[:, None]).astype(np.float32)  # what a word adds to its passage's place in the space
    usual = np.median(idf[heavy]) if heavy.any() else 1.0
    light = [(idf[x] ** 2).mean() < usual**2 / 4 for x in terms.words]
    anchors = _Anchors(terms.words, [len(x) if len(x) < SHORT else WEAK_RUN if y else RUN for x, y in zip(terms.words, light, strict=True)])

    def search(batches):
        names = [x.strip().split()[0] for x in schema.split(",")]
        for got in batches:
            for x in got.to_pylist():
                ids, first, numbers = unplanes(x["ids"], np.int64), unplanes(x["first"], np.int64), unplanes(x["numbers"], np.int32)
                if len(numbers):
                    rows = _matches(ids, first, numbers)
                    if rows:
                        yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)})

    def _matches(ids, first, numbers):
        begin, end, row = _passages(first, size, stride)
        place = _latent(numbers, first, size, stride, folding, frequent)
        place /= np.maximum(np.linalg.norm(place, axis=1, keepdims=True), np.float32(1e-9))
        best: dict[tuple, tuple] = {}
        seen: dict[tuple, tuple] = {}  # the last stretch that was compared with an item

        def compare(r, q, low, high, near):
            low, high, item = int(max(first[r], low)), int(min(first[r + 1], high)), terms.words[q]
            seen[r, q] = low, high
            if np.count_nonzero(np.isin(item, numbers[low:high])) < cover * len(item):
                return  # too few words in common for any subsequence
            pairs = common(item.tolist(), numbers[low:high].tolist())
            answer = terms.answer[q]
            share, told = len(pairs) / len(item), sum(i >= answer for i, _ in pairs) / (len(item) - answer)
            if share >= cover and told >= answer_cover:
                found = (share, near, told, int(low - first[r] + pairs[0][1]), int(low - first[r] + pairs[-1][1]))
                best[r, q] = max(best.get((r, q), found), found)

        for low in range(0, len(place), 4096):
            near = place[low : low + 4096] @ in_space.T
            for p, k in zip(*np.nonzero(near >= cosine), strict=True):
                q = query_item[k]
                compare(row[low + p], q, begin[low + p] - len(terms.words[q]), end[low + p] + len(terms.words[q]), float(near[p, k]))
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        whole = set(best)
        seen.clear()
        for r, q, at, offset in anchors.found(numbers, rows).tolist():
            size_of = len(terms.words[q])
            low, high = max(at - offset, first[r]), min(at - offset + size_of, first[r + 1])
            before = seen.get((r, q))
            if (r, q) in whole or before and before[0] <= low and high <= before[1]:
                continue  # found by its cosine, or compared with what an earlier run began
            p = int(np.searchsorted(begin, at, "right")) - 1
            compare(r, q, low - size_of, high + size_of, float((in_space[query_item == q] @ place[p]).max(initial=0.0)))
        return [(None if ids[r] == LAST else int(ids[r]), items[terms.items[q]][0], c, s, t, i, j) for (r, q), (s, c, t, i, j) in best.items()]

    return table.select("ids", "first", "numbers").mapInArrow(search, schema)


def _eigenvectors(sketch: np.ndarray, probe: np.ndarray, rank: int) -> np.ndarray:
    """At most ``rank`` leading eigenvectors of a positive matrix K from K @ probe alone (one pass over the data)."""
    shift = 1e-9 * np.linalg.norm(sketch)
    sketch = sketch + shift * probe
    values, vectors = np.linalg.eigh((m := probe.T @ sketch) / 2 + m.T / 2)
    good = values > values.max(initial=0) * 1e-10
    return np.linalg.svd(sketch @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)[0][:, :rank]


def _distinct(numbers, begin, end, n_terms):
    """The terms of each passage, once each."""
    size = (end - begin).max(initial=1)
    at = begin[:, None] + np.arange(size)
    inside = at < end[:, None]
    found = np.where(inside, numbers[np.minimum(at, max(len(numbers) - 1, 0))], 0) if len(numbers) else np.zeros((0, 1), int)
    found.sort(axis=1)
    return found[:, 1:][found[:, 1:] != found[:, :-1]]


def _summed(table: DataFrame, part, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums, row by row, of the matrices that ``part`` makes of the table's rows; one a task is sent on.
    The driver gets one matrix of benchmark terms, whatever the number of documents."""

    def run(batches):
        total = None
        for got in batches:
            for row in got.to_pylist():
                x = part(row)
                total = x if total is None else total + x
        if total is not None:
            at = np.flatnonzero(np.any(total != 0, axis=1))
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * width + 1, width), pa.int32()), pa.array(total[at].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(at), values], ["at", "x"])

    rows = table.mapInArrow(run, "at long, x array<double>").groupBy("at").agg(*(F.sum(F.col("x")[k]).alias(f"x{k}") for k in range(width))).toPandas()
    return rows["at"].to_numpy(np.int64), rows.iloc[:, 1:].to_numpy(float)

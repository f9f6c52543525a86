"""SentencePiece encoding and decoding: N-best segmentations of the piece lattice.

The lattice of a text has an edge for each piece of the model that occurs in it; a segmentation's score is
the sum of its pieces' scores. A forward Viterbi pass gives the best score of every prefix, which is the
exact heuristic of the A* search that then runs backward from the end: the k-th path to reach the start is
the k-th best. Characters that no piece covers fall back to bytes, at a score below all pieces.

No piece crosses from a word into the white space after it, so a text's lattice is a chain of words'
lattices. A worker searches the distinct words of a batch at once, each word one time, and the text's N best
are merged from theirs: where another choice of a word can matter, the word's own search goes on.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Tiles, U, gathered, room, slices, utf8

SPACE = "▁"
_CACHE_ENTRIES = 400_000
_WIDEST = 64  #: longer words are searched one by one
_ROWS = 8192
_FACTOR, _SPREAD, _SLOT_BITS = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), 20
_total = itemgetter(0)


class _Beginnings:
    """Every beginning of a piece by its hash: where it is among them, its id (-1 for none) and its score."""

    def __init__(self, begun: dict[str, tuple[int, float] | None]):
        names = list(begun)
        h = np.zeros(len(names), U)
        for k in range(max(map(len, names), default=0)):
            at = np.array([n for n, x in enumerate(names) if len(x) > k], np.int64)
            h[at] = (h[at] + np.array([ord(names[n][k]) + 1 for n in at.tolist()], U)) * _FACTOR
        order = np.argsort(self._slot(h), kind="stable")
        self.keys = h[order]
        if len(np.unique(h)) < len(h):
            raise ValueError("two beginnings of pieces have one hash")
        found = [begun[names[k]] for k in order.tolist()]
        self.ids = np.array([x[0] if x else -1 for x in found], np.int64)
        self.score = np.array([x[1] if x else 0.0 for x in found])
        self.first = np.searchsorted(self._slot(self.keys), np.arange(1 << _SLOT_BITS)).astype(np.int32)
        self.deepest = int(np.bincount(self._slot(h), minlength=1).max(initial=1))

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (((h ^ (h >> U(32))) * _SPREAD) >> U(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        base, out = self.first[self._slot(h)], np.full(len(h), -1, np.int64)
        for k in range(self.deepest):
            at = np.minimum(base + k, len(self.keys) - 1)
            out = np.where(self.keys[at] == h, at, out)
        return out


class _Known:
    """Words searched so far: their best ids in one array, scores, and losses by the second choice."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(4096, np.uint32), 0
        self.start, self.size, self.score, self.loss = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024), np.zeros(1024)

    def add(self, words: list[bytes], flat, start, size, score, loss) -> None:
        n, m = len(self.at), len(words)
        self.at.update(zip(words, range(n, n + m), strict=True))
        self.flat = room(self.flat, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        for name, x in (("start", start + self.used), ("size", size), ("score", score), ("loss", loss)):
            column = room(getattr(self, name), n + m)
            column[n : n + m] = x
            setattr(self, name, column)
        self.used += len(flat)


class Lattice:
    """A piece model. ``pieces`` maps text to (id, score), ``byte_ids`` has 256 ids."""

    _loaded: dict[str, Lattice] = {}

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], normalize=None):
        if any(SPACE in x.lstrip(SPACE) for x in pieces):
            raise ValueError("a piece crosses a word's end")
        self.pieces, self.byte_ids = pieces, byte_ids
        self.longest = max(map(len, pieces))
        #: Every beginning of a piece, with the piece if it is one: a search stops where no piece goes on.
        self.begun: dict[str, tuple[int, float] | None] = dict.fromkeys((x[:k] for x in pieces for k in range(1, len(x))), None) | pieces
        self.byte_score = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self.normalize = normalize or (lambda x: SPACE + x.replace(" ", SPACE) if x else "")
        self.bytes_of = {i: p.replace(SPACE, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        #: White space that no piece holds is a word of its own.
        self.break_alone = not any("\n" in x for x in pieces)
        self.beginnings = _Beginnings(self.begun)
        raw = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=-1) + 1)]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.known, self.ranked = _Known(), {}

    @classmethod
    def load(cls, path: str) -> Lattice:
        if path not in cls._loaded:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            ids = range(sp.get_piece_size())
            plain = {sp.id_to_piece(i): (i, float(sp.get_score(i))) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
            cls._loaded[path] = cls(plain, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], sp.normalize)
        return cls._loaded[path]

    def segment(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations (score, ids) of one word, best first; equal scores in a fixed order."""
        pieces, longest, size = self.pieces, self.longest, len(text)
        get = self.begun.get
        best = [-1e300] * (size + 1)
        best[0] = 0.0
        into: list[list] = [[] for _ in range(size + 1)]
        for i in range(size):
            at = best[i]
            for j in range(i + 1, min(size, i + longest) + 1):
                found = get(text[i:j], 0)
                if found == 0:
                    break
                if found:
                    total = at + found[1]
                    into[j].append((-total, i, found[0], found[1]))
                    if total > best[j]:
                        best[j] = total
            if text[i] not in pieces:
                total = at + self.byte_score
                into[i + 1].append((-total, i, text[i], self.byte_score))
                if total > best[i + 1]:
                    best[i + 1] = total
        #: A heap entry is the path behind j and the next edge into j to try, by rank. Of equal totals the path
        #: nearest the start goes on, so ties cost no breadth.
        for edges in into:
            if len(edges) > 1:
                edges.sort(key=_total)
        heap, made, out = [(-best[size], size, 0, 0, 0.0, None)], 0, []
        push, pop = heapq.heappush, heapq.heappop
        while heap and len(out) < n:
            _, j, _, rank, behind, path = pop(heap)
            if not j:
                ids: list[int] = []
                while path:
                    x, path = path
                    if isinstance(x, str):
                        ids += [self.byte_ids[b] for b in x.encode()]
                    else:
                        ids.append(x)
                out.append((behind, tuple(ids)))
                continue
            edges = into[j]
            if rank + 1 < len(edges):
                made += 1
                push(heap, (edges[rank + 1][0] - behind, j, made, rank + 1, behind, path))
            total, i, x, score = edges[rank]
            made += 1
            push(heap, (total - behind, i, made, 0, behind + score, (x, path)))
        return out

    def best_two(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """The first two results of ``segment`` for many words at once: the best's ids (one array, with each
        word's start and size in it) and score, and how much the second loses.

        The forward pass goes over all words of about one length by position. Backward, the search's first
        path follows the best edges; its second leaves that path by the cheapest other edge into one of its
        nodes and then follows the best ones again.
        """
        n = len(words)
        length = np.array([len(x) for x in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        first = np.cumsum(length) - length
        start, size, score, loss = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
        flats, used = [], 0
        wide = -(-length // 4) * 4
        scalar = np.flatnonzero(length > _WIDEST).tolist()
        for w in np.unique(wide[length <= _WIDEST]).tolist():
            group = np.flatnonzero(wide == w)
            for rows in (group[k : k + _ROWS] for k in range(0, len(group), _ROWS)):
                at = first[rows] + np.arange(w)[:, None]
                chars = np.where(np.arange(w)[:, None] < length[rows], code[np.minimum(at, len(code) - 1)].astype(U) + U(1), U(0))
                ids, count, score[rows], loss[rows], odd = self._backward(*self._forward(chars), length[rows])
                flats.append(ids)
                size[rows], start[rows] = count, used + np.cumsum(count) - count
                used += len(ids)
                scalar += rows[odd].tolist()
        for k in scalar:
            ranked = self.segment(words[k], 2)
            flats.append(np.array(ranked[0][1], np.int64))
            start[k], size[k], score[k], loss[k] = used, len(flats[-1]), ranked[0][0], ranked[0][0] - ranked[1][0] if len(ranked) > 1 else np.inf
            used += size[k]
        return np.concatenate([np.zeros(0, np.int64), *flats]).astype(np.uint32), start, size, score, loss

    def _forward(self, chars: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each prefix of words (a column each, characters from 1, 0 after the end): the best score and the
        second best edge's, where the best edge begins and its id (-1 - a character for its bytes)."""
        w, m = chars.shape
        best, second = np.full((w + 1, m), -np.inf), np.full((w + 1, m), -np.inf)
        best[0] = 0
        back, ids = np.zeros((w + 1, m), np.int64), np.zeros((w + 1, m), np.int64)

        def edges(i, j, rows, total, found):
            old = best[j, rows]
            second[j, rows] = np.maximum(second[j, rows], np.minimum(old, total))
            better = total > old
            rows = rows[better]
            best[j, rows], back[j, rows], ids[j, rows] = total[better], i, found[better]

        table = self.beginnings
        for i in range(w):
            live = np.flatnonzero(chars[i])
            h = np.zeros(len(live), U)
            for j in range(i + 1, min(w, i + self.longest) + 1):
                c = chars[j - 1, live]
                h = (h + c) * _FACTOR
                at = np.where(c > 0, table.find(h), -1)
                is_piece = (at >= 0) & (table.ids[at] >= 0)
                if j == i + 1 and not is_piece.all():
                    rows = live[~is_piece]
                    edges(i, j, rows, best[i, rows] + self.byte_score, -chars[i, rows].astype(np.int64))
                rows, of = live[is_piece], at[is_piece]
                edges(i, j, rows, best[i, rows] + table.score[of], table.ids[of])
                live, h = live[at >= 0], h[at >= 0]
                if not len(live):
                    break
        return best, second, back, ids

    def _backward(self, best, second, back, ids, length) -> tuple[np.ndarray, ...]:
        w, m = best.shape
        out, count, loss = np.zeros((w, m), np.int64), np.zeros(m, np.int64), np.full(m, np.inf)
        at, live = length.copy(), np.flatnonzero(length)
        for k in range(w):
            if not len(live):
                break
            j = at[live]
            loss[live] = np.minimum(loss[live], best[j, live] - second[j, live])
            out[k, live], at[live] = ids[j, live], back[j, live]
            count[live] += 1
            live = live[at[live] > 0]
        rows = np.repeat(np.arange(m), count)
        place = np.repeat(np.cumsum(count), count) - 1 - np.arange(len(rows))
        found = out[place, rows]
        byte = found < 0
        odd = np.unique(rows[found < -128])  # characters of several bytes that no piece holds
        found[byte] = np.array(self.byte_ids, np.int64)[np.minimum(-1 - found[byte], 127)]
        return found, count, best[length, np.arange(m)], loss, odd

    def _tiles(self, texts: list[str]) -> Tiles:
        """Words of normalised texts, as bytes with plain spaces."""
        data, offsets = utf8(pa.array([self.normalize(x).replace(SPACE, " ") for x in texts], pa.large_string()))
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        if self.break_alone:
            breaks = data == 10
            begins |= breaks
            begins[1:] |= breaks[:-1]
        return Tiles(data, offsets, begins)

    def batch(self, texts: list[str], n: int):
        """Of texts: the best ids of all end to end, where each text's begin (and the end), each text's score, and
        its other choices as lists of (score, ids as bytes), up to ``n`` in all."""
        tiles, known = self._tiles(texts), self.known
        if len(known.at) > _CACHE_ENTRIES:
            known = self.known = _Known()
        if new := [x for x in tiles.words if x not in known.at]:
            known.add(new, *self.best_two([x.decode().replace(" ", SPACE) for x in new]))
        of = np.array([known.at[x] for x in tiles.words], np.int64)[tiles.of]
        size = known.size[of]
        ids = gathered(known.flat, known.start[of], size)
        place = np.append(0, np.cumsum(size))
        edge = place[tiles.first]
        counts = np.diff(tiles.first)
        some = np.flatnonzero(counts)
        begin = tiles.first[some]
        score = np.zeros(len(texts))
        if len(some):
            score[some] = np.add.reduceat(known.score[of], begin)
        #: Only the n - 1 words that lose least by their second choice can differ among the n best.
        loss, few = known.loss[of], [[] for _ in texts]
        for _ in range(n - 1 if len(some) else 0):
            least = np.minimum.reduceat(loss, begin)
            where = np.flatnonzero(loss == np.repeat(least, counts[some]))
            where = where[np.searchsorted(where, begin)]
            for t, k, x in zip(some.tolist(), where.tolist(), least.tolist(), strict=True):
                if x < np.inf:
                    few[t].append(k)
            loss[where] = np.inf
        others = [self._others(n, score[t], few[t], tiles, ids, place, edge[t], edge[t + 1]) for t in range(len(texts))]
        return ids, edge, score, others

    def _others(self, n, score, few, tiles, ids, place, begin, end) -> list[tuple[float, bytes]]:
        choices = {}
        for k in few:
            word = tiles.words[tiles.of[k]]
            if (word, n) not in self.ranked:
                if len(self.ranked) > 20_000:
                    self.ranked.clear()
                self.ranked[word, n] = self.segment(word.decode().replace(" ", SPACE), n)
            choices[k] = self.ranked[word, n]
        merged: list[tuple[float, tuple]] = [(0.0, ())]
        for k in few:
            losses = [choices[k][0][0] - s for s, _ in choices[k]]
            merged = sorted((loss + more, (*chosen, (k, c)) if c else chosen) for loss, chosen in merged for c, more in enumerate(losses))[:n]
        out = []
        for loss, chosen in merged[1:]:
            parts, at = [], begin
            for k, c in sorted(chosen):
                parts += [ids[at : place[k]].astype("<u4").tobytes(), np.array(choices[k][c][1], "<u4").tobytes()]
                at = place[k + 1]
            out.append((float(score - loss), b"".join([*parts, ids[at:end].astype("<u4").tobytes()])))
        return out

    def nbest(self, text: str, n: int = 3) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations (score, ids as little-endian uint32) of a whole text, best first."""
        ids, _, score, others = self.batch([text], n)
        return [(float(score[0]), ids.astype("<u4").tobytes()), *others[0]]

    def decoded(self, ids: np.ndarray, edge: np.ndarray) -> list[bytes]:
        """The bytes of texts' ids (one array, and where each text's begin), without the space that
        normalisation puts before them."""
        size = self.raw_size[ids]
        raw = gathered(self.raw, self.raw_start[ids], size).tobytes()
        at = np.append(0, np.cumsum(size))[edge].tolist()
        return [raw[i:j].removeprefix(b" ") for i, j in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return self.decoded(ids, np.array([0, len(ids)]))[0].decode("utf-8", "replace")


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("score", pa.float64()),
    ("next_scores", pa.list_(pa.float64())), ("next_crc32", pa.list_(pa.int64())), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()),
])


def encoded(docs: DataFrame, model: str, n: int = 3, with_ids: bool = True) -> DataFrame:
    """The ``n`` best segmentations of each whole text, and the best one decoded again.

    Returns doc_id, n_pieces, ids (little-endian uint32, if wanted), ids_crc32 and score of the best,
    next_scores and next_crc32 of the others (fewer if the text has fewer), decoded_sha256 and round_trip
    (whether decoding gives the text again; U+2581 stands for a space and comes back as one). A null text is
    empty, and an empty one has no pieces and a score of 0. Rows are independent; null and repeated doc_ids
    are kept. An empty table gives no rows. Other columns are left out.
    """
    fields = [x for x in _OUT if with_ids or x.name != "ids"]

    def run(batches):
        lattice = Lattice.load(model)
        for got in batches:
            for part in slices(got, "text", 1 << 20):
                rows, texts = [], [x or "" for x in part["text"].to_pylist()]
                ids, edge, scores, others = lattice.batch(texts, n)
                ids = ids.astype("<u4")
                for k, (doc, text, raw) in enumerate(zip(part["doc_id"].to_pylist(), texts, lattice.decoded(ids, edge), strict=True)):
                    mine, same = ids[edge[k] : edge[k + 1]].tobytes(), raw == text.encode()
                    if not same:
                        again = raw.decode("utf-8", "replace")
                        raw, same = again.encode(), again == text
                    rows.append((doc, len(mine) // 4, mine, zlib.crc32(mine), float(scores[k]), [s for s, _ in others[k]], [zlib.crc32(x) for _, x in others[k]],
                                 hashlib.sha256(raw).hexdigest(), same))
                columns = [c for c, f in zip(zip(*rows, strict=True), _OUT, strict=True) if f in fields]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    ddl = "doc_id long, n_pieces long, " + "ids binary, " * with_ids + "ids_crc32 long, score double, next_scores array<double>, next_crc32 array<long>, decoded_sha256 string, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)

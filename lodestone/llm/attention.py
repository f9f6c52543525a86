"""Language-model scores from causal self-attention over subword ids, trained in numpy.

A text's subwords are scored in windows of WINDOW ids that overlap by WINDOW - STRIDE, each id once, with
one batched masked attention over all windows of a batch. The network predicts the class of the next
subword; which of the class it is follows the counts of all training documents. A word's probability is
that of its subwords and of ending there, mixed with its share of all training words, so the probabilities of
all words and of the end sum to at most 1. The network starts from about ``SAMPLE_DOCS`` documents and then
learns from every training document: each task goes over all its windows, and the tasks' parameters are
averaged. Classes, words, subwords and the mixture follow all training documents.

Texts are read once. What later passes read are a batch's distinct words, as subwords, and which of them each
word is.
"""

from __future__ import annotations

import copy
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, gathered, numbered, slices, words_of
from .packing import LAST, bucket_count, deltas, ids_of, planes, ranges, text_bytes, undeltas, unplanes
from .tables import bucketed, written

WINDOW, STRIDE, SIZE, HEAD = 32, 24, 16, 8
STARTS, INSIDES = 20, 19  #: classes of subwords that begin a word and that don't; one more is the end
FREQUENT = 3000  #: subwords with an input vector of their own; others have their class's
SAMPLE_DOCS = 1500  #: chosen by a bound on their hash; the start alone depends on it
MET = 1 << 19  #: words whose subwords a worker remembers
MARKS = 96  #: frequent subwords by which the others' neighbours are told
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_processors: dict = {}


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


class Subwords:
    """Ids of lower-cased texts, cut into words. The end of a text is the id after the model's last."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.sp.get_piece_size()
        self.starts = np.array([self.sp.id_to_piece(i).startswith("▁") for i in range(self.size)])
        #: Words encoded before: hashes in order, where the ids of each begin among all, how many it has, all ids.
        self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @classmethod
    def get(cls, path: str) -> Subwords:
        if path not in _processors:
            _processors[path] = cls(path)
        return _processors[path]

    def of(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids and where each word begins among them."""
        words = [_WORD.findall((x or "").translate(_LOWER)) for x in texts]
        out = []
        for w, ids in zip(words, self.sp.encode([" ".join(x) for x in words], num_threads=1), strict=True):
            ids = np.array(ids, np.int32)
            first = np.flatnonzero(self.starts[ids])
            if len(first) != len(w):  # a word holds what the model takes for a space
                parts = [np.array(x, np.int32) for x in self.sp.encode(w, num_threads=1)]
                ids = np.concatenate(parts)
                first = np.cumsum([0, *(len(x) for x in parts[:-1])])
            out.append((ids, first))
        return out


    def distinct(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words' hashes in order, which of them each word is, their ids end to end and how many each
        has. No piece crosses white space, so a word has the same ids in every text."""
        of, hashes = numbered(w.hash)
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        index = np.empty(len(order), np.int64)
        index[of[::-1]] = np.arange(len(of))[::-1]
        index, hashes = index[order], hashes[order]
        known, start, size, ids = self.met
        at = np.searchsorted(known, hashes)
        met = np.append(known, np.uint64(0))[at] == hashes
        met[at == len(known)] = False
        raw, new = w.data.tobytes(), index[~met]
        words = [raw[i:j].decode("utf-8", "replace") for i, j in zip(w.start[new].tolist(), w.end[new].tolist(), strict=True)]
        lists = [x or [0] for x in self.sp.encode(words, num_threads=1)] if words else []
        sizes, starts, made = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64), np.array([len(x) for x in lists], np.int64)
        sizes[met], sizes[~met] = size[at[met]], made
        starts[met], starts[~met] = start[at[met]], len(ids) + np.cumsum(made) - made
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(lists), np.int32, int(made.sum()))])
        flat = gathered(ids, starts, sizes)
        if len(known) + len(new) > MET:  # starts over with the words of this batch
            self.met = hashes[:MET], np.cumsum(sizes)[:MET] - sizes[:MET], sizes[:MET], flat
        else:
            into = np.argsort(all_ := np.concatenate([known, hashes[~met]]), kind="stable")
            self.met = all_[into], np.concatenate([start, starts[~met]])[into], np.concatenate([size, made])[into], ids
        return hashes, place[of], flat, sizes


def _sequence(of: np.ndarray, flat: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A batch's ids end to end, and where each text begins among them."""
    starts, each = np.cumsum(sizes) - sizes, np.append(0, np.cumsum(sizes[of]))
    return flat[np.repeat(starts[of] - each[:-1], sizes[of]) + np.arange(each[-1])], each[first]


_BATCH = pa.schema([("batch", pa.int64()), ("docs", pa.int64()), ("learned", pa.int64()), *((x, pa.binary()) for x in ("ids", "first", "of", "flat", "sizes", "hashes", "counts", "pieces"))])
_BATCH_DDL = "batch long, docs long, learned long, ids binary, first binary, of binary, flat binary, sizes binary, hashes binary, counts binary, pieces binary"


def _encoder(model: str):
    """Batches of documents: doc_ids, first words, words by number; and of the distinct words subwords, hashes
    and counts in training documents."""

    def run(batches):
        subwords, made = Subwords.get(model), 0
        for got in batches:
            for part in slices(got, "text", 4 << 20):
                ids = ids_of(part["doc_id"])
                w = words_of(part["text"], lower=True)
                hashes, of, flat, sizes = subwords.distinct(w)
                learn = _learns(ids)
                counts = np.bincount(of, learn[w.rows], len(hashes)).astype(np.int64)
                pieces = np.bincount(flat, np.repeat(counts, sizes), subwords.size).astype(np.int64)
                row = {
                    "batch": TaskContext.get().partitionId() << 32 | made, "docs": len(ids), "learned": int(learn.sum()), "ids": planes(ids), "first": planes(w.first.astype(np.int64)),
                    "of": planes(of.astype(np.int32)), "flat": planes(flat.astype(np.int32)), "sizes": planes(sizes.astype(np.int32)), "hashes": deltas(hashes), "counts": planes(counts), "pieces": planes(pieces),
                }
                made += 1
                yield pa.RecordBatch.from_pylist([row], schema=_BATCH)

    return run


class _Batch:
    """What a row of encoded batches holds."""

    def __init__(self, row: dict):
        self.ids, self.first = unplanes(row["ids"], np.int64), unplanes(row["first"], np.int64)
        self.of, self.flat, self.sizes = (unplanes(row[x], np.int32).astype(np.int64) for x in ("of", "flat", "sizes"))

    def learned(self) -> list[np.ndarray]:
        """The subwords of each training document."""
        ids, at = _sequence(self.of, self.flat.astype(np.int32), self.sizes, self.first)
        return [ids[i:j] for x, i, j in zip(_learns(self.ids), at[:-1], at[1:], strict=True) if x]


def _learns(ids: np.ndarray) -> np.ndarray:
    return np.array([not held_out(None if x == LAST else x) for x in ids.tolist()], bool)


def _marks(counts: np.ndarray, n: int) -> np.ndarray:
    mark = np.full(n, -1)
    marks = np.argsort(-counts[:n], kind="stable")[:MARKS]
    mark[marks] = np.arange(len(marks))
    return mark


def _neighbours(encoded: DataFrame, mark: np.ndarray) -> np.ndarray:
    """How often each mark stands after and before each subword in all training documents."""

    def run(batches):
        total = np.zeros(len(mark) * 2 * MARKS, np.int64)
        for got in batches:
            for row in got.to_pylist():
                texts = _Batch(row).learned()
                if not texts:
                    continue
                ids, edge = np.concatenate(texts), np.cumsum([len(x) for x in texts])[:-1]
                inside = np.ones(len(ids), bool)
                inside[edge[edge < len(ids)]] = False  # no subword stands before a text's first
                a, b = ids[:-1][inside[1:]], ids[1:][inside[1:]]
                for x, y, shift in ((a, b, 0), (b, a, MARKS)):
                    known = mark[y] >= 0
                    total += np.bincount(x[known].astype(np.int64) * 2 * MARKS + mark[y[known]] + shift, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    got = encoded.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(mark) * 2 * MARKS, np.float32)
    out[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(np.float32)
    return out.reshape(len(mark), 2 * MARKS)


def _classes(seen: np.ndarray, counts: np.ndarray, starts: np.ndarray, rng) -> np.ndarray:
    """A class for each subword, by what stands before and after it: 0 is the end's, then STARTS for those
    that begin a word, then INSIDES. The last of either kind takes the subwords with few neighbours."""
    n = len(starts)
    out = np.zeros(n + 1, np.int64)
    expected = seen.sum(0) / max(seen.sum(), 1)
    for flag, low, k in ((True, 1, STARTS), (False, 1 + STARTS, INSIDES)):
        mine = np.flatnonzero(starts == flag)
        total = seen[mine].sum(1)
        known = mine[total >= 20]
        out[mine] = low + k - 1
        if len(known) < k:
            continue
        rows = np.sqrt(seen[known] / seen[known].sum(1, keepdims=True)) - np.sqrt(expected)
        centers = rows[rng.choice(len(rows), k - 1, False, p=counts[known] / counts[known].sum() if counts[known].all() else None)]
        for _ in range(12):
            near = ((rows**2).sum(1)[:, None] - 2 * rows @ centers.T + (centers**2).sum(1)).argmin(1)
            for c in range(k - 1):
                if (near == c).any():
                    centers[c] = np.average(rows[near == c], axis=0, weights=counts[known][near == c] + 1)
        out[known] = low + near
    return out


_MOST = np.float32(60)


def _capped(x: np.ndarray) -> np.ndarray:
    """The array with no more than ``_MOST``: the greatest is found much faster than a minimum is taken."""
    return np.minimum(x, _MOST, out=x) if x.size and x.max() > _MOST else x


def _by(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The product of all rows with one matrix, as one product of matrices."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], *w.shape[1:])


def _total(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis: for a short one a product with ones is the fast way."""
    return _by(x, np.ones(x.shape[-1], x.dtype))


class _Adam:
    def __init__(self, p: dict):
        self.p, self.n = p, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def update(self, gradients: dict, rate: float) -> None:
        self.n += 1
        for k, d in gradients.items():
            self.first[k] += 0.1 * (d - self.first[k])
            self.second[k] += 0.01 * (d * d - self.second[k])
            self.p[k] -= rate * (self.first[k] / (1 - 0.9**self.n)) / (np.sqrt(self.second[k] / (1 - 0.99**self.n)) + 1e-8)


def _trained(encoded: DataFrame, network: Network) -> int:
    """Trains on every training document: each task from the same start over all its windows, then the mean
    of the tasks' parameters by their targets. Returns the number of targets."""
    names = list(network.p)

    def run(batches):
        mine, total, adam = copy.deepcopy(network), 0, None
        for got in batches:
            for row in got.to_pylist():
                if texts := _Batch(row).learned():
                    adam = adam or _Adam(mine.p)
                    total += mine.learn(texts, np.random.default_rng(row["batch"]), adam)
        if total:
            flat = np.concatenate([mine.p[k].reshape(-1) for k in names]).astype(float) * total
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([flat.tobytes()], pa.binary())], ["n", "p"])

    def summed(batches):
        n, total = 0, 0.0
        for got in batches:
            for row in got.to_pylist():
                n, total = n + row["n"], total + np.frombuffer(row["p"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "p"])

    parts = encoded.mapInArrow(run, "n long, p binary").repartition(8).mapInArrow(summed, "n long, p binary").collect()
    n = sum(x["n"] for x in parts)
    if n:
        flat = np.sum([np.frombuffer(x["p"]) for x in parts], axis=0) / n
        for k in names:
            size = network.p[k].size
            network.p[k], flat = flat[:size].reshape(network.p[k].shape).astype(np.float32), flat[size:]
    return n


class Network:
    """One causal attention head over class-and-subword vectors, with a residual path, to class scores."""

    def __init__(self, counts: np.ndarray, classes: np.ndarray, rng):
        n = len(classes) - 1
        self.classes, self.n_classes = classes, 1 + STARTS + INSIDES
        self.begins = np.arange(self.n_classes) <= STARTS
        frequent = np.argsort(-counts[:n], kind="stable")[:FREQUENT]
        self.row = FREQUENT + classes
        self.row[frequent] = np.arange(len(frequent))
        share = counts + 0.1
        self.within = np.log(share / np.bincount(classes, share, self.n_classes)[classes]).astype(np.float32)
        base = np.log(np.bincount(classes, share, self.n_classes) + 1.0)
        base[np.bincount(classes, minlength=self.n_classes) == 0] -= 40.0  # nothing is of such a class
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-1] if len(shape) == 1 else shape[0])).astype(np.float32)
        self.p = {
            "vectors": 0.3 * draw(FREQUENT + self.n_classes, SIZE) * np.sqrt(FREQUENT), "places": 0.1 * draw(WINDOW, SIZE) * np.sqrt(WINDOW),
            "q": draw(SIZE, HEAD), "k": draw(SIZE, HEAD), "v": draw(SIZE, HEAD), "o": draw(HEAD, SIZE),
            "out": 0.1 * draw(SIZE, self.n_classes), "bias": (base - base.max()).astype(np.float32),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale = np.float32(HEAD**-0.5)
        self.mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def forward(self, rows: np.ndarray) -> dict:
        p = self.p
        x = p["vectors"].take(rows, axis=0)
        x += p["places"]
        w = np.concatenate([p["q"] * self.scale, p["k"], p["v"]], axis=1)
        q, k, v = np.split(_by(x, w), 3, axis=-1)
        e = _capped(q @ k.transpose(0, 2, 1))  # in the place of the greatest of each row: exp can't overflow
        np.exp(e, out=e)
        e *= self.mask
        inverse = 1 / _total(e)[..., None]
        m = e @ v
        m *= inverse  # a row's weights are divided by their sum here, where rows are short
        h = _by(m, p["o"])
        h += x
        return {"x": x, "w": w, "q": q, "k": k, "v": v, "e": e, "inverse": inverse, "m": m, "h": h}

    def outcomes(self, h: np.ndarray) -> np.ndarray:
        """Scores of the classes."""
        y = _by(h, self.p["out"])
        y += self.p["bias"]
        return _capped(y)

    def step(self, rows: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of the targets' classes."""
        p, f = self.p, self.forward(rows)
        flat = lambda z: z.reshape(-1, z.shape[-1])
        dy, at = flat(self.outcomes(f["h"])), np.arange(targets.size) * self.n_classes + targets.reshape(-1)
        weight = weight.reshape(-1) / max(float(weight.sum()), 1.0)
        chosen = dy.take(at)
        np.exp(dy, out=dy)
        total = _total(dy)
        loss = float((weight * (np.log(total) - chosen)).sum())
        dy *= (weight / total)[..., None]
        dy.reshape(-1)[at] -= weight
        g = {"out": flat(f["h"]).T @ dy, "bias": np.ones(len(dy), dy.dtype) @ dy}
        dh = _by(dy, p["out"].T).reshape(f["h"].shape)
        g["o"] = flat(f["m"]).T @ flat(dh)
        dm = _by(dh, p["o"].T)
        dm *= f["inverse"]
        ds = dm @ f["v"].transpose(0, 2, 1)
        ds -= _total(dm * f["m"])[..., None]
        ds *= f["e"]
        d = np.empty((*rows.shape, 3 * HEAD), ds.dtype)  # of q, k and v side by side, as in the product that gave them
        np.matmul(ds, f["k"], out=d[..., :HEAD])
        np.matmul(ds.transpose(0, 2, 1), f["q"], out=d[..., HEAD : 2 * HEAD])
        np.matmul(f["e"].transpose(0, 2, 1), dm, out=d[..., 2 * HEAD :])
        g["q"], g["k"], g["v"] = np.split(flat(f["x"]).T @ flat(d), 3, axis=1)
        g["q"] = g["q"] * self.scale
        dx = dh
        dx += _by(d, f["w"].T)
        g["places"] = dx.sum(0)
        at, dx = rows.reshape(-1).astype(np.uint16), flat(dx)
        order = np.argsort(at, kind="stable")  # of 16 bits: counted, not compared
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        g["vectors"] = np.zeros_like(p["vectors"], dx.dtype)
        g["vectors"][at[first]] = np.add.reduceat(dx.take(order, axis=0), first, axis=0)
        return loss, g

    def train(self, texts: list[np.ndarray], rng, steps: int = 500, batch: int = 96, rate: float = 0.01) -> None:
        if not texts:
            return
        rows, targets, scored, _ = self.windows(texts)
        adam = _Adam(self.p)
        for n in range(1, steps + 1):
            at = rng.integers(0, len(rows), batch)
            _, g = self.step(rows[at], self.classes[targets[at]], scored[at].astype(np.float32))
            adam.update(g, rate * (1 - n / (steps + 1)))

    def learn(self, texts: list[np.ndarray], rng, adam: _Adam, batch: int = 192, rate: float = 0.003) -> int:
        """One pass over the texts in windows that don't overlap, in any order; returns the number of targets."""
        rows, targets, scored, _ = self.windows(texts, WINDOW)
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            at = order[k : k + batch]
            _, g = self.step(rows[at], self.classes[targets[at]], scored[at].astype(np.float32))
            adam.update(g, rate / np.sqrt(1 + adam.n / 100))
        return int(scored.sum())

    def windows(self, texts: list[np.ndarray], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input rows, target ids, which targets a window scores, and each target's place among all."""
        end = len(self.classes) - 1
        sizes = np.array([len(x) + 1 for x in texts])
        base = np.cumsum(sizes) - sizes
        targets = np.concatenate([z for x in texts for z in (x, [end])]).astype(np.int64)
        inputs = np.empty_like(targets)
        inputs[1:] = targets[:-1]
        inputs[base] = end  # the end of what was before stands at the start
        n = np.maximum(1, -(-(sizes - (WINDOW - stride)) // stride))
        text = np.repeat(np.arange(len(texts)), n)
        k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        inside = (k * stride)[:, None] + np.arange(WINDOW)
        valid = inside < sizes[text][:, None]
        place = base[text][:, None] + np.minimum(inside, sizes[text][:, None] - 1)
        scored = valid & ((np.arange(WINDOW) >= WINDOW - stride) | (k == 0)[:, None])
        return self.row[inputs[place]], targets[place], scored, place

    def score(self, texts: list[np.ndarray], chunk: int = 192) -> tuple[np.ndarray, np.ndarray]:
        """Of every target (each text's ids and its end, end to end): log probability, and the log probability
        that a word begins (or the text ends) there."""
        rows, targets, scored, place = self.windows(texts)
        logp, begin = (np.empty(sum(len(x) + 1 for x in texts), np.float32) for _ in range(2))
        for i in range(0, len(rows), chunk):
            on = scored[i : i + chunk]
            y = self.outcomes(self.forward(rows[i : i + chunk])["h"][on])
            t, at = targets[i : i + chunk][on], place[i : i + chunk][on]
            chosen = y[np.arange(len(t)), self.classes[t]] + self.within[t]
            e = np.exp(y, out=y)
            total = np.log(_total(e))
            logp[at] = chosen - total
            begin[at] = np.log(e @ self.begins.astype(e.dtype)) - total
        return logp, begin


_ASKS = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_TOLD = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64())])


def _asker(buckets: int):
    """Each batch's distinct words with their counts in its training documents, by hash range."""

    def run(batches):
        for got in batches:
            for row in got.to_pylist():
                hashes, counts = undeltas(row["hashes"]), unplanes(row["counts"], np.int64)
                edge = ranges(hashes, buckets)
                out = [(k, row["batch"], deltas(hashes[i:j]), planes(counts[i:j])) for k, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if i < j]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ASKS, strict=True)], schema=_ASKS)

    return run


def _owner(table: pa.Table) -> pa.Table:
    """Sums the counts of a hash range's words, for every batch that asked."""
    asked = [undeltas(x) for x in table["hashes"].to_pylist()]
    counts = np.concatenate([unplanes(x, np.int64) for x in table["counts"].to_pylist()])
    hashes, of = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(of, counts, len(hashes)).astype(np.int64)
    told = [planes(x) for x in np.split(total[of], np.cumsum([len(x) for x in asked])[:-1])]
    once = np.zeros((2, table.num_rows), np.int64)
    once[:, 0] = (total > 0).sum(), total.sum()
    return pa.table([table["batch"], table["bucket"], pa.array(told, pa.binary()), *map(pa.array, once)], schema=_TOLD)


class _Scorer:
    def __init__(self, network: Network, buckets: int, n: int, v: int, ends: int, share: float = 0.5):
        self.network, self.buckets, self.n, self.v, self.ends, self.share = network, buckets, n, v, ends, share

    def words(self, row: dict):
        """Of a batch: doc_ids, word counts, and each token's training count (ends included) and log
        probability by subwords."""
        b, hashes = _Batch(row), undeltas(row["hashes"])
        counts = np.zeros(len(hashes), np.int64)
        edge = ranges(hashes, self.buckets)
        for x in row["told"] or []:
            counts[edge[x["bucket"]] : edge[x["bucket"] + 1]] = unplanes(x["counts"], np.int64)
        n_words = np.diff(b.first)
        known = np.insert(counts[b.of], b.first[1:], self.ends) if len(n_words) else counts[b.of]
        starts, out = np.cumsum(b.sizes) - b.sizes, []
        for k in range(0, len(n_words), 100):
            at = b.first[k : k + 101]
            mine = b.of[at[0] : at[-1]]
            at = at - at[0]
            each = np.append(0, np.cumsum(b.sizes[mine]))
            ids = gathered(b.flat, starts[mine], b.sizes[mine])
            bounds = each[at]
            logp, begin = self.network.score([ids[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)])
            texts = np.arange(len(at) - 1)
            first = np.insert(each[:-1] + np.repeat(texts, np.diff(at)), at[1:], bounds[1:] + texts)
            is_end = np.insert(np.zeros(len(mine), bool), at[1:], True)
            value = np.add.reduceat(logp.astype(float), first) - begin[first]
            value += np.where(is_end, 0.0, np.append(begin, 0)[np.append(first[1:], len(begin))])
            out.append(value)
        return b.ids, n_words, known, np.concatenate(out) if out else np.zeros(0)

    def mixed(self, known: np.ndarray, by_parts: np.ndarray, share: float, less: int = 0) -> np.ndarray:
        """Log probability of tokens: of a known one by its share of training tokens and by its subwords, of any
        other by its subwords alone. ``less`` of each token's own occurrences are left out of its share."""
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(known - less, 0)) - np.log(max(self.n - less, 1))
        return np.logaddexp(whole + np.log(share), by_parts + np.log1p(-share))

    def mixtures(self, known: np.ndarray, by_parts: np.ndarray, shares: tuple[float, ...], less: int = 0) -> list[float]:
        """Sums of ``mixed`` for each share: the ratio of both probabilities is the same for all of them."""
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(known - less, 0)) - np.log(max(self.n - less, 1))
        apart = whole - by_parts
        ratio = np.exp(np.minimum(apart, 700.0))  # exp can't overflow; beyond, the subwords' part is nothing and the rest is added
        base = float(by_parts.sum() + (apart[apart > 700] - 700).sum())
        return [base + float(np.log(x * ratio + (1 - x)).sum()) for x in shares]


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_PARTS = pa.schema([("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("known", pa.binary()), ("by_parts", pa.binary()), ("values", pa.list_(pa.float64()))])
_SHARES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98)


def language_scores(docs: DataFrame, model: str) -> DataFrame:
    """Score all whole texts by a model of those whose crc32(doc_id as text) mod 5 is not 1.

    Tokens are words (A-Z lower-cased) and an end. Returns doc_id, held_out, n_tokens, n_known (tokens met in
    training), train_tokens, base_score (log10 of smoothed token shares, summed) and score (log10 of the
    model's probability of the text). A null text is empty and has its end alone; a null doc_id counts as
    empty text in the crc32; rows that share a doc_id are separate texts. Without training documents all
    tokens are unknown. An empty table gives no rows. Other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = bucket_count(total := text_bytes(docs))
    encoded = bucketed(docs.mapInArrow(_encoder(model), _BATCH_DDL), "batch", bucket_count(total, 16 << 20), "language")
    asks = encoded.select("batch", "hashes", "counts").mapInArrow(_asker(buckets), "bucket int, batch long, hashes binary, counts binary")
    told = written(asks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_owner, "batch long, bucket int, counts binary, distinct long, total long"), "counts")
    sums = told.agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    rows = encoded.agg(F.sum("docs").alias("docs"), F.sum("learned").alias("learned")).first()
    ends = rows["learned"] or 0
    n, v = (sums["n"] or 0) + ends, (sums["v"] or 0) + bool(ends)

    subwords = Subwords.get(model)
    counts = np.zeros(subwords.size + 1)
    counts[:-1] = _pieces(encoded, subwords.size)
    counts[-1] = ends
    rng = np.random.default_rng(11)
    bound = int(min(1.0, SAMPLE_DOCS / max(ends, 1)) * (1 << 63))
    learn = docs.where("pmod(crc32(coalesce(CAST(doc_id AS STRING), '')), 5) <> 1").where(F.abs(F.xxhash64("doc_id", "text") / 2) <= bound / 2)
    sample = [x for x, _ in subwords.of(sorted(x[0] or "" for x in learn.select("text").limit(2 * SAMPLE_DOCS).collect()))]
    batches = encoded.select("ids", "first", "of", "flat", "sizes")
    seen = _neighbours(batches, _marks(counts, subwords.size))
    network = Network(counts, _classes(seen, counts, subwords.starts, rng), rng)
    network.train(sample, rng)
    _trained(batches.withColumn("batch", F.pmod(F.xxhash64("ids"), F.lit(1000))), network)
    scorer = _Scorer(network, buckets, n, v, ends)

    told = told.groupBy("batch").agg(F.collect_list(F.struct("bucket", "counts")).alias("told"))
    joined = encoded.drop("counts", "pieces").join(told.hint("shuffle_hash"), "batch", "left")

    def fitted(batches):
        for got in batches:
            for row in got.to_pylist():
                ids, n_words, known, by_parts = scorer.words(row)
                use = np.repeat(_learns(ids), n_words + 1)
                ids = [None if x == LAST else x for x in ids.tolist()]
                values = scorer.mixtures(known[use], by_parts[use], _SHARES, 1)
                out = [[ids], [n_words.tolist()], [planes(known)], [planes(by_parts.astype(np.float32))], [values]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PARTS, strict=True)], schema=_PARTS)

    #: What the network gives each token, so that the mixture can follow all of them before it is used.
    parts = written(joined.mapInArrow(fitted, "ids array<long>, n_words array<long>, known binary, by_parts binary, values array<double>"), "parts")
    values = parts.agg(*(F.sum(F.col("values")[k]) for k in range(len(_SHARES)))).first()
    scorer.share = _SHARES[int(np.argmax(values))] if ends else 0.5

    def scored(batches):
        ten = np.log(10)
        for got in batches:
            for row in got.to_pylist():
                ids, n_words = row["ids"], np.array(row["n_words"], np.int64)
                known, by_parts = unplanes(row["known"], np.int64), unplanes(row["by_parts"], np.float32).astype(float)
                at = np.cumsum(n_words + 1) - (n_words + 1)
                add = lambda x: np.add.reduceat(x, at) if len(at) else np.zeros(0)  # noqa: E731, B023
                base = np.log10((known + 0.5) / (n + 0.5 * (v + 1)))
                columns = [ids, [held_out(x) for x in ids], n_words + 1, add((known > 0).astype(np.int64)), np.full(len(ids), n), add(base), add(scorer.mixed(known, by_parts, scorer.share)) / ten]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    return parts.drop("values").mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _pieces(encoded: DataFrame, size: int) -> np.ndarray:
    """Subword counts of all training documents: a task sends one vector of the model's size."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for got in batches:
            for x in got["pieces"].to_pylist():
                total += unplanes(x, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    got = encoded.select("pieces").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return out

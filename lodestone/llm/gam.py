"""Quality classifier: an additive model with pairwise interactions, boosted cyclically from shallow trees.

Each feature has a lookup table over its bins, some pairs of features a table over both's bins; a score is
the logistic function of the sum of entries. Boosting visits the features in turn and fits to the residuals
a tree of at most four leaves on one feature (then one on a pair), whose leaves are added to its table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import slices, utf8, words_of

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digits", "symbols", "bars", "bangs", "stops", "other_bytes",
    "spaces", "line_bytes", "short_lines", "short_words", "distinct_words", "top_word", "repeats_beside",
)
_KINDS = {
    "upper": [*range(65, 91)], "digits": [*range(48, 58)], "symbols": [*b"#$%&*+/<=>@\\^_`{}~"], "bars": [124], "bangs": [33, 63],
    "stops": [44, 46, 58, 59], "other_bytes": [*range(128, 256)], "spaces": [*range(9, 14), 32],
}


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text, from whole texts; an empty text's are zeros."""
    data, offsets = utf8(column)
    w = words_of(column)
    size, n_words = np.diff(offsets), np.diff(w.first)
    share = lambda of, by: of / np.maximum(by, 1)

    def total(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags, dtype=np.int64))
        return sums[at[1:]] - sums[at[:-1]]

    out = {"log_bytes": np.log1p(size), "log_words": np.log1p(n_words)}
    lengths = w.end - w.start
    out["word_bytes"] = share(total(lengths, w.first), n_words)
    out["short_words"] = share(total(lengths <= 3, w.first), n_words)
    table = np.zeros(256, bool)
    for name, codes in _KINDS.items():
        table[:] = False
        table[codes] = True
        out[name] = share(total(table[data], offsets), size)
    breaks = total(data == 10, offsets)
    out["line_bytes"] = np.log1p(share(size, breaks + 1))
    out["short_lines"] = share(breaks, n_words)
    same = np.append(False, (w.hash[1:] == w.hash[:-1]) & (w.rows[1:] == w.rows[:-1])) if len(w.hash) else np.zeros(0, bool)
    out["repeats_beside"] = share(total(same, w.first), n_words)
    for name in ("distinct_words", "top_word", "longest_word"):
        out[name] = np.zeros(len(size))
    for k in np.flatnonzero(n_words):
        i, j = w.first[k], w.first[k + 1]
        found = np.sort(w.hash[i:j])
        runs = np.flatnonzero(np.append(found[1:] != found[:-1], True))
        out["distinct_words"][k] = np.log(len(runs)) / np.log(j - i + 1)
        out["top_word"][k] = np.diff(runs, prepend=-1).max() / (j - i)
        out["longest_word"][k] = np.log1p(lengths[i:j].max())
    return np.stack([out[x] for x in FEATURES], 1)


@dataclass
class Gam:
    """``edges`` of each feature's bins, coarse ``edges2`` for pairs, and the tables that boosting filled."""

    edges: list[np.ndarray]
    edges2: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edge, x[:, k], "right")]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[np.searchsorted(self.edges2[a], x[:, a], "right"), np.searchsorted(self.edges2[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def _steps(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Newton steps of a tree over ordered bins: the best cut is taken again and again."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, 0, 0)
        for k, (i, j) in enumerate(parts):
            gs, hs = np.cumsum(g[i:j]), np.cumsum(h[i:j])
            gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
            if not len(gl):
                continue
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
            gain[(hl < least) | (hr < least)] = 0
            at = int(gain.argmax())
            best = max(best, (float(gain[at]), k, i + at + 1))
        if not best[2]:
            break
        i, j = parts.pop(best[1])
        parts += [(i, best[2]), (best[2], j)]
    out = np.zeros(len(g))
    for i, j in parts:
        out[i:j] = g[i:j].sum() / (h[i:j].sum() + ridge)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Steps of a tree over a grid with one cut on either axis, and its gain."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    part = lambda c, i, j: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])
    i, j = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    if not i.size:
        return np.zeros_like(g), 0.0
    gs, hs = part(cg, i, j), part(ch, i, j)
    gain = sum(a**2 / (b + ridge) for a, b in zip(gs, hs, strict=True))
    at = np.unravel_index(gain.argmax(), gain.shape)
    i, j = at[0] + 1, at[1] + 1
    out = np.zeros_like(g)
    values = [a / (b + ridge) for a, b in zip(part(cg, i, j), part(ch, i, j), strict=True)]
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = values
    return out, float(gain[at])


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 64, pairs: int = 8, ridge: float = 2.0) -> Gam:
    """Boost a model for labels y (0 or 1). Without both labels, it scores the one there is (or 0.5)."""
    n, d = x.shape
    p = (y.sum() + 0.5) / (n + 1)
    cuts = lambda k, m: np.unique(np.quantile(x[:, k], np.arange(1, m) / m)) if n else np.zeros(0)
    model = Gam([cuts(k, bins) for k in range(d)], [cuts(k, 12) for k in range(d)], float(np.log(p / (1 - p))), [], [], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if n == 0 or y.min() == y.max():
        return model
    fine = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges2)]
    total = np.full(n, model.base)

    def residuals():
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for k in range(d):
            g, h = residuals()
            size = len(model.tables[k])
            step = rate * _steps(np.bincount(fine[k], g, size), np.bincount(fine[k], h, size), 4, ridge, 2.0)
            model.tables[k] += step
            total += step[fine[k]]
    shape = [len(e) + 1 for e in model.edges2]

    def grid(a, b, v):
        return np.bincount(coarse[a] * shape[b] + coarse[b], v, shape[a] * shape[b]).reshape(shape[a], shape[b])

    g, h = residuals()
    gains = sorted(((_quarters(grid(a, b, g), grid(a, b, h), ridge)[1], a, b) for a in range(d) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for _, a, b in gains[:pairs]]
    model.grids = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    for _ in range(rounds // 3):
        for k, (a, b) in enumerate(model.pairs):
            g, h = residuals()
            step = rate * _quarters(grid(a, b, g), grid(a, b, h), ridge)[0]
            model.grids[k] += step
            total += step[coarse[a], coarse[b]]
    return model


def remainder(doc_id: int | None, of: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 20_000) -> DataFrame:
    """Score all documents by a model of ``labels.quality`` (1: good).

    Returns the columns of ``docs`` with held_out, score (0 to 1) and predicted (1 if score >= ``threshold``)
    added (columns of these names are replaced). Labels whose crc32(doc_id as text) mod 4 is 2 are not
    learned from (held_out). At most ``sample`` labels are, those with the least hash of doc_id: the only
    bounded step. Features come from the text alone, of which a null is empty. Null labels are not used; of
    several for a doc_id, the largest is; of several texts for one, the first in order is learned. A null doc_id is scored and never learned from. Without labels
    every score is 0.5. An empty table gives no rows.
    """
    docs = docs.drop("held_out", "score", "predicted")
    learn = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL AND pmod(crc32(CAST(doc_id AS STRING)), 4) <> 2")
    learn = learn.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    learn = learn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(learn), "doc_id")
    known = known.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))

    def measured(batches):
        for got in batches:
            for part in slices(got, "text", 1 << 20):
                x = features(part["text"])
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], rows, part["y"]], ["doc_id", "x", "y"])

    got = known.mapInArrow(measured, "doc_id long, x array<double>, y double").toPandas()
    got = got.assign(of=[zlib.crc32(str(k).encode()) for k in got["doc_id"]]).sort_values(["of", "doc_id"], kind="stable")
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    model = train(x, got["y"].to_numpy(float))

    def scored(batches):
        for got in batches:
            for part in slices(got, "text", 1 << 20):
                score = model.score(features(part["text"]))
                held = [remainder(x, 4) == 2 for x in part["doc_id"].to_pylist()]
                more = [pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "held_out", "score", "predicted"])

    added = [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, *added]))

"""MinHash near-dedup by a signature-coordinate inverted join.

A document is posted under each (coordinate, value) of its MinHash signature. Two documents similar enough
agree on ``matches`` of the ``coords`` coordinates at least, so they share one of the coords - matches + 1
rarest of either: only that prefix is merged, and a document of whose coordinates too few occur elsewhere
is skipped. Collisions of the pairs that meet in the prefix are counted on whole signatures, and pairs at
or above the match threshold are confirmed on full shingle sets.

Equal sets form one class and only classes are compared. In a posting list, each class is first paired
with a few others (leaders of the list, and of those that share the next coordinate too). Classes whose lists
then still hold several components are joined once more by their rarest shingles, in cells that can hold
similar sets, so no link between components is lost; pairs inside a component need no test.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .hashing import U, mix, slices, words_of
from .packing import LAST, deltas, ids_of, undeltas
from .tables import written

_SIGNED = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.list_(pa.int64()))])
_SETS = pa.schema([("doc", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("shingles", pa.binary())])


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes of each text, end to end, and offsets (rows + 1).

    A-Z is lower-cased. A text of fewer words than ``size`` has its whole sequence as one shingle.
    """
    w = words_of(column, lower=True)
    hashes, at = w.windows(size)
    first = np.searchsorted(w.rows[at], np.arange(len(w.first)))
    out, n_words = [], np.diff(w.first)
    for k in range(len(n_words)):
        if n_words[k] >= size:
            out.append(np.unique(hashes[first[k] : first[k + 1]]))
        elif n_words[k]:
            h = U(n_words[k])
            for x in w.hash[w.first[k] : w.first[k + 1]]:
                h = mix(np.array([h ^ x]))[0]
            out.append(np.array([h], U))
        else:
            out.append(np.zeros(0, U))
    return np.concatenate(out) if out else np.zeros(0, U), np.append(0, np.cumsum([len(x) for x in out])).astype(np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell sets apart."""
    out = []
    for salt in (0x51ED270B0A1F3C2D, 0x2545F4914F6CDD1D):
        total = np.append(U(0), np.cumsum(mix(values ^ U(salt)), dtype=U))
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def _signer(size: int, coords: int):
    rng = np.random.default_rng(20240607)
    factor = rng.integers(0, 1 << 63, coords, dtype=np.uint64) << U(1) | U(1)
    shift = rng.integers(0, 1 << 63, coords, dtype=np.uint64)

    def run(batches):
        for got in batches:
            for part in slices(got, "text", 1 << 20):
                values, offsets = shingle_sets(part["text"], size)
                has = np.flatnonzero(np.diff(offsets))
                sig = np.empty((len(has), coords), np.int64)
                for k in range(coords if len(has) else 0):
                    x = (values ^ shift[k]) * factor[k]
                    least = np.minimum.reduceat(x ^ (x >> U(32)), offsets[has])
                    sig[:, k] = mix(least + shift[-1 - k]).view(np.int64)
                lists = np.zeros(len(offsets), np.int64)
                lists[1:] = np.cumsum(np.where(np.diff(offsets) > 0, coords, 0))
                s1, s2 = _sums(values, offsets)
                sigs = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(ids_of(part["doc_id"])), pa.array(np.diff(offsets)), pa.array(s1), pa.array(s2), sigs], schema=_SIGNED)

    return run


def _set_maker(size: int):
    def run(batches):
        for got in batches:
            for part in slices(got, "text", 1 << 20):
                values, offsets = shingle_sets(part["text"], size)
                s1, s2 = _sums(values, offsets)
                blobs = [deltas(values[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc"], pa.array(s1), pa.array(s2), pa.array(blobs, pa.binary())], schema=_SETS)

    return run


def _confirmer(percent: int):
    def run(batches):
        for got in (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256)):
            keep, last, of = [], None, None
            for x, y in zip(got["shingles_a"].to_pylist(), got["shingles_b"].to_pylist(), strict=True):
                if x != last:
                    last, of = x, undeltas(x)
                other = undeltas(y)
                both = np.sort(np.concatenate([of, other]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield got.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, coords: int = 48, matches: int = 24) -> DataFrame:
    """Components of documents linked where 100 * shared shingles >= percent * shingles of either.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (doc_id = component_id).
    A null or wordless text has no shingles, no links, and is kept. A null doc_id counts as larger than any
    other and is returned as null; rows that share a doc_id are one node if their sets are equal, and each
    row is returned. An empty table gives no rows. Other columns are left out. With the defaults, a pair at
    0.8 agrees on fewer than 24 of 48 coordinates once in about a million; a lower ``percent`` wants fewer ``matches``.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
    signed = written(docs.mapInArrow(_signer(shingle, coords), "doc long, n long, s1 long, s2 long, sig array<long>"), "signed")
    classes = written(
        signed.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep"), F.first("sig").alias("sig"))
        .withColumn("c", F.monotonically_increasing_id()), "classes")
    posted = _prefixes(classes, coords, matches)
    tests = _Tests(docs, classes, posted, shingle, percent, matches)

    def labelled(links: DataFrame | None) -> DataFrame:
        found = components(links)
        return written(posted.select("c").distinct().join(found.withColumnRenamed("node", "c"), "c", "left").select("c", F.coalesce("comp", "c").alias("comp")), "labelled")

    pairs = _meetings(posted, percent)
    pairs = tests.counted(pairs)
    best = pairs.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")
    links = tests.confirmed(best)
    labels = labelled(links)
    links = links.unionByName(tests.confirmed(tests.across(pairs.select("a", "b"), labels)))
    labels = labelled(links)
    links = links.unionByName(tests.confirmed(tests.counted(tests.unmet(labels)).select("a", "b")))
    labels = labelled(links)

    of = classes.select("c", "n", "s1", "s2", "rep").join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    least = of.groupBy("comp").agg(F.min("rep").alias("component"))
    of = of.join(least, "comp").select("n", "s1", "s2", "component")
    out = signed.select("doc", "n", "s1", "s2").join(of, ["n", "s1", "s2"], "left")
    doc, comp = F.col("doc"), F.coalesce("component", "doc")
    return out.select(
        F.when(doc != LAST, doc).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(comp != LAST, comp).alias("component_id"), (doc == comp).alias("kept"))


def _meetings(posted: DataFrame, percent: int) -> DataFrame:
    """Pairs (c, other), a few for each posting: in each list, classes of about one size are paired with the
    smallest document, with the most typical one and with a leader of those that share the next coordinate too,
    and the leaders of neighbouring sizes with each other. Leaders are aggregates: no list is ordered in one task."""
    band = F.floor(F.log(F.col("n")) / float(np.log(1.1)))
    posted = posted.withColumn("band", band)
    led = posted.groupBy("key", "band").agg(F.count("*").alias("size"), F.min(F.struct("rep", "c")).alias("least"), F.max(F.struct("typical", "c")).alias("most"))
    led = led.select("key", "band", "size", F.col("least.c").alias("least"), F.col("most.c").alias("most"))
    inside = posted.join(written(led.where("size > 1"), "led"), ["key", "band"]).select("c", F.explode(F.array("least", "most")).alias("other"))
    nearer = posted.groupBy("key", "second", "band").agg(F.count("*").alias("size"), F.min(F.struct("typical", "rep", "c")).alias("x"))
    nearer = written(nearer.where("size > 1").select("key", "second", "band", F.col("x.c").alias("other")), "nearer")
    inside = inside.union(posted.join(nearer, ["key", "second", "band"]).select("c", "other"))
    heads = led.select("key", "band", F.col("most").alias("c"))
    between = None
    for step in range(1, 1 + max(1, math.ceil(math.log(100 / percent) / math.log(1.1)))):  # sizes of similar sets are that near
        after = led.select("key", (F.col("band") - step).alias("band"), F.col("most").alias("other"))
        found = heads.join(after, ["key", "band"]).select("c", "other")
        between = found if between is None else between.union(found)
    return inside.union(between).where("c <> other")


def _prefixes(classes: DataFrame, coords: int, matches: int) -> DataFrame:
    """Postings (key, second, c, rep, typical, n) of the rarest coords - matches + 1 coordinates of each class, without
    values that one class alone has; classes with fewer than ``matches`` other values have none. ``second`` is the
    class's next coordinate in that order."""
    each = classes.select("c", "rep", F.col("n").alias("shingles"), F.explode("sig").alias("key"))
    common = each.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    each = each.join(written(common, "common"), "key")  # a table, so that Spark can split a value that very many share
    by = Window.partitionBy("c")
    each = each.select("*", F.count("*").over(by).alias("n"), F.sum("df").over(by).alias("typical"), F.row_number().over(by.orderBy("df", "key")).alias("k"), F.lead("key").over(by.orderBy("df", "key")).alias("second"))
    alone = coords - F.col("n")
    return written(each.where((F.col("n") >= matches) & (F.col("k") <= coords - matches + 1 - alone)).select("key", "second", "c", "rep", "typical", F.col("shingles").alias("n")), "posted")


class _Tests:
    def __init__(self, docs, classes, posted, shingle, percent, matches):
        self.signatures = classes.select("c", "sig")
        self.posted, self.percent, self.matches = posted, percent, matches
        wanted = posted.select("c").distinct().join(classes.select("c", "rep", "s1", "s2"), "c")
        texts = docs.withColumnRenamed("doc_id", "doc").join(wanted.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi")
        sets = texts.mapInArrow(_set_maker(shingle), "doc long, s1 long, s2 long, shingles binary")
        sets = sets.join(wanted.withColumnRenamed("rep", "doc"), ["doc", "s1", "s2"]).select("c", "shingles")
        self.sets = written(sets.dropDuplicates(["c"]), "sets")

    def counted(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a < b, shared) whose signatures agree on enough coordinates."""
        x, y = pairs.columns[:2]
        pairs = pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
        pairs = pairs.join(self.signatures.toDF("a", "sig_a"), "a").join(self.signatures.toDF("b", "sig_b"), "b")
        pairs = pairs.select("a", "b", F.size(F.array_intersect("sig_a", "sig_b")).alias("shared"))
        return written(pairs.where(F.col("shared") >= self.matches), "pairs")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose full sets are similar enough."""
        pairs = pairs.join(self.sets.toDF("b", "shingles_b"), "b").join(self.sets.toDF("a", "shingles_a"), "a")
        return written(pairs.select("a", "b", "shingles_a", "shingles_b").mapInArrow(_confirmer(self.percent), "a long, b long"), "confirmed")

    def across(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        ends = pairs.join(labels.toDF("a", "comp_a"), "a").join(labels.toDF("b", "comp_b"), "b")
        return ends.where("comp_a <> comp_b").select("a", "b")

    def unmet(self, labels: DataFrame) -> DataFrame:
        """Pairs of different components that the leaders' tests may have left out.

        Lists of one component drop out, and so do lists of two classes. The classes in other lists are joined on whole sets: two similar ones share one of the rarest
        shingles of either, and a class of whose shingles too few occur elsewhere is skipped. In a shingle's
        list, all but the largest component's classes meet the rest.
        """
        at = self.posted.select("key", "c").join(labels, "c")
        by_comp = at.groupBy("key", "comp").agg(F.count("*").alias("size"))
        mixed = by_comp.groupBy("key").agg(F.count("*").alias("comps"), F.sum("size").alias("size")).where("comps > 1 AND size > 2")
        open_ = at.join(mixed.select("key"), "key").select("c", "comp").distinct()
        shingles = self.sets.join(open_, "c").mapInArrow(_exploder, "c long, comp long, size long, shingle long")
        often = shingles.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
        by = Window.partitionBy("c")
        common = shingles.join(written(often, "often"), "shingle").select("*", F.count("*").over(by).alias("n"), F.row_number().over(by.orderBy("df", "shingle")).alias("k"))
        least = F.ceil(F.col("size") * self.percent / 100)
        alone = F.col("size") - F.col("n")
        pos = alone + F.col("k")
        #: What a class shares with any other is at most what it shares with any at all and, where this is the
        #: first shingle that both have, at most what follows it.
        reach = F.least("n", 1 + F.col("size") - pos)
        rare = common.where((F.col("n") >= least) & (pos <= F.col("size") - least + 1)).select("shingle", "c", "comp", "size", reach.alias("reach"))
        bands = {"sizes": F.floor(F.log("size") / math.log(_SIZES)), "reaches": F.floor(_REACHES * F.col("reach") / F.col("size"))}
        rare = written(rare.withColumns(bands), "rare")
        by_comp = rare.groupBy("shingle", "comp").agg(F.count("*").alias("many"))
        mixed = by_comp.groupBy("shingle").agg(F.count("*").alias("comps"), F.max(F.struct("many", "comp")).alias("main")).where("comps > 1")
        rare = written(rare.join(written(mixed.select("shingle", F.col("main.comp").alias("main")), "mixed"), "shingle"), "lists")
        cells = written(_cells(rare, self.percent), "cells")
        side = lambda rows, k: rows.select("shingle", "main", *(F.col(m).alias(f"{m}_{k}") for m in ("c", "comp", "size", "reach", "sizes", "reaches")))
        met = side(rare.where("comp <> main"), "x").join(cells, ["shingle", "sizes_x", "reaches_x"])
        met = met.join(side(rare, "y").drop("main"), ["shingle", "sizes_y", "reaches_y"])
        return met.where(f"comp_x <> comp_y AND (comp_y = main OR c_x < c_y) AND {_alike(self.percent)}").select(F.col("c_x").alias("x"), F.col("c_y").alias("y"))


#: Ratio of the sizes in a cell, and parts of the share of a set that can still be common.
_SIZES, _REACHES = 1.05, 50


def _alike(percent: int) -> str:
    """Whether sets of these sizes, sharing at most the smaller reach, can be similar enough."""
    shared = "least(reach_x, reach_y)"
    return f"100 * {shared} >= {int(percent)} * (size_x + size_y - {shared})"


def _cells(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs of cells (size by reach) of a shingle's list whose classes can be similar, by each cell's bounds.

    A template that many documents share fills cells that can't meet unless its rows may be near copies, so
    they are never paired. A list has as many cells as it has sizes and reaches, however many rows it has.
    """
    cells = rare.groupBy("shingle", "sizes", "reaches").agg(F.min("size").alias("size"), F.max("reach").alias("reach"))
    far = 1 + math.ceil(math.log(100 / percent) / math.log(_SIZES))
    x = cells.withColumn("step", F.explode(F.array(*(F.lit(k) for k in range(-far, far + 1)))))
    x = x.select("shingle", (F.col("sizes") + F.col("step")).alias("sizes_y"), *(F.col(k).alias(f"{k}_x") for k in ("sizes", "reaches", "size", "reach")))
    y = cells.select("shingle", *(F.col(k).alias(f"{k}_y") for k in ("sizes", "reaches", "size", "reach")))
    return x.join(y, ["shingle", "sizes_y"]).where(_alike(percent)).select("shingle", "sizes_x", "reaches_x", "sizes_y", "reaches_y")


def _exploder(batches):
    for got in batches:
        for c, comp, blob in zip(got["c"].to_pylist(), got["comp"].to_pylist(), got["shingles"].to_pylist(), strict=True):
            values = undeltas(blob).view(np.int64)
            n = len(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x)) for x in (c, comp, n)] + [pa.array(values)], ["c", "comp", "size", "shingle"])

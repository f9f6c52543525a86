"""Vector code compression: product quantisation in whole numbers, learnt on weighted distinct parts.

A vector's components become floor(1024 * x) and the vector is cut into equal consecutive parts. At each part
position, equal parts are one row with the number of vectors that have it. Lloyd's rounds run over these rows:
tasks sum what they assign to each codebook entry, Spark adds the tasks' sums, and the driver holds the codebooks
(256 entries for each position, whatever the table's size). Codes and errors of the distinct parts are joined
back to the vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

SCALE = 1024
LIMIT = 1 << 28  #: whole components are held to this size, so no squared distance leaves 64 bits
RESULT = "vec_id long, code string, error long, label long, label_error long, codebooks_sha256 string"


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole_numbers(vector: Column) -> Column:
    held = lambda x: F.least(F.greatest(x.cast("double") * SCALE, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row by squared distance (ties to the lower index), and the distance; both exact."""
    index, least = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    most = max((int(np.abs(x).max()) for x in (rows, book) if x.size), default=0)
    if most < 1 << 20 and rows.shape[1] <= 2048:  # products and their sums are whole numbers below 2**53
        entries, norms = book.astype(float), (book.astype(float) ** 2).sum(1)
        for k in range(0, len(rows), 4096):
            x = rows[k : k + 4096].astype(float)
            gap = norms - 2 * (x @ entries.T)
            index[k : k + 4096] = at = gap.argmin(1)
            least[k : k + 4096] = gap[np.arange(len(x)), at] + (x**2).sum(1)
        return index, least
    least[:] = np.iinfo(np.int64).max
    for e, entry in enumerate(book):
        gap = ((rows - entry) ** 2).sum(1)
        index[gap < least] = e
        least = np.minimum(least, gap)
    return index, least


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _sums(books: list[np.ndarray], width: int):
    """Of each task: how many vectors it assigns to each entry and the sums of their components."""

    def run(batches):
        n = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros((len(b), width), np.int64) for b in books]
        for batch in batches:
            pos, weight, rows = batch.column("pos").to_numpy(), batch.column("n").to_numpy(), _matrix(batch.column("part"), width)
            for p, book in enumerate(books):
                at = np.flatnonzero(pos == p)
                if len(at):
                    entry, _ = nearest(rows[at], book)
                    np.add.at(n[p], entry, weight[at])
                    np.add.at(sums[p], entry, rows[at] * weight[at, None])
        for p in range(len(books)):
            used = np.flatnonzero(n[p])
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), p)), pa.array(used), pa.array(n[p][used]), pa.array(sums[p][used].tolist(), pa.list_(pa.int64()))],
                    ["pos", "entry", "n", "sums"],
                )

    return run


def _assigned(books: list[np.ndarray], width: int):
    def run(batches):
        for batch in batches:
            pos, rows = batch.column("pos").to_numpy(), _matrix(batch.column("part"), width)
            entry, gap = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
            for p, book in enumerate(books):
                at = np.flatnonzero(pos == p)
                if len(at):
                    entry[at], gap[at] = nearest(rows[at], book)
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("part"), pa.array(entry), pa.array(gap)], ["pos", "part", "entry", "gap"])

    return run


def learned(distinct: DataFrame, books: list[np.ndarray], width: int, rounds: int) -> list[np.ndarray]:
    """Codebooks after ``rounds`` of Lloyd over rows (pos, part, n); an entry that gets no part stays."""
    for _ in range(rounds):
        sums = distinct.mapInArrow(_sums(books, width), "pos long, entry long, n long, sums array<long>").groupBy("pos", "entry")
        books = [b.copy() for b in books]
        for row in sums.agg(F.sum("n"), *(F.sum(F.get("sums", F.lit(k))) for k in range(width))).collect():
            pos, entry, n, *total = row
            books[pos][entry] = [x // n for x in total]
    return books


def compressed(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """Codes of vectors: vec_id, code (two hex digits a part), error, label, label_error and codebooks_sha256.

    Takes vec_id, embedding and label; other columns are left out. A vector that is null, or has a null or
    infinite component or one that is no number, gives no row. A codebook starts as the parts of the
    ``entries`` smallest vec_ids (fewer if there are fewer vectors; ties of vec_id by the components, a null
    vec_id is the largest). Repeated rows and vec_ids are rows of their own. Vectors that are shorter than the
    longest, or not of a multiple of ``parts``, are continued by zeros. Whole components beyond 2**28 are held
    to it. Null labels share one sum. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where(finite(F.col("embedding")))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], RESULT)
    width = max(1, -(-longest // parts))
    filled = F.concat(whole_numbers(F.col("embedding")), F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("embedding")))
    cut = lambda q: F.array(*(F.slice(q, p * width + 1, width) for p in range(parts)))
    rows = written(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", filled.alias("q")), "vectors")

    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    start = np.array([r["q"] for r in first], np.int64)
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    distinct = written(rows.select(F.posexplode(cut(F.col("q"))).alias("pos", "part")).groupBy("pos", "part").agg(F.count("*").alias("n")), "parts")
    books = learned(distinct, books, width, rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for entry in b.tolist() for x in entry).encode()).hexdigest()

    coded = written(distinct.select("pos", "part").mapInArrow(_assigned(books, width), "pos int, part array<int>, entry long, gap long"), "coded_parts")
    each = rows.select("row", "vec_id", "label", F.posexplode(cut(F.col("q"))).alias("pos", "part")).join(coded, ["pos", "part"])
    digits = F.concat(*(F.lpad(F.lower(F.hex(F.max(F.when(F.col("pos") == p, F.col("entry"))))), 2, "0") for p in range(parts)))
    found = each.groupBy("row").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), digits.alias("code"), F.sum("gap").alias("error"))
    found = written(found.drop("row"), "codes")
    #: The sums are a table of their own, so that both sides of the join are shuffled for it and a hot label can be split.
    sums = written(found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label_errors")
    return found.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label", "label_error", F.lit(digest).alias("codebooks_sha256"))

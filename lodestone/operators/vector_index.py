"""An inverted-file index of vectors: k-means cells, rows stored by cell as blocks, reads of few cells.

Vectors are brought to length 1, so the nearest by cosine are the nearest by distance. Cells are learnt by Lloyd's
rounds that Spark adds up: the driver holds the centres (``MOST_CELLS`` at most). The table is partitioned by
cell; a cell's rows are packed into blocks of up to ``BLOCK`` rows, so a cell that a third of all rows share is
many blocks and is never one task. A search reads the cells nearest to its queries. With the greatest distance
of a cell's rows from its centre, the triangle inequality tells which further cells can hold a nearer row: reading
those as well makes a search exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut, new_path

MOST_CELLS = 16_384
FIT_A_CELL = 256  #: rows a cell that centres are learnt from
BLOCK = 2_000
ASKED = 500  #: queries that meet a block at once
ROWS = 500  #: rows whose distances from all centres are held at once
SLICE = 20_000  #: queries' cells that are held as rows at once
_BLOCKS = "block long, n long, dims long, ids array<long>, vectors binary, far double, cell int"
_HITS = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64())])


@dataclass
class Index:
    """``table`` is the Parquet folder of blocks, ``centres`` a row for each cell, ``far`` the distance of each
    cell's farthest row from its centre (-1: the cell has none)."""

    spark: SparkSession
    table: str
    centres: np.ndarray
    far: np.ndarray

    def blocks(self, cells: list[int] | None = None) -> DataFrame:
        """Blocks of all cells or of some; of a partitioned table only these cells' folders are read."""
        rows = self.spark.read.schema(_BLOCKS).parquet(self.table)
        return rows if cells is None else rows.where(F.col("cell").isin(*cells))


def units(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of length 1, one a row; zeros where there is none, it has another size or no length."""
    size = np.asarray(column.value_lengths().fill_null(0))
    out = np.zeros((len(column), dims))
    good = np.flatnonzero(size == dims)
    if len(good) and dims:
        out[good] = column.take(pa.array(good)).flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, dims)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=(norm > 0) & np.isfinite(norm))


def gaps(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (vectors**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * vectors @ centres.T
    return np.sqrt(np.maximum(square, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (id, embedding) whose vector is there and has a length."""
    some = F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where(some)


def _fitted(vectors: DataFrame, centres: np.ndarray, rounds: int) -> np.ndarray:
    dims = centres.shape[1]
    for _ in range(rounds):

        def sums(batches, centres=centres):
            total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for batch in batches:
                for k in range(0, batch.num_rows, ROWS):
                    x = units(batch.column("embedding").slice(k, ROWS), dims)
                    at = gaps(x, centres).argmin(1)
                    np.add.at(total, at, x)
                    n += np.bincount(at, minlength=len(n))
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], ["cell", "n", "sums"])

        parts = vectors.mapInArrow(sums, "cell long, n long, sums array<double>").groupBy("cell")
        centres = centres.copy()
        for row in parts.agg(F.sum("n"), F.array(*(F.sum(F.get("sums", F.lit(k))) for k in range(dims)))).collect():
            centres[row[0]] = np.array(row[2]) / row[1]
    return centres


def build(vectors: DataFrame, cells: int | None = None, rounds: int = 6, block: int = BLOCK) -> Index:
    """An index of all rows (id, embedding); those without a vector, or whose vector is zero, match nothing.

    Without ``cells`` there is about one for the square root of the rows. Centres are learnt from up to about
    256 rows a cell, chosen by a hash of the id (a bound, not a cut: every row is indexed). An empty table gives
    an index without cells. Vectors of another size than most of the learnt ones' match nothing either.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not sizes:
        return Index(spark, "", np.zeros((0, 0)), np.zeros(0))
    dims, n = sizes[0]
    rows = rows.where(F.size("embedding") == dims)
    cells = max(1, min(cells or round(n**0.5), MOST_CELLS, n))
    share = min(1.0, FIT_A_CELL * cells / n)
    fit = cut(rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))) if share < 1 else rows
    first = fit.orderBy(F.xxhash64("id"), "id").limit(cells).collect()
    start = units(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), dims)
    centres = _fitted(fit, start, rounds)

    def placed(batches):
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            d = gaps(units(batch.column("embedding"), dims), centres)
            at = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], [*batch.schema.names, "cell", "gap"])

    def packed(batches):
        """Blocks of sorted rows; a block never holds two cells."""
        held, k = [], 0

        def closed(part: pa.Table):
            x = units(part["embedding"].combine_chunks(), dims)
            return pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() << 32 | k]), pa.array([len(part)]), pa.array([dims]), pa.array([part["id"].to_pylist()], pa.list_(pa.int64())),
                 pa.array([x.tobytes()], pa.binary()), pa.array([float(np.max(part["gap"].to_numpy()))]), pa.array([part["cell"][0].as_py()], pa.int32())],
                ["block", "n", "dims", "ids", "vectors", "far", "cell"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            cell = batch.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for i, j in zip(edges, edges[1:]):
                part = table.slice(i, j - i)
                if held and (held[0]["cell"][0].as_py() != part["cell"][0].as_py() or sum(map(len, held)) + len(part) > block):
                    yield closed(pa.concat_tables(held))
                    held, k = [], k + 1
                while len(part) > block:
                    yield closed(part.slice(0, block))
                    part, k = part.slice(block), k + 1
                if len(part):
                    held.append(part)
        if held:
            yield closed(pa.concat_tables(held))

    near = rows.mapInArrow(placed, "id long, embedding array<double>, cell int, gap double")
    blocks = near.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").mapInArrow(packed, _BLOCKS)
    path = new_path(spark, "vector-index")
    blocks.write.partitionBy("cell").parquet(path)
    far = np.full(len(centres), -1.0)
    for row in spark.read.schema(_BLOCKS).parquet(path).groupBy("cell").agg(F.max("far").alias("far")).collect():
        far[row["cell"]] = row["far"]
    return Index(spark, path, centres, far)


def _asked(index: Index, queries: DataFrame, probes: int, least: DataFrame | None) -> DataFrame:
    """Rows (cell, chunk, queries, vectors) of packed queries for the cells that each must see.

    Without ``least`` these are its ``probes`` nearest; with it (query, least: the cosine that a new row needs) all
    others that can hold such a row.
    """
    centres, far, dims = index.centres, index.far, index.centres.shape[1]
    rows, further = queries.select(F.col("id").alias("query"), "embedding"), least is not None
    rows = rows.join(least, "query") if further else rows.withColumn("least", F.lit(None).cast("double"))

    def run(batches):
        step = max(1, SLICE // len(centres))  # where all cells are asked, a query has a row for each
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                yield asked(batch.slice(k, step))

    def asked(batch):
        x = units(batch.column("embedding"), dims)
        d = np.where(far < 0, np.inf, gaps(x, centres))
        ranks = d.argsort(1, kind="stable").argsort(1, kind="stable")
        first = (ranks < probes) & np.isfinite(d)
        if further:
            need = np.array(batch.column("least").to_pylist(), float)
            radius = np.sqrt(np.maximum(0, 2 - 2 * need)) + 1e-6
            first = ~first & (d - far <= radius[:, None]) & np.isfinite(d)
        of, cell = np.nonzero(first)
        unit = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * dims), pa.array(x[of].ravel()))
        return pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(of)), pa.array(cell.astype(np.int32)), unit], ["query", "cell", "unit"])

    each = cut(rows.mapInArrow(run, "query long, cell int, unit array<double>"))
    chunks = each.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).alias("chunks"))
    chunk = F.pmod(F.xxhash64("query"), F.col("chunks")).alias("chunk")
    return each.join(chunks, "cell").select("query", "cell", "unit", chunk).groupBy("cell", "chunk").agg(F.collect_list(F.struct("query", "unit")).alias("asked"))


def _met(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The k best rows of each block for each query that is sent to its cell."""
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()] if len(index.centres) <= 1000 else None

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):  # one block at a time: a batch's queries are many times its bytes as objects
                row = {c: batch.column(c)[at] for c in ("n", "dims", "ids", "vectors", "asked")}
                x = np.frombuffer(row["vectors"].as_py()).reshape(row["n"].as_py(), row["dims"].as_py())
                each = row["asked"].values
                ids, query = row["ids"].values.to_numpy(), each.field("query").to_numpy()
                near = np.round(each.field("unit").flatten().to_numpy().reshape(-1, x.shape[1]) @ x.T, 9)
                for q, line in zip(query.tolist(), near, strict=True):
                    top = np.lexsort((ids, -line))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), q)), pa.array(ids[top]), pa.array(line[top])], schema=_HITS)

    return index.blocks(cells).join(asked, "cell").select("n", "dims", "ids", "vectors", "asked").mapInArrow(run, "query long, id long, cosine double")


def nearest(index: Index, queries: DataFrame, k: int = 50, probes: int = 8, exact: bool = False, least: float = -2.0) -> DataFrame:
    """The k rows nearest to each query (id, embedding): query, id, cosine, vector_rank; ties go to the least id.

    Reads the ``probes`` cells nearest to each query. With ``exact`` also all others that can hold a row as near as
    the k-th found. Cosines are rounded to 9 places. A query without a vector, or with one of another size, has no
    rows; nor has a table without vectors.
    """
    schema = "query long, id long, cosine double, vector_rank int"
    if not len(index.centres):
        return index.spark.createDataFrame([], schema)
    queries = cut(usable(queries).where(F.size("embedding") == index.centres.shape[1]))
    order = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "id")
    top = lambda hits: hits.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= k)
    found = top(_met(index, cut(_asked(index, queries, probes, None)), k))
    if exact and probes < len(index.centres):
        found = cut(found)
        last = found.groupBy("query").agg(F.when(F.count("*") >= k, F.min("cosine")).otherwise(F.lit(-1.0)).alias("least"))
        more = _met(index, cut(_asked(index, queries, probes, last)), k)
        found = top(found.drop("vector_rank").unionByName(more))
    return found.where(F.col("cosine") >= least).select("query", "id", "cosine", F.col("vector_rank").cast("int").alias("vector_rank"))


def probes_for(index: Index, vectors: DataFrame, k: int = 50, target: float = 0.95, sample: int = 100) -> int:
    """The least number of cells with which a search finds ``target`` of the k nearest on average.

    Measured on up to ``sample`` rows (by a hash of the id) whose nearest are searched exactly; where rows have
    no clusters, many cells are needed for them.
    """
    asked = usable(vectors).where(F.size("embedding") == index.centres.shape[1]).orderBy(F.xxhash64("id"), "id").limit(sample)
    of = index.blocks().select(F.explode("ids").alias("id"), "cell") if len(index.centres) else None
    if of is None or not (rows := asked.collect()):
        return 1
    true = nearest(index, asked, k, exact=True).select("query", "id").join(of, "id").collect()
    x = units(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), index.centres.shape[1])
    place = np.where(index.far < 0, np.inf, gaps(x, index.centres)).argsort(1, kind="stable").argsort(1, kind="stable")
    at = {r["id"]: n for n, r in enumerate(rows)}
    needed = np.sort([place[at[r["query"]], r["cell"]] for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1

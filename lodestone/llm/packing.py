"""Batches of documents as one blob each, and sorted arrays of hashes as compressed blobs.

An operator that must compare every word window of a corpus sends, for each batch, only the sorted
distinct hashes of the batch to the hash range's owner, and gets back which of them occur elsewhere.
A group that is copied a million times is one entry for each batch, so no task sees it whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import slices

PACKED = "batch long, n_rows long, n_bytes long, blob binary"
BATCH_BYTES = 8 << 20
LAST = np.iinfo(np.int64).max  #: stands for a null doc_id, which sorts last


def pack(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Rows (batch, n_rows, n_bytes, blob) of the columns doc_id and text; a batch never splits a text."""

    def run(batches):
        n = 0
        for got in batches:
            for part in slices(got, "text", batch_bytes):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                blob = sink.getvalue().to_pybytes()
                at = TaskContext.get().partitionId() << 32 | n
                yield pa.RecordBatch.from_pylist(
                    [{"batch": at, "n_rows": part.num_rows, "n_bytes": part.get_total_buffer_size(), "blob": blob}],
                    schema=pa.schema([("batch", pa.int64()), ("n_rows", pa.int64()), ("n_bytes", pa.int64()), ("blob", pa.binary())]),
                )
                n += 1

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy()


def planes(values: np.ndarray) -> bytes:
    """An integer array as byte planes, compressed: the high bytes of small numbers cost nothing."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unplanes(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def deltas(values: np.ndarray) -> bytes:
    """A sorted uint64 array."""
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def undeltas(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob, np.uint64), dtype=np.uint64)


def ranges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Positions in a sorted array where each of ``buckets`` equal hash ranges begins (buckets + 1)."""
    edges = np.array([k * (1 << 64) // buckets for k in range(buckets)], np.uint64)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def bucket_count(n_bytes: int, each: int = 16 << 20) -> int:
    """Hash ranges (or partitions) for so much text."""
    return max(8, -(-n_bytes // each))


def text_bytes(docs: DataFrame) -> int:
    return docs.select(F.sum(F.octet_length("text"))).first()[0] or 0


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_utf8(), len(offsets) - 1, buffers).cast(pa.string())

"""Token-id files: one concatenated id array a shard, with document boundaries as Elias-Fano lists.

A token file is a folder of Parquet parts that Spark writes and commits; each row is a shard with the ids
of consecutive documents (ascending doc_id), their doc_ids and the Elias-Fano code of their ends. No
offset table is stored or made: ``EliasFano.select`` finds document k's end from the stored samples.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import Tiles, gathered, room, slices, utf8
from .packing import LAST, bucket_count, planes, text_bytes, unplanes
from .tables import new_path

_SAMPLE = 64  #: every so many ones, the place of a one in the upper bits is kept


class EliasFano:
    """A rising list of n numbers up to ``top`` in about n * (2.5 + log2(top / n)) bits.

    The low bits of each number are stored as they are; the high parts in unary: bit high(k) + k is set. Every
    ``_SAMPLE``-th one's place is stored too, so ``select`` counts at most so many ones and no list of
    offsets is ever made.
    """

    def __init__(self, n: int, low_bits: int, samples: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.samples, self.low, self.high = n, low_bits, samples, low, high

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        n = len(numbers)
        if not n:
            return cls(0, 0, np.zeros(0, "<u4"), np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        low_bits = max(0, (int(numbers[-1]) // n).bit_length() - 1)
        low = np.packbits((numbers[:, None] >> np.arange(low_bits)) & 1, bitorder="little") if low_bits else np.zeros(0, np.uint8)
        places = (numbers >> low_bits) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, places[::_SAMPLE].astype("<u4"), low, np.packbits(bits, bitorder="little"))

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.low_bits, len(self.low)], "<i8").tobytes() + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> EliasFano:
        n, low_bits, size = np.frombuffer(blob, "<i8", 3).tolist()
        count = -(-n // _SAMPLE)
        rest = np.frombuffer(blob, np.uint8, offset=24 + 4 * count)
        return cls(n, low_bits, np.frombuffer(blob, "<u4", count, 24), rest[:size], rest[size:])

    def select(self, k: int) -> int:
        """The k-th number (from 0): from the nearest sample on, ones in the upper bits are counted."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at, left = int(self.samples[k // _SAMPLE]), k % _SAMPLE
        byte = at >> 3
        bits = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        low = 0
        if self.low_bits:
            first = k * self.low_bits
            span = self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes()
            low = int.from_bytes(span, "little") >> (first & 7) & (1 << self.low_bits) - 1
        return (place - k) << self.low_bits | low


_SPACES = b" \n\t\r"
_SPACE = np.zeros(256, bool)
_SPACE[list(_SPACES)] = True
_RUN = 64  #: new chunks that are encoded as one text
#: First bytes of all other white space.
_RARE = np.zeros(256, bool)
_RARE[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_OTHER_SPACE = re.compile(r"[^\S \n\t\r]")
_CACHE_ENTRIES = 1_200_000
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Byte-level BPE ids of texts, the special tokens in them included.

    The pre-tokenizer never joins a non-space with the white space after it, so a text is a chain of chunks
    (white space and the non-space after it) that are encoded by themselves, each distinct chunk of a batch
    once. Texts that hold a special token, or white space of other kinds, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()  # a character stands for a byte
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size, self.start, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    @classmethod
    def get(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode new chunks: those that begin with white space and don't end with it many at once, which
        gives the same ids, told apart by the ids' lengths in bytes."""
        chained = [k for k, x in enumerate(chunks) if x[0] in _SPACES and x[-1] not in _SPACES]
        runs = [chained[k : k + _RUN] for k in range(0, len(chained), _RUN)]
        alone = sorted(set(range(len(chunks))).difference(chained))
        found = self._ids([b"".join([chunks[k] for k in run]).decode() for run in runs] + [chunks[k].decode() for k in alone])
        flat = np.concatenate(found)
        order = np.array(chained + alone)
        ends = np.cumsum([len(chunks[k]) for k in order.tolist()])
        edge = np.searchsorted(np.cumsum(self.n_bytes[flat]), ends, "right")
        size = np.empty(len(chunks), np.int64)
        size[order] = np.diff(edge, prepend=0)
        start = np.empty(len(chunks), np.int64)
        start[order] = edge - np.diff(edge, prepend=0)
        n, m = len(self.known), len(chunks)
        self.known.update(zip(chunks, range(n, n + m), strict=True))
        self.size, self.start = (room(x, n + m) for x in (self.size, self.start))
        self.flat = room(self.flat, self.used + len(flat))
        self.size[n : n + m], self.start[n : n + m] = size, self.used + start
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a batch's texts end to end, and how many each text has. A null text has none."""
        data, offsets = utf8(column)
        whole = self._whole(column, data, offsets)
        space = _SPACE[data]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        tiles = Tiles(data, offsets, begins)
        if len(self.known) > _CACHE_ENTRIES:
            self._forget()
        skip = set()
        if whole:  # their chunks need not be what the tokenizer would make of them
            held = np.zeros(len(tiles.words), bool)
            used = np.repeat(~np.isin(np.arange(len(column)), list(whole)), np.diff(tiles.first))
            held[tiles.of[used]] = True
            skip = set(np.flatnonzero(~held).tolist())
        if new := [x for k, x in enumerate(tiles.words) if x not in self.known and k not in skip]:
            self._learn(new)
        at = np.array([0 if k in skip else self.known[x] for k, x in enumerate(tiles.words)] if skip else [self.known[x] for x in tiles.words], np.int64)[tiles.of]
        size = self.size[at]
        ids = gathered(self.flat, self.start[at], size)
        edge = np.append(0, np.cumsum(size))[tiles.first]
        counts = np.diff(edge)
        if whole:
            parts = np.split(ids, edge[1:-1])
            for k, x in whole.items():
                parts[k] = x
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, counts

    def _whole(self, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """Ids of the texts that can't be cut into chunks."""
        rows = set((np.searchsorted(offsets, np.flatnonzero(_RARE[data]), "right") - 1).tolist())
        rows = {k for k in rows if _OTHER_SPACE.search(column[k].as_py())}
        for x in self.added:
            rows |= set(np.flatnonzero(pc.match_substring(column, x).fill_null(False).to_numpy(zero_copy_only=False)).tolist())
        rows = sorted(rows)
        return dict(zip(rows, self._ids([column[k].as_py() for k in rows]), strict=True)) if rows else {}


_SHARD = "shard long, n_docs long, n_tokens long, width int, doc_ids binary, ends binary, ids binary"
_SHARD_ARROW = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.binary()), ("ends", pa.binary()), ("ids", pa.binary())])
_DOC = [("shard", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_bytes: int = 8 << 20) -> None:
    """Write the ids of each text (null: none) and ``end_id`` after it, in ascending doc_id order.

    A null doc_id comes last; rows that share a doc_id follow each other in any order. An empty table makes
    an empty file. A shard holds about ``shard_bytes`` of text, one document at least.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")

    def run(batches):
        made = 0

        def shard(docs, counts, ids):
            nonlocal made
            docs, counts, numbers = (np.concatenate(x) for x in (docs, counts, ids))
            width = 2 if numbers.max() < 1 << 16 else 4
            row = {
                "shard": TaskContext.get().partitionId() << 32 | made, "n_docs": len(docs), "n_tokens": len(numbers), "width": width,
                "doc_ids": planes(np.diff(docs, prepend=0)), "ends": EliasFano.of(np.cumsum(counts)).to_bytes(), "ids": numbers.astype(f"<u{width}").tobytes(),
            }
            made += 1
            return pa.RecordBatch.from_pylist([row], schema=_SHARD_ARROW)

        encoder, held, size = Encoder.get(tokenizer), [], 0
        for got in batches:
            for part in slices(got, "text", 2 << 20):
                ids, counts = encoder.encode(part["text"])
                held.append((part["doc"].to_numpy(), counts + 1, np.insert(ids, np.cumsum(counts), end_id)))
                size += part["text"].get_total_buffer_size()
                if size >= shard_bytes:
                    yield shard(*zip(*held, strict=True))
                    held, size = [], 0
        if held:
            yield shard(*zip(*held, strict=True))

    parts = bucket_count(text_bytes(docs), 24 << 20)
    ordered = docs.repartitionByRange(parts, "doc").sortWithinPartitions("doc")
    ordered.mapInArrow(run, _SHARD).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32 and, if wanted, ids as little-endian uint32).

    ``start`` counts the ids of all documents before; the sum runs over shards' totals, not over documents.
    """
    shards = spark.read.schema(_SHARD).parquet(path)
    schema = pa.schema([*_DOC, ("ids", pa.binary())] if with_ids else _DOC)

    def run(batches):
        for got in batches:
            for row in got.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                ends = EliasFano.from_bytes(row["ends"])
                ends = np.array([ends.select(k) for k in range(ends.n)], np.int64)
                starts = np.append(0, ends[:-1])
                docs = np.cumsum(unplanes(row["doc_ids"], np.int64))
                each = [ids[i:j].tobytes() for i, j in zip(starts, ends, strict=True)]
                columns = [
                    pa.array(np.full(len(docs), row["shard"])), pa.array(docs, mask=docs == LAST), pa.array(starts),
                    pa.array(ends - starts), pa.array([zlib.crc32(x) for x in each], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(each, pa.binary())] if with_ids else columns, schema=schema)

    out = shards.mapInArrow(run, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    #: Shards' totals are summed within blocks of a thousand partitions, and blocks' totals over all.
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.select("shard", "n_tokens", F.shiftright("shard", 42).alias("block"))
    blocks = totals.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(earlier(Window.orderBy("block"))), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(earlier(Window.partitionBy("block").orderBy("shard"))), F.lit(0))
    base = totals.select("shard", "block", inside.alias("inside")).join(blocks, "block").select("shard", (F.col("before") + F.col("inside")).alias("base"))
    return out.join(base, "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_file(docs: DataFrame, tokenizer: str, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Write ``docs`` to a token file in the shared folder and read it back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path, with_ids)

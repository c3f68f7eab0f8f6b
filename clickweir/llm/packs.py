"""Documents packed into rows of bounded size, and the codes of the messages that packs send to hash buckets.

Operators that need corpus-wide facts about every word or window use one pattern: each pack sends its *distinct* keys to
buckets of the key space, a bucket task merges them and replies with what the pack needs, and the pack is read again
together with its replies. A frequent key therefore costs one entry per pack, never one per occurrence, and no task
holds more than a pack or a bucket. The packs are a table bucketed by pack number, so joining replies moves only replies.
"""

from __future__ import annotations

import ctypes
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from clickweir.session import scratch

PACK_BYTES = 8 << 20  # text per pack; one longer document makes a pack of its own
PACK_SCHEMA = "pack long, doc_ids array<bigint>, lens array<int>, body binary"


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_put(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers as byte planes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<IB", len(values), width) + squeeze(planes.tobytes())


def pack_get(data: bytes) -> np.ndarray:
    count, width = struct.unpack_from("<IB", data)
    steps = np.zeros((count, 8), np.uint8)
    steps[:, :width] = np.frombuffer(expand(data[5:]), np.uint8).reshape(width, count).T
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)


def bits_put(flags: np.ndarray) -> bytes:
    return squeeze(np.packbits(flags).tobytes())


def bits_get(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(expand(data), np.uint8), count=count).view(bool)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers live on, and several share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def text_column(batch: pa.RecordBatch, at: int) -> pa.Array:
    """A string column with 64-bit offsets, nulls as empty texts."""
    column = batch.column(at)
    return column.cast(pa.large_string()).fill_null("")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return ends, memoryview(data) if data is not None else memoryview(b"")


def texts_of(batch: pa.RecordBatch, at: int) -> Iterator[bytes]:
    """Each text as UTF-8 bytes, null as empty, without Python strings."""
    ends, data = bytes_of(text_column(batch, at))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield bytes(data[a:b])


def slices(batches: Iterator[pa.RecordBatch], at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut after the row with which column `at` exceeds `most` bytes."""
    for batch in batches:
        ends, lo = bytes_of(text_column(batch, at))[0], 0
        while lo < batch.num_rows:
            hi = min(max(int(np.searchsorted(ends, ends[lo] + most)), lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of non-null texts: the distinct words, the place of each word among them, and
    where each text's words start (one more entry than texts)."""
    distinct, places, starts = coded_words(texts)
    return distinct.cast(pa.large_binary()).to_pylist(), places, starts


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """words_of() with the distinct words as an Arrow column."""
    split = pc.ascii_split_whitespace(texts)
    starts, coded = np.asarray(split.offsets), split.flatten().dictionary_encode()
    distinct, places = coded.dictionary, np.asarray(coded.indices)
    empty = pc.index(distinct, "").as_py()
    if empty >= 0:  # around leading and trailing white space
        words = places != empty
        starts = np.concatenate([[0], np.cumsum(words)])[starts]
        places = places[words]
    return distinct, places, starts.astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids: list = []
    parts: list = []
    size = 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int32())),
            pa.array([squeeze(b"".join(parts))], pa.binary())], ["pack", "doc_ids", "lens", "body"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1)):
            ids.append(key)
            parts.append(text)
            size += len(text) + 16
            if size >= most:
                yield row()
                number, ids, parts, size = number + 1, [], [], 0
    if ids:
        yield row()


def write_packs(spark: SparkSession, docs: DataFrame, ordered: bool, most: int | None = None) -> DataFrame:
    """`docs` (doc_id, text) as packs, stored below the shared folder and bucketed by pack.

    `ordered` gives packs ascending ranges of doc_id (rows of one id: by a hash of the text, nulls first), so that the
    order of packs and of the rows in them is the order of the documents.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if ordered:
        tie = F.xxhash64("text")
        docs = docs.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    name = f"packs_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = most or PACK_BYTES
    (docs.mapInArrow(lambda batches: _packed(batches, most), PACK_SCHEMA).write.format("parquet").option("path", scratch(spark, name))
     .option("compression", "none").bucketBy(buckets, "pack").sortBy("pack").saveAsTable(name))
    return spark.table(name)


class Pack:
    """One pack row: its number, the ids and texts of its documents, null texts as empty."""

    def __init__(self, row: dict):
        self.number, self.ids = row["pack"], row["doc_ids"]
        body = expand(row["body"])
        ends = np.concatenate([[0], np.cumsum(row["lens"], dtype=np.int64)])
        self.texts = pa.LargeStringArray.from_buffers(len(self.ids), pa.py_buffer(ends), pa.py_buffer(body))


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def with_replies(packs: DataFrame, replies: DataFrame, columns: list[str], name: str = "replies") -> DataFrame:
    """Packs with an array of the replies to each; no pack moves. A pack gets at most one reply per bucket and kind."""
    grouped = replies.groupBy("pack").agg(F.collect_list(F.struct(*columns)).alias(name))
    return packs.join(grouped, "pack", "left")

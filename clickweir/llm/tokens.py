"""Token ids as directly addressable codes.

A table of segments in ascending document order. Each segment holds whole documents and is coded by itself: ids are
split into byte-wide chunks, level 0 has the low chunk of every id, level k the next chunk of those ids that continue.
Every level carries a bitmap of which entries continue and a directory with the number of set bits before each block of
512, so that token i is found by one rank step per level, without decoding its neighbours.
"""

from __future__ import annotations

import os
import string
import struct
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clickweir.llm.packs import bytes_of, coded_words, give_back, slices, text_column
from clickweir.session import scratch

SEGMENT_TOKENS = 1 << 18  # a segment ends with the document that reaches this
CACHED_WORDS = 300_000  # words a worker remembers
TOGETHER = 4 << 20  # bytes of text encoded in one go
BLOCK = 64  # bytes of bitmap per entry of the rank directory
MAGIC = b"DAC1"
assert sys.byteorder == "little" and array("I").itemsize == 4
SEGMENTS = "part int, seq int, doc_ids array<bigint>, starts array<bigint>, n_tokens bigint, codes binary"
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def dac_encode(ids: np.ndarray) -> bytes:
    levels = []
    rest = ids.astype(np.uint64)
    while True:
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % BLOCK))
        counts = _POPCOUNT[bitmap].reshape(-1, BLOCK).sum(1, dtype=np.uint32)
        directory = (np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4")
        levels.append((rest & 255).astype(np.uint8).tobytes() + bitmap.tobytes() + directory.tobytes())
        levels[-1] = struct.pack("<I", len(rest)) + levels[-1]
        if not more.any():
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)
        rest = rest[more] >> 8


class Dac:
    """Reader of one segment: `dac[i]` is random access, `dac.all()` decodes everything."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of token codes")
        self.levels = []
        at = 8
        for _ in range(struct.unpack_from("<I", data, 4)[0]):
            n = struct.unpack_from("<I", data, at)[0]
            blocks = -(-(-(-n // 8)) // BLOCK)
            chunks = np.frombuffer(data, np.uint8, n, at + 4)
            bitmap = np.frombuffer(data, np.uint8, blocks * BLOCK, at + 4 + n)
            directory = np.frombuffer(data, "<u4", blocks, at + 4 + n + blocks * BLOCK)
            self.levels.append((chunks, bitmap, directory))
            at += 4 + n + blocks * (BLOCK + 4)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // (8 * BLOCK)
            before = bitmap[block * BLOCK:i >> 3]
            i = int(directory[block]) + int(_POPCOUNT[before].sum()) + int(_POPCOUNT[bitmap[i >> 3] & ((1 << (i & 7)) - 1)])
        return value

    def all(self) -> np.ndarray:
        values = self.levels[-1][0].astype(np.uint32)
        for chunks, bitmap, _ in reversed(self.levels[:-1]):
            low = chunks.astype(np.uint32)
            low[np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)] |= values << np.uint32(8)
            values = low
        return values


class WordCoder:
    """Ids of texts by words: the tokenizer is asked once for each word that a worker does not remember.

    Right for tokenizers that never merge across white space and drop it; `whole` skips the words for others. Words of
    Latin letters, perhaps with ASCII punctuation behind, go without it and in lower case straight to the tokenizer's
    byte-level model, if that and the ids of the punctuation give what the whole tokenizer gives for PROBES. Two
    generations of words are remembered; the older is forgotten when the younger is full.
    """

    PROBES = ("The", "thing,", "OF.", "antidisestablishment", "x", "q,!", "Zz...", "ciónñoÑ", "Übergrößen.", "e\u0301té", "ĐŐŠŸ")

    def __init__(self, path: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        self.model = self.tokenizer.model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}
        self.old_cores: dict[bytes, bytes] = {}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]  # byte-level models write these from U+0100 on
        self.byte_letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self.direct = True
        probes = pa.array(self.PROBES, pa.large_string())
        self.direct = all(whole == got for whole, got in zip(_joined(self._whole(list(self.PROBES))).to_pylist(), self._lists(probes).to_pylist(), strict=True))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", got.ids).tobytes() for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cores(self, cores: list[bytes]) -> list[bytes | None]:
        """Ids of distinct words without punctuation behind, ASCII ones in lower case; None if not of the plain form."""
        if len(self.cores) > CACHED_WORDS // 2:
            self.old_cores, self.cores = self.cores, {}
        known, ask = self.cores, self.model.tokenize
        codes = list(map(known.get, cores))
        for i, code in enumerate(codes):
            if code is not None:
                continue
            core = cores[i]
            code = self.old_cores.get(core)
            if code is None:
                text = core.decode()
                if not core.isalpha():  # not ASCII letters only
                    text = unicodedata.normalize("NFC", text)
                    if not text.isalpha() or max(text) > "\u024f" or "İ" in text:
                        continue
                    text = text.lower().encode().decode("latin-1").translate(self.byte_letters)
                code = array("I", [t.id for t in ask(text)]).tobytes()
            known[core] = codes[i] = code
        return codes

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words by the whole tokenizer."""
        if len(self.young) > CACHED_WORDS // 2:
            self.old, self.young = self.young, {}
        here = {word: self.young.get(word) or self.old.get(word) for word in words}
        rest = [w for w, code in here.items() if code is None]
        here.update(zip(rest, self._whole([w.decode() for w in rest])))
        self.young.update(here)
        return list(here.values())

    def _lists(self, words: pa.Array) -> pa.Array:
        """A list of ids for each of the distinct words."""
        if not self.direct:
            return _joined(self._ids(words.cast(pa.large_binary()).to_pylist()))
        cores = pc.ascii_rtrim(words, characters=string.punctuation)
        tails = _behind(words, cores).dictionary_encode()
        cores = pc.if_else(pc.ascii_is_alpha(cores), pc.ascii_lower(cores), cores).dictionary_encode()
        codes = self._cores(cores.dictionary.cast(pa.large_binary()).to_pylist())
        first, second = np.asarray(cores.indices).astype(np.int64), np.asarray(tails.indices) + len(codes)
        tail_codes = self._whole(tails.dictionary.to_pylist())
        odd = np.flatnonzero(np.array([code is None for code in codes], bool)[first])
        odd_codes = self._ids(words.take(pa.array(odd)).cast(pa.large_binary()).to_pylist())
        pieces = _joined([*[code or b"" for code in codes], *tail_codes, *odd_codes, b""])
        first[odd], second[odd] = np.arange(len(odd)) + len(codes) + len(tail_codes), len(pieces) - 1
        both = pieces.take(pa.array(np.stack([first, second], 1).reshape(-1)))
        return pa.LargeListArray.from_arrays(pa.array(np.asarray(both.offsets)[::2] - both.offsets[0].as_py()), both.flatten())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls), one after the other, and how many each has."""
        if self.whole:
            codes = self._whole(texts.to_pylist())
            return np.frombuffer(b"".join(codes), "<u4"), np.array([len(c) // 4 for c in codes], np.int64)
        words, places, starts = coded_words(texts)
        lists = self._lists(words)
        ends = np.concatenate([[0], np.cumsum(np.diff(np.asarray(lists.offsets))[places])])[starts]
        return np.asarray(lists.take(pa.array(places)).flatten()), np.diff(ends)


def _joined(codes: list[bytes]) -> pa.Array:
    """Ids of each entry as lists."""
    lens = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int64()), pa.array(np.frombuffer(b"".join(codes), "<u4")))


def _behind(words: pa.Array, cores: pa.Array) -> pa.Array:
    """What `words` have behind `cores`, with which they begin."""
    ends, data = bytes_of(words)
    lens = np.diff(ends) - np.diff(bytes_of(cores)[0])
    starts = np.concatenate([[0], np.cumsum(lens)])
    at = np.repeat(ends[1:] - starts[1:], lens) + np.arange(starts[-1])
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(starts), pa.py_buffer(np.frombuffer(data, np.uint8)[at]))


_coders: dict[tuple, WordCoder] = {}


def coder(path: str, whole: bool) -> WordCoder:
    """One coder per worker process, kept between tasks."""
    if (path, whole) not in _coders:
        _coders[path, whole] = WordCoder(path, whole)
    return _coders[path, whole]


def encoded(batches: Iterator[pa.RecordBatch], words: WordCoder) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each row (doc_id, text); texts are encoded some at a time."""
    for some in slices(batches, 1, TOGETHER):
        ids, counts = words.encode(text_column(some, 1))
        yield from zip(some.column(0).to_pylist(), np.split(ids, np.cumsum(counts)[:-1]))


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, whole: bool = False) -> str:
    """Encode `docs` (doc_id, text; null texts are empty) and write the segments to `path`.

    Every document gets `end_id` at its end. Documents are ordered by doc_id, nulls first, rows of one id by a hash of
    the text and the text; repeated rows are kept. `tokenizer` must be readable at that path on the executors.
    """
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = coder(tokenizer, whole), np.array([end_id], "<u4")
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        ids, starts, codes, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            tokens = np.concatenate(codes)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([starts], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([dac_encode(tokens)], pa.binary())],
                ["part", "seq", "doc_ids", "starts", "n_tokens", "codes"])

        for key, code in encoded(batches, words):
            ids.append(key)
            starts.append(base + size)
            codes += [code, end]
            size += len(code) + 1
            if size >= SEGMENT_TOKENS:
                yield row()
                seq, base = seq + 1, base + size
                ids, starts, codes, size = [], [], [], 0
        if ids:
            yield row()
        give_back()

    tie = F.xxhash64("text")
    (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
     .repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
     .mapInArrow(segments, SEGMENTS).write.option("compression", "zstd").parquet(path))
    return path


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids in all parts before each part. One row per part goes through the ordered sum."""
    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; ids are decoded from the segments."""
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tokens = Dac(row["codes"]).all().astype("<u4")
                starts = np.array(row["starts"], np.int64)
                lens = np.diff(starts, append=starts[0] + len(tokens))
                local = starts - starts[0]
                data = memoryview(tokens.tobytes())
                crc = [zlib.crc32(data[4 * a:4 * (a + n)]) for a, n in zip(local.tolist(), lens.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(starts), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "local", "n_tokens", "ids_crc32"])

    found = (spark.read.parquet(path).select("part", "doc_ids", "starts", "codes")
             .mapInArrow(documents, "part int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"))
    return (found.join(segment_starts(spark, path), "part")
            .select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"))


def token_slice(spark: SparkSession, path: str, start: int, count: int) -> list[int]:
    """`count` ids from global position `start`, by random access into the segments that hold them."""
    rows = (spark.read.parquet(path).join(segment_starts(spark, path), "part")
            .withColumn("first", F.col("base") + F.element_at("starts", 1))
            .where((F.col("first") < start + count) & (F.col("first") + F.col("n_tokens") > start)).orderBy("first"))
    out: list[int] = []
    for row in rows.select("first", "n_tokens", "codes").toLocalIterator():
        dac = Dac(bytes(row["codes"]))
        lo, hi = max(start, row["first"]), min(start + count, row["first"] + row["n_tokens"])
        out += [dac[i - row["first"]] for i in range(lo, hi)]
    return out


def documents_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write below the shared folder and read back."""
    return read_tokens(spark, write_tokens(spark, docs, tokenizer, scratch(spark, "tokens")))

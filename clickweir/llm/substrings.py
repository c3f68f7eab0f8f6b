"""Removal of repeated word sequences with fixed-block anchors.

A repeat of WINDOW = 20 words holds, in its earlier place, at least one whole reference block of 10 words that starts
at a multiple of 10. Every document's non-overlapping blocks are the index; every rolling window of 10 words is a
probe. A block that some other window hits anchors a possible repeat, and each hit is extended on both sides: all
windows of 20 words around it are compared exactly, by 96 bits of hash, with the windows around the other hits, and
the windows found to start earlier elsewhere merge into maximal repeats.

Both comparisons are messages from packs of documents to buckets of hashes: a pack sends each distinct hash once, so a
passage that a third of the documents share costs a bucket one entry per pack. Packs are in document order, so of equal
hashes the one from the lowest pack is the earliest, and replies are bitmaps over what the pack sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from clickweir.llm.mixing import stored
from clickweir.llm.packs import (Pack, bits_get, bits_put, expand, give_back, pack_get, pack_put, pack_rows, squeeze, with_replies, words_of,
                                 write_packs)

WINDOW, BLOCK = 20, 10
BUCKET_WORDS = 1 << 20  # rolling windows per bucket, about
MESSAGE = "bucket int, pack long, keys binary, marks binary"
REPLY = "pack long, bucket int, flags binary"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _rolling(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all sequences of 10 and of 20 words, built by joining shorter ones."""
    def join(left: np.ndarray, n: int, right: np.ndarray, by: int) -> np.ndarray:
        size = max(0, len(right) - by)
        return left[:size] * _power(n) + right[by:]

    two = join(words, 1, words, 1)
    four = join(two, 2, two, 2)
    eight = join(four, 4, four, 4)
    ten = join(eight, 2, two, 8)
    twenty = join(ten, 10, ten, 10)
    return ten, twenty


class Windows:
    """The words of a pack as numbers, and what its windows hash to."""

    def __init__(self, row: dict, bits: int):
        self.pack = Pack(row)
        self.words, self.places, self.starts = words_of(self.pack.texts)
        values = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        self.hashes = values[self.places] if len(values) else np.zeros(0, np.uint64)
        n = len(self.places)
        lens = np.diff(self.starts)
        ends = np.repeat(self.starts[1:], lens)
        at = np.arange(n)
        ten, twenty = _rolling(self.hashes)
        self.ten_at = np.flatnonzero(at + BLOCK <= ends)
        self.ten = _mixed(ten[self.ten_at]) >> np.uint64(64 - bits)
        self.anchor = (self.ten_at - np.repeat(self.starts[:-1], lens)[self.ten_at]) % BLOCK == 0
        self.fits = at + WINDOW <= ends
        self.twenty = twenty

    def sent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of 10 words, ascending; whether one starts a reference block; whether it occurs again here."""
        keyed = np.sort(self.ten * np.uint64(2) + self.anchor.astype(np.uint64))
        hashes = keyed >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(keyed) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:], [len(keyed)]]).astype(np.int64) - 1 if len(first) else first
        return hashes[first], (keyed[last] & np.uint64(1)).astype(bool), last > first

    def candidates(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of 20 words around hits, `hit` telling which of sent() are hits: their starts in the order of their
        hashes and places, the hashes, 32 further bits, and which is the first of its kind in the pack."""
        keys = self.sent()[0][hit]
        marked = np.zeros(len(self.places) + 1, np.int64)
        if len(keys):
            near = np.minimum(np.searchsorted(keys, self.ten), len(keys) - 1)
            marked[self.ten_at[keys[near] == self.ten] + 1] = 1
        hits = np.cumsum(marked)
        starts = np.flatnonzero(self.fits)
        starts = starts[hits[starts + WINDOW - BLOCK + 1] > hits[starts]]
        hashes = _mixed(self.twenty[starts])
        extra = (self._second()[starts] >> np.uint64(32)).astype(np.uint32) if len(starts) else np.zeros(0, np.uint32)
        order = np.lexsort((extra, hashes))  # stable: places ascend among equals
        starts, hashes, extra = starts[order], hashes[order], extra[order]
        first = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (extra[1:] != extra[:-1])]) if len(starts) else np.zeros(0, bool)
        return starts, hashes, extra, first

    def _second(self) -> np.ndarray:
        return _mixed(_rolling(_mixed(self.hashes ^ _BASE))[1])


def _by_bucket(keys: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """Runs of ascending keys that go to one bucket: (bucket, from, to)."""
    if len(keys):
        buckets = (keys >> np.uint64(shift)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(buckets[a]), a, b


def _flags(row: dict, name: str, keys: np.ndarray, shift: int) -> np.ndarray:
    """The replies to a pack, put together over the keys it sent; buckets without a reply had nothing to tell."""
    flags, replies = np.zeros(len(keys), bool), {r["bucket"]: r["flags"] for r in row[name] or ()}
    for bucket, a, b in _by_bucket(keys, shift):
        if bucket in replies:
            flags[a:b] = bits_get(replies[bucket], b - a)
    return flags


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, ["bucket", "pack", "keys", "marks"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])


def _replies(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, ["pack", "bucket", "flags"], [pa.int64(), pa.int32(), pa.binary()])])


def _hit_blocks(table: pa.Table) -> pa.Table:
    """One bucket of probes: which hashes are a reference block and occur more than once."""
    sent = [(m["pack"], m["bucket"], pack_get(m["keys"]), np.unpackbits(np.frombuffer(expand(m["marks"]), np.uint8)).view(bool)) for m in table.to_pylist()]
    coded = []
    for _, _, keys, marks in sent:
        n = len(keys)
        coded.append(keys * np.uint64(4) + marks[:n] * np.uint64(2) + marks[n:2 * n])
    merged = np.sort(np.concatenate(coded))
    keys = merged >> np.uint64(2)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    marks = np.bitwise_or.reduceat(merged & np.uint64(3), first)
    often = np.diff(first, append=len(keys)) > 1
    hits = keys[first][(marks >= 2) & (often | (marks & np.uint64(1)).astype(bool))]
    rows = []
    for pack, bucket, keys, _ in sent:
        flags = hits[np.minimum(np.searchsorted(hits, keys), len(hits) - 1)] == keys if len(hits) else np.zeros(len(keys), bool)
        if flags.any():
            rows.append((pack, bucket, bits_put(flags)))
    return _replies(rows)


def _later(table: pa.Table) -> pa.Table:
    """One bucket of windows: which of a pack's were sent by a lower pack too."""
    sent = [(m["pack"], m["bucket"], pack_get(m["keys"]), np.frombuffer(expand(m["marks"]), np.uint32)) for m in table.to_pylist()]
    sent.sort(key=lambda m: m[0])
    keys, extra = np.concatenate([m[2] for m in sent]), np.concatenate([m[3] for m in sent])
    order = np.lexsort((extra, keys))  # stable: packs ascend among equals
    again = np.zeros(len(keys), bool)
    same = (keys[order][1:] == keys[order][:-1]) & (extra[order][1:] == extra[order][:-1])
    again[order[1:]] = same
    rows, at = [], 0
    for pack, bucket, own, _ in sent:
        flags = again[at:at + len(own)]
        at += len(own)
        if flags.any():
            rows.append((pack, bucket, bits_put(flags)))
    return _replies(rows)


def dedup_substrings(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, removed, kept) for every row of `docs` (doc_id, text).

    Words are `[^\\\\x20\\\\x09-\\\\x0D]+` of the whole text, unchanged (null: none). A window of 20 words in one document is
    a repeat if its words also start earlier: at a smaller doc_id, or earlier in the same document; rows of one doc_id are
    ordered by a hash of the text, null ids first. `removed` are the maximal spans [from, to) of words that repeats
    cover, judged on the input; `kept` are the other words, joined by a space.
    """
    packs = write_packs(spark, docs, ordered=True)
    size = packs.agg(F.sum(F.expr("aggregate(lens, 0L, (a, x) -> a + x)"))).first()[0] or 0
    words = max(1, size // 6)
    bits = min(62, max(24, math.ceil(math.log2(words)) + 12))  # a chance hit in 4096 blocks: it only makes a candidate
    fan = max(0, math.ceil(math.log2(words / BUCKET_WORDS)) if words > BUCKET_WORDS else 0)
    ten_shift, twenty_shift = bits - fan, 64 - max(0, fan - 1)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in pack_rows(batches):
            keys, anchors, again = Windows(row, bits).sent()
            yield _messages([(bucket, row["pack"], pack_put(keys[a:b]), bits_put(np.concatenate([anchors[a:b], again[a:b]])))
                             for bucket, a, b in _by_bucket(keys, ten_shift)])
        give_back()

    def extensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in pack_rows(batches):
            windows = Windows(row, bits)
            _, hashes, extra, first = windows.candidates(_flags(row, "hits", windows.sent()[0], ten_shift))
            hashes, extra = hashes[first], extra[first]
            yield _messages([(bucket, row["pack"], pack_put(hashes[a:b]), squeeze(extra[a:b].tobytes()))
                             for bucket, a, b in _by_bucket(hashes, twenty_shift)])
        give_back()

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in pack_rows(batches):
            windows = Windows(row, bits)
            starts, hashes, _, first = windows.candidates(_flags(row, "hits", windows.sent()[0], ten_shift))
            repeated = ~first
            repeated[first] = _flags(row, "earlier", hashes[first], twenty_shift)
            edges = np.zeros(len(windows.places) + WINDOW + 1, np.int64)
            np.add.at(edges, starts[repeated], 1)
            np.add.at(edges, starts[repeated] + WINDOW, -1)
            gone = np.cumsum(edges)[:len(windows.places)] > 0
            ids, counts, spans, texts = [], [], [], []
            for key, a, b in zip(windows.pack.ids, windows.starts[:-1].tolist(), windows.starts[1:].tolist()):
                own = gone[a:b]
                turns = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
                ids.append(key)
                counts.append(b - a)
                spans.append([{"from": x, "to": y} for x, y in zip(turns[::2], turns[1::2])])
                texts.append(b" ".join([windows.words[i] for i in windows.places[a:b][~own].tolist()]).decode())
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.string())],
                                             ["doc_id", "n_words", "removed", "kept"])
        give_back()

    hits = stored(spark, packs.mapInArrow(probes, MESSAGE).groupBy("bucket").applyInArrow(_hit_blocks, REPLY), "hits")
    hit = with_replies(packs, hits, ["bucket", "flags"], "hits")
    later = stored(spark, hit.mapInArrow(extensions, MESSAGE).groupBy("bucket").applyInArrow(_later, REPLY), "earlier")
    whole = with_replies(hit, later, ["bucket", "flags"], "earlier")
    return whole.mapInArrow(cleaned, "doc_id long, n_words long, removed array<struct<from: long, to: long>>, kept string")

"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ORDER long, with the counts of the symbols that follow each context in the
training documents. A symbol unseen in a context escapes to the context one byte shorter, with the chance q / 2n for n
symbols of q kinds, one seen c times has (2c - 1) / 2n, and the kinds that the longer context has seen are excluded from
the shorter one's counts. Below
the empty context all symbols left are equally likely. A text's score is the log10 probability of its bytes and of its
end.

The trie is never in one place. Packs of documents count the distinct paths of full length that they hold; paths are
merged by the last two context bytes, so a task has every context of two to ORDER bytes of its kind, and the counts below
that are a table of 257 * 257. Tasks reply with the log probability of each path to the packs that asked. A table of
words, which the base score needs, is built by the same exchange of distinct words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from clickweir.llm.mixing import stored
from clickweir.llm.packs import Pack, bytes_of, coded_words, expand, give_back, pack_get, pack_put, pack_rows, squeeze, with_replies, write_packs

ORDER = 5
SYMBOLS = 257  # 0 stands before a text and ends it, byte b is b + 1
PACK_BYTES = 4 << 20
DENSE = 1 << 15  # texts numbered in the bits that a path leaves free in 64; more are sorted by so many
GRAM_BUCKETS = 192
WORDS_PER_BUCKET = 8 << 20  # with repetitions; each pack sends a row to each bucket, so buckets are large
WORD_BUCKETS = 64  # at least, for small inputs to use all cores
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
MERGED = 128  # packs whose messages are merged first
GRAMS, WORDS = 0, 1
MESSAGE = "kind int, bucket int, pack long, keys binary, counts binary"
PART = "bucket int, keys binary, counts binary"
REPLY = "kind int, bucket int, pack long, values binary, seen long, total long"


def in_training(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts; `ordered` has one value at least."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


class Counted:
    """What a pack holds: its words, and the path that ends at each symbol of its texts.

    A path is one 64-bit key (nearest context byte first, symbol last). Paths are counted by sorting these numbers, with
    the text that a path stands in, or whether it trains, in the low bits; no table is read out of order.
    """

    def __init__(self, row: dict, trains: Callable[[int | None], bool]):
        self.pack = Pack(row)
        texts, n = self.pack.texts, len(self.pack.ids)
        self.train = np.array([trains(k) for k in self.pack.ids], bool)
        self.words, self.places, self.word_starts = coded_words(pc.ascii_lower(texts))
        ends, data = bytes_of(texts)
        lens = np.diff(ends)
        # ORDER zeros before each text and after the last; the first zero after a text is its end
        lengths = np.full(2 * n + 1, ORDER)
        lengths[1::2] = lens
        symbols = np.zeros(lengths.sum(), np.uint16)
        symbols[np.repeat(np.arange(2 * n + 1) % 2 == 1, lengths)] = np.frombuffer(data, np.uint8)[:ends[-1]] + np.uint16(1)
        self.lens = lens + 1
        # no path ends at the other zeros
        lengths = np.full(2 * n, ORDER - 1)
        lengths[::2] = self.lens
        asked = np.repeat(np.arange(2 * n) % 2 == 0, lengths)
        self.paths = np.zeros(self.lens.sum(), np.uint64)
        for half in np.split(np.array([*range(1, ORDER + 1), 0]), 2):  # 32 bits hold three symbols
            keys = np.zeros(len(asked), np.uint32)
            for back in half.tolist():
                keys *= np.uint32(SYMBOLS)
                keys += symbols[ORDER - back:len(symbols) - back]
            self.paths *= np.uint64(SYMBOLS ** len(half))
            self.paths += keys[asked]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct paths in ascending order, and how often each occurs in training. Uses up the paths."""
        marked, self.paths = self.paths, None
        marked <<= np.uint64(1)
        marked |= np.repeat(self.train, self.lens)
        marked.sort()
        keys = marked >> np.uint64(1)
        first = _runs(keys)
        marked &= np.uint64(1)
        return keys[first], np.add.reduceat(marked, first)

    def by_text(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """For each DENSE texts: their distinct paths in ascending order, how often each occurs, the text (from 0) of
        each occurrence in that order, and how many texts there are. Uses up the paths."""
        paths, self.paths = self.paths, None
        starts = np.concatenate([[0], np.cumsum(self.lens)])
        for lo in range(0, len(self.lens), DENSE):
            some = self.lens[lo:lo + DENSE]
            bits = np.uint64((len(some) - 1).bit_length())
            marked = paths[starts[lo]:starts[lo + len(some)]]
            marked <<= bits
            marked |= np.repeat(np.arange(len(some), dtype=np.uint32), some)
            marked.sort()
            keys = marked >> bits
            first = _runs(keys)
            own, often = keys[first], np.diff(first, append=len(keys))
            del keys
            marked &= (np.uint64(1) << bits) - np.uint64(1)
            yield own, often, marked.view(np.int64), len(some)

    def vocabulary(self, buckets: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words with the end of a text as b"" last, their training counts and buckets."""
        words = pa.concat_arrays([self.words.cast(pa.large_binary()), pa.array([b""], pa.large_binary())])
        of_train = np.repeat(self.train, np.diff(self.word_starts))
        counts = np.append(np.bincount(self.places[of_train], minlength=len(words))[:len(self.words)], self.train.sum())
        return words, counts, _word_buckets(words, buckets)


def _word_buckets(words: pa.Array, buckets: int) -> np.ndarray:
    """By a hash of all bytes of a word."""
    ends, data = bytes_of(words)
    lens = np.diff(ends)
    values = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] + np.uint64(1)
    values *= POWERS[(np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], lens)) % len(POWERS)]
    hashes = np.zeros(len(words), np.uint64)
    if len(values):
        hashes[lens > 0] = np.add.reduceat(values, (ends[:-1] - ends[0])[lens > 0])
    hashes ^= hashes >> np.uint64(32)
    return (hashes * POWERS[0] >> np.uint64(32)).astype(np.int64) % buckets


def _gram_buckets(keys: np.ndarray) -> np.ndarray:
    """By the two nearest context bytes."""
    pair = keys // np.uint64(SYMBOLS ** (ORDER - 1))
    return (pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % GRAM_BUCKETS


def _sorted_by(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indexes in their order)."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for some in np.split(order, cuts):
        if len(some):
            yield int(buckets[some[0]]), some


def _counts_put(counts: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return squeeze(planes.tobytes())


def _counts_get(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def _merge(table: pa.Table) -> pa.Table:
    rows = table.select(["bucket", "salt", "keys", "counts"]).to_pylist()
    keys, counts = _summed(np.concatenate([pack_get(r["keys"]) for r in rows]), np.concatenate([_counts_get(r["counts"]) for r in rows]))
    return pa.table({"bucket": pa.array([rows[0]["bucket"]], pa.int32()), "salt": pa.array([rows[0]["salt"]], pa.int64()),
                     "keys": pa.array([pack_put(keys)], pa.binary()), "counts": pa.array([_counts_put(counts)], pa.binary())})


def log_probabilities(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of the chance of the symbol of each path, `keys` ascending.

    All paths that share the two nearest context bytes with one of them must be among them; `pairs` has the counts of
    symbol (column) after byte (row) over all training texts.
    """
    s = SYMBOLS
    symbol = (keys % np.uint64(s)).astype(np.int64)
    near = (keys // np.uint64(s ** ORDER)).astype(np.int64)
    context = {k: (keys // np.uint64(s ** (ORDER + 1 - k))).astype(np.int64) for k in range(2, ORDER + 1)}
    count, total, kinds, taken = {}, {}, {}, {}
    for k in range(ORDER, 1, -1):
        starts = np.concatenate([[True], context[k][1:] != context[k][:-1]])
        group = np.cumsum(starts) - 1
        entry = group * s + symbol
        order = np.argsort(entry, kind="stable")
        new = np.concatenate([[True], entry[order][1:] != entry[order][:-1]])
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new) - 1
        sums = np.bincount(number, weights=counts)
        one = order[new]  # a path for each (context, symbol)
        seen = sums > 0
        count[k], total[k] = sums[number], np.bincount(group, weights=counts)[group]
        kinds[k] = np.bincount(group[one], weights=seen, minlength=group[-1] + 1)[group]
        taken[k] = (group, one, seen)  # for the exclusions of the next shorter context
    count[1], total[1], kinds[1] = pairs[near, symbol], pairs.sum(1)[near], (pairs > 0).sum(1)[near]
    single = pairs.sum(0)
    count[0], total[0], kinds[0] = single[symbol], np.full(len(keys), single.sum()), np.full(len(keys), (single > 0).sum())
    out, done = np.zeros(len(keys)), np.zeros(len(keys), bool)
    for k in range(ORDER, -1, -1):
        excluded, out_kinds = 0.0, 0.0
        if k < ORDER:
            out_kinds = kinds[k + 1]
            if k == 0:
                excluded = ((pairs > 0) @ single)[near]
            else:
                group, one, seen = taken[k + 1]
                excluded = np.bincount(group[one], weights=count[k][one] * seen, minlength=group[-1] + 1)[group]
        n, q = total[k] - excluded, kinds[k] - out_kinds
        active = ~done & (q > 0)
        hit = active & (count[k] > 0)
        out[hit] += np.log10((2 * count[k] - 1)[hit] / (2 * n)[hit])
        missed = active & ~hit
        out[missed] += np.log10((q / np.where(n > 0, 2 * n, 1))[missed])
        done |= hit
    out[~done] -= np.log10(max(1, s - int((single > 0).sum())))
    return out


def _answer_grams(requests: list[dict], keys: np.ndarray, logs: np.ndarray) -> list[tuple]:
    return [(GRAMS, r["bucket"], r["pack"], squeeze(logs[np.searchsorted(keys, pack_get(r["keys"]))].astype("<f4").tobytes()), 0, 0) for r in requests]


def _words_put(words: pa.Array, parts: list[np.ndarray]) -> list[bytes]:
    """The words of each part, which are places in `words`."""
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    lists = pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), words.take(pa.array(np.concatenate(parts))))
    return [squeeze(joined) for joined in pc.binary_join(lists, pa.scalar(b"\n", pa.large_binary())).to_pylist()]


def _answer_words(table: pa.Table) -> pa.Table:
    """One bucket of words: training counts to the packs that have them, and one row with how many kinds and tokens."""
    sent = table.select(["pack", "keys", "counts"]).to_pylist()
    counts = [_counts_get(r["counts"]) for r in sent]
    joined = pa.array([b"\n".join([expand(r["keys"]) for r in sent])], pa.large_binary())
    words = pc.split_pattern(joined, b"\n").flatten().dictionary_encode()
    places = np.asarray(words.indices)
    totals = np.bincount(places, weights=np.concatenate(counts), minlength=len(words.dictionary)).astype(np.int64)
    bucket = table["bucket"][0].as_py()
    parts = np.split(totals[places], np.cumsum([len(c) for c in counts])[:-1])
    rows = [(WORDS, bucket, r["pack"], _counts_put(part), 0, 0) for r, part in zip(sent, parts)]
    return _reply_table([*rows, (WORDS, bucket, None, None, int((totals > 0).sum()), int(totals.sum()))])


def _reply_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[i]) for i, n in enumerate(["kind", "bucket", "pack", "values", "seen", "total"])})


def _gathered(row: dict, kind: int, size: int, parts: Iterator[tuple[int, np.ndarray]], read: Callable[[bytes], np.ndarray]) -> np.ndarray:
    replies = {r["bucket"]: r["values"] for r in row["replies"] or () if r["kind"] == kind}
    out = np.zeros(size, np.float64)
    for bucket, places in parts:
        out[places] = read(replies[bucket])
    return out


def score(spark: SparkSession, docs: DataFrame, trains: Callable[[int | None], bool] = in_training) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs` (doc_id, text).

    The model and the word table learn from the rows whose doc_id `trains`; null texts count as empty, which still have
    an end. The model reads the bytes of the text as it is. Tokens of the base score are the words `[^\\\\x20\\\\x09-\\\\x0D]+`
    with A-Z lower-cased and one end per text; its chance of a token is (c + 1) / (N + V + 1). Without training texts all
    chances are uniform.
    """
    packs = write_packs(spark, docs, ordered=False, most=PACK_BYTES)
    size = packs.agg(F.sum(F.expr("aggregate(lens, 0L, (a, x) -> a + x)"))).first()[0] or 0
    word_buckets = max(WORD_BUCKETS, size // 6 // WORDS_PER_BUCKET)

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in pack_rows(batches):
            held = Counted(row, trains)
            rows = []
            keys, counts = held.grams()
            for bucket, some in _sorted_by(_gram_buckets(keys)):
                rows.append((GRAMS, bucket, row["pack"], pack_put(keys[some]), _counts_put(counts[some])))
            words, counts, own = held.vocabulary(word_buckets)
            buckets, parts = zip(*_sorted_by(own))
            for bucket, some, joined in zip(buckets, parts, _words_put(words, parts)):
                rows.append((WORDS, bucket, row["pack"], joined, _counts_put(counts[some])))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["kind", "bucket", "pack", "keys", "counts"])
        give_back()

    sent = stored(spark, packs.mapInArrow(messages, MESSAGE), "messages")
    salt = F.pmod(F.xxhash64("pack"), F.lit(max(1, size // PACK_BYTES // MERGED)))
    grams = sent.where(F.col("kind") == GRAMS).withColumn("salt", salt)
    merged = stored(spark, grams.groupBy("bucket", "salt").applyInArrow(_merge, "bucket int, salt long, keys binary, counts binary"), "paths")

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, counts = pack_get(r["keys"]), _counts_get(r["counts"])
                pair = keys // np.uint64(SYMBOLS ** ORDER) * np.uint64(SYMBOLS) + keys % np.uint64(SYMBOLS)
                pair, n = _summed(pair, counts)
                yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

    pairs = np.zeros(SYMBOLS * SYMBOLS)  # at most so many rows come to the driver
    for r in merged.select("keys", "counts").mapInArrow(pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    pairs = pairs.reshape(SYMBOLS, SYMBOLS)

    def model(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, counts = _summed(np.concatenate([pack_get(r["keys"]) for r in rows]), np.concatenate([_counts_get(r["counts"]) for r in rows]))
        return pa.table({"bucket": pa.array([rows[0]["bucket"]], pa.int32()), "keys": pa.array([pack_put(keys)], pa.binary()),
                         "counts": pa.array([squeeze(log_probabilities(keys, counts, pairs).astype("<f4").tobytes())], pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not known.num_rows or not asked.num_rows:
            return _reply_table([])
        r = known.select(["keys", "counts"]).to_pylist()[0]
        return _reply_table(_answer_grams(asked.select(["bucket", "pack", "keys"]).to_pylist(), pack_get(r["keys"]), np.frombuffer(expand(r["counts"]), "<f4")))

    trie = stored(spark, merged.groupBy("bucket").applyInArrow(model, PART), "trie")
    known = merged.select(F.col("bucket").alias("b"), F.col("salt").alias("s")).join(trie, F.col("b") == trie["bucket"]).select("b", "s", "keys", "counts")
    gram_replies = grams.groupBy("bucket", "salt").cogroup(known.groupBy("b", "s")).applyInArrow(answer, REPLY)
    word_replies = sent.where(F.col("kind") == WORDS).groupBy("bucket").applyInArrow(_answer_words, REPLY)
    replies = stored(spark, gram_replies.unionAll(word_replies), "replies")
    stats = replies.where(F.col("kind") == WORDS).agg(F.sum("seen").alias("v"), F.sum("total").alias("n")).first()
    tokens, kinds = stats["n"] or 0, stats["v"] or 0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in pack_rows(batches):
            held = Counted(row, trains)
            runs = list(held.by_text())
            keys = runs[0][0] if len(runs) == 1 else np.unique(np.concatenate([r[0] for r in runs]))
            logs = _gathered(row, GRAMS, len(keys), _sorted_by(_gram_buckets(keys)), lambda d: np.frombuffer(expand(d), "<f4"))
            sums = np.concatenate([np.bincount(texts, weights=np.repeat(logs[np.searchsorted(keys, own)], often), minlength=some) for own, often, texts, some in runs])
            del runs
            words, _, own = held.vocabulary(word_buckets)
            counts = _gathered(row, WORDS, len(words), _sorted_by(own), _counts_get)
            n = len(held.pack.ids)
            of_doc = np.repeat(np.arange(n), np.diff(held.word_starts))
            seen = counts[held.places]
            n_tokens = np.diff(held.word_starts) + 1
            known = np.bincount(of_doc, weights=seen > 0, minlength=n) + (counts[-1] > 0)
            base = np.bincount(of_doc, weights=np.log10(seen + 1), minlength=n) + np.log10(counts[-1] + 1) - n_tokens * np.log10(tokens + kinds + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.pack.ids, pa.int64()), pa.array(held.train), pa.array(n_tokens, pa.int64()), pa.array(known.astype(np.int64)),
                 pa.array(np.full(n, tokens), pa.int64()), pa.array(base), pa.array(sums)],
                ["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        give_back()

    asked = with_replies(packs, replies.where("pack IS NOT NULL"), ["kind", "bucket", "values"])
    return asked.mapInArrow(scored, "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Phrases whose words stand together more often than chance, counted by a suffix tree in vertical partitions.

The suffixes of a language's pieces are cut to five words. Words and pairs that are rarer than the least count cannot
be part of a candidate, so a suffix ends where one begins. Tasks know the frequent words by a Bloom filter and the
frequent pairs by a bitmap of hash cells that counted enough; both are of bounded size, and what passes them wrongly costs
work and changes nothing, as all counts come from the tree. Equal suffixes are one leaf with its total. Leaves are divided by word prefixes, each no more than the memory budget: a prefix with more leaves is
replaced by the prefixes one word longer, whose own count is then read from their totals. Prefixes are grouped up to the
budget, and each group is one task's depth-truncated subtree: leaves in order of their words, every node's count the sum
of its leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clickweir.llm.packs import expand, give_back, pack_get, pack_put, slices, squeeze, text_column
from clickweir.llm.running import running_total
from clickweir.session import scratch

DEPTH = 5        # words of the longest phrase
LEAST = 100      # occurrences of a candidate
BUDGET = 200_000  # leaves of a task's subtree
FIRST = 2000     # phrases listed per language
CONTAINED = 100  # percent of its occurrences inside one longer phrase with which a candidate is dropped
SLICE_BYTES = 16 << 20  # text taken at once; one longer document is taken alone
FILTER_BITS, LEAST_FILTER_BITS = 1 << 28, 1 << 20  # of the filter of frequent words
HASHES = 3
CELLS, LEAST_CELLS, RANGE = 1 << 28, 1 << 18, 1 << 18  # hash cells of pairs, and how many of them a row counts together
SALTS = 64  # parts in which a language's list is cut to its length before it is ranked as one

_MARK = b"\xff"  # stands between pieces; no byte of UTF-8
_LETTERS = bytes(32 if b == 9 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_LEAVES = "lang string, words array<string>, n long"


# Words of a slice of documents

def _sliced(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Iterator[tuple[str, bytes]]]:
    """Per slice, the texts of each of its languages; documents end in a line break."""
    def languages(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        langs = batch.column(0).cast(pa.string()).fill_null("und").dictionary_encode()
        texts = text_column(batch, 1).cast(pa.large_binary()).to_pylist()
        places = np.asarray(langs.indices)
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, b"\n".join(texts[i] for i in np.flatnonzero(places == code))

    for batch in slices(batches, 1, most):
        yield languages(batch)


def _by_language(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, bytes]]:
    for languages in _sliced(batches, most):
        yield from languages


def _words(body: bytes) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, and each word's place among them in the order of the text; -1 between pieces."""
    body = body.translate(_LETTERS).replace(b"\n", b" " + _MARK + b" ")
    text = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(body)], np.int64)), pa.py_buffer(body))
    coded = pc.ascii_split_whitespace(text).flatten().dictionary_encode()
    distinct, places = coded.dictionary.cast(pa.large_binary()).to_pylist(), np.asarray(coded.indices)
    if b"" in distinct:
        places = places[places != distinct.index(b"")]
    if _MARK in distinct:
        mark = distinct.index(_MARK)
        places, distinct[mark] = np.where(places == mark, -1, places), b""
    return distinct, places


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _batches(lang: str, columns: list[np.ndarray], words: list[bytes], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (lang, words, n); `columns` hold a row's words as places among `words`, -1 behind its end."""
    names = _strings(words)
    for lo in range(0, len(counts), 100_000):
        table = np.stack([c[lo:lo + 100_000] for c in columns], 1)
        ends = np.concatenate([[0], np.cumsum((table >= 0).sum(1))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(table[table >= 0])))
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(table)), lists, pa.array(counts[lo:lo + 100_000])], ["lang", "words", "n"])


def _count_words(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for lang, body in _by_language(batches, most):
        words, places = _words(body)
        counts = np.bincount(places[places >= 0], minlength=len(words))
        some = np.flatnonzero(counts)
        yield from _batches(lang, [some], words, counts[some])
    give_back()


# Filters of what is frequent

def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) ^ (second >> np.uint64(31) | second << np.uint64(33))
    mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> np.uint64(27)


def _filter_places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """`bits` is a power of two, at most 2 ** 28: places are taken from the two halves of a hash."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return [((low + np.uint64(i) * high) & np.uint64(bits - 1)).astype(np.int64) for i in range(HASHES)]


def _bloom(keys: DataFrame) -> np.ndarray:
    """Filter of single words (lang, words), as bytes: 16 bits a word, at most FILTER_BITS. Its pieces of 64 bits are
    merged over the cluster; that many rows at most come to the driver."""
    bits = LEAST_FILTER_BITS
    while bits < min(16 * keys.count(), FILTER_BITS):
        bits *= 2

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                lists = batch.column(1).filter(pc.equal(batch.column(0), lang))
                hashes = _hashes(lang, lists.flatten().cast(pa.binary()).to_pylist())
                places = np.unique(np.concatenate(_filter_places(hashes, bits)))
                masks = (np.uint64(1) << (places & 63).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(places >> 6), pa.array(masks)], ["at", "mask"])

    merged = keys.select("lang", "words").mapInArrow(marked, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(merged["at"].combine_chunks())] = np.asarray(merged["mask"].combine_chunks())
    return out.view(np.uint8)


def _passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool) for p in _filter_places(hashes, len(bits) * 8)])


# Pairs and suffixes

def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct key first is, the rank of every key, and how often each occurs."""
    _, first, ranks, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, ranks, counts


def _frequent_words(lang: str, words: list[bytes], places: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of words, and places with -1 also where a word is rare."""
    hashes = _hashes(lang, words)
    often = np.append(_passing(hashes, bits), False) if len(words) else np.zeros(1, bool)
    return hashes, np.where(often[places], places, -1)


def _pairs(lang: str, body: bytes, word_bits: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice's frequent words: the words, their places, where pairs begin, each pair's rank among the distinct ones,
    and the hashes and counts of these."""
    words, places = _words(body)
    hashes, places = _frequent_words(lang, words, places, word_bits)
    at = np.flatnonzero((places[:-1] >= 0) & (places[1:] >= 0))
    a, b = places[at].astype(np.int64), places[at + 1].astype(np.int64)
    first, ranks, counts = _distinct(a * len(words) + b)
    return words, places, at, ranks, (_pair_hashes(hashes[a[first]], hashes[b[first]]), counts)


def _cell(hashes: np.ndarray, cells: int) -> np.ndarray:
    """`cells` is a power of two."""
    return (hashes >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def _send_pairs(batches: Iterator[pa.RecordBatch], most: int, word_bits, cells: int, span: int, least: int) -> Iterator[pa.RecordBatch]:
    """Per slice and range of cells, the cells that pairs fall into with their counts, which end at `least`."""
    for languages in _sliced(batches, most):
        found = [_pairs(lang, body, word_bits.value)[4] for lang, body in languages]
        hit, ranks = np.unique(np.concatenate([_cell(h, cells) for h, _ in found]), return_inverse=True)
        counts = np.minimum(np.bincount(ranks, np.concatenate([c for _, c in found])), least).astype(np.uint32)
        ranges, starts = np.unique(hit // span, return_index=True)
        rows = [(r, pack_put((h - r * span).astype(np.uint64)), squeeze(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 4).T).tobytes()))
                for r, h, c in zip(ranges.tolist(), np.split(hit, starts[1:]), np.split(counts, starts[1:]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["range", "cells", "counts"])
    give_back()


def _count_cells(batches: Iterator[pa.RecordBatch], span: int, least: int) -> Iterator[pa.RecordBatch]:
    """Ranges come together: the bitmap of each one's cells that reach `least`."""
    def row(at: int, totals: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(totals >= least, bitorder="little").tobytes()], pa.binary())], ["range", "bits"])

    now, totals = None, None
    for batch in batches:
        for at, cells, counts in zip(*[c.to_pylist() for c in batch.columns]):
            if at != now:
                if now is not None:
                    yield row(now, totals)
                now, totals = at, np.zeros(span, np.int64)
            counted = np.frombuffer(expand(counts), np.uint8).reshape(4, -1)
            totals[pack_get(cells).astype(np.int64)] += np.ascontiguousarray(counted.T).view(np.uint32).ravel()
    if now is not None:
        yield row(now, totals)
    give_back()


def _pair_bits(rows: DataFrame, word_bits, words: int, least: int) -> np.ndarray:
    """Bitmap of the cells in which pairs occur at least `least` times: a cell per 16 words of the corpus, CELLS at most.
    Its pieces are counted over the cluster, each as its parts come, and only the bitmap comes to the driver."""
    cells, most = LEAST_CELLS, SLICE_BYTES
    while cells < min(words // 16, CELLS):
        cells *= 2
    span = min(cells, RANGE)
    sent = rows.mapInArrow(lambda batches: _send_pairs(batches, most, word_bits, cells, span, least), "range long, cells binary, counts binary")
    counted = sent.repartition("range").sortWithinPartitions("range").mapInArrow(lambda batches: _count_cells(batches, span, least), "range long, bits binary")
    out = np.zeros((cells // span, span // 8), np.uint8)
    for row in counted.toLocalIterator():
        out[row["range"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _suffixes(batches: Iterator[pa.RecordBatch], most: int, word_bits, pair_bits) -> Iterator[pa.RecordBatch]:
    """Suffixes of two to DEPTH words that end before a rare word or pair, with how often they are in the slice."""
    for lang, body in _by_language(batches, most):
        words, places, at, ranks, (hashes, _) = _pairs(lang, body, word_bits.value)
        cells = _cell(hashes, len(pair_bits.value) * 8)
        at = at[(pair_bits.value[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)[ranks]]
        goes_on = np.zeros(len(places) + DEPTH, bool)
        goes_on[at] = True
        columns = [places[at].astype(np.int64), places[at + 1].astype(np.int64)]
        open_ = np.ones(len(at), bool)
        padded = np.concatenate([places, np.full(DEPTH, -1, places.dtype)])
        key = columns[0] * len(words) + columns[1]
        for k in range(2, DEPTH):
            open_ = open_ & goes_on[at + k - 1]
            columns.append(np.where(open_, padded[at + k], -1).astype(np.int64))
            _, ranks, _ = _distinct(key)
            key = ranks * (len(words) + 1) + columns[-1] + 1
        first, _, counts = _distinct(key)
        yield from _batches(lang, [c[first] for c in columns], words, counts)
    give_back()


# Vertical partitions and subtrees

def _prefix(words: int) -> Column:
    return F.slice("words", 1, words).alias("prefix")


def _partitions(spark: SparkSession, leaves: DataFrame, budget: int) -> tuple[list[tuple[int, DataFrame]], DataFrame | None]:
    """Per depth the prefixes (lang, prefix, part) of at most `budget` leaves, and the nodes (lang, words, n) above them."""
    found, above, hot = [], None, None
    for depth in range(2, DEPTH + 1):
        rows = leaves.where(F.size("words") >= depth)
        if hot is not None:
            rows = rows.withColumn("above", F.slice("words", 1, depth - 1)).join(
                hot.select("lang", F.col("prefix").alias("above")), ["lang", "above"], "left_semi")
        path = scratch(spark, "prefixes")
        rows.groupBy("lang", _prefix(depth)).agg(F.count("*").alias("leaves"), F.sum("n").alias("n")).write.parquet(path)
        sizes = spark.read.parquet(path)
        fits = (F.col("leaves") <= budget) | F.lit(depth == DEPTH)  # leaves of full depth are one each
        packed = running_total(spark, sizes.where(fits), ["lang", "prefix"], F.col("leaves"), "upto")
        part = F.concat_ws(":", F.lit(depth), F.floor((F.col("upto") - F.col("leaves")) / budget).cast("long"))
        found.append((depth, packed.select("lang", "prefix", part.alias("part"))))
        hot = sizes.where(~fits)
        if hot.isEmpty():
            break
        nodes = hot.select("lang", F.col("prefix").alias("words"), "n")
        above = nodes if above is None else above.unionAll(nodes)
    return found, above


def _subtree(group: pa.Table, least: int) -> pa.Table:
    """Nodes of at least `least` occurrences of one group's tree, from the depth of its prefixes on."""
    prefix = int(group["part"][0].as_py().split(":")[0])
    lists, totals = group["words"].combine_chunks(), np.asarray(group["n"].combine_chunks())
    langs = np.asarray(group["lang"].combine_chunks().dictionary_encode().indices).astype(np.int64)
    sizes, flat = np.diff(np.asarray(lists.offsets)), lists.flatten().dictionary_encode()
    table = np.full((len(lists), DEPTH), -1, np.int64)
    table[np.arange(DEPTH) < sizes[:, None]] = np.asarray(flat.indices)
    order = np.lexsort([*table.T[::-1], langs])
    table, langs, totals = table[order], langs[order], totals[order]
    new, nodes = np.append(True, langs[1:] != langs[:-1]) if len(langs) else np.zeros(0, bool), []
    for depth in range(DEPTH):
        new = new | np.append(True, table[1:, depth] != table[:-1, depth])[:len(new)]
        starts = np.flatnonzero(new)
        counts = np.add.reduceat(totals, starts)
        keep = (counts >= least) & (table[starts, depth] >= 0)
        if depth + 1 >= prefix:
            nodes.append((order[starts[keep]], depth + 1, counts[keep]))
    out = []
    for at, depth, counts in nodes:
        words = pc.list_slice(lists.take(pa.array(at)), 0, depth)
        out.append(pa.table({"lang": group["lang"].combine_chunks().take(pa.array(at)), "words": words.cast(pa.list_(pa.string())), "n": pa.array(counts, pa.int64())}))
    return pa.concat_tables(out)


def count_phrases(spark: SparkSession, docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and (lang, words, n): all words of each language of `docs` (lang, text), and every phrase of one to
    DEPTH words that occurs at least `least` times within pieces, overlaps included.

    Texts are lower-cased in A-Z and cut at `[.,;:!?\\x0A-\\x0D]`; words are `[^\\x20\\x09]+`. Null languages are `und`,
    null texts empty; whole texts are counted, repeated rows as often as they are there. An empty table gives no rows.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    path, most = scratch(spark, "words"), SLICE_BYTES
    rows.mapInArrow(lambda batches: _count_words(batches, most), _LEAVES).groupBy("lang", "words").agg(F.sum("n").alias("n")).write.parquet(path)
    words = spark.read.parquet(path)
    often = words.where(F.col("n") >= least)
    broadcast = spark.sparkContext.broadcast
    word_bits = broadcast(_bloom(often))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    pair_bits = broadcast(_pair_bits(rows, word_bits, totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], least))
    path = scratch(spark, "leaves")
    (rows.mapInArrow(lambda batches: _suffixes(batches, most, word_bits, pair_bits), _LEAVES).groupBy("lang", "words").agg(F.sum("n").alias("n"))
     .write.parquet(path))
    leaves = spark.read.parquet(path)
    parts, above = _partitions(spark, leaves, budget)
    grouped = reduce(DataFrame.unionAll, [
        leaves.where(F.size("words") >= depth).withColumn("prefix", _prefix(depth)).join(prefixes, ["lang", "prefix"]).select("part", "lang", "words", "n")
        for depth, prefixes in parts])
    nodes = grouped.groupBy("part").applyInArrow(lambda group: _subtree(group, least), _LEAVES)
    everything = often.unionAll(nodes)
    if above is not None:
        everything = everything.unionAll(above.where(F.col("n") >= least))
    path = scratch(spark, "phrases")
    everything.write.parquet(path)
    return totals, spark.read.parquet(path)


# Scores

def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, first: int = FIRST, contained: int = CONTAINED,
                 budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `first` best phrases of two to DEPTH words.

    a, l and r are the occurrences of the phrase, of its first words and of the rest at the cut with the lowest score
    floor(1000 * a * n / (l * r)), the earliest of equals; products are exact. A phrase is left out if a phrase one word
    longer holds it in `contained` percent of its occurrences or more: of phrases longer by more, the one between occurs
    as often at least. Order is by score and a descending, then by the bytes of the phrase.
    """
    totals, phrases = count_phrases(spark, docs, least, budget)
    phrases = phrases.select("lang", "words", F.col("n").alias("a"))
    candidates = phrases.where(F.size("words") > 1)
    inner = candidates.where(F.size("words") > 2).select("lang", F.col("a").alias("longer"), F.explode(F.array(
        F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1))).alias("words"))
    held = inner.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    kept = (candidates.join(held, ["lang", "words"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a"))).drop("longer"))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    parts = cuts.join(phrases.select("lang", F.col("words").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    parts = parts.join(phrases.select("lang", F.col("words").alias("right"), F.col("a").alias("r")), ["lang", "right"]).join(totals, "lang")
    wide = [F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")]
    scored = parts.select("lang", "words", "a", "n", "l", "r", "k", (F.lit(1000).cast("decimal(4,0)") * wide[0] * wide[1]).alias("over"), (wide[2] * wide[3]).alias("under"))
    scored = scored.withColumn("score", F.expr("CAST(over div under AS LONG)"))
    lowest = scored.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ready = lowest.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order, place = [F.desc("score"), F.desc("a"), F.asc("phrase")], F.row_number()
    # A part of a language keeps no more than the whole list has, so the task that ranks it gets SALTS lists at most.
    some = ready.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("rank", place.over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", place.over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

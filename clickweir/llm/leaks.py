"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages of SPAN words, benchmark items as pieces of at most PIECE words. Passages and pieces are
TF-IDF vectors over the benchmark's words. A randomised SVD of the passages, with the pieces weighing as much as the whole
corpus, gives the latent space: every task multiplies its part of the matrix with a random one, and the products' sum
yields singular vectors by the Nystroem formula, in one pass. All overlapping passages are then compared with all pieces
by their cosine in that space. What comes near is checked word by word: the longest common subsequence of the item and
the text around the passage, and for looser matches the item's answer, its last sentence.
"""

from __future__ import annotations

import itertools
import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickweir.llm.packs import give_back, slices, text_column
from clickweir.llm.rows import free_names
from clickweir.session import scratch

STEP, SPAN, PIECE = 16, 48, 32  # words; PIECE <= SPAN - STEP, so that some passage holds a piece whole
TOGETHER = 4 << 20  # bytes of text worked on at once
TERMS = 1 << 14  # dimensions; the words of a larger benchmark share them
PIECES = 512  # per latent space; a larger benchmark gets several
ITEMS = 2_000  # searched for at a time, as they and their spaces go to every task; more items take several passes
COMMON = 0.002  # words in more than this share of the passages weigh nothing,
LEAST, LEAST_SHARE = 3, 0.25  # but of each piece this many of its rarest words, and this share of them, always weigh
OVERSAMPLE = 16
NEAR = 0.5  # cosine of a candidate
FEWEST = 2  # weighing words of a passage, fewer if PARAPHRASE of some piece's are fewer. Of 24,000 paraphrases of the given items that kept
# 60 to 80 % of the words, 0.1 to 0.2 % had no passage with so many; with three it would be 0.5 to 1.5 %.
VERBATIM, PARAPHRASE, ANSWER = 0.75, 0.55, 0.8  # shares of the item's, and of its answer's, words found in order
KIND = "array<struct<item_id: long, cosine: double, matched: double, answered: double>>"
ARROW_KIND = pa.list_(pa.struct([("item_id", pa.int64()), *[(n, pa.float64()) for n in ("cosine", "matched", "answered")]]))
TRIM = string.punctuation + "“”„«»…‘’¿¡"


def plain_words(text: str) -> list[str]:
    """Lower-cased words without punctuation around them."""
    words = [w.strip(TRIM).lower() for w in re.split(r"[\x20\x09-\x0D]+", text)]
    return [w for w in words if w]


class Item:
    def __init__(self, item_id: int, text: str):
        self.item_id, self.words = item_id, plain_words(text)
        sentences = [w for w in map(plain_words, re.split(r"(?<=[.!?])\s+", text.strip())) if w]
        self.answer = sentences[-1] if sentences else []
        # A sentence may be a word or two: the answer then reaches back to a quarter of the item.
        self.answer = self.words[-max(len(self.answer), len(self.words) // 4, 1):]
        self.numbered({w: w for w in self.words})

    def numbered(self, index: dict) -> None:
        """Take words by their entries in `index` from now on."""
        self.places: dict = {}
        for i, word in enumerate(self.words):
            self.places[index[word]] = self.places.get(index[word], 0) | 1 << i
        self.often = {k: bits.bit_count() for k, bits in self.places.items()}

    def at_most(self, words: set) -> float:
        """The share of the item's words that are among `words`: no subsequence has more."""
        return sum([self.often[w] for w in self.often.keys() & words]) / len(self.words)

    def found(self, words: list) -> tuple[float, float]:
        """Shares of the item's words and of its answer's in the longest common subsequence with `words`."""
        n, state = len(self.words), 0
        full = (1 << n) - 1
        row = full
        for word in words:
            match = self.places.get(word, 0)
            if match:
                both = row & match
                row = (row + both | row - both) & full
        state = ~row & full  # bits of the words that the subsequence has
        tail = state >> n - len(self.answer)
        return state.bit_count() / n, tail.bit_count() / len(self.answer)


class Vocabulary:
    def __init__(self, items: list[Item]):
        words = sorted({w for item in items for w in item.words})
        self.values, self.size = pa.array(words, pa.large_string()), len(words)
        self.dims = min(TERMS, max(1, len(words)))
        self.dim_of = np.arange(len(words), dtype=np.int64) % self.dims
        self.index = {w: i for i, w in enumerate(words)}

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Plain words of texts: the benchmark word that each is (-1 for other words), and the starts of the texts.
        Words of punctuation alone are left out."""
        split = pc.ascii_split_whitespace(texts)
        starts, coded = np.asarray(split.offsets), split.flatten().dictionary_encode()
        distinct = pc.utf8_lower(pc.utf8_trim(coded.dictionary, TRIM))
        term = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=self.values), -1)).astype(np.int64)
        blank = np.asarray(pc.equal(distinct, ""))
        places = np.asarray(coded.indices)
        if blank.any():
            kept = ~blank[places]
            starts = np.concatenate([[0], np.cumsum(kept)])[starts]
            places = places[kept]
        words = term[places] if len(term) else np.zeros(0, np.int64)
        return words, starts.astype(np.int64)

    def scaled(self, space: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """`space` with the words' weights in it, where every word has a dimension of its own."""
        return space * weights[:, None] if self.dims == self.size else space

    def latent(self, scaled: np.ndarray, weights: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Weighted latent vectors of words."""
        return scaled[words] if self.dims == self.size else scaled[self.dim_of[words]] * weights[words, None]


def _passages(terms: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Non-overlapping passages of SPAN words: (passage, word) of every benchmark word, and how many passages."""
    lens = np.diff(starts)
    counts = -(-lens // SPAN)
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.flatnonzero(terms >= 0)
    doc = np.searchsorted(starts, at, side="right") - 1
    return first[doc] + (at - starts[doc]) // SPAN, terms[at], int(first[-1])


def _texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for some in slices(batches, at, TOGETHER):
        yield some, text_column(some, at)


def passage_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many passages of all documents each benchmark word occurs, and how many passages there are."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(vocabulary.size, np.int64), 0
        for _, texts in _texts(batches, 0):
            passage, term, n = _passages(*vocabulary.read(texts))
            key = np.sort(passage * vocabulary.size + term)
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            total += np.bincount(key % vocabulary.size, minlength=vocabulary.size)
            passages += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int64()), pa.array([*total[some].tolist(), passages], pa.int64())], ["term", "n"])

    rows = docs.select("text").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each word of ITEMS items
    out = np.zeros(vocabulary.size + 1, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def _unit_rows(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighing words by row, each row's weights as a unit vector (a word's repeats add up)."""
    some = weights[terms] > 0
    key = np.sort(rows[some] * len(weights) + terms[some])
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    often = np.diff(first, append=len(key))
    row, term = np.divmod(key[first], len(weights))
    value = often * weights[term]
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    norm = np.sqrt(np.add.reduceat(value * value, begin))
    number = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]])).astype(np.int64)
    return number, term, value / norm[number]


def _times(row: np.ndarray, term: np.ndarray, value: np.ndarray, right: np.ndarray, out: np.ndarray) -> None:
    """out += A^T (A right) for the sparse A (row, term, value), rows ascending."""
    step = 1 << 13
    cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
    at = 0
    while at < len(cuts):
        to = min(len(cuts), max(at + 1, int(np.searchsorted(cuts, cuts[at] + step))))
        lo, hi = cuts[at], cuts[to] if to < len(cuts) else len(row)
        v, t = value[lo:hi, None].astype(np.float32), term[lo:hi]
        made = np.add.reduceat(v * right[t], cuts[at:to] - lo)
        part = v * made[row[lo:hi] - row[lo]]
        order = np.argsort(t, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], t[order][1:] != t[order][:-1]]))
        out[t[order][begin]] += np.add.reduceat(part[order], begin)
        at = to


def latent_space(docs: DataFrame, vocabulary: Vocabulary, weights: np.ndarray, pieces: list[np.ndarray], seed: int = 7) -> np.ndarray:
    """Right singular vectors (dimension by rank) of all passages and the weighted pieces."""
    rank = min(len(pieces), vocabulary.dims)
    width = min(vocabulary.dims, rank + OVERSAMPLE)
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((vocabulary.dims, width)))[0].astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((omega, weights))  # TERMS * (PIECES + OVERSAMPLE) numbers at most

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, w = shared.value
        out, passages = np.zeros(right.shape, np.float32), 0
        for _, texts in _texts(batches, 0):
            passage, term, n = _passages(*vocabulary.read(texts))
            row, term, value = _unit_rows(passage, term, w)
            _times(row, vocabulary.dim_of[term], value, right, out)
            passages += n
        some = np.flatnonzero(np.any(out, axis=1))
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int64()), pa.array([*[out[i].tobytes() for i in some], np.float64(passages).tobytes()], pa.binary())], ["term", "part"])

    def summed(table: pa.Table) -> pa.Table:
        term = table["term"][0].as_py()
        kind = np.float64 if term < 0 else np.float32
        total = np.zeros(1 if term < 0 else width)
        for part in table["part"].to_pylist():
            total += np.frombuffer(part, kind)
        return pa.table({"term": pa.array([term], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})

    y, passages = np.zeros((vocabulary.dims, width)), 0.0
    for r in docs.select("text").mapInArrow(product, "term long, part binary").groupBy("term").applyInArrow(summed, "term long, part binary").toLocalIterator():
        if r["term"] < 0:
            passages = float(np.frombuffer(r["part"])[0])
        else:
            y[r["term"]] = np.frombuffer(r["part"])
    own = np.zeros((vocabulary.dims, width), np.float32)
    rows = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    row, term, value = _unit_rows(rows, np.concatenate(pieces), weights)
    _times(row, vocabulary.dim_of[term], value, omega, own)
    y += own * max(1.0, passages / len(pieces))
    # Nystroem: the sum is M omega for M = A^T A, so M is nearly y (omega^T y)^-1 y^T.
    shift = 1e-6 * max(1e-12, float(np.linalg.norm(y)))
    y += shift * omega
    middle = omega.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    good = values > values.max() * 1e-9
    root = y @ (vectors[:, good] / np.sqrt(values[good]))
    return np.linalg.svd(root, full_matrices=False)[0][:, :rank]


def word_weights(vocabulary: Vocabulary, pieces: list[np.ndarray], frequency: np.ndarray, passages: int) -> tuple[np.ndarray, int]:
    """The words' weights, and how many weighing words a passage must have to be compared.

    A word's weight depends on its share of the passages and on the pieces it is in, not on the size of corpus or
    benchmark. The rarest words of a piece weigh whatever their share is, so that no piece is left without words.
    """
    rarity = np.log((1 + passages) / (1 + frequency))
    weights = np.where(frequency > COMMON * passages, 0.0, rarity)
    for piece in pieces:
        least = min(len(piece), max(LEAST, math.ceil(LEAST_SHARE * len(piece))))
        rarest = piece[np.argsort(frequency[piece], kind="stable")[:least]]
        weights[rarest] = np.maximum(weights[rarest], rarity[rarest] + 0.01)
    return weights, min(FEWEST, *(math.ceil(PARAPHRASE * int((weights[p] > 0).sum())) for p in pieces))


def _ranges(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The items that have words, in ascending order, at most ITEMS at a time."""
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    some = rows.limit(ITEMS + 1).collect()
    if len(some) > ITEMS:
        ordered = rows.orderBy(F.col("item_id").asc_nulls_last(), "text").toLocalIterator()
        parts = iter(lambda: list(itertools.islice(ordered, ITEMS)), [])
    else:
        parts = iter([sorted(some, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))])
    for part in parts:
        items = [i for i in (Item(r["item_id"], r["text"]) for r in part) if i.words]
        if items:
            yield items


def with_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, name: str = "leaks") -> DataFrame:
    """`docs` with an array column `name` of (item_id, cosine, matched, answered), one for each item of `benchmark`
    (item_id, text) that the row's text holds word for word or as a paraphrase.

    An item is held if VERBATIM of its words are found in their order near a passage that is close in latent space, or
    PARAPHRASE of them and ANSWER of its answer. Items and texts that are null or without words match nothing; repeated
    rows are judged each for itself. The driver reads ITEMS items at a time; a larger benchmark takes as many passes over
    `docs`, which are stored in between.
    """
    out, shared = None, None
    for items in _ranges(benchmark):
        if out is not None:
            path = scratch(spark, "leaks")
            out.write.parquet(path)
            out = spark.read.parquet(path)
            shared.destroy()
        found, shared = _search(spark, docs if out is None else out, items)
        out = docs.withColumn(name, found) if out is None else out.withColumn(name, F.concat(F.col(name), found))
    return docs.withColumn(name, F.array().cast(KIND)) if out is None else out


def _search(spark: SparkSession, docs: DataFrame, items: list[Item]) -> tuple[Column, Broadcast]:
    """The column of leaks of `items`, and what its tasks share."""
    vocabulary = Vocabulary(items)
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    pieces, owner = [], []
    for number, item in enumerate(items):
        words = np.array([vocabulary.index[w] for w in item.words])
        for part in np.array_split(words, -(-len(words) // PIECE)):
            pieces.append(part)
            owner.append(number)
        item.numbered(vocabulary.index)
    weights, fewest = word_weights(vocabulary, pieces, *passage_frequencies(texts, vocabulary))
    spaces = []
    for lo in range(0, len(pieces), PIECES):
        some = pieces[lo:lo + PIECES]
        space = vocabulary.scaled(latent_space(texts, vocabulary, weights, some), weights)
        latent = np.stack([vocabulary.latent(space, weights, p).sum(0) for p in some])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        spaces.append((space.astype(np.float32), latent.T.astype(np.float32), np.array(owner[lo:lo + PIECES])))
    shared = spark.sparkContext.broadcast((items, weights.astype(np.float32), spaces))  # bounded by ITEMS, TERMS and PIECES

    def searched(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = [own for _, texts in _texts(iter([pa.RecordBatch.from_arrays([column], ["text"])]), 0) for own in near(texts)]
            yield pa.array(found, ARROW_KIND)
        give_back()

    def near(texts: pa.Array) -> list[list[dict]]:
        items, weights, spaces = shared.value
        known, starts = vocabulary.read(texts)
        at = np.flatnonzero(known >= 0)
        at = at[weights[known[at]] > 0]
        lens = np.diff(starts)
        counts = np.maximum(1, -(-(lens - SPAN) // STEP) + 1) * (lens > 0)
        doc = np.repeat(np.arange(len(lens)), counts)
        begin = starts[doc] + STEP * (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts))
        lo, hi = np.searchsorted(at, begin), np.searchsorted(at, np.minimum(begin + SPAN, starts[doc + 1]))
        full = np.flatnonzero(hi - lo >= fewest)
        best: dict[tuple[int, int], tuple] = {}
        for a in range(0, len(full), 2048):
            own = full[a:a + 2048]
            # Passages overlap: each block of STEP words is summed once and shared by the passages that it is in.
            limit = starts[doc[own] + 1][:, None]
            blocks = begin[own][:, None] + STEP * np.arange(SPAN // STEP)
            inside = blocks < limit
            block, one, place = np.unique(blocks[inside], return_index=True, return_inverse=True)
            last = np.minimum(blocks + STEP, limit)[inside][one]
            block_lo, block_hi = np.searchsorted(at, block), np.searchsorted(at, last)
            some = block_hi > block_lo
            size = (block_hi - block_lo)[some]
            ends = np.cumsum(size)
            term = known[at[np.repeat(block_lo[some], size) + np.arange(ends[-1]) - np.repeat(ends - size, size)]]
            of = np.full(blocks.shape, len(block))
            of[inside] = place
            for space, latent, owners in spaces:
                sums = np.zeros((len(block) + 1, space.shape[1]), np.float32)
                sums[:-1][some] = np.add.reduceat(vocabulary.latent(space, weights, term), ends - size)
                made = sums[of[:, 0]]
                for k in range(1, SPAN // STEP):
                    made += sums[of[:, k]]
                cosines = made @ latent / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
                for i, j in zip(*np.nonzero(cosines >= NEAR)):
                    window, number = own[i], int(owners[j])
                    item, d = items[number], int(doc[window])
                    around = max(STEP, len(item.words))
                    region = known[max(starts[d], begin[window] - around):min(starts[d + 1], begin[window] + SPAN + around)]
                    words = region[region >= 0].tolist()
                    if item.at_most(set(words)) < PARAPHRASE:
                        continue
                    matched, answered = item.found(words)
                    if matched >= VERBATIM or matched >= PARAPHRASE and answered >= ANSWER:
                        got = (matched, answered, float(cosines[i, j]))
                        best[d, number] = max(best.get((d, number), got), got)
        found: list[list[dict]] = [[] for _ in range(len(texts))]
        for (d, number), (matched, answered, cosine) in sorted(best.items()):
            found[d].append({"item_id": items[number].item_id, "cosine": cosine, "matched": matched, "answered": answered})
        return found

    return F.arrow_udf(searched, KIND)(F.col("text").cast("string")), shared


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, matched, answered): a row for each leak of with_leaks()."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_leaks(spark, rows, benchmark).select("doc_id", F.inline("leaks"))


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no item of the benchmark."""
    name, = free_names(docs, "_leaks")
    return with_leaks(spark, docs, benchmark, name).where(F.size(name) == 0).select(*[f"`{c}`" for c in docs.columns])

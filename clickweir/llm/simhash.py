"""Near-duplicates by SimHash, with pigeonring filtering.

A 64-bit fingerprint is a ring of 8 segments of 8 bits. If two fingerprints differ in at most 4 bits, then from some
segment on, every chain of l consecutive segments differs in at most l * 4 / 8 bits. So the first segment of that chain
is equal, one of the next two is, and two of the next four: each fingerprint is indexed under the 8 x 5 triples of
segments that this allows. Fingerprints that share a triple are candidates; those whose chain from its start keeps
within the budget at every length are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickweir.llm.components import components
from clickweir.llm.mixing import stored
from clickweir.llm.packs import give_back, texts_of
from clickweir.llm.rows import content_key, repeated

SEGMENTS, LIMIT = 8, 4
OFFSETS = [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4)]
CELL = 2048  # fingerprints of one key compared in one go; larger keys are split into pairs of blocks
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SLICE = 1 << 18


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    """SimHash over shingles of `size` words, repeats included; zero without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    shingles = max(1, len(words) - size + 1)
    first, last = starts[:shingles].tolist(), (ends[-shingles:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, shingles, _SLICE):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[lo:lo + _SLICE], last[lo:lo + _SLICE])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > shingles, bitorder="little").view("<u8")[0])


def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Arrow function: fingerprints of texts, the 64 bits as a signed long."""
    for column in texts:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        yield pa.array(np.array([fingerprint(t) for t in texts_of(batch, 0)], np.uint64).view(np.int64))
    give_back()


def _chained(differing: np.ndarray, start: int) -> np.ndarray:
    """Which differences (XOR) keep within the budget for every chain length from segment `start` on."""
    parts = np.bitwise_count(differing.astype("<u8", copy=False).view(np.uint8).reshape(-1, SEGMENTS))
    sums = np.cumsum(np.roll(parts, -start, axis=1), axis=1)
    return (sums <= np.arange(1, SEGMENTS + 1) * LIMIT // SEGMENTS).all(1)


def _forest(fps: np.ndarray, start: int) -> Iterator[tuple[int, int]]:
    """Links that join what a cell's links join: each fingerprint is reached once, so links stay fewer than rows."""
    left = np.arange(len(fps))
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = _chained(fps[left] ^ fps[at], start)
            for other in left[near]:
                stack.append(other)
                yield at, other
            left = left[~near]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted cells (key, cell, start, fp); a cell may go on in the next batch."""
    held: list[np.ndarray] = []

    def found(table: np.ndarray) -> pa.RecordBatch:
        u, v = [], []
        cuts = np.flatnonzero((table[1:, 0] != table[:-1, 0]) | (table[1:, 1] != table[:-1, 1]) | (table[1:, 2] != table[:-1, 2])) + 1
        bounds = np.concatenate([[0], cuts, [len(table)]])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a > 1:
                fps = table[a:b, 3].view(np.uint64)
                for i, j in _forest(fps, int(table[a, 2])):
                    u.append(table[a + i, 3])
                    v.append(table[a + j, 3])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        table = np.column_stack([np.asarray(c) for c in batch.columns])
        if held:
            table = np.concatenate([*held, table])
        last = np.flatnonzero((table[:, :3] != table[-1, :3]).any(1)) if len(table) else []
        cut = int(last[-1]) + 1 if len(last) else 0
        held = [table[cut:]]
        if cut:
            yield found(table[:cut])
    if held:
        yield found(held[0])


def links(spark: SparkSession, fps: DataFrame) -> DataFrame:
    """(u, v): links between the distinct fingerprints `fps` (fp) that join all that differ in at most 4 bits.

    A key with more than CELL fingerprints is dealt out as pairs of blocks of them, each a cell of its own. Spark takes
    the keys to be as large as the fingerprints, which have a 40th of their rows, and would broadcast them: the join is
    a merge.
    """
    shift = lambda s: F.shiftrightunsigned("fp", 8 * (s % SEGMENTS)).bitwiseAND(F.lit(255))
    keys = [(F.lit((start * len(OFFSETS) + k) << 24) + shift(start) * 65536 + shift(start + a) * 256 + shift(start + b))
            for start in range(SEGMENTS) for k, (a, b) in enumerate(OFFSETS)]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / CELL).cast("long")
    own = F.pmod(F.xxhash64("fp"), blocks)
    cells = (keyed.hint("merge").join(crowded, "key").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
             .withColumn("cell", F.least("own", "other") * 2**31 + F.greatest("own", "other"))
             .select("key", "cell", F.floor(F.shiftright("key", 24) / len(OFFSETS)).cast("long").alias("start"), "fp"))
    return (cells.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_links, "u long, v long"))


def marked(spark: SparkSession, docs: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, *more) of every row of `docs`, stored, and (fp, component) of every fingerprint."""
    compute = F.arrow_udf(fingerprints, "long")
    rows = stored(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), compute(F.col("text").cast("string")).alias("fp"), *more), "fingerprints")
    fps = rows.select("fp").distinct()
    joined = components(spark, links(spark, fps))
    return rows, fps.join(joined, fps["fp"] == joined["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs` (doc_id, text).

    Texts are lower-cased in A-Z and cut into words at ASCII white space; null and wordless texts have the fingerprint
    zero, which links like any other. component_id is the smallest doc_id that links reach, its own included (null ids
    only if there is no other). Rows with one fingerprint are one node, however many there are.
    """
    rows, of_class = marked(spark, docs)
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(of_class, "fp")
    lowest = firsts.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = of_class.join(lowest, "component").select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay if one of each group of near-duplicates does: the one with the smallest doc_id (rows
    without one last; of one id, that with the lowest hash of its content)."""
    rows, of_class = marked(spark, docs, content_key(docs).alias("_key"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_key")
    firsts = rows.groupBy("fp").agg(F.min(order).alias("first")).join(of_class, "fp")
    kept = firsts.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first._key").alias("_key"))
    often = rows.groupBy("_key").agg(F.count("*").alias("_rows"))
    return repeated(docs, kept.join(often, "_key").select("_key", F.lit(1).alias("_copies"), "_rows"))

"""URL verdicts by rules, with exact membership in rule lists from a cascade of Bloom filters.

A cascade answers membership without error for every key of a known universe. Level 0 holds the listed keys; level 1 the
keys of the universe that pass level 0 without being listed; level 2 the listed keys that pass level 1, and so on until
no key is wrong. A key is listed if the first level that denies it is odd. The filters go to every task, so judging a
page is an expression over its own row and needs no join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from clickweir.llm.rows import free_names
from clickweir.session import scratch

KEY_BITS = 10  # bits of filter per key
HASHES = 7
MAX_BYTES = 256 << 20  # of all filters of a cascade; beyond that build_cascade() raises
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _places(key: str, level: int, size: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), seed=level)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b & (1 << 64) - 1) % size for i in range(HASHES)]


def passes(key: str, level: int, bits: bytes) -> bool:
    return all(bits[p >> 3] >> (p & 7) & 1 for p in _places(key, level, 8 * len(bits)))


def listed(key: str, cascade: list[bytes]) -> bool:
    """Exact for keys of the universe that the cascade was built over."""
    for level, bits in enumerate(cascade):
        if not passes(key, level, bits):
            return level % 2 == 1
    return len(cascade) % 2 == 1


def _filter(keys: DataFrame, level: int, count: int) -> bytes:
    """A filter of `count` keys: tasks set bits, words of bits are merged by OR before they come together."""
    size = 64 * max(1, math.ceil(count * KEY_BITS / 64))

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            places = np.array([p for k in frame["key"] for p in _places(k, level, size)], np.int64)
            yield pd.DataFrame({"word": places >> 6, "bits": (np.uint64(1) << (places & 63).astype(np.uint64)).view(np.int64)})

    merged = keys.mapInPandas(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(size // 64, np.int64)
    for row in merged.toLocalIterator():
        out[row["word"]] = row["bits"]
    return out.tobytes()


def _passing(keys: DataFrame, level: int, bits: bytes) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    def still(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[passes(k, level, shared.value) for k in frame["key"]]] if len(frame) else frame

    return keys.mapInPandas(still, "key string")


def build_cascade(spark: SparkSession, keys: DataFrame, universe: DataFrame, levels: int = 40) -> list[bytes]:
    """Cascade for the listed `keys` over `universe` (both one column, key; nulls are left out, repeats allowed).

    Listed keys outside the universe do no harm. The filters' size is counted before they are made; more than MAX_BYTES
    raises. The universe is only filtered by level 0 where it lies; what passes without being listed, about a hundredth,
    is stored, and every further level takes on a hundredth of the level two before.
    """
    cascade: list[bytes] = []
    encoded, against = keys.where("key is not null").select("key").distinct(), universe.where("key is not null").select("key")
    for level in range(levels):
        count = encoded.count()
        if not count:
            return cascade
        if sum(map(len, cascade)) + count * KEY_BITS // 8 > MAX_BYTES:
            raise ValueError(f"filters of more than {MAX_BYTES} bytes: split the list by a prefix of the key")
        cascade.append(_filter(encoded, level, count))
        wrong = _passing(against, level, cascade[-1])
        if level == 0:
            wrong = wrong.distinct().join(encoded, "key", "left_anti")
        path = scratch(spark, "passing")
        wrong.write.parquet(path)
        encoded, against = spark.read.parquet(path), encoded
    raise RuntimeError("the cascade did not settle")


def split_url(pages: DataFrame) -> DataFrame:
    """`pages` with host and path. Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path:
    from there up to `?`, `#` or the end. Null or without `://`: both empty."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return (pages.withColumn("host", F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER))
            .withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)))


def candidates(host: str, path: str, lengths: list[int]) -> Iterator[tuple[str, int]]:
    """Keys a rule that fits this address can have, longest host first, then longest path."""
    while host:
        for n in lengths:
            if n <= len(path):
                yield f"{host}{path[:n]}", n
        host = host.partition(".")[2]


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict.

    `rules` are (verdict, host, path); a rule fits its host and all subdomains if the path starts with the rule's. Of
    the rules that fit, the one with the longest key (host and path together; then the longest host; then block before
    allow) counts. Without one, rule is null and the verdict is `default`, as the lists then hold no key of the page.
    The universe is every host suffix with every path prefix as long as some rule's path, of every page.
    """
    hosted = split_url(pages)
    lengths = sorted({len(path) for _, _, path in rules}, reverse=True)
    ranked = [(verdict, host.translate(str.maketrans(UPPER, LOWER)), path) for verdict, host, path in rules]

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": list({k for h, p in zip(frame["host"], frame["path"]) for k, _ in candidates(h, p, lengths)})}, dtype=object)

    universe = hosted.select("host", "path").mapInPandas(keys, "key string").distinct()
    cascades = {}
    for verdict in sorted({v for v, _, _ in ranked}):
        own = spark.createDataFrame([(h + p,) for v, h, p in ranked if v == verdict], "key string")
        cascades[verdict] = build_cascade(spark, own, universe)
    shared = spark.sparkContext.broadcast(cascades)

    def verdicts(hosts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for host, path in hosts:
            rows = []
            for h, p in zip(host, path):
                found = [(len(k), len(k) - n, v == "block", k, v) for k, n in candidates(h, p, lengths)
                         for v, cascade in shared.value.items() if listed(k, cascade)]
                rows.append(max(found)[3:] if found else (None, default))
            yield pd.DataFrame(rows, columns=["rule", "verdict"], dtype=object)

    fits = F.pandas_udf(verdicts, "rule string, verdict string")
    name, = free_names(hosted, "_fit")
    return (hosted.withColumn(name, fits("host", "path")).withColumn("rule", F.col(f"{name}.rule"))
            .withColumn("verdict", F.col(f"{name}.verdict")).drop(name))

"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered over a global order. A keyed Feistel network permutes the smallest power of four that holds all
numbers; a number that falls outside is sent through again (cycle walking) until it is inside, so the numbers are
permuted among themselves. The permuted number gives shard (remainder) and slot (quotient): shards differ by at most one
row, slots have no gaps, and both directions are computed from (number of rows, shards, seed) without any table. Another
seed is another shuffle, such as one for each epoch.

The law is `rows`: every row is placed by itself, equal texts included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField

from clickweir.llm.running import running_total

LAW = "rows"
SHARDS = 8
SEED = "shuffle"
ROUNDS = 8
_WORD = (1 << 31) - 1  # rounds work on 31 bits, so that every product fits 63 and SQL can follow


def round_keys(seed: str) -> list[tuple[int, int, int]]:
    """Multiplier, addend and second multiplier of each round, from a hash of the seed; multipliers are odd."""
    keys = []
    for r in range(ROUNDS):
        raw = hashlib.sha256(f"{seed}:{r}".encode()).digest()
        a, b, c = (int.from_bytes(raw[i:i + 4], "big") & _WORD for i in (0, 4, 8))
        keys.append((a | 1, b, c | 1))
    return keys


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 .. rows - 1 for up to 2 ** 62 rows."""
    rows: int
    seed: str = SEED

    @property
    def half(self) -> int:
        return max(1, (max(self.rows - 1, 0).bit_length() + 1) // 2)

    def _mixed(self, value: np.ndarray, key: tuple[int, int, int]) -> np.ndarray:
        a, b, c = key
        mixed = (value * a + b) & _WORD
        return (((mixed ^ (mixed >> 15)) * c) & _WORD) >> (31 - self.half)

    def _network(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        left, right = numbers >> self.half, numbers & ((1 << self.half) - 1)
        for key in reversed(round_keys(self.seed)) if back else round_keys(self.seed):
            if back:
                left, right = right ^ self._mixed(left, key), left
            else:
                left, right = right, left ^ self._mixed(right, key)
        return (left << self.half) | right

    def _walked(self, numbers, back: bool) -> np.ndarray:
        out = np.array(numbers, np.int64).reshape(-1)
        if len(out) and (out.min() < 0 or out.max() >= self.rows):
            raise ValueError(f"row numbers go from 0 to {self.rows - 1}")
        open_ = np.arange(len(out))
        while len(open_):
            out[open_] = self._network(out[open_], back)
            open_ = open_[out[open_] >= self.rows]
        return out

    def forward(self, numbers) -> np.ndarray:
        return self._walked(numbers, back=False)

    def inverse(self, places) -> np.ndarray:
        return self._walked(places, back=True)


def locate(number: int, rows: int, shards: int = SHARDS, seed: str = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    place = int(Permutation(rows, seed).forward([number])[0])
    return place % shards, place // shards


def number_at(shard: int, slot: int, rows: int, shards: int = SHARDS, seed: str = SEED) -> int:
    """The row number in a slot of a shard."""
    return int(Permutation(rows, seed).inverse([slot * shards + shard])[0])


def shard_rows(shard: int, rows: int, shards: int = SHARDS) -> int:
    """How many slots a shard has."""
    return (rows - shard + shards - 1) // shards


def _hashed(field: StructField) -> Column:
    """A column as Spark can hash it, which it cannot where maps are in it."""
    column = F.col(f"`{field.name}`")
    return F.to_json(F.struct(column)) if "map<" in field.dataType.simpleString() else column


def place(spark: SparkSession, docs: DataFrame, keep: Sequence[Column | str], shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(number, shard, slot, kept) for every row of `docs` (doc_id and any other columns); kept is a struct of `keep`.

    Rows are numbered from 0 by doc_id, nulls first, rows of one id by a hash of all their columns; only rows that are
    equal throughout may swap numbers between runs. The text is hashed before the shuffle and is shuffled only if it is
    kept. An empty table gives no rows. Names of other columns do not matter: they are read into the hash and the struct.
    """
    if not 0 < shards < 1 << 31:
        raise ValueError("at least one shard")
    tie = F.xxhash64(*[_hashed(field) for field in docs.schema.fields])
    # The running number tells equal rows apart, so that a row repeated many times is no single range.
    keyed = docs.select(F.struct(*keep).alias("kept"), F.col("doc_id").alias("key"), tie.alias("tie"), F.monotonically_increasing_id().alias("id"))
    numbered = running_total(spark, keyed, ["key", "tie", "id"], F.lit(1), "upto")
    permutation = Permutation(numbered.count(), seed)
    permuted = F.pandas_udf(lambda numbers: pd.Series(permutation.forward(numbers.to_numpy())), "long")
    placed = numbered.select("kept", (F.col("upto") - 1).cast("long").alias("number")).withColumn("place", permuted("number"))
    return placed.select("number", F.expr(f"CAST(place % {shards} AS INT)").alias("shard"), F.expr(f"place div {shards}").alias("slot"), "kept")


def assign(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, number, shard, slot) for every row of `docs` (doc_id, text).

    Size is the text's UTF-8 bytes plus 1. A null text counts as empty: size 1, checksum 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    return place(spark, docs, kept, shards, seed).select("kept.*", F.lit(LAW).alias("law"), "number", "shard", "slot")


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED, slots: int = 100_000) -> None:
    """All columns of `docs` as `path`/shard=S/part=P, where part P holds the slots P * slots and on, in order of slot."""
    placed = place(spark, docs, [F.col(f"`{c}`") for c in docs.columns], shards, seed).select(
        "shard", F.expr(f"slot div {int(slots)}").alias("part"), "slot", F.col("kept").alias("row"))
    (placed.repartition("shard", "part").sortWithinPartitions("shard", "part", "slot")
     .write.partitionBy("shard", "part").parquet(path))


def read_slots(spark: SparkSession, path: str, shard: int, first: int = 0, upto: int | None = None, slots: int = 100_000) -> DataFrame:
    """The rows (slot, row) of a shard's slots from `first` to before `upto`; `slots` is that of write_shards. Only the
    parts that hold them are listed and read."""
    rows = spark.read.parquet(path).where((F.col("shard") == shard) & (F.col("slot") >= first) & (F.col("part") >= first // slots))
    if upto is not None:
        rows = rows.where((F.col("slot") < upto) & (F.col("part") <= max(upto - 1, 0) // slots))
    return rows.select("slot", "row")

"""Tables made of parts, for jobs that write batch after batch.

A batch adds one part, named by its number, and nothing that is stored is changed. A part counts once Spark has written
its success mark, so readers see all of it or nothing, a batch that is repeated after a crash writes the part again, and
a part that counts is left alone. Compaction writes one part for a run of batches; it counts in place of the parts inside
its run, which stay for readers that have listed them already and are removed after a while.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StructField, StructType

from ..functions.times import at, instant
from .tables import DATE, _children, _hadoop

MINUTE = "minute_number"  # of rows with a time: minutes since 1970; Parquet skips by bounds on numbers, not on naive times
FAN = 10  # parts of one width that compaction makes one of

_NAME = re.compile(r"part=(\d{12})-(\d{12})$")
_TYPES = {DATE: DateType()}

Run = tuple[int, int]


def folder(path: str, run: Run) -> str:
    return f"{path}/part={run[0]:012d}-{run[1]:012d}"


def stored(spark: SparkSession, path: str) -> list[Run]:
    """All parts that were written to their end, also those that a wider one stands for."""
    fs, make = _hadoop(spark, path)
    runs = [(int(m[1]), int(m[2])) for m in map(_NAME.match, _children(spark, path)) if m]
    return sorted(run for run in runs if fs.exists(make(f"{folder(path, run)}/_SUCCESS")))


def live(spark: SparkSession, path: str) -> list[Run]:
    """The parts that make the table now."""
    return _live(stored(spark, path))


def _live(runs: Sequence[Run]) -> list[Run]:
    kept: list[Run] = []
    for run in sorted(runs, key=lambda r: r[0] - r[1]):  # the widest first
        if not any(lo <= run[0] and run[1] <= hi for lo, hi in kept):
            kept.append(run)
    return sorted(kept)


def publish(rows: DataFrame, path: str, run: Run, by: Sequence[str] = (), column: str | None = None, ranges: bool = False) -> None:
    """Add `rows` as the part of `run` unless it is there. Rows are gathered by folder and lie in order of `column` in
    their files; with `ranges`, for large rows, also the files of a folder follow each other in it, so that bounds on it
    skip files and not only row groups."""
    spark = rows.sparkSession
    fs, make = _hadoop(spark, path)
    if fs.exists(make(f"{folder(path, run)}/_SUCCESS")):
        return
    if column:
        rows = rows.withColumn(MINUTE, minute_number(F.col(column)))
    if ranges:
        rows = rows.repartitionByRange(*by, column)
    elif by:
        rows = rows.hint("rebalance", *[F.col(c) for c in by])
    if column:
        rows = rows.sortWithinPartitions(*by, column)
    rows.write.mode("overwrite").partitionBy(*by).parquet(folder(path, run))


def minute_number(ts: Column) -> Column:
    return F.timestamp_diff("MINUTE", at("1970-01-01"), ts)


def read(spark: SparkSession, path: str, schema: StructType, by: Sequence[str] = (), runs: Sequence[Run] | None = None,
         dates: Sequence[date | None] | None = None, start=None, end=None) -> DataFrame:
    """Rows of the table, or of some of its parts or dates, with the folder columns `by`; empty if there is none. `start`
    and `end` skip what lies in other dates, files and row groups; rows of up to a minute around them are still there."""
    folders = [StructField(c, _TYPES.get(c, IntegerType())) for c in by]
    whole = StructType([*schema.fields, *folders])
    runs = live(spark, path) if runs is None else runs
    if not runs:
        return spark.createDataFrame([], whole)
    numbered = StructType([*schema.fields, StructField(MINUTE, LongType()), *folders])
    rows = spark.read.schema(numbered).option("basePath", path).parquet(*[folder(path, run) for run in runs])
    if start is not None:
        rows = rows.filter((F.col(MINUTE) >= _minute_of(start) - 1) & (F.col(DATE) >= F.lit(instant(start).date())))
    if end is not None:
        rows = rows.filter((F.col(MINUTE) <= _minute_of(end) + 1) & (F.col(DATE) <= F.lit(instant(end).date())))
    rows = rows.select(*whole.names)
    return rows if dates is None else rows.filter(in_dates(dates))


def _minute_of(time) -> int:
    return int((instant(time) - datetime(1970, 1, 1)).total_seconds() // 60)


def in_dates(dates: Sequence[date | None]) -> Column:
    """A literal filter on the date folders."""
    known = sorted(d for d in dates if d is not None)
    chosen = F.col(DATE).isin(known) if known else F.lit(False)
    return chosen | F.col(DATE).isNull() if None in dates else chosen


def dates_of(spark: SparkSession, path: str) -> list[str]:
    """The dates that live parts have, from folder names alone."""
    return sorted({name.split("=", 1)[1] for run in live(spark, path) for name in _children(spark, folder(path, run)) if name.startswith(f"{DATE}=")})


def compact(spark: SparkSession, path: str, schema: StructType, combine: Callable[[DataFrame], DataFrame], by: Sequence[str] = (),
            column: str | None = None, fan: int = FAN, ranges: bool = False) -> list[Run]:
    """Make one part of every `fan` neighbouring parts of like width, and of such parts again, which are then not written
    by themselves; over many calls each row is rewritten about as often as the logarithm of the number of batches.
    Returns the new parts."""
    groups = [(run, [run]) for run in live(spark, path)]
    while True:
        level = [_level(hi - lo + 1, fan) for (lo, hi), _ in groups]
        start = next((i for i in range(len(groups) - fan + 1) if len(set(level[i:i + fan])) == 1), None)
        if start is None:
            break
        chosen = groups[start:start + fan]
        groups[start:start + fan] = [((chosen[0][0][0], chosen[-1][0][1]), [run for _, runs in chosen for run in runs])]
    made = [(run, runs) for run, runs in groups if len(runs) > 1]
    for run, runs in made:
        publish(combine(read(spark, path, schema, by, runs)), path, run, by, column, ranges)
    return [run for run, _ in made]


def _level(width: int, fan: int) -> int:
    level = 0
    while width >= fan:
        width, level = width // fan, level + 1
    return level


def sweep(spark: SparkSession, path: str, grace_seconds: float = 3600) -> list[Run]:
    """Remove the parts that a wider one has stood for at least as long as a reader may take."""
    fs, make = _hadoop(spark, path)
    runs, gone = stored(spark, path), []
    kept = _live(runs)
    for run in runs:
        if run in kept:
            continue
        wider = next(k for k in kept if k[0] <= run[0] and run[1] <= k[1])
        written = fs.getFileStatus(make(f"{folder(path, wider)}/_SUCCESS")).getModificationTime() / 1000
        if time.time() - written >= grace_seconds:
            fs.delete(make(folder(path, run)), True)
            gone.append(run)
    return gone


def drop_before(spark: SparkSession, path: str, cutoff: date) -> list[str]:
    """Remove the date folders before `cutoff` from all parts. Returns the dates removed."""
    fs, make = _hadoop(spark, path)
    gone = set()
    for run in stored(spark, path):
        for name in _children(spark, folder(path, run)):
            text = name.split("=", 1)[1] if name.startswith(f"{DATE}=") else ""
            if text[:1].isdigit() and date.fromisoformat(text) < cutoff:
                fs.delete(make(f"{folder(path, run)}/{name}"), True)
                gone.add(text)
    return sorted(gone)

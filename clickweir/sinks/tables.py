"""Date-partitioned Parquet tables: overwrite by partition, upsert, insert-if-absent, bucket replacement, retention.

The frame-level functions (`upserted`, `with_absent`, `with_bucket_replaced`, `retained`) say what the table holds
afterwards. The `*_table` functions apply them to a stored table: the new rows are computed once and stored, the dates
they touch become literals, only those partitions are read, and what they shall hold is written beside the table and
then put in their place, date by date. A job that ends in between is finished by the next call, so a table never loses
rows to a crash. One writer per table at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.times import at, between, instant
from ..session import scratch

DATE = "event_date"
_NO_DATE = "__HIVE_DEFAULT_PARTITION__"
_STAGE = "_stage"

# How many days each table is kept.
RETENTION_DAYS = {"events_raw": 30, "metrics_1min": 7, "metrics_1hour": 365}


def with_date(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(DATE, F.to_date(column))


def with_week(df: DataFrame, column: str, name: str = "event_week") -> DataFrame:
    """Week start, the partition column of tables kept in seven-day pieces."""
    return df.withColumn(name, F.date_sub(F.next_day(F.to_date(column), "Mon"), 7))


def write_table(df: DataFrame, path: str, column: str, gather: bool = True) -> None:
    """Write a table partitioned by the date of `column`, replacing it.

    Rows are gathered by date first, so that a date gets files of a good size instead of one per task.
    Spark splits a large date over many tasks and joins small ones. Rows that already lie in time order
    need no gathering; ``gather=False`` saves the shuffle.
    """
    dated = with_date(df, column)
    (_gathered(dated) if gather else dated).write.mode("overwrite").partitionBy(DATE).parquet(path)


def _gathered(dated: DataFrame) -> DataFrame:
    return dated.hint("rebalance", F.col(DATE))


def _same(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    """Keys compared with nulls as values, so that a row without a time is found again too."""
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in key])


def absent(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return new.join(old, _same(new, old, key), "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """`old` with the rows of `new` added; a new row wins over an old one with its key."""
    return absent(new, old, key).unionByName(new)


def with_absent(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """`old` with only those rows of `new` whose key it lacks."""
    return old.unionByName(absent(old, new, key))


def one_per_key(new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of rows with one key the largest by the other columns, so that the choice is stable."""
    rest = [c for c in new.columns if c not in key]
    if not rest:
        return new.distinct()
    return new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("row")).select(*key, "row.*").select(*new.columns)


def with_bucket_replaced(old: DataFrame, new: DataFrame, bucket, column: str = "time_bucket") -> DataFrame:
    """All rows of one bucket replaced by `new`, which may be empty."""
    return old.filter(~F.col(column).eqNullSafe(at(bucket))).unionByName(new)


def retained(df: DataFrame, column: str, as_of, **span: float) -> DataFrame:
    """Rows not older than the span, future rows included; the dates of a dated table are bounded as well."""
    return between(df, column, instant(as_of) - timedelta(**span), None)


# Folders

def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    make = lambda text: jvm.org.apache.hadoop.fs.Path(text)
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, make = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(make(path))] if fs.exists(make(path)) else []


def stored_dates(spark: SparkSession, path: str) -> list[str]:
    """The partitions a table has, as text."""
    return sorted(name.split("=", 1)[1] for name in _children(spark, path) if name.startswith(f"{DATE}="))


def read_table(spark: SparkSession, path: str, schema: StructType, dates: Sequence[date | None] | None = None) -> DataFrame:
    """The rows of a table, of some dates only if given; empty when the table does not exist or holds nothing."""
    if not stored_dates(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path).select(*schema.names)
    if dates is None:
        return rows
    known = [d for d in dates if d is not None]
    chosen = F.col(DATE).isin(known) if known else F.lit(False)
    return rows.filter(chosen | F.col(DATE).isNull() if None in dates else chosen)


# Swapping partitions

def _put(spark: SparkSession, path: str, after: DataFrame, dates: Sequence[date | None], by: Sequence[str] = (DATE,)) -> None:
    """Make `after` the content of the partitions `dates`; dates it has no rows for are removed."""
    stage = f"{path}/{_STAGE}/{uuid.uuid4().hex}"
    _gathered(after).write.partitionBy(*by).parquet(stage)
    fs, make = _hadoop(spark, path)
    for day in dates:
        fs.mkdirs(make(f"{stage}/{DATE}={day.isoformat() if day else _NO_DATE}"))
    fs.create(make(f"{stage}/_ready")).close()
    recover(spark, path)


def recover(spark: SparkSession, path: str) -> None:
    """Finish what an ended job had made ready; what it had not finished writing is thrown away.

    Each date is moved in one rename; a date that is already moved is no longer in the stage.
    """
    fs, make = _hadoop(spark, path)
    for name in sorted(_children(spark, f"{path}/{_STAGE}")):
        stage = f"{path}/{_STAGE}/{name}"
        if fs.exists(make(f"{stage}/_ready")):
            for part in _children(spark, stage):
                if not part.startswith(f"{DATE}="):
                    continue
                source, target = make(f"{stage}/{part}"), make(f"{path}/{part}")
                fs.delete(target, True)
                if fs.listStatus(source):
                    if not fs.rename(source, target):
                        raise OSError(f"cannot move {stage}/{part}")
                else:
                    fs.delete(source, True)
        fs.delete(make(stage), True)


def _once(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows of `df`, computed now and read from storage from then on."""
    path = scratch(spark, "new_rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _dates(dated: DataFrame) -> list[date | None]:
    """The dates of stored rows; one row per date comes to the driver."""
    return [r[DATE] for r in dated.select(DATE).distinct().collect()]


def _change(spark: SparkSession, path: str, new: DataFrame, key: Sequence[str], column: str,
            combine: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]) -> None:
    if column not in key:
        raise ValueError(f"the key {list(key)} must hold {column}: rows are looked for in the dates of the new ones only")
    recover(spark, path)
    dated = _once(spark, with_date(one_per_key(new, key), column))
    dates = _dates(dated)
    if dates:
        _put(spark, path, combine(read_table(spark, path, dated.schema, dates), dated, key), dates)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: Sequence[str], column: str = "time_bucket") -> None:
    """Add the rows of `new`, which win over stored ones with their key. The table need not exist."""
    _change(spark, path, new, key, column, upserted)


def insert_absent_table(spark: SparkSession, path: str, new: DataFrame, key: Sequence[str],
                        column: str = "time_bucket") -> None:
    """Add the rows of `new` whose key the table lacks. Rewrites the touched dates instead of appending, so that a
    repeated run cannot add a row twice."""
    _change(spark, path, new, key, column, with_absent)


def replace_bucket_table(spark: SparkSession, path: str, new: DataFrame, bucket, column: str = "time_bucket") -> None:
    """Replace one bucket on disk. An empty `new` clears the bucket."""
    recover(spark, path)
    day = instant(bucket).date()
    dated = with_date(new, column)
    _put(spark, path, with_bucket_replaced(read_table(spark, path, dated.schema, [day]), dated, bucket, column), [day])


def replace_buckets_table(spark: SparkSession, path: str, new: DataFrame, buckets: DataFrame, column: str = "time_bucket") -> None:
    """Replace all rows of the `buckets` (one column, `column`) by `new`, which must have rows of these buckets only."""
    recover(spark, path)
    dated, gone = _once(spark, with_date(new, column)), _once(spark, with_date(buckets.select(column).distinct(), column))
    dates = _dates(gone)
    if dates:
        old = read_table(spark, path, dated.schema, dates)
        _put(spark, path, absent(gone, old, [column]).unionByName(dated), dates)


def overwrite_dates(dated: DataFrame, path: str, by: Sequence[str] = (DATE,)) -> None:
    """Replace the partitions that occur in `dated` and leave the others."""
    (_gathered(dated).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


def drop_expired(spark: SparkSession, path: str, as_of, **span: float) -> list[str]:
    """Delete whole date partitions older than the span; the boundary date stays. Returns the dates dropped."""
    cutoff = (instant(as_of) - timedelta(**span)).date()
    fs, make = _hadoop(spark, path)
    expired = [text for text in stored_dates(spark, path) if text != _NO_DATE and date.fromisoformat(text) < cutoff]
    for text in expired:
        fs.delete(make(f"{path}/{DATE}={text}"), True)
    return expired

"""Reference times, ranges and buckets. Nothing here reads the wall clock."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F


def instant(value: str | datetime) -> datetime:
    """A naive UTC time."""
    return datetime.fromisoformat(value) if isinstance(value, str) else value


def at(value: str | datetime) -> Column:
    return F.lit(instant(value).isoformat(sep=" ")).cast("timestamp_ntz")


def minutes(count: int) -> Column:
    return F.make_dt_interval(mins=F.lit(count))


def micros(ts: Column) -> Column:
    """Naive time as a number, for arithmetic on many rows; whole numbers compare and add faster than intervals.
    Goes through the session's zone, which must be UTC."""
    return F.timestamp_diff("MICROSECOND", at("1970-01-01"), ts)


def from_micros(number: Column) -> Column:
    return F.timestamp_add("MICROSECOND", number, at("1970-01-01"))


def between(df: DataFrame, column: str, start, end) -> DataFrame:
    """Rows in ``[start, end)``; either bound may be None.

    A table partitioned by ``event_date`` also gets a filter on it, so that files of other days are
    never listed for the scan.
    """
    dated = "event_date" in df.columns and column != "event_date"
    if start is not None:
        df = df.filter(F.col(column) >= at(start))
        if dated:
            df = df.filter(F.col("event_date") >= F.lit(instant(start).date()))
    if end is not None:
        df = df.filter(F.col(column) < at(end))
        if dated:
            df = df.filter(F.col("event_date") <= F.lit(_last_date(instant(end))))
    return df


def _last_date(end: datetime) -> date:
    return (end - timedelta(microseconds=1)).date()


def lookback(df: DataFrame, column: str, as_of, **span: float) -> DataFrame:
    """Rows of the last ``span`` (keywords of ``timedelta``) before `as_of`."""
    end = instant(as_of)
    return between(df, column, end - timedelta(**span), end)


_UNITS = ["day", "hour", "minute", "second"]


def truncate(column: Column, unit: str) -> Column:
    """Start of the naive time's day, hour, minute or second, made of its own fields: ``date_trunc`` would go through the
    session's zone, which lacks an hour each spring."""
    kept = _UNITS.index(unit)
    clock = [field(column) if kept > i else F.lit(0) for i, field in enumerate((F.hour, F.minute, F.second))]
    return F.make_timestamp_ntz(F.year(column), F.month(column), F.day(column), *clock)


def bucket_start(column: Column, length: str) -> Column:
    return F.window(column, length).getField("start")


def naive_utc(df: DataFrame) -> DataFrame:
    """Zoned timestamps to naive UTC (the session zone must be UTC)."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name)
        for f in df.schema.fields
    ])

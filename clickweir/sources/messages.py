"""Raw messages to typed, flat, clean events. Every step works on tables and on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import EVENT_TYPES, MESSAGE, MONEY, REQUIRED

_BROKEN = "_broken"

# The full date and time; anything shorter would be filled up from the day the job runs.
_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?( ?(Z|z|[+-]\d{2}(:?\d{2})?))?$"


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 text of a full date and time to the second or finer, with or without a zone, to a time; null when it is
    not one."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(_TIME), F.try_to_timestamp(trimmed))


def decode(messages: DataFrame, value: str = "value", types: str = "any", received: str | None = None,
           ahead_minutes: float | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """JSON messages to typed nested events with the text they came in and a `reject_reason`, null for good ones.

    Reasons: ``malformed json``, ``wrong type`` (JSON, but a field does not have its type), ``missing <field>`` for
    required fields that are absent, null or blank, ``bad timestamp``; with ``types="known"`` also ``unknown event
    type`` (by default any type is kept, as the original does; metrics pass over unknown ones); and ``ahead of time``
    for events more than `ahead_minutes` after the message's time in the column `received`, which would move the
    watermark of a stream past everything else. Columns of the messages named in `keep` stay beside the fields.
    """
    if types not in ("any", "known"):
        raise ValueError(f"unknown types: {types}")
    schema = StructType([*MESSAGE.fields, StructField(_BROKEN, StringType())])
    text = F.col(value).cast("string")
    body = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    names = ["message_text", *keep, *(["_received"] if received else [])]
    if received:
        messages = messages.withColumn("_received", F.col(received))
    events = messages.withColumns({"data": body, "message_text": text}).select("data.*", *names)
    time = parse_timestamp(F.col("timestamp"))
    is_object = F.ltrim(F.col(_BROKEN)).startswith("{") & F.get_json_object(F.col(_BROKEN), "$").isNotNull()
    reason = F.when(F.col(_BROKEN).isNotNull(), F.when(is_object, F.lit("wrong type")).otherwise(F.lit("malformed json")))
    for name in REQUIRED:
        reason = reason.when(F.col(name).isNull() | (F.trim(F.col(name)) == ""), F.lit(f"missing {name}"))
    reason = reason.when(time.isNull(), F.lit("bad timestamp"))
    if types == "known":
        reason = reason.when(~F.col("event_type").isin(EVENT_TYPES), F.lit("unknown event type"))
    if received and ahead_minutes is not None:
        latest = F.col("_received").cast("timestamp") + F.make_dt_interval(mins=F.lit(ahead_minutes))
        reason = reason.when(time > latest, F.lit("ahead of time"))
    return (
        events
        .withColumn("reject_reason", reason)
        .withColumn("timestamp", time)
        .withColumnRenamed(_BROKEN, "broken_text")
        .drop("_received")
    )


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reject_reason").isNull()).drop("reject_reason", "broken_text")


def rejected(decoded: DataFrame) -> DataFrame:
    """The dead letters: reason, the broken text if any, and what could be read."""
    return decoded.filter(F.col("reject_reason").isNotNull())


def row_to_json(df: DataFrame) -> Column:
    """The whole row as JSON text; null fields are left out."""
    return F.to_json(F.struct(*[F.col(name) for name in df.columns]))


def flatten(events: DataFrame) -> DataFrame:
    """Nested events to the 16 columns of the raw event table; `raw_data` is the message as it came."""
    return events.select(
        "event_id", "event_type", "timestamp", "user_id", "session_id",
        F.col("product.id").alias("product_id"),
        F.col("product.name").alias("product_name"),
        F.col("product.category").alias("product_category"),
        F.col("product.price").alias("product_price"),
        "quantity", "total_amount", "payment_method",
        F.col("location.city").alias("city"),
        F.col("location.country").alias("country"),
        F.col("location.ip").alias("ip_address"),
        F.col("message_text").alias("raw_data"),
    )


def with_defaults(events: DataFrame, defaults: str = "none") -> DataFrame:
    """Fill missing values: ``none``, ``quantity`` (quantity 1) or ``zero`` (also price and total 0).

    A default price is given only to events that lack a price, product or not, and a default total to
    every event without one.
    """
    if defaults not in ("none", "quantity", "zero"):
        raise ValueError(f"unknown defaults: {defaults}")
    if defaults == "none":
        return events
    fill = {"quantity": F.lit(1)}
    if defaults == "zero":
        fill["total_amount"] = F.lit(0).cast(MONEY)
        fill["product_price"] = F.lit(0.0)
    return events.withColumns({name: F.coalesce(F.col(name), value) for name, value in fill.items()})


def deduplicate(events: DataFrame, key: str = "event_id", order: str = "timestamp") -> DataFrame:
    """One row per key: the earliest, and among equals the smallest row, so that the choice is stable.

    Copies meet in the map-side aggregate first, so a key with very many copies sends at most one row
    per task through the shuffle.
    """
    rest = [name for name in events.columns if name not in (key, order)]
    best = F.min(F.struct(order, *rest)).alias("row")
    return events.groupBy(key).agg(best).select(key, "row.*").select(*events.columns)


def deduplicate_stream(events: DataFrame, key: str = "event_id") -> DataFrame:
    """The first copy of each event of a watermarked stream. Keys are forgotten when the watermark passes them,
    and later copies are dropped as late."""
    return events.dropDuplicatesWithinWatermark([key])

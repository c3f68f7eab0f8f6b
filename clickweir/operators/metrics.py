"""Sales, traffic and funnel metrics per minute and per hour.

One definition serves tables and streams. Streams allow no distinct aggregate, and collecting a window's
users would put an unbounded set into one task. So each event is spread over the things to be counted
(its session, its user, for hours also its minute), and two ordinary aggregates follow: one per window and
counted thing, one per window. The first has many keys however busy a window is, and both reduce rows
before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import amount_sum, cents, dollars
from ..functions.ratios import percent, safe_ratio, shortfall_percent
from ..schemas import ADD, HOUR_COLUMNS, METRIC_COLUMNS, PURCHASE, REMOVE, SEARCH, VIEW

_MINUTE, _SESSION, _USER = 0, 1, 2

# Output name -> event type counted.
_COUNTS = {
    "total_views": VIEW,
    "add_to_cart_count": ADD,
    "remove_from_cart_count": REMOVE,
    "purchase_count": PURCHASE,
    "search_count": SEARCH,
}


def is_type(event_type: str) -> Column:
    return F.col("event_type") == event_type


def revenue() -> Column:
    return amount_sum("total_amount", is_type(PURCHASE))


def count_type(event_type: str) -> Column:
    return F.count(F.when(is_type(event_type), 1))


def minute_metrics(events: DataFrame, users: str = "viewers", empty: str = "null",
                   distinct: str = "exact") -> DataFrame:
    """Twelve measures per minute.

    `users` counts ``viewers`` or ``all`` users, `empty` gives the average order value of a minute without
    orders (``null`` or ``zero``), and ``distinct="approx"`` trades exact distinct counts for a sketch of
    fixed size, with one row per minute in the shuffle and in stream state.
    """
    if distinct == "approx":
        viewer = F.when(_counted(users), F.col("user_id"))
        window = events.groupBy(F.window("timestamp", "1 minute").alias("w")).agg(
            revenue().alias("total_revenue"),
            *[count_type(t).alias(name) for name, t in _COUNTS.items()],
            F.approx_count_distinct(viewer).alias("unique_users"),
            F.approx_count_distinct("session_id").alias("unique_sessions"),
        )
    else:
        window = _tally(events, "1 minute", users, minutes=False)
    return _finish(window, empty).select(*METRIC_COLUMNS)


def hour_metrics(events: DataFrame, users: str = "viewers", empty: str = "null") -> DataFrame:
    """The measures per hour, with the best minute's revenue and orders. Distinct counts are exact."""
    window = _tally(events, "1 hour", users, minutes=True)
    return _finish(window, empty).select(*HOUR_COLUMNS)


SKETCHES = ["users_sketch", "sessions_sketch"]


def minute_sketches(events: DataFrame, users: str = "viewers") -> DataFrame:
    """Mergeable sketches of each minute's users and sessions, to be stored beside its metrics."""
    return events.groupBy(F.window("timestamp", "1 minute").alias("w")).agg(
        F.hll_sketch_agg(F.when(_counted(users), F.col("user_id"))).alias(SKETCHES[0]),
        F.hll_sketch_agg("session_id").alias(SKETCHES[1]),
    ).select(F.col("w.start").alias("time_bucket"), *SKETCHES)


def hour_rollup(minutes: DataFrame, empty: str = "null") -> DataFrame:
    """Hour metrics from stored minute metrics with their sketches, without a look at the events. Distinct counts are
    estimates; `hour_metrics` counts them exactly from the events."""
    counts = ["total_views", "add_to_cart_count", "purchase_count"]
    hours = minutes.groupBy(F.window("time_bucket", "1 hour").alias("w")).agg(
        amount_sum("total_revenue").alias("total_revenue"), *[F.sum(name).alias(name) for name in counts],
        F.hll_sketch_estimate(F.hll_union_agg(SKETCHES[0])).alias("unique_users"),
        F.hll_sketch_estimate(F.hll_union_agg(SKETCHES[1])).alias("unique_sessions"),
        F.max("total_revenue").alias("peak_revenue_per_minute"), F.max("total_orders").alias("peak_orders_per_minute"),
    )
    return _finish(hours, empty).select(*HOUR_COLUMNS)


def _counted(users: str) -> Column:
    if users not in ("viewers", "all"):
        raise ValueError(f"unknown users: {users}")
    return is_type(VIEW) if users == "viewers" else F.lit(True)


def _thing(kind: int, id: Column, minute: Column) -> Column:
    return F.struct(F.lit(kind).cast("tinyint").alias("kind"), id.cast("string").alias("id"), minute.alias("minute"))


def _tally(events: DataFrame, length: str, users: str, minutes: bool) -> DataFrame:
    no_minute = F.lit(None).cast("long")
    things = [_thing(_SESSION, F.col("session_id"), no_minute)]
    if minutes:
        # Minute within the window as a number, so that equal minutes meet whatever the timestamp type.
        things.append(_thing(_MINUTE, F.lit(None), F.minute("timestamp").cast("long")))
    user = _thing(_USER, F.col("user_id"), no_minute)
    with_user = F.array(*things, user)
    spread = events.select(
        F.window("timestamp", length).alias("w"), "event_type", "total_amount",
        F.explode(F.when(_counted(users), with_user).otherwise(F.array(*things))).alias("thing"),
    )
    # Measures are taken once per event: on the minute's row if there is one, else on the session's.
    carrier = F.col("thing.kind") == F.lit(_MINUTE if minutes else _SESSION)

    def once(event_type: str) -> Column:
        return carrier & is_type(event_type)

    things_seen = spread.groupBy("w", "thing.kind", "thing.id", "thing.minute").agg(
        F.sum(F.when(once(PURCHASE), cents(F.col("total_amount")))).alias("revenue_cents"),
        *[F.count(F.when(once(t), 1)).alias(name) for name, t in _COUNTS.items()],
    )

    return _totals(things_seen, minutes)


def _totals(things_seen: DataFrame, minutes: bool) -> DataFrame:
    def known(kind: int) -> Column:
        return F.count(F.when((F.col("kind") == kind) & F.col("id").isNotNull(), 1))

    peaks = [
        dollars(F.max("revenue_cents")).alias("peak_revenue_per_minute"),
        F.max("purchase_count").alias("peak_orders_per_minute"),
    ]
    return things_seen.groupBy("w").agg(
        dollars(F.sum("revenue_cents")).alias("total_revenue"),
        *[F.sum(name).alias(name) for name in _COUNTS],
        known(_USER).alias("unique_users"),
        known(_SESSION).alias("unique_sessions"),
        *(peaks if minutes else []),
    )


# Partials: what a batch of events adds to its minutes. Partials of one key are added up, so neither events nor earlier
# partials are read to take a batch in, late events included.

ACTIVITY_KEY = ["time_bucket", "kind", "id"]
ACTIVITY_SUMS = ["revenue_cents", *_COUNTS]


def activity(events: DataFrame, users: str = "viewers") -> DataFrame:
    """One row per minute and session, with the measures of its events, and per minute and counted user."""
    things = [_thing(_SESSION, F.col("session_id"), F.lit(None).cast("long"))]
    with_user = F.array(*things, _thing(_USER, F.col("user_id"), F.lit(None).cast("long")))
    spread = events.select(
        F.window("timestamp", "1 minute").getField("start").alias("time_bucket"), "event_type", "total_amount",
        F.explode(F.when(_counted(users), with_user).otherwise(F.array(*things))).alias("thing"))
    carrier = F.col("thing.kind") == F.lit(_SESSION)
    return spread.groupBy("time_bucket", "thing.kind", "thing.id").agg(
        F.coalesce(F.sum(F.when(carrier & is_type(PURCHASE), cents(F.col("total_amount")))), F.lit(0)).alias("revenue_cents"),
        *[F.count(F.when(carrier & is_type(t), 1)).alias(name) for name, t in _COUNTS.items()])


def added(partials: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
    """Partials of one key as one row."""
    return partials.groupBy(*key).agg(*[F.sum(name).alias(name) for name in sums])


def minutes_of_activity(partials: DataFrame, empty: str = "null") -> DataFrame:
    """minute_metrics() of the events behind the partials."""
    things = added(partials, ACTIVITY_KEY, ACTIVITY_SUMS).withColumn("w", F.window("time_bucket", "1 minute"))
    return _finish(_totals(things, minutes=False), empty).select(*METRIC_COLUMNS)


def hours_of_activity(partials: DataFrame, empty: str = "null") -> DataFrame:
    """hour_metrics() of the events behind the partials: a session's or user's minutes are one thing of the hour, and the
    measures, which peaks are taken of, go to the minute."""
    thing = F.struct("kind", "id", F.lit(None).cast("long").alias("minute"))
    minute = F.struct(F.lit(_MINUTE).cast("tinyint").alias("kind"), F.lit(None).cast("string").alias("id"), F.minute("time_bucket").cast("long").alias("minute"))
    both = F.when(F.col("kind") == _SESSION, F.array(thing, minute)).otherwise(F.array(thing))
    spread = partials.select(F.window("time_bucket", "1 hour").alias("w"), *ACTIVITY_SUMS, F.explode(both).alias("thing"))
    carrier = F.col("thing.kind") == F.lit(_MINUTE)
    things = spread.groupBy("w", "thing.kind", "thing.id", "thing.minute").agg(*[F.sum(F.when(carrier, F.col(name)).otherwise(0)).alias(name) for name in ACTIVITY_SUMS])
    return _finish(_totals(things, minutes=True), empty).select(*HOUR_COLUMNS)


def united_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of one minute from several batches as one."""
    return sketches.groupBy("time_bucket").agg(*[F.hll_union_agg(name).alias(name) for name in SKETCHES])


def _finish(window: DataFrame, empty: str) -> DataFrame:
    orders, views, adds = F.col("purchase_count"), F.col("total_views"), F.col("add_to_cart_count")
    return window.withColumns({
        "time_bucket": F.col("w.start"),
        "total_orders": orders,
        "average_order_value": safe_ratio(F.col("total_revenue"), orders, {"null": None, "zero": 0.0}[empty]),
        "conversion_rate": percent(orders, views),
        "cart_abandonment_rate": shortfall_percent(orders, adds),
    })


def stamped(df: DataFrame, name: str = "created_at", as_of: Column | None = None) -> DataFrame:
    """Add the processing time: the clock in streams, a given time in repeatable batch jobs."""
    return df.withColumn(name, F.current_timestamp() if as_of is None else as_of)

"""Sales by country and city."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.display import place_label
from ..functions.money import cents, dollars
from ..functions.times import lookback
from ..schemas import GEO_COLUMNS, PURCHASE, VIEW
from .metrics import is_type


def _by_user(events: DataFrame, keys: list[Column]) -> DataFrame:
    """Measures per place and user: the step before distinct users can be counted, on streams too."""
    return events.groupBy(*keys, "country", "city", "user_id").agg(
        F.count(F.when(is_type(VIEW), 1)).alias("views"),
        F.count(F.when(is_type(PURCHASE), 1)).alias("orders"),
        F.sum(F.when(is_type(PURCHASE), cents(F.col("total_amount")))).alias("cents"),
    )


def _by_place(users: DataFrame, keys: list[str]) -> DataFrame:
    return users.groupBy(*keys, "country", "city").agg(
        F.sum("views").alias("views"),
        F.sum("orders").alias("orders"),
        dollars(F.sum("cents")).alias("revenue"),
        F.count("user_id").alias("users"),
    )


def geo_metrics(events: DataFrame) -> DataFrame:
    """Views, orders, revenue and users per minute and place, for events with a country."""
    located = events.filter(F.col("country").isNotNull())
    users = _by_user(located, [F.window("timestamp", "1 minute").alias("w")])
    return _columns(_by_place(users, ["w"]).withColumn("time_bucket", F.col("w.start")))


def _columns(places: DataFrame) -> DataFrame:
    return places.select(
        "time_bucket", "country", "city",
        F.col("views").alias("total_views"), F.col("orders").alias("total_orders"),
        F.col("revenue").alias("total_revenue"), F.col("users").alias("unique_users"),
    ).select(*GEO_COLUMNS)


# Partials, as in metrics: what a batch of events adds to the minutes of a place's users.
PARTIAL_KEY = ["time_bucket", "country", "city", "user_id"]
PARTIAL_SUMS = ["views", "orders", "cents"]


def geo_partials(events: DataFrame) -> DataFrame:
    located = events.filter(F.col("country").isNotNull())
    users = _by_user(located, [F.window("timestamp", "1 minute").getField("start").alias("time_bucket")])
    return users.withColumn("cents", F.coalesce("cents", F.lit(0)))


def places_of_partials(partials: DataFrame) -> DataFrame:
    """geo_metrics() of the events behind the partials."""
    users = partials.groupBy(*PARTIAL_KEY).agg(*[F.sum(name).alias(name) for name in PARTIAL_SUMS])
    return _columns(_by_place(users, ["time_bucket"]))


def top_locations(events: DataFrame, as_of, hours: float = 1, limit: int = 10) -> DataFrame:
    """The places with the most revenue in the lookback."""
    recent = lookback(events, "timestamp", as_of, hours=hours)
    located = recent.filter(F.col("country").isNotNull() & F.col("city").isNotNull())
    places = _by_place(_by_user(located, []), [])
    return (
        places
        .orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last("country"), F.asc_nulls_last("city"))
        .limit(limit)
        .select("country", "city", place_label(F.col("city"), F.col("country")).alias("location"),
                "revenue", "orders", "views", "users")
    )

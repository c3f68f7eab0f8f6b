"""Ad-hoc reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.money import cents
from ..schemas import PURCHASE
from .metrics import count_type, is_type


def stats_report(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Five labelled totals as text; the four on events come from one scan."""
    amounts = F.sum(F.when(is_type(PURCHASE), cents(F.col("total_amount"))))
    totals = events.agg(
        F.count(F.lit(1)).alias("events"), amounts.alias("revenue"),
        count_type(PURCHASE).alias("purchases"), F.countDistinct("user_id").alias("users"),
    )

    def line(label: str, value):
        return F.struct(F.lit(label).alias("metric"), value.alias("value"))

    event_lines = totals.select(F.inline(F.array(
        line("Total Events", F.col("events").cast("string")),
        line("Total Revenue", F.concat(F.lit("$"), F.rint(F.col("revenue") / 100).cast("bigint").cast("string"))),
        line("Total Purchases", F.col("purchases").cast("string")),
        line("Unique Users", F.col("users").cast("string")),
    )))
    alert_line = alerts.filter("is_active").agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.lit("Active Alerts").alias("metric"), "value")
    return event_lines.unionByName(alert_line)


def newest(events: DataFrame, limit: int = 10) -> DataFrame:
    """The last events with all columns; each task keeps its best rows only."""
    return events.orderBy(F.desc_nulls_last("timestamp"), F.desc_nulls_last("event_id")).limit(limit)


def recent_events(events: DataFrame, limit: int = 10) -> DataFrame:
    return newest(events, limit).select("event_type", "timestamp", "user_id", "product_name", "total_amount")


def recent_purchases(events: DataFrame, limit: int = 10) -> DataFrame:
    return recent_events(events.filter(is_type(PURCHASE)), limit).drop("event_type")


def latest_metrics(metrics: DataFrame, limit: int = 10) -> DataFrame:
    return (
        metrics.select("time_bucket", "total_revenue", "total_orders", "unique_users",
                       "conversion_rate", "cart_abandonment_rate")
        .orderBy(F.desc_nulls_last("time_bucket")).limit(limit)
    )

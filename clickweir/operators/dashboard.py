"""Dashboard reads over minute metrics and events."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import amount_sum
from ..functions.ratios import percent, percent_change, round_exact
from ..functions.times import at, between, instant, lookback, minutes as span_of


def total(column: str, where: Column | None = None) -> Column:
    value = F.col(column)
    return F.coalesce(F.sum(value if where is None else F.when(where, value)), F.lit(0)).cast("bigint")


def live_metrics(metrics: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """One row: sums of sales, and unweighted means of the minutes' users and rates; zeros when empty."""
    def mean(column: str) -> Column:
        return F.coalesce(F.avg(column), F.lit(0.0))

    return lookback(metrics, "time_bucket", as_of, minutes=minutes).agg(
        amount_sum("total_revenue").alias("revenue"),
        total("total_orders").alias("orders"),
        mean("unique_users").cast("bigint").alias("active_users"),
        mean("conversion_rate").alias("conversion_rate"),
        mean("cart_abandonment_rate").alias("cart_abandonment_rate"),
    )


def active_users(events: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """One row: different users with any event in the lookback."""
    return lookback(events, "timestamp", as_of, minutes=minutes).agg(
        F.countDistinct("user_id").alias("active_users"))


def active_users_history(events: DataFrame, minutes: int = 5) -> DataFrame:
    """active_users() at the end of every minute that has some: (as_of, active_users), over the `minutes` before as_of.

    A user's minutes are put in order, and each of them counts for the ends that no earlier one has counted for, so users
    are never collected or made distinct per window; a user has no more rows than there are minutes.
    """
    seen = (events.filter(F.col("user_id").isNotNull())
            .groupBy("user_id", F.window("timestamp", "1 minute").getField("start").alias("minute")).agg(F.count(F.lit(1)).alias("n")))
    before = F.lag("minute").over(Window.partitionBy("user_id").orderBy("minute"))
    first = F.greatest(F.col("minute") + span_of(1), F.coalesce(before + span_of(minutes + 1), F.col("minute") + span_of(1)))
    ends = seen.select(first.alias("first"), (F.col("minute") + span_of(minutes)).alias("last"))
    every = F.when(F.col("first") <= F.col("last"), F.sequence("first", "last", span_of(1)))
    return ends.select(F.explode(every).alias("as_of")).groupBy("as_of").agg(F.count(F.lit(1)).alias("active_users"))


def revenue_trend(metrics: DataFrame, as_of, hours: float = 1) -> DataFrame:
    """The minutes of the lookback in time order."""
    return (
        lookback(metrics, "time_bucket", as_of, hours=hours)
        .select(
            F.col("time_bucket").alias("timestamp"),
            F.col("total_revenue").alias("revenue"),
            F.col("total_orders").alias("orders"),
            F.coalesce("average_order_value", F.lit(0.0)).alias("average_order_value"),
        )
        .orderBy("timestamp")
    )


def conversion_funnel(metrics: DataFrame, as_of, hours: float = 1) -> DataFrame:
    """One row: views, cart adds, purchases, and the latter two in percent of views."""
    views, adds, purchases = F.col("views"), F.col("add_to_cart"), F.col("purchases")
    return (
        lookback(metrics, "time_bucket", as_of, hours=hours)
        .agg(
            total("total_views").alias("views"),
            total("add_to_cart_count").alias("add_to_cart"),
            total("purchase_count").alias("purchases"),
        )
        .select(
            "views", "add_to_cart", "purchases",
            round_exact(percent(adds, views), 2).alias("cart_rate"),
            round_exact(percent(purchases, views), 2).alias("conversion_rate"),
        )
    )


def funnel_tier(conversion_rate: Column) -> Column:
    """7 percent and above is good, 3 and above fair."""
    return F.when(conversion_rate >= 7, "good").when(conversion_rate >= 3, "fair").otherwise("poor")


def funnel_shares(funnel: DataFrame) -> DataFrame:
    """One row per funnel stage: its share of the largest stage and of the views, and the funnel's tier."""
    largest = F.greatest("views", "add_to_cart", "purchases")
    stages = [
        F.struct(F.lit(label).alias("stage"), F.col(name).alias("count"))
        for label, name in [("Product Views", "views"), ("Add to Cart", "add_to_cart"), ("Purchases", "purchases")]
    ]
    return (
        funnel
        .select("views", largest.alias("largest"), funnel_tier(F.col("conversion_rate")).alias("tier"),
                F.inline(F.array(*stages)))
        .select(
            "stage", "count",
            percent(F.col("count"), F.col("largest")).alias("pct_of_max"),
            round_exact(percent(F.col("count"), F.col("views")), 1, ties="away").alias("pct_of_views"),
            "tier",
        )
    )


def hourly_comparison(metrics: DataFrame, as_of) -> DataFrame:
    """One row: the calendar hour of `as_of`, up to then, against the hour before, from one scan."""
    now = instant(as_of)
    start = now.replace(minute=0, second=0, microsecond=0)
    current = F.col("time_bucket") >= at(start)
    previous = ~current
    rows = between(metrics, "time_bucket", start - timedelta(hours=1), now)
    sums = rows.agg(
        amount_sum("total_revenue", current).alias("current_revenue"),
        amount_sum("total_revenue", previous).alias("previous_revenue"),
        total("total_orders", current).alias("current_orders"),
        total("total_orders", previous).alias("previous_orders"),
        F.coalesce(F.avg(F.when(current, F.col("conversion_rate"))), F.lit(0.0)).alias("current_conversion"),
        F.coalesce(F.avg(F.when(previous, F.col("conversion_rate"))), F.lit(0.0)).alias("previous_conversion"),
    )

    def change(measure: str) -> Column:
        return round_exact(percent_change(F.col(f"current_{measure}"), F.col(f"previous_{measure}")), 1)

    return sums.select(
        change("revenue").alias("revenue_change_percent"),
        change("orders").alias("orders_change_percent"),
        "current_revenue", "current_orders", "current_conversion", "previous_conversion",
    )


def _one(section: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.to_json(F.struct("*")).alias("payload"))


def _many(section: str, df: DataFrame) -> DataFrame:
    """A limited result as one JSON list, in the order of its rows."""
    numbered = df.select(F.monotonically_increasing_id().alias("n"), F.struct("*").alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n", "row"))), lambda pair: pair["row"])
    return numbered.agg(rows.alias("rows")).select(F.lit(section).alias("section"), F.to_json("rows").alias("payload"))


def snapshot(single: dict[str, DataFrame], lists: dict[str, DataFrame]) -> DataFrame:
    """One row with a JSON column per dashboard read.

    Every read becomes one labelled row; the labels are then turned into columns, so no join is needed.
    `lists` must hold results already limited in rows, in their final order.
    """
    sections = [_one(name, df) for name, df in single.items()] + [_many(name, df) for name, df in lists.items()]
    rows = reduce(DataFrame.unionByName, sections)
    return rows.agg(*[
        F.max(F.when(F.col("section") == name, F.col("payload"))).alias(name) for name in [*single, *lists]
    ])

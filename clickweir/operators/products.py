"""Product metrics, trending scores and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import amount_sum, cents, dollars
from ..functions.ratios import percent
from ..functions.times import lookback
from ..schemas import PRODUCT, PRODUCT_METRIC_COLUMNS, PURCHASE, VIEW
from .metrics import count_type, revenue


def activity_score(views: Column, purchases: Column) -> Column:
    """Score of one bucket. 10 per view, 50 per purchase."""
    return (views * 10 + purchases * 50).cast("double")


def lookback_score(views: Column, purchases: Column, minutes: float) -> Column:
    """Score over a lookback. 1 per view, 5 per view a minute, 10 per purchase, 1 per percent converted."""
    return views * F.lit(1.0) + views / F.lit(float(minutes)) * 5.0 + purchases * F.lit(10.0) + percent(purchases, views)


def _measures() -> list[Column]:
    return [
        count_type(VIEW).alias("view_count"),
        count_type(PURCHASE).alias("purchase_count"),
        revenue().alias("revenue"),
    ]


def _bucket_columns(df: DataFrame, minutes: float) -> DataFrame:
    return df.withColumns({
        "views_per_minute": F.col("view_count") / F.lit(float(minutes)),
        "trending_score": activity_score(F.col("view_count"), F.col("purchase_count")),
    }).select(*PRODUCT_METRIC_COLUMNS)


def product_metrics(events: DataFrame, minutes: int = 1) -> DataFrame:
    """Views, purchases and revenue per bucket and product, from view and purchase events."""
    grouped = (
        events.filter(F.col("event_type").isin(VIEW, PURCHASE))
        .groupBy(F.window("timestamp", f"{minutes} minutes").alias("w"), *PRODUCT)
        .agg(*_measures())
        .withColumn("time_bucket", F.col("w.start"))
    )
    return _bucket_columns(grouped, minutes)


def product_metrics_by_id(events: DataFrame, minutes: int = 1) -> DataFrame:
    """The same per product id alone, from all events with a product; of differing attributes the largest.

    Attributes are grouped on first: that aggregate has fixed-size buffers and hashes, while a maximum of
    text would sort all events. The maximum then runs over one row per variant of a product.
    """
    variants = (
        events.filter(F.col("product_id").isNotNull())
        .groupBy(F.window("timestamp", f"{minutes} minutes").alias("w"), *PRODUCT)
        .agg(*_measures())
    )
    grouped = variants.groupBy("w", "product_id").agg(
        *[F.max(name).alias(name) for name in PRODUCT[1:]],
        *[F.sum(name).alias(name) for name in ("view_count", "purchase_count")],
        amount_sum("revenue").alias("revenue"),
    ).withColumn("time_bucket", F.col("w.start"))
    return _bucket_columns(grouped, minutes)


# Partials, as in metrics: what a batch of events adds to the minutes of products.
PARTIAL_KEY = ["time_bucket", *PRODUCT]
PARTIAL_SUMS = ["view_count", "purchase_count", "revenue_cents"]


def product_partials(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("event_type").isin(VIEW, PURCHASE))
        .groupBy(F.window("timestamp", "1 minute").getField("start").alias("time_bucket"), *PRODUCT)
        .agg(count_type(VIEW).alias("view_count"), count_type(PURCHASE).alias("purchase_count"),
             F.coalesce(F.sum(F.when(F.col("event_type") == PURCHASE, cents(F.col("total_amount")))), F.lit(0)).alias("revenue_cents"))
    )


def _of_partials(partials: DataFrame, minutes: int) -> DataFrame:
    grouped = partials.groupBy(F.window("time_bucket", f"{minutes} minutes").alias("w"), *PRODUCT).agg(*[F.sum(n).alias(n) for n in PARTIAL_SUMS])
    return grouped.withColumns({"time_bucket": F.col("w.start"), "revenue": dollars(F.col("revenue_cents"))})


def products_of_partials(partials: DataFrame, minutes: int = 1) -> DataFrame:
    """product_metrics() of the events behind the partials."""
    return _bucket_columns(_of_partials(partials, minutes), minutes)


def rankings_of_partials(partials: DataFrame, minutes: int = 5, limit: int = 20) -> DataFrame:
    """ranking_history() of the events behind the partials; products without a view are not ranked there either."""
    return _ranked(_of_partials(partials.filter(F.col("product_id").isNotNull()), minutes), minutes, limit)


def _scored(df: DataFrame, minutes: float) -> DataFrame:
    return (
        df.filter(F.col("view_count") > 0)
        .withColumns({
            "views_per_minute": F.col("view_count") / F.lit(float(minutes)),
            "trending_score": lookback_score(F.col("view_count"), F.col("purchase_count"), minutes),
        })
    )


def _best_first() -> list[Column]:
    return [F.desc_nulls_last("trending_score"), F.asc_nulls_last("product_id")]


def trending(events: DataFrame, as_of, minutes: int = 5, limit: int = 20) -> DataFrame:
    """The `limit` best products of the lookback with their rank.

    The limit comes before the ranking: each task keeps its best rows, and only `limit` rows are numbered.
    """
    products = (
        lookback(events, "timestamp", as_of, minutes=minutes)
        .filter(F.col("product_id").isNotNull())
        .groupBy(*PRODUCT)
        .agg(*_measures())
    )
    best = _scored(products, minutes).orderBy(*_best_first()).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*_best_first())).cast("bigint"))


def ranking_history(events: DataFrame, minutes: int = 5, limit: int = 20) -> DataFrame:
    """A ranking per bucket of `minutes`, as stored by a job that ranks at every bucket's end.

    Spark limits each bucket inside the tasks before it gathers a bucket to number its rows.
    """
    products = (
        events.filter(F.col("product_id").isNotNull())
        .groupBy(F.window("timestamp", f"{minutes} minutes").alias("w"), *PRODUCT)
        .agg(*_measures())
    )
    return _ranked(products.withColumn("time_bucket", F.col("w.start")), minutes, limit)


def _ranked(products: DataFrame, minutes: int, limit: int) -> DataFrame:
    ranks = Window.partitionBy("time_bucket").orderBy(*_best_first())
    return (
        _scored(products, minutes)
        .withColumn("rank", F.row_number().over(ranks).cast("bigint"))
        .filter(F.col("rank") <= limit)
        .select(*PRODUCT_METRIC_COLUMNS, "rank")
    )


def trending_now(rankings: DataFrame, as_of, minutes: int = 5, limit: int = 10,
                 all_buckets: bool = False) -> DataFrame:
    """The best ranked products of recent rankings.

    By default each product counts once, with its latest bucket; `all_buckets` lists every stored row.
    """
    rows = lookback(rankings, "time_bucket", as_of, minutes=minutes)
    if not all_buckets:
        columns = rows.columns
        latest = F.max(F.struct("time_bucket", *[c for c in columns if c not in ("time_bucket", "product_id")]))
        rows = rows.groupBy("product_id").agg(latest.alias("row")).select("product_id", "row.*").select(*columns)
    best = rows.orderBy(F.asc_nulls_last("rank"), F.desc_nulls_last("time_bucket"), F.asc_nulls_last("product_id"))
    return best.limit(limit).select(
        "product_id", "product_name",
        F.col("product_category").alias("category"),
        F.coalesce(F.col("product_price"), F.lit(0.0)).alias("price"),
        F.col("view_count").alias("views"),
        F.col("purchase_count").alias("purchases"),
        "revenue", "views_per_minute", "trending_score", "rank",
    )

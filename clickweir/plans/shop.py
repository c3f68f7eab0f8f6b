"""The `events`, `part`, `customer`, `nation` and `region` tables seen as shop events."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.times import at, between, bucket_start
from ..schemas import ADD, EVENT_COLUMNS, MONEY, PURCHASE, REMOVE, SEARCH, VIEW
from ..session import drop_scratch, scratch
from ..streaming.jobs import watermarked

# Event types of the table -> event types of the shop.
TYPES = {"view": VIEW, "click": ADD, "error": REMOVE, "purchase": PURCHASE, "signup": SEARCH}


def shop_type(column: Column) -> Column:
    mapped = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, shop_name in TYPES.items():
        mapped = mapped.when(column == name, shop_name)
    return mapped


def product_of(props: Column) -> Column:
    """The number in ``{"k": n}``, null without one. A pattern reads it several times faster than a JSON parser."""
    return F.nullif(F.regexp_extract(props, r'"k"\s*:\s*"?(\d+)', 1), F.lit(""))


def as_shop_events(raw: DataFrame) -> DataFrame:
    """Event columns known from the `events` row itself; `product_id` is null for searches."""
    kind = shop_type(F.col("event_type"))
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        kind.alias("event_type"),
        F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"),
        F.when(kind != SEARCH, product_of(F.col("props"))).alias("product_id"),
        F.when(kind.isin(ADD, REMOVE, PURCHASE), F.lit(1)).alias("quantity"),
        F.when(kind == PURCHASE, F.col("value").try_cast(MONEY)).alias("total_amount"),
        F.lit(None).cast("string").alias("payment_method"),
        F.lit(None).cast("string").alias("ip_address"),
    )


def with_products(spark: SparkSession, events: DataFrame, sf_dir: str) -> DataFrame:
    """Product attributes by id. No broadcast is forced: Spark broadcasts `part` while its measured size is
    below the threshold, and otherwise sorts and merges, splitting partitions of frequent products."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("product_key"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("product_category"),
        F.col("p_retailprice").alias("product_price"),
    )
    # Events without a product get scattered keys that match nothing, so they do not meet in one task.
    nowhere = -1 - F.pmod(F.xxhash64("event_id"), F.lit(1 << 20))
    key = F.coalesce(F.col("product_id").try_cast("bigint"), nowhere)
    return events.withColumn("product_key", key).join(part, "product_key", "left").drop("product_key")


def with_places(spark: SparkSession, events: DataFrame, sf_dir: str) -> DataFrame:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    places = (
        read("customer")
        .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("user_key"), F.col("n_name").alias("city"), F.col("r_name").alias("country"))
    )
    keyed = events.withColumn("user_key", F.col("user_id").try_cast("bigint"))
    return keyed.join(places, "user_key", "left").drop("user_key")


def shop_events(spark: SparkSession, sf_dir: str, products: bool = False, places: bool = False) -> DataFrame:
    """Events with the asked attributes; what is not asked for is not joined or read."""
    return attributed(spark, as_shop_events(spark.read.parquet(f"{sf_dir}/events.parquet")), sf_dir, products, places)


def attributed(spark: SparkSession, events: DataFrame, sf_dir: str, products: bool, places: bool) -> DataFrame:
    if products:
        events = with_products(spark, events, sf_dir)
    if places:
        events = with_places(spark, events, sf_dir)
    return events.select(*[name for name in EVENT_COLUMNS if name in events.columns])


# Edges of the periods that streams read one after the other, so that state is carried over several batches.
EDGES = ["2024-01-11", "2024-01-21"]


def event_periods(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """The events table in periods, the older first."""
    events, bounds = spark.read.parquet(f"{sf_dir}/events.parquet"), [None, *EDGES, None]
    for start, end in zip(bounds[:-1], bounds[1:]):
        yield between(events, "ts", start, end)


def shop_stream(spark: SparkSession, sf_dir: str, raw: DataFrame, products: bool = False, places: bool = False) -> DataFrame:
    """Shop events of a stream of the events table."""
    return attributed(spark, watermarked(as_shop_events(raw)), sf_dir, products, places)


def message_periods(spark: SparkSession, sf_dir: str, late: str | None) -> Iterator[DataFrame]:
    """Damaged messages of one period after the other. Every event of the first ten products comes again a period later,
    dated a day after its first copy; events of the type `late` come a period late, and only then. A period must be used before
    the next is asked for."""
    path, ends = scratch(spark, "attributed"), [F.col("timestamp") < at(edge) for edge in EDGES]
    events = shop_events(spark, sf_dir, products=True, places=True).filter(F.col("timestamp").isNotNull())
    period_of = reduce(lambda later, end: F.when(end[1], end[0]).otherwise(later), reversed([*enumerate(ends)]), F.lit(len(EDGES)))
    events.withColumn("period", period_of).write.partitionBy("period").parquet(path)  # joined once, read period by period
    stored = spark.read.schema(StructType([*events.schema.fields, StructField("period", IntegerType())])).parquet(path)
    before = None
    for number in range(len(EDGES) + 2):
        now = stored.filter(F.col("period") == number).drop("period")
        is_late = (F.col("event_type") == late) if late else F.lit(False)
        period = now.filter(~is_late)
        if before is not None:
            again = before.filter(F.col("product_id").cast("int") < 10).withColumn("timestamp", F.col("timestamp") + F.make_dt_interval(days=F.lit(1)))
            period = period.unionByName(before.filter(is_late)).unionByName(again)
        yield damaged_messages(period)
        before = now
    drop_scratch(spark, [path])


def as_messages(events: DataFrame) -> DataFrame:
    """Events as JSON messages in a binary `value` column."""
    body = F.struct(
        "event_id", "event_type",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "user_id", "session_id",
        F.when(F.col("product_id").isNotNull(), F.struct(
            F.col("product_id").alias("id"), F.col("product_name").alias("name"),
            F.col("product_category").alias("category"), F.col("product_price").alias("price"))).alias("product"),
        "quantity", "total_amount", "payment_method",
        F.struct("city", "country", F.col("ip_address").alias("ip")).alias("location"),
    )
    return events.select("event_id", "product_id", F.to_json(body).alias("text"))


def damaged_messages(events: DataFrame) -> DataFrame:
    """Messages with faults by product: 94 has a blank user, 95 a price in words, 96 a time without a date, 97 is cut
    short, 98 has no time, 99 lacks the user."""
    text, product = F.col("text"), F.col("product_id")
    faulty = (
        F.when(product == "94", F.regexp_replace(text, '"user_id":"[^"]*"', '"user_id":" "'))
        .when(product == "95", F.regexp_replace(text, '"price":[0-9.Ee]+', '"price":"dear"'))
        .when(product == "96", F.regexp_replace(text, '"timestamp":"[^"]*"', '"timestamp":"10:00"'))
        .when(product == "97", F.expr("left(text, length(text) - 20)"))
        .when(product == "98", F.regexp_replace(text, '"timestamp":"[^"]*"', '"timestamp":"soon"'))
        .when(product == "99", F.regexp_replace(text, '"user_id":"[^"]*",', ""))
        .otherwise(text)
    )
    return as_messages(events).select(faulty.cast("binary").alias("value"))


def hours_of_revenue(events: DataFrame, factor: int = 1) -> DataFrame:
    """Small hourly table for the write operators."""
    return events.groupBy(bucket_start(F.col("timestamp"), "1 hour").alias("time_bucket")).agg(
        (F.coalesce(F.sum(F.when(F.col("event_type") == PURCHASE, F.col("total_amount"))), F.lit(0)).cast("double")
         * factor).alias("total_revenue"),
        F.count(F.when(F.col("event_type") == PURCHASE, 1)).alias("total_orders"),
    )

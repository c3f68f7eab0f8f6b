"""One registered query per operator. Lookbacks and limits are set so that the sparse given events yield rows;
the operators' own defaults are untouched."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import display, ratios, times
from ..functions.money import amount_sum
from ..operators import alerts, dashboard, geo, metrics, products, reports, sessions
from ..schemas import ADD, ALERT_COLUMNS, EVENT_COLUMNS, HOUR_COLUMNS, PURCHASE, REMOVE, SEARCH, VIEW
from ..session import require_utc, scratch
from ..sinks import tables as sinks
from ..sources import messages, tables
from ..streaming import jobs, refresh
from . import shop

Query = Callable[[SparkSession, str], DataFrame]

# The reference time: the end of the last day with events.
AS_OF = "2024-01-31 00:00:00"
COMPARED_AT = "2024-01-30 23:59:00"
CHECKED_AT = "2024-01-27 16:36:00"
TRENDING_AT = "2024-01-22 20:00:00"
DAY = 24 * 60
GAP = 12 * 60

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name; results get plain types (naive UTC times, double amounts)."""
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(fn(require_utc(spark), sf_dir))
    _QUERIES[fn.__name__] = run
    return run


def plain(df: DataFrame) -> DataFrame:
    naive = times.naive_utc(df)
    return naive.select(*[
        F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name)
        for f in naive.schema.fields
    ])


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Means of doubles depend on the order of addition in their last digits; four places do not."""
    return df.withColumns({name: F.round(name, 4) for name in columns})


def minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.minute_metrics(shop.shop_events(spark, sf_dir))


def last_day(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return times.lookback(df, column, AS_OF, hours=24)


def last_day_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute metrics of the last day; the bound reaches the scan of the events."""
    return metrics.minute_metrics(last_day(shop.shop_events(spark, sf_dir)))


# Metrics

@query
def metrics_1min(spark, sf_dir):
    return minute(spark, sf_dir)


@query
def metrics_1min_options(spark, sf_dir):
    """All users counted, and zero as the average order value of minutes without orders."""
    return metrics.minute_metrics(shop.shop_events(spark, sf_dir), users="all", empty="zero")


@query
def metrics_1hour(spark, sf_dir):
    return metrics.hour_metrics(shop.shop_events(spark, sf_dir))


@query
def product_metrics_1min(spark, sf_dir):
    return products.product_metrics(shop.shop_events(spark, sf_dir, products=True))


@query
def product_metrics_by_id(spark, sf_dir):
    return products.product_metrics_by_id(shop.shop_events(spark, sf_dir, products=True))


@query
def geo_metrics_1min(spark, sf_dir):
    return geo.geo_metrics(shop.shop_events(spark, sf_dir, places=True))


# Rankings and dashboard reads

@query
def trending_top20(spark, sf_dir):
    return products.trending(shop.shop_events(spark, sf_dir, products=True), AS_OF, minutes=DAY)


@query
def trending_now(spark, sf_dir):
    ranked = products.ranking_history(last_day(shop.shop_events(spark, sf_dir, products=True)), minutes=60)
    return products.trending_now(ranked, AS_OF, minutes=DAY)


@query
def trending_now_buckets(spark, sf_dir):
    """Every stored row of the ranking, not only a product's latest."""
    ranked = products.ranking_history(last_day(shop.shop_events(spark, sf_dir, products=True)), minutes=60)
    return products.trending_now(ranked, AS_OF, minutes=DAY, all_buckets=True)


@query
def live_metrics(spark, sf_dir):
    live = dashboard.live_metrics(last_day_minutes(spark, sf_dir), AS_OF, minutes=DAY)
    return rounded(live, "conversion_rate", "cart_abandonment_rate")


@query
def active_users(spark, sf_dir):
    return dashboard.active_users(shop.shop_events(spark, sf_dir), AS_OF, minutes=DAY)


@query
def revenue_trend(spark, sf_dir):
    return dashboard.revenue_trend(last_day_minutes(spark, sf_dir), AS_OF, hours=24)


@query
def conversion_funnel(spark, sf_dir):
    return dashboard.conversion_funnel(last_day_minutes(spark, sf_dir), AS_OF, hours=24)


@query
def funnel_shares(spark, sf_dir):
    return dashboard.funnel_shares(dashboard.conversion_funnel(last_day_minutes(spark, sf_dir), AS_OF, hours=24))


@query
def geo_top_locations(spark, sf_dir):
    return geo.top_locations(shop.shop_events(spark, sf_dir, places=True), AS_OF, hours=24)


@query
def hourly_comparison(spark, sf_dir):
    hours = times.lookback(shop.shop_events(spark, sf_dir), "timestamp", COMPARED_AT, hours=2)
    compared = dashboard.hourly_comparison(metrics.minute_metrics(hours), COMPARED_AT)
    return rounded(compared, "current_conversion", "previous_conversion")


# Alerts

def rules() -> dict[str, alerts.Rule]:
    """Hour-long periods and limits that the sparse events reach."""
    return {
        "traffic_spike": alerts.traffic_spike(60),
        "traffic_drop": alerts.traffic_drop(60),
        "low_conversion": alerts.low_conversion(60, min_views=2),
        "cart_abandonment": alerts.high_cart_abandonment(60, min_adds=2),
        "revenue_anomaly": alerts.revenue_anomaly(60),
    }


def alert_history(spark, sf_dir, *names: str, since=None) -> DataFrame:
    """Verdicts of every minute of the history, or of its part from `since` on."""
    chosen = [rules()[name] for name in names or rules()]
    start = None if since is None else times.instant(since) - timedelta(hours=2)   # the rules look back two hours
    events = times.between(shop.shop_events(spark, sf_dir), "timestamp", start, None if since is None else AS_OF)
    found = alerts.evaluate(metrics.minute_metrics(events), chosen, until=AS_OF, since=since)
    return rounded(found, "current_value", "percentage_change")


def trending_history(spark, sf_dir, since=None, all_buckets: bool = False) -> DataFrame:
    start = None if since is None else times.instant(since) - timedelta(minutes=DAY)
    events = times.between(shop.shop_events(spark, sf_dir, products=True), "timestamp", start, None if since is None else AS_OF)
    found = alerts.trending_products(products.product_metrics(events, minutes=60), minutes=DAY, step_minutes=60, until=AS_OF, since=since,
                                     all_buckets=all_buckets)
    return rounded(found, "current_value", "threshold_value", "percentage_change")


def alert_log(spark, sf_dir, since=None) -> DataFrame:
    return alerts.recorded(alert_history(spark, sf_dir, since=since).unionByName(trending_history(spark, sf_dir, since)))


@query
def alert_traffic_spike(spark, sf_dir):
    return alerts.alert_columns(alert_history(spark, sf_dir, "traffic_spike"))


@query
def alert_traffic_drop(spark, sf_dir):
    return alerts.alert_columns(alert_history(spark, sf_dir, "traffic_drop"))


@query
def alert_low_conversion(spark, sf_dir):
    return alerts.alert_columns(alert_history(spark, sf_dir, "low_conversion"))


@query
def alert_cart_abandonment(spark, sf_dir):
    return alerts.alert_columns(alert_history(spark, sf_dir, "cart_abandonment"))


@query
def alert_revenue_anomaly(spark, sf_dir):
    return alerts.alert_columns(alert_history(spark, sf_dir, "revenue_anomaly"))


@query
def alert_trending_product(spark, sf_dir):
    return alerts.alert_columns(trending_history(spark, sf_dir))


@query
def alert_trending_buckets(spark, sf_dir):
    """Each bucket raises an alert of its own, with its own id."""
    log = alerts.recorded(trending_history(spark, sf_dir, all_buckets=True))
    return log.select(*ALERT_COLUMNS, alerts.SOURCE, "id")


@query
def alert_trending_now(spark, sf_dir):
    """Point in time: the hourly product rows of the day before."""
    recent = times.lookback(shop.shop_events(spark, sf_dir, products=True), "timestamp", TRENDING_AT, hours=24)
    found = alerts.trending_products(products.product_metrics(recent, minutes=60), TRENDING_AT, minutes=DAY)
    return alerts.alert_columns(rounded(found, "current_value", "threshold_value", "percentage_change"))


@query
def alert_messages(spark, sf_dir):
    """The texts of all six types."""
    found = alert_history(spark, sf_dir).unionByName(trending_history(spark, sf_dir))
    return found.select(*ALERT_COLUMNS, *alerts.TEXT_COLUMNS)


@query
def alert_options(spark, sf_dir):
    """Losses only beyond a hundred percent, and periods without rows as missing instead of zero."""
    chosen = [alerts.traffic_drop(60, missing="null"), alerts.revenue_anomaly(60, down_pct=100.0)]
    found = alerts.evaluate(minute(spark, sf_dir), chosen, until=AS_OF)
    return alerts.alert_columns(rounded(found, "current_value", "percentage_change"))


@query
def alerts_all(spark, sf_dir):
    return alert_log(spark, sf_dir).select(*ALERT_COLUMNS, "id", "is_active", "resolved_at")


@query
def alerts_resolved(spark, sf_dir):
    return alerts.resolved(alert_log(spark, sf_dir), AS_OF).select(*ALERT_COLUMNS, "id", "is_active", "resolved_at")


ONE_HOUR_AGO = "2024-01-30 23:00:00"


@query
def active_alerts(spark, sf_dir):
    """Only what is not yet resolved: the last hour is judged and nothing before it."""
    return alerts.active_alerts(alerts.resolved(alert_log(spark, sf_dir, since=ONE_HOUR_AGO), AS_OF))


@query
def alerts_now(spark, sf_dir):
    """Point in time: all six checks at the last minute with the same limits, from the events that they look back on."""
    recent = times.lookback(shop.shop_events(spark, sf_dir, products=True), "timestamp", CHECKED_AT, hours=24)
    minutes = metrics.minute_metrics(times.lookback(recent, "timestamp", CHECKED_AT, hours=2))
    found = alerts.run_all_checks(minutes, products.product_metrics(recent, minutes=60), CHECKED_AT,
                                  rules=list(rules().values()), minutes=DAY)
    return alerts.alert_columns(rounded(found, "current_value", "threshold_value", "percentage_change"))


# Reports

@query
def stats_report(spark, sf_dir):
    log = alerts.resolved(alert_log(spark, sf_dir, since=ONE_HOUR_AGO), AS_OF)
    return reports.stats_report(shop.shop_events(spark, sf_dir), log)


@query
def recent_events(spark, sf_dir):
    newest = reports.newest(shop.shop_events(spark, sf_dir))     # names are looked up for these only
    return reports.recent_events(shop.with_products(spark, newest, sf_dir))


@query
def recent_purchases(spark, sf_dir):
    newest = reports.newest(shop.shop_events(spark, sf_dir).filter(F.col("event_type") == PURCHASE))
    return reports.recent_purchases(shop.with_products(spark, newest, sf_dir))


@query
def latest_metrics(spark, sf_dir):
    return reports.latest_metrics(minute(spark, sf_dir))


ADHOC_TEXT = """
    SELECT n_name AS city, event_type, COUNT(*) AS events, COUNT(DISTINCT user_id) AS users,
           CAST(SUM(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total_value
    FROM events
    JOIN customer ON user_id = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name, event_type
"""


@query
def adhoc_sql(spark, sf_dir):
    names = ["events", "customer", "nation"]
    return tables.adhoc_sql(spark, ADHOC_TEXT, {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


@query
def dashboard_snapshot(spark, sf_dir):
    """The seven reads, the alerts of all six checks among them, as the payload has them: a row for each field."""
    minutes = last_day_minutes(spark, sf_dir)
    snapshot = dashboard.snapshot(
        single={
            "live": dashboard.live_metrics(minutes, AS_OF, minutes=DAY),
            "funnel": dashboard.conversion_funnel(minutes, AS_OF, hours=24),
            "comparison": dashboard.hourly_comparison(minutes, COMPARED_AT),
        },
        lists={
            "trending_products": trending_now(spark, sf_dir),
            "alerts": active_alerts(spark, sf_dir),
            "revenue_trend": dashboard.revenue_trend(minutes, AS_OF, hours=24),
            "geographic": geo_top_locations(spark, sf_dir),
        },
    )
    sections = snapshot.unpivot([], snapshot.columns, "section", "payload")
    one = F.col("payload").startswith("{")
    rows = F.from_json(F.when(one, F.concat(F.lit("["), "payload", F.lit("]"))).otherwise(F.col("payload")), "array<map<string, string>>")
    fields = sections.select("section", F.posexplode(rows).alias("place", "row")).select("section", "place", F.explode("row").alias("field", "value"))
    return fields.select("section", F.col("place").cast("bigint").alias("place"), "field", F.round(F.col("value").try_cast("double"), 3).alias("number"),
                         F.when(F.col("value").try_cast("double").isNull(), F.regexp_replace("value", r"T(\d\d:\d\d:\d\d)\.000", " $1")).alias("text"))


# Decoding

def all_events(spark, sf_dir):
    return shop.shop_events(spark, sf_dir, products=True, places=True)


def decoded(spark, sf_dir):
    return messages.decode(shop.damaged_messages(all_events(spark, sf_dir)))


@query
def decode_events(spark, sf_dir):
    return messages.accepted(decoded(spark, sf_dir)).select(
        "event_id", "event_type", "timestamp", "user_id", "session_id",
        F.col("product.id").alias("product_id"), F.col("product.price").alias("product_price"),
        "quantity", "total_amount", F.col("location.city").alias("city"))


@query
def reject_malformed(spark, sf_dir):
    return messages.rejected(decoded(spark, sf_dir)).groupBy("reject_reason").agg(
        F.count(F.lit(1)).alias("messages"), F.count("broken_text").alias("with_text"))


@query
def flatten_events(spark, sf_dir):
    good = shop.as_messages(all_events(spark, sf_dir)).select(F.col("text").alias("value"))
    return messages.flatten(messages.accepted(messages.decode(good))).select(*EVENT_COLUMNS)


@query
def default_fill(spark, sf_dir):
    events = all_events(spark, sf_dir)
    return messages.with_defaults(events, "zero").select(
        "event_id", "event_type", "quantity", "total_amount", "product_price")


@query
def default_quantity(spark, sf_dir):
    events = all_events(spark, sf_dir)
    return messages.with_defaults(events, "quantity").select("event_id", "event_type", "quantity", "total_amount", "product_price")


@query
def row_to_json(spark, sf_dir):
    events = all_events(spark, sf_dir).select(
        "event_id", "event_type", "user_id", "session_id", "product_id", "quantity", "total_amount", "city")
    return events.select("event_id", messages.row_to_json(events).alias("raw_data"))


@query
def parse_timestamp(spark, sf_dir):
    """Times written in several ways by event type: with Z, without, with an offset, not a time, and only a part of one."""
    events = shop.shop_events(spark, sf_dir)
    plain_text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_type")
    text = (F.when(kind == VIEW, F.concat(plain_text, F.lit("Z")))
            .when(kind == ADD, plain_text)
            .when(kind == PURCHASE, F.concat(plain_text, F.lit("+02:00")))
            .when(kind == REMOVE, F.lit("soon"))
            .otherwise(F.element_at(F.array(F.lit(""), F.date_format("timestamp", "HH:mm"), F.date_format("timestamp", "yyyy"),
                                            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm")), (F.col("event_id").cast("bigint") % 4 + 1).cast("int"))))
    return events.select("event_id", text.alias("text")).withColumn("parsed", messages.parse_timestamp(F.col("text")))


@query
def dedup_events(spark, sf_dir):
    """Events of the first ten products arrive again a second later; the earlier row stays."""
    events = shop.shop_events(spark, sf_dir).select("event_id", "event_type", "timestamp", "user_id", "total_amount",
                                                    "product_id")
    again = events.filter(F.col("product_id").cast("int") < 10).withColumn(
        "timestamp", F.col("timestamp") + F.expr("INTERVAL 1 SECOND"))
    return messages.deduplicate(events.unionByName(again))


# Column expressions

@query
def safe_ratio(spark, sf_dir):
    return minute(spark, sf_dir).select(
        "time_bucket", "total_views", "add_to_cart_count", "purchase_count",
        ratios.safe_ratio(F.col("purchase_count"), F.col("total_views")).alias("per_view"),
        ratios.safe_ratio(F.col("purchase_count"), F.col("total_views"), None).alias("per_view_or_null"),
        ratios.percent(F.col("add_to_cart_count"), F.col("total_views")).alias("cart_percent"),
        ratios.shortfall_percent(F.col("purchase_count"), F.col("add_to_cart_count")).alias("abandonment"),
    )


@query
def percent_change(spark, sf_dir):
    """Second against first half of every hour."""
    late = F.minute("time_bucket") >= 30
    halves = minute(spark, sf_dir).groupBy(times.truncate(F.col("time_bucket"), "hour").alias("time_bucket")).agg(
        amount_sum("total_revenue", late).alias("current"),
        amount_sum("total_revenue", ~late).alias("previous"))
    return halves.withColumn("change", ratios.percent_change(F.col("current"), F.col("previous")))


@query
def rounding(spark, sf_dir):
    share = ratios.percent(F.col("total_orders"), F.col("total_views") + F.col("add_to_cart_count") + 13)
    value = F.col("value")
    return minute(spark, sf_dir).select("time_bucket", share.alias("value")).select(
        "time_bucket", "value",
        ratios.round_exact(value, 0).alias("to_0"),
        ratios.round_exact(value, 1).alias("to_1"),
        ratios.round_exact(value, 2).alias("to_2"),
        display.fixed(value, 1).alias("text_1"),
    )


@query
def time_buckets(spark, sf_dir):
    ts = F.col("timestamp")
    return shop.shop_events(spark, sf_dir).select(
        "event_id", "timestamp",
        times.truncate(ts, "minute").alias("minute_start"),
        times.truncate(ts, "hour").alias("hour_start"),
        times.bucket_start(ts, "5 minutes").alias("five_minutes"),
        (ts >= times.at(AS_OF) - times.minutes(DAY)).alias("in_last_day"),
    )


@query
def local_time_labels(spark, sf_dir):
    """Each event's time, and the time half a year later, when daylight saving time holds."""
    winter = shop.shop_events(spark, sf_dir).select("event_id", "timestamp")
    summer = winter.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 180 DAYS"))
    ts = F.col("timestamp")
    return winter.unionByName(summer).select(
        "event_id", "timestamp",
        display.clock_label(ts).alias("clock"),
        display.clock_label_with_place(ts).alias("clock_place"),
        display.date_time_label(ts).alias("date_time"),
        display.chart_label(ts).alias("chart"),
        display.daylight_label(ts).alias("daylight"),
        display.zone_label(ts).alias("zone"),
    )


@query
def display_formats(spark, sf_dir):
    return minute(spark, sf_dir).select(
        "time_bucket", "total_revenue", "total_views", "cart_abandonment_rate",
        display.currency(F.col("total_revenue") * 1000).alias("revenue_text"),
        display.currency(-F.col("total_revenue")).alias("refund_text"),
        display.thousands(F.col("total_views") * 12345).alias("views_text"),
        display.signed_percent(F.col("cart_abandonment_rate")).alias("abandonment_text"),
    )


# Tables

def hours(spark, sf_dir, factor: int = 1, start=None, end=None):
    return shop.hours_of_revenue(times.between(shop.shop_events(spark, sf_dir), "timestamp", start, end), factor)


def _stored_hours(spark, sf_dir, name: str) -> str:
    """A table on disk with the hours before January 20."""
    path = scratch(spark, name)
    sinks.write_table(hours(spark, sf_dir, end="2024-01-20"), path, "time_bucket")
    return path


def _newer_hours(spark, sf_dir):
    return hours(spark, sf_dir, factor=2, start="2024-01-15")


def _read_hours(spark, path):
    return spark.read.parquet(path).select("time_bucket", "total_revenue", "total_orders")


@query
def upsert_metrics(spark, sf_dir):
    path = _stored_hours(spark, sf_dir, "upsert")
    sinks.upsert_table(spark, path, _newer_hours(spark, sf_dir), ["time_bucket"])
    return _read_hours(spark, path)


@query
def insert_absent_metrics(spark, sf_dir):
    path = _stored_hours(spark, sf_dir, "insert_absent")
    sinks.insert_absent_table(spark, path, _newer_hours(spark, sf_dir), ["time_bucket"])
    return _read_hours(spark, path)


@query
def replace_bucket(spark, sf_dir):
    path = _stored_hours(spark, sf_dir, "replace_bucket")
    bucket = times.instant("2024-01-17 10:00:00")
    new = hours(spark, sf_dir, factor=2, start=bucket, end=bucket + timedelta(hours=1))
    sinks.replace_bucket_table(spark, path, new, bucket)
    return _read_hours(spark, path)


@query
def retention_filter(spark, sf_dir):
    return sinks.retained(shop.shop_events(spark, sf_dir), "timestamp", AS_OF, days=7)


@query
def partitioned_scan(spark, sf_dir):
    path = scratch(spark, "events_by_date")
    sinks.write_table(shop.shop_events(spark, sf_dir), path, "timestamp")
    week = tables.scan(spark, path, start="2024-01-10", end="2024-01-17")
    return week.select(*[c for c in EVENT_COLUMNS if c in week.columns])


# Sessions

@query
def sessionize(spark, sf_dir):
    return sessions.sessionize(shop.shop_events(spark, sf_dir), gap_minutes=GAP)


@query
def cart_state(spark, sf_dir):
    return sessions.cart_state(shop.shop_events(spark, sf_dir))


@query
def session_funnel(spark, sf_dir):
    return sessions.session_funnel(shop.shop_events(spark, sf_dir))


# Streams: each runs the operator over the events as a stream until they are used up, and returns the table written.

def _streamed(spark, sf_dir, name: str, operator, column: str, start=jobs.start_append) -> DataFrame:
    """The table of a query over a stream of the events table. The query is started again for each period on one
    checkpoint, so a batch is a period, whose files are written and read by as many tasks as its rows need."""
    root, source = scratch(spark, name), scratch(spark, "event_files")
    for period in shop.event_periods(spark, sf_dir):
        period.write.mode("append").parquet(source)
        df = operator(jobs.file_stream(spark, source, period.schema))
        jobs.wait([start(df, name, root, column)])
    return jobs.stored(spark, root, name, df.schema)


@query
def stream_raw_events(spark, sf_dir):
    return _streamed(spark, sf_dir, "events_raw", lambda raw: shop.shop_stream(spark, sf_dir, raw, products=True, places=True), "timestamp")


@query
def stream_metrics_1min(spark, sf_dir):
    return _streamed(spark, sf_dir, "metrics_1min", lambda raw: metrics.minute_metrics(shop.shop_stream(spark, sf_dir, raw)), "time_bucket", jobs.start_batches)


@query
def stream_metrics_1hour(spark, sf_dir):
    return _streamed(spark, sf_dir, "metrics_1hour", lambda raw: metrics.hour_metrics(shop.shop_stream(spark, sf_dir, raw)), "time_bucket")


@query
def stream_product_metrics(spark, sf_dir):
    return _streamed(spark, sf_dir, "product_metrics", lambda raw: products.product_metrics(shop.shop_stream(spark, sf_dir, raw, products=True)), "time_bucket")


@query
def stream_geo_metrics(spark, sf_dir):
    return _streamed(spark, sf_dir, "geo_metrics", lambda raw: geo.geo_metrics(shop.shop_stream(spark, sf_dir, raw, places=True)), "time_bucket")


@query
def stream_sessionize(spark, sf_dir):
    return _streamed(spark, sf_dir, "sessions", lambda raw: sessions.stream_sessions(shop.shop_stream(spark, sf_dir, raw), gap_minutes=GAP), "session_start")


@query
def stream_dedup(spark, sf_dir):
    """Every event of the first ten products comes twice."""
    def twice(raw: DataFrame) -> DataFrame:
        events = shop.as_shop_events(raw).select("event_id", "event_type", "timestamp", "user_id", "product_id")
        again = events.filter(F.col("product_id").cast("int") < 10)
        return messages.deduplicate_stream(jobs.watermarked(events.unionByName(again)))

    return _streamed(spark, sf_dir, "dedup", twice, "timestamp")


@query
def stream_late_data(spark, sf_dir):
    """All searches arrive after everything else. The query is stopped in between and resumes from its checkpoint;
    searches of minutes already given are dropped."""
    root = scratch(spark, "late_data")
    source = f"{root}/source"
    events = shop.shop_events(spark, sf_dir).select("timestamp", "event_type", "user_id", "session_id", "total_amount")

    def arrive(part: DataFrame) -> DataFrame:
        part.write.mode("append").parquet(source)
        counted = metrics.minute_metrics(jobs.watermarked(jobs.file_stream(spark, source, part.schema)))
        jobs.wait([jobs.start_append(counted, "metrics", root, "time_bucket")])
        return counted

    arrive(events.filter(F.col("event_type") != SEARCH))
    counted = arrive(events.filter(F.col("event_type") == SEARCH))
    return jobs.stored(spark, root, "metrics", counted.schema)


# The whole job

def run_job(spark, sf_dir, late: str | None, names) -> str:
    """The job, started again for each period of messages on one checkpoint; a period's files are read by many tasks."""
    root, path = scratch(spark, "all_tables"), scratch(spark, "messages")
    for period in shop.message_periods(spark, sf_dir, late):
        period.write.mode("append").parquet(path)
        started = refresh.start(jobs.file_stream(spark, path, period.schema), root, every=None, names=names, rules=list(rules().values()),
                                trending={"minutes": DAY, "step_minutes": 60})
        jobs.wait([started])
    return root


# Table of the job -> (time column, two measures).
JOB_TABLES = {
    "events_raw": ("timestamp", "total_amount", "quantity"),
    "metrics_1min": ("time_bucket", "total_revenue", "unique_users"),
    "metrics_1hour": ("time_bucket", "peak_revenue_per_minute", "unique_sessions"),
    "product_metrics": ("time_bucket", "revenue", "trending_score"),
    "geo_metrics": ("time_bucket", "total_revenue", "unique_users"),
    "rankings": ("time_bucket", "trending_score", "rank"),
}


@query
def stream_all_tables(spark, sf_dir):
    """The job over messages with late searches, damaged texts and duplicates that bear another date, in four batches;
    each table by day, read through the views of ad-hoc SQL. Parts are compacted before they are read."""
    root = run_job(spark, sf_dir, SEARCH, refresh.DEFAULT_TABLES)
    refresh.maintain(spark, root, fan=2)
    refresh.register_tables(spark, root)
    parts = [f"""SELECT '{name}' AS table_name, CAST({time} AS DATE) AS day, COUNT(*) AS row_count,
                        ROUND(SUM(CAST({first} AS DOUBLE)), 2) AS first_sum, ROUND(SUM(CAST({second} AS DOUBLE)), 2) AS second_sum
                 FROM {name} GROUP BY CAST({time} AS DATE)""" for name, (time, first, second) in JOB_TABLES.items()]
    return spark.sql(" UNION ALL ".join(parts))


@query
def stream_alert_log(spark, sf_dir):
    """The log that the job has written after its last batch."""
    root = run_job(spark, sf_dir, None, ["metrics_1min", "product_metrics", refresh.LOG])
    log = rounded(refresh.read(spark, root, refresh.LOG), "current_value", "threshold_value", "percentage_change")
    return log.select(*ALERT_COLUMNS, "id", "is_active")


@query
def alert_episodes(spark, sf_dir):
    """Alerts that go on from minute to minute as one row each."""
    log = rounded(alert_log(spark, sf_dir), "current_value", "threshold_value", "percentage_change")
    return rounded(alerts.episodes(log, gap_minutes=60), "peak_change", "peak_excess")


@query
def stream_hours_from_minutes(spark, sf_dir):
    """The job's hours twice: exact ones as it serves them, and what its minute table and the minutes' sketches give, which
    must be the same but for distinct counts within five percent (or two)."""
    root = run_job(spark, sf_dir, SEARCH, ["metrics_1min", "metrics_1hour", "sketches_1min"])
    minutes = refresh.read(spark, root, "metrics_1min").join(refresh.read(spark, root, "sketches_1min"), "time_bucket")
    rolled = metrics.hour_rollup(minutes)
    both = refresh.read(spark, root, "metrics_1hour").alias("h").join(rolled.alias("r"), "time_bucket")
    exact = [c for c in HOUR_COLUMNS if c not in ("time_bucket", "unique_users", "unique_sessions")]

    def near(name):
        return F.abs(F.col(f"h.{name}") - F.col(f"r.{name}")) <= F.greatest(F.lit(2.0), F.col(f"h.{name}") * 0.05)

    return both.select("time_bucket", *[F.col(f"r.{c}") for c in exact], "h.unique_users", "h.unique_sessions",
                       near("unique_users").alias("users_near"), near("unique_sessions").alias("sessions_near"))


@query
def stream_cart_state(spark, sf_dir):
    """Open carts of the job after batches in which the removes come a period late."""
    root = run_job(spark, sf_dir, REMOVE, [refresh.CARTS])
    return refresh.read(spark, root, refresh.CARTS).select("session_id", "product_id", "open_quantity")


@query
def stream_session_funnel(spark, sf_dir):
    """The funnel of the job's sessions; views come a period late, so first views change when their adds are stored."""
    root = run_job(spark, sf_dir, VIEW, [refresh.STEPS])
    return refresh.read(spark, root, refresh.FUNNEL)


@query
def stream_lateness(spark, sf_dir):
    """Per minute, how many events came late and by how much; searches come a period late."""
    root = run_job(spark, sf_dir, SEARCH, [refresh.LATENESS])
    return refresh.read(spark, root, refresh.LATENESS)


@query
def active_users_history(spark, sf_dir):
    """Active users of the last five minutes at the end of every minute."""
    return dashboard.active_users_history(shop.shop_events(spark, sf_dir))


@query
def stream_rejected(spark, sf_dir):
    """The dead letters by reason."""
    root = run_job(spark, sf_dir, SEARCH, [])
    letters = refresh.read(spark, root, refresh.LETTERS)
    return letters.groupBy("reject_reason").agg(F.count("message_text").alias("messages"))


@query
def metrics_1hour_rollup(spark, sf_dir):
    """Hours from the stored minutes and their sketches; the events are read for the minutes only."""
    events = shop.shop_events(spark, sf_dir)
    path = scratch(spark, "minutes")
    sinks.write_table(metrics.minute_metrics(events).join(metrics.minute_sketches(events), "time_bucket"), path, "time_bucket")
    return metrics.hour_rollup(spark.read.parquet(path))


@query
def refresh_minutes(spark, sf_dir):
    """A stored minute table that counts all users; the last day is aggregated again, with viewers only."""
    events = shop.shop_events(spark, sf_dir)
    raw, minutes = scratch(spark, "raw"), scratch(spark, "minutes")
    sinks.write_table(events, raw, "timestamp")
    sinks.write_table(metrics.minute_metrics(events, users="all"), minutes, "time_bucket")
    refresh.refresh_minutes(spark, raw, minutes, AS_OF, minutes=DAY)
    return spark.read.parquet(minutes).drop("event_date")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)

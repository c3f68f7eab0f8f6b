"""Event vocabulary, message schema and table columns."""

from __future__ import annotations

from pyspark.sql.types import (
    DecimalType, DoubleType, IntegerType, StringType, StructField, StructType,
)

# Event types.
VIEW = "product_view"
ADD = "add_to_cart"
REMOVE = "remove_from_cart"
PURCHASE = "purchase"
SEARCH = "search"
EVENT_TYPES = [VIEW, ADD, REMOVE, PURCHASE, SEARCH]

# Amounts are summed exactly and turned into doubles last.
MONEY = DecimalType(18, 2)


def _fields(*pairs) -> StructType:
    return StructType([StructField(name, kind) for name, kind in pairs])


# One JSON object per message.
MESSAGE = _fields(
    ("event_id", StringType()),
    ("event_type", StringType()),
    ("timestamp", StringType()),
    ("user_id", StringType()),
    ("session_id", StringType()),
    ("product", _fields(
        ("id", StringType()), ("name", StringType()),
        ("category", StringType()), ("price", DoubleType()))),
    ("quantity", IntegerType()),
    ("total_amount", MONEY),
    ("payment_method", StringType()),
    ("search_query", StringType()),
    ("location", _fields(
        ("city", StringType()), ("country", StringType()), ("ip", StringType()))),
)

REQUIRED = ["event_id", "event_type", "timestamp", "user_id", "session_id"]

# Flat event columns, without the JSON copy `raw_data`.
EVENT_COLUMNS = [
    "event_id", "event_type", "timestamp", "user_id", "session_id",
    "product_id", "product_name", "product_category", "product_price",
    "quantity", "total_amount", "payment_method", "city", "country", "ip_address",
]

PRODUCT = ["product_id", "product_name", "product_category", "product_price"]

METRIC_COLUMNS = [
    "time_bucket", "total_revenue", "total_orders", "average_order_value",
    "total_views", "unique_users", "unique_sessions",
    "add_to_cart_count", "remove_from_cart_count", "purchase_count", "search_count",
    "conversion_rate", "cart_abandonment_rate",
]

HOUR_COLUMNS = [
    "time_bucket", "total_revenue", "total_orders", "average_order_value",
    "total_views", "unique_users", "unique_sessions",
    "add_to_cart_count", "purchase_count",
    "conversion_rate", "cart_abandonment_rate",
    "peak_revenue_per_minute", "peak_orders_per_minute",
]

PRODUCT_METRIC_COLUMNS = [
    "time_bucket", *PRODUCT, "view_count", "purchase_count", "revenue",
    "views_per_minute", "trending_score",
]

GEO_COLUMNS = [
    "time_bucket", "country", "city",
    "total_views", "total_orders", "total_revenue", "unique_users",
]

ALERT_COLUMNS = [
    "alert_type", "severity", "metric_name", "current_value", "threshold_value",
    "percentage_change", "product_id", "product_name", "detected_at",
]

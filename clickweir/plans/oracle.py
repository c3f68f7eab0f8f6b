"""SQL over the given tables that each registered query must equal. Written apart from the operators: plain
grouping, range joins and window functions instead of tallies, evaluation times and cells."""

from __future__ import annotations

import re

EVENTS = """
ev AS (
    SELECT CAST(event_id AS VARCHAR) AS event_id,
           CASE event_type WHEN 'view' THEN 'product_view' WHEN 'click' THEN 'add_to_cart'
                WHEN 'error' THEN 'remove_from_cart' WHEN 'purchase' THEN 'purchase'
                WHEN 'signup' THEN 'search' END AS event_type,
           ts AS "timestamp",
           CAST(user_id AS VARCHAR) AS user_id,
           CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
           CASE WHEN event_type <> 'signup' THEN json_extract_string(props, '$.k') END AS product_id,
           p_name AS product_name, p_type AS product_category, p_retailprice AS product_price,
           CASE WHEN event_type IN ('click', 'error', 'purchase') THEN 1 END AS quantity,
           CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18, 2)) END AS total_amount,
           CAST(NULL AS VARCHAR) AS payment_method,
           n_name AS city, r_name AS country,
           CAST(NULL AS VARCHAR) AS ip_address
    FROM events
    LEFT JOIN part ON event_type <> 'signup' AND p_partkey = CAST(json_extract_string(props, '$.k') AS BIGINT)
    LEFT JOIN customer ON c_custkey = user_id
    LEFT JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN region ON r_regionkey = n_regionkey
)"""

FLAT = """event_id, event_type, "timestamp", user_id, session_id, product_id, product_name, product_category,
    product_price, quantity, CAST(total_amount AS DOUBLE) AS total_amount, payment_method, city, country, ip_address"""

# Columns known without joins.
OWN = """event_id, event_type, "timestamp", user_id, session_id, product_id, quantity,
    CAST(total_amount AS DOUBLE) AS total_amount, payment_method, ip_address"""

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
COMPARED_AT = "TIMESTAMP '2024-01-30 23:59:00'"
CHECKED_AT = "TIMESTAMP '2024-01-27 16:36:00'"
TRENDING_AT = "TIMESTAMP '2024-01-22 20:00:00'"
LAST_DAY = f"""\"timestamp" >= {AS_OF} - INTERVAL 24 HOUR AND "timestamp" < {AS_OF}"""

REVENUE = "COALESCE(CAST(SUM(total_amount) FILTER (event_type = 'purchase') AS DOUBLE), 0.0)"


def _n(event_type: str) -> str:
    return f"COUNT(*) FILTER (event_type = '{event_type}')"


_VIEWS, _BOUGHT, _ADDS = _n("product_view"), _n("purchase"), _n("add_to_cart")


def metrics(unit: str, source: str = "ev", where: str = "TRUE") -> str:
    removed = "" if unit == "hour" else f"""
        {_n('remove_from_cart')} AS remove_from_cart_count, {_n('search')} AS search_count,"""
    return f"""
    SELECT date_trunc('{unit}', "timestamp") AS time_bucket,
        {REVENUE} AS total_revenue, {_BOUGHT} AS total_orders,
        CASE WHEN {_BOUGHT} > 0 THEN {REVENUE} / CAST({_BOUGHT} AS DOUBLE) END AS average_order_value,
        {_VIEWS} AS total_views,
        COUNT(DISTINCT user_id) FILTER (event_type = 'product_view') AS unique_users,
        COUNT(DISTINCT session_id) AS unique_sessions,
        {_ADDS} AS add_to_cart_count,{removed}
        {_BOUGHT} AS purchase_count,
        CASE WHEN {_VIEWS} > 0 THEN CAST({_BOUGHT} AS DOUBLE) / {_VIEWS} * 100 ELSE 0.0 END AS conversion_rate,
        CASE WHEN {_ADDS} > 0 THEN (1 - CAST({_BOUGHT} AS DOUBLE) / {_ADDS}) * 100 ELSE 0.0 END AS cart_abandonment_rate
    FROM {source} WHERE {where} GROUP BY 1"""


HOURS = f"""
    SELECT h.*, peak_revenue_per_minute, peak_orders_per_minute
    FROM ({metrics('hour')}) h
    JOIN (SELECT date_trunc('hour', time_bucket) AS time_bucket,
                 MAX(total_revenue) AS peak_revenue_per_minute, MAX(total_orders) AS peak_orders_per_minute
          FROM ({metrics('minute')}) GROUP BY 1) p USING (time_bucket)"""

PRODUCT = "product_id, product_name, product_category, product_price"


def product_metrics(unit: str = "minute", minutes: int = 1) -> str:
    return f"""
    SELECT date_trunc('{unit}', "timestamp") AS time_bucket, {PRODUCT},
        {_VIEWS} AS view_count, {_BOUGHT} AS purchase_count, {REVENUE} AS revenue,
        {_VIEWS} / {minutes}.0::DOUBLE AS views_per_minute,
        CAST({_VIEWS} * 10 + {_BOUGHT} * 50 AS DOUBLE) AS trending_score
    FROM ev WHERE event_type IN ('product_view', 'purchase')
    GROUP BY ALL"""


PRODUCT_BY_ID = f"""
    SELECT date_trunc('minute', "timestamp") AS time_bucket, product_id,
        MAX(product_name) AS product_name, MAX(product_category) AS product_category,
        MAX(product_price) AS product_price,
        {_VIEWS} AS view_count, {_BOUGHT} AS purchase_count, {REVENUE} AS revenue,
        CAST({_VIEWS} AS DOUBLE) AS views_per_minute,
        CAST({_VIEWS} * 10 + {_BOUGHT} * 50 AS DOUBLE) AS trending_score
    FROM ev WHERE product_id IS NOT NULL
    GROUP BY 1, 2"""

GEO = f"""
    SELECT date_trunc('minute', "timestamp") AS time_bucket, country, city,
        {_VIEWS} AS total_views, {_BOUGHT} AS total_orders, {REVENUE} AS total_revenue,
        COUNT(DISTINCT user_id) AS unique_users
    FROM ev WHERE country IS NOT NULL
    GROUP BY 1, 2, 3"""


def score(minutes: int) -> str:
    return f"""view_count * 1.0::DOUBLE + view_count / {minutes}.0::DOUBLE * 5.0::DOUBLE
        + purchase_count * 10.0::DOUBLE + purchase_count / view_count::DOUBLE * 100"""


def ranked(bucket: str, minutes: int, limit: int) -> str:
    """Top products of the last day, as a whole or per bucket."""
    return f"""
    SELECT *, ROW_NUMBER() OVER (PARTITION BY time_bucket ORDER BY trending_score DESC, product_id) AS rank
    FROM (SELECT *, view_count / {minutes}.0::DOUBLE AS views_per_minute, {score(minutes)} AS trending_score
          FROM (SELECT {bucket} AS time_bucket, {PRODUCT}, {_VIEWS} AS view_count, {_BOUGHT} AS purchase_count,
                       {REVENUE} AS revenue
                FROM ev WHERE product_id IS NOT NULL AND {LAST_DAY} GROUP BY ALL)
          WHERE view_count > 0)
    QUALIFY rank <= {limit}"""


TRENDING_COLUMNS = f"{PRODUCT}, view_count, purchase_count, revenue, views_per_minute, trending_score, rank"

# The parts of alert rows.
ALERT = """alert_type, severity, metric_name, ROUND(current_value, 4) AS current_value, threshold_value,
    ROUND(percentage_change, 4) AS percentage_change, product_id, product_name, detected_at"""
NO_PRODUCT = "CAST(NULL AS VARCHAR) AS product_id, CAST(NULL AS VARCHAR) AS product_name"

# Totals of the hour before each minute and of the hour before that.
def totals(source: str = "ev") -> str:
    return f"""
m AS ({metrics('minute', source)}),
grid AS (
    SELECT UNNEST(generate_series((SELECT MIN(time_bucket) FROM m) + INTERVAL 1 MINUTE, {AS_OF}, INTERVAL 1 MINUTE)) AS t
),
totals AS (
    SELECT t AS detected_at,
        COALESCE(SUM(total_views) FILTER (recent), 0)::BIGINT AS views, COUNT(*) FILTER (recent) AS views_rows,
        COALESCE(SUM(total_views) FILTER (NOT recent), 0)::BIGINT AS views_before,
        COALESCE(SUM(purchase_count) FILTER (recent), 0)::BIGINT AS bought,
        COALESCE(AVG(conversion_rate) FILTER (recent), 0) AS conversion,
        COALESCE(SUM(add_to_cart_count) FILTER (recent AND add_to_cart_count > 0), 0)::BIGINT AS adds,
        COALESCE(SUM(purchase_count) FILTER (recent AND add_to_cart_count > 0), 0)::BIGINT AS bought_with_adds,
        COALESCE(AVG(cart_abandonment_rate) FILTER (recent AND add_to_cart_count > 0), 0) AS abandonment,
        COALESCE(SUM(CAST(total_revenue AS DECIMAL(18, 2))) FILTER (recent), 0)::DECIMAL(18, 2) AS revenue,
        COALESCE(SUM(CAST(total_revenue AS DECIMAL(18, 2))) FILTER (NOT recent), 0)::DECIMAL(18, 2) AS revenue_before
    FROM (SELECT t, m.*, time_bucket >= t - INTERVAL 60 MINUTE AS recent
          FROM grid JOIN m ON time_bucket >= t - INTERVAL 120 MINUTE AND time_bucket < t)
    GROUP BY t
)"""


TOTALS = totals()

CHANGE = "(views::DOUBLE - views_before) / views_before * 100"
DROP = "(views_before::DOUBLE - views) / views_before * 100"
REVENUE_CHANGE = "(revenue::DOUBLE - revenue_before::DOUBLE) / revenue_before::DOUBLE * 100"

ALERTS = {
    "traffic_spike": f"""
    SELECT 'traffic_spike' AS alert_type, 'warning' AS severity, 'total_views' AS metric_name,
        views::DOUBLE AS current_value, views_before::DOUBLE AS threshold_value, {CHANGE} AS percentage_change,
        {NO_PRODUCT}, detected_at,
        'Traffic Spike Detected (+' || format('{{:.0f}}', {CHANGE}) || '%)' AS title,
        'Traffic increased from ' || views_before || ' to ' || views || ' views in the last 60 minutes.' AS description
    FROM totals WHERE views_before > 0 AND {CHANGE} > 50""",
    "traffic_drop": f"""
    SELECT 'traffic_drop' AS alert_type, 'critical' AS severity, 'total_views' AS metric_name,
        views::DOUBLE AS current_value, views_before::DOUBLE AS threshold_value, -({DROP}) AS percentage_change,
        {NO_PRODUCT}, detected_at,
        'Traffic Drop Detected (-' || format('{{:.0f}}', {DROP}) || '%)' AS title,
        'Traffic decreased from ' || views_before || ' to ' || views || ' views in the last 60 minutes.' AS description
    FROM totals WHERE views_before > 0 AND {DROP} > 30""",
    "low_conversion": f"""
    SELECT 'low_conversion' AS alert_type, 'warning' AS severity, 'conversion_rate' AS metric_name,
        conversion AS current_value, 3.0::DOUBLE AS threshold_value, 0.0::DOUBLE AS percentage_change,
        {NO_PRODUCT}, detected_at,
        'Low Conversion Rate (' || format('{{:.1f}}', conversion) || '%)' AS title,
        'Conversion rate dropped to ' || format('{{:.1f}}', conversion) || '% (' || bought || ' purchases / '
            || views || ' views).' AS description
    FROM totals WHERE conversion < 3 AND views > 2""",
    "cart_abandonment": f"""
    SELECT 'high_cart_abandonment' AS alert_type, 'warning' AS severity, 'cart_abandonment_rate' AS metric_name,
        abandonment AS current_value, 80.0::DOUBLE AS threshold_value, 0.0::DOUBLE AS percentage_change,
        {NO_PRODUCT}, detected_at,
        'High Cart Abandonment (' || format('{{:.0f}}', abandonment) || '%)' AS title,
        'Cart abandonment rate is ' || format('{{:.0f}}', abandonment) || '% (' || adds || ' adds, '
            || bought_with_adds || ' purchases).' AS description
    FROM totals WHERE abandonment > 80 AND adds > 2""",
    "revenue_anomaly": f"""
    SELECT 'revenue_anomaly' AS alert_type, CASE WHEN {REVENUE_CHANGE} > 0 THEN 'warning' ELSE 'critical' END AS severity,
        'total_revenue' AS metric_name,
        revenue::DOUBLE AS current_value, revenue_before::DOUBLE AS threshold_value,
        {REVENUE_CHANGE} AS percentage_change, {NO_PRODUCT}, detected_at,
        'Revenue Anomaly Detected (' || format('{{:+.0f}}', {REVENUE_CHANGE}) || '%)' AS title,
        'Revenue ' || CASE WHEN {REVENUE_CHANGE} > 0 THEN 'increased' ELSE 'decreased' END || ' from $'
            || revenue_before || ' to $' || revenue || '.' AS description
    FROM totals WHERE revenue_before > 0 AND ({REVENUE_CHANGE} > 100 OR {REVENUE_CHANGE} < -50)""",
}

# Hourly product rows of the day before each full hour: one row per product, its best hour.
def hot(rows: str, source: str = "ev") -> str:
    return f"""
hourly AS ({rows.replace('FROM ev', f'FROM {source}')}),
hours AS (
    SELECT UNNEST(generate_series((SELECT date_trunc('hour', MIN(time_bucket)) FROM hourly) + INTERVAL 1 HOUR, {AS_OF}, INTERVAL 1 HOUR)) AS t
),
listed AS (SELECT t, hourly.* FROM hours JOIN hourly ON time_bucket >= t - INTERVAL 24 HOUR AND time_bucket < t),
means AS (SELECT t, COALESCE(NULLIF(AVG(views_per_minute), 0), 10.0) AS mean FROM listed GROUP BY t),
best AS (
    SELECT * FROM listed
    QUALIFY ROW_NUMBER() OVER (PARTITION BY t, product_id ORDER BY views_per_minute DESC, time_bucket DESC) = 1
),
buckets AS (
    SELECT t, product_id, product_name, time_bucket, views_per_minute, mean FROM listed JOIN means USING (t)
    WHERE views_per_minute > mean * 3 * (1 + 1e-9)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY t ORDER BY views_per_minute DESC, time_bucket DESC, product_id) <= 5
),
hot AS (
    SELECT 'trending_product' AS alert_type, 'info' AS severity, 'views_per_minute' AS metric_name,
        views_per_minute AS current_value, ROUND(mean * 3, 4) AS threshold_value,
        (views_per_minute - mean) / mean * 100 AS percentage_change, product_id, product_name, t AS detected_at,
        'Trending: ' || product_name AS title,
        product_name || ' is trending with ' || format('{{:.0f}}', views_per_minute) || ' views/min (' || view_count
            || ' total views).' AS description
    FROM best JOIN means USING (t) WHERE views_per_minute > mean * 3 * (1 + 1e-9)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY t ORDER BY views_per_minute DESC, time_bucket DESC, product_id) <= 5
)"""


HOT = hot(product_metrics('hour', 60))

# The same at one minute: the day before it, in hourly rows of the events of that day.
HOT_NOW = f"""
hourly_now AS ({product_metrics('hour', 60).replace("FROM ev WHERE", f"FROM ev WHERE \"timestamp\" >= {CHECKED_AT} - INTERVAL 24 HOUR AND \"timestamp\" < {CHECKED_AT} AND")}),
listed_now AS (SELECT * FROM hourly_now WHERE time_bucket >= {CHECKED_AT} - INTERVAL 24 HOUR AND time_bucket < {CHECKED_AT}),
hot_now AS (
    SELECT 'trending_product' AS alert_type, 'info' AS severity, 'views_per_minute' AS metric_name,
        views_per_minute AS current_value, ROUND(mean * 3, 4) AS threshold_value,
        (views_per_minute - mean) / mean * 100 AS percentage_change, product_id, product_name, {CHECKED_AT} AS detected_at
    FROM (SELECT * FROM listed_now
          QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY views_per_minute DESC, time_bucket DESC) = 1),
         (SELECT COALESCE(NULLIF(AVG(views_per_minute), 0), 10.0) AS mean FROM listed_now)
    WHERE views_per_minute > mean * 3 * (1 + 1e-9)
    QUALIFY ROW_NUMBER() OVER (ORDER BY views_per_minute DESC, time_bucket DESC, product_id) <= 5
)"""

LOG = f"""
{TOTALS}, {HOT},
found AS ({' UNION ALL '.join(ALERTS.values())} UNION ALL SELECT * FROM hot),
log AS (
    SELECT *, sha256(alert_type || '-' || COALESCE(product_id, '') || '-' || strftime(detected_at, '%Y-%m-%d %H:%M:%S')) AS id
    FROM found
)"""

# Events whose messages are not damaged.
GOOD = "good AS (SELECT * FROM ev WHERE product_id IS NULL OR product_id NOT IN ('94', '95', '96', '97', '98', '99'))"

JOB_LOG = f"""
{GOOD}, {totals('good')}, {hot(product_metrics(), 'good')},
found AS ({' UNION ALL '.join(ALERTS.values())} UNION ALL SELECT * FROM hot)"""

OLD = f"detected_at < {AS_OF} - INTERVAL 1 HOUR"


def _with(body: str, *parts: str) -> str:
    return f"WITH {', '.join([EVENTS, *parts])} {body}"


def _alert(name: str, columns: str = ALERT) -> str:
    return _with(f"SELECT {columns} FROM ({ALERTS[name]})", TOTALS)


DAY_METRICS = f"m AS ({metrics('minute', where=LAST_DAY)})"

FUNNEL = """
f AS (
    SELECT COALESCE(SUM(total_views), 0)::BIGINT AS views, COALESCE(SUM(add_to_cart_count), 0)::BIGINT AS add_to_cart,
           COALESCE(SUM(purchase_count), 0)::BIGINT AS purchases FROM m
)"""

SHARES = """
    SELECT stage, n AS count,
        CASE WHEN top > 0 THEN n / top::DOUBLE * 100 ELSE 0.0 END AS pct_of_max,
        CASE WHEN views > 0 THEN ROUND(n / views::DOUBLE * 100, 1) ELSE 0.0 END AS pct_of_views,
        CASE WHEN views > 0 AND purchases / views::DOUBLE * 100 >= 7 THEN 'good'
             WHEN views > 0 AND purchases / views::DOUBLE * 100 >= 3 THEN 'fair' ELSE 'poor' END AS tier
    FROM (SELECT views, purchases, GREATEST(views, add_to_cart, purchases) AS top, 'Product Views' AS stage, views AS n FROM f
          UNION ALL SELECT views, purchases, GREATEST(views, add_to_cart, purchases), 'Add to Cart', add_to_cart FROM f
          UNION ALL SELECT views, purchases, GREATEST(views, add_to_cart, purchases), 'Purchases', purchases FROM f)"""

COMPARISON = f"""
    SELECT CASE WHEN r0 > 0 THEN CAST(format('{{:.1f}}', (r1 - r0) / r0 * 100) AS DOUBLE) ELSE 0.0 END AS revenue_change_percent,
           CASE WHEN o0 > 0 THEN CAST(format('{{:.1f}}', (o1::DOUBLE - o0) / o0 * 100) AS DOUBLE) ELSE 0.0 END AS orders_change_percent,
           r1 AS current_revenue, o1 AS current_orders, ROUND(c1, 4) AS current_conversion, ROUND(c0, 4) AS previous_conversion
    FROM (SELECT COALESCE(CAST(SUM(CAST(total_revenue AS DECIMAL(18, 2))) AS DOUBLE), 0) AS r1,
                 COALESCE(SUM(total_orders), 0)::BIGINT AS o1, COALESCE(AVG(conversion_rate), 0) AS c1
          FROM m WHERE time_bucket >= TIMESTAMP '2024-01-30 23:00:00' AND time_bucket < {COMPARED_AT}) c,
         (SELECT COALESCE(CAST(SUM(CAST(total_revenue AS DECIMAL(18, 2))) AS DOUBLE), 0) AS r0,
                 COALESCE(SUM(total_orders), 0)::BIGINT AS o0, COALESCE(AVG(conversion_rate), 0) AS c0
          FROM m WHERE time_bucket >= TIMESTAMP '2024-01-30 22:00:00'
                   AND time_bucket < TIMESTAMP '2024-01-30 23:00:00') p"""

STATS = f"""
    SELECT 'Total Events' AS metric, CAST(COUNT(*) AS VARCHAR) AS value FROM ev
    UNION ALL SELECT 'Total Revenue', '$' || CAST(ROUND(SUM(total_amount)) AS BIGINT) FROM ev WHERE event_type = 'purchase'
    UNION ALL SELECT 'Total Purchases', CAST(COUNT(*) AS VARCHAR) FROM ev WHERE event_type = 'purchase'
    UNION ALL SELECT 'Unique Users', CAST(COUNT(DISTINCT user_id) AS VARCHAR) FROM ev
    UNION ALL SELECT 'Active Alerts', CAST(COUNT(*) AS VARCHAR) FROM log WHERE NOT ({OLD})"""

# Hourly table of the write queries.
HOURLY = f"""
    SELECT date_trunc('hour', "timestamp") AS time_bucket, {REVENUE} AS total_revenue, {_BOUGHT} AS total_orders
    FROM ev GROUP BY 1"""
OLDER = "time_bucket < TIMESTAMP '2024-01-20'"
NEWER = "time_bucket >= TIMESTAMP '2024-01-15'"
REPLACED = "TIMESTAMP '2024-01-17 10:00:00'"

SESSIONS = """
    SELECT user_id, MIN("timestamp") AS session_start, MAX("timestamp") AS session_end, COUNT(*) AS event_count
    FROM (SELECT *, SUM(starts) OVER (PARTITION BY user_id ORDER BY "timestamp", event_id) AS session
          FROM (SELECT *, CASE WHEN "timestamp" < LAG("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp", event_id)
                                     + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS starts FROM ev))
    GROUP BY user_id, session"""

# The watermark when everything has been read.
SEEN = """(SELECT MAX("timestamp") - INTERVAL 2 MINUTE FROM ev)"""


def _closed(body: str, length: str, kept: str = "TRUE") -> str:
    """Windows that ended before the watermark, which follows the events the operator keeps."""
    return f"""SELECT * FROM ({body})
        WHERE time_bucket + INTERVAL {length} <= (SELECT MAX("timestamp") - INTERVAL 2 MINUTE FROM ev WHERE {kept})"""


LATE = f"""
marks AS (
    SELECT MAX("timestamp") FILTER (event_type <> 'search') - INTERVAL 2 MINUTE AS first_mark,
           MAX("timestamp") - INTERVAL 2 MINUTE AS last_mark FROM ev
),
kept AS (
    SELECT ev.* FROM ev, marks
    WHERE event_type <> 'search' OR date_trunc('minute', "timestamp") + INTERVAL 1 MINUTE > first_mark
)"""

TIME_LABELS = """
shifted AS (
    SELECT event_id, "timestamp" FROM ev UNION ALL SELECT event_id, "timestamp" + INTERVAL 180 DAY FROM ev
),
local AS (
    SELECT event_id, "timestamp", timezone('America/New_York', timezone('UTC', "timestamp")) AS l FROM shifted
)"""

ROUNDING = """
v AS (
    SELECT time_bucket, CASE WHEN total_views + add_to_cart_count + 13 > 0
        THEN total_orders / (total_views + add_to_cart_count + 13)::DOUBLE * 100 ELSE 0.0 END AS value FROM m
)"""

MINUTES = f"m AS ({metrics('minute')})"

TEXT = """
t AS (
    SELECT event_id, CASE event_type
        WHEN 'product_view' THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
        WHEN 'add_to_cart' THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f')
        WHEN 'purchase' THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || '+02:00'
        WHEN 'remove_from_cart' THEN 'soon'
        ELSE CASE CAST(event_id AS BIGINT) % 4 WHEN 0 THEN '' WHEN 1 THEN strftime("timestamp", '%H:%M')
             WHEN 2 THEN strftime("timestamp", '%Y') ELSE strftime("timestamp", '%Y-%m-%dT%H:%M') END END AS text,
        CASE event_type WHEN 'product_view' THEN "timestamp" WHEN 'add_to_cart' THEN "timestamp"
             WHEN 'purchase' THEN "timestamp" - INTERVAL 2 HOUR END AS parsed
    FROM ev
)"""

JSON_TEXT = """
    SELECT event_id, '{"event_id":"' || event_id || '","event_type":"' || event_type || '","user_id":"' || user_id
        || '","session_id":"' || session_id || '"'
        || COALESCE(',"product_id":"' || product_id || '"', '')
        || COALESCE(',"quantity":' || quantity, '')
        || COALESCE(',"total_amount":' || total_amount, '')
        || COALESCE(',"city":"' || city || '"', '') || '}' AS raw_data
    FROM ev"""


def _job_tables() -> str:
    from .queries import JOB_TABLES

    def of(body: str) -> str:
        return body.replace("FROM ev", "FROM good")

    tables = {
        "events_raw": "SELECT * FROM good", "metrics_1min": of(metrics("minute")), "metrics_1hour": of(HOURS),
        "product_metrics": of(product_metrics()), "geo_metrics": of(GEO),
        "rankings": of(ranked('time_bucket(INTERVAL 5 MINUTE, "timestamp")', 5, 20).replace(LAST_DAY, "TRUE")),
    }
    return _with(" UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, CAST("{time}" AS DATE) AS day, COUNT(*) AS row_count,
                   ROUND(SUM(CAST({first} AS DOUBLE)), 2) AS first_sum, ROUND(SUM(CAST({second} AS DOUBLE)), 2) AS second_sum
            FROM ({tables[name]}) GROUP BY 2""" for name, (time, first, second) in JOB_TABLES.items()), GOOD)


def _fields(section: str, query: str, numbers: str, texts: str = "") -> str:
    """A row for each field of each row of a query that is not null."""
    one = "SELECT '{s}' AS section, place, '{c}' AS field, {n} AS number, {t} AS text FROM {s}_rows WHERE {c} IS NOT NULL"
    parts = [one.format(s=section, c=c, n=f"ROUND(CAST({c} AS DOUBLE), 3)", t="CAST(NULL AS VARCHAR)") for c in numbers.split()]
    parts += [one.format(s=section, c=c, n="CAST(NULL AS DOUBLE)", t=f"CAST({c} AS VARCHAR)") for c in texts.split()]
    return f"SELECT * FROM (WITH {section}_rows AS (SELECT *, ROW_NUMBER() OVER () - 1 AS place FROM ({query})) {' UNION ALL '.join(parts)})"


def snapshot_sql(sql: dict[str, str]) -> str:
    return " UNION ALL ".join([
        _fields("live", sql["live_metrics"], "revenue orders active_users conversion_rate cart_abandonment_rate"),
        _fields("funnel", sql["conversion_funnel"], "views add_to_cart purchases cart_rate conversion_rate"),
        _fields("comparison", sql["hourly_comparison"],
                "revenue_change_percent orders_change_percent current_revenue current_orders current_conversion previous_conversion"),
        _fields("trending_products", sql["trending_now"],
                "product_id price views purchases revenue views_per_minute trending_score rank", "product_name category"),
        _fields("alerts", sql["active_alerts"], "current_value threshold change_percent",
                "id type severity title description metric product detected_at"),
        _fields("revenue_trend", sql["revenue_trend"], "revenue orders average_order_value", '"timestamp"').replace("'\"timestamp\"'", "'timestamp'"),
        _fields("geographic", sql["geo_top_locations"], "revenue orders views users", "country city location"),
    ])


def oracle_sql() -> dict[str, str]:
    sql = _own_sql()
    # The job's tables hold the events whose messages are not damaged.
    good = {name: _with(re.sub(r"\bev\b", "good", sql[table].removeprefix(_with(""))), GOOD)
            for name, table in (("stream_cart_state", "cart_state"), ("stream_session_funnel", "session_funnel"))}
    return {**sql, **good, "dashboard_snapshot": snapshot_sql(sql)}


def _own_sql() -> dict[str, str]:
    from .queries import ADHOC_TEXT

    return {
        "metrics_1min": _with(metrics("minute")),
        "metrics_1min_options": _with(f"""
            SELECT m.* REPLACE (COALESCE(average_order_value, 0.0) AS average_order_value, all_users AS unique_users)
            FROM m JOIN (SELECT date_trunc('minute', "timestamp") AS time_bucket, COUNT(DISTINCT user_id) AS all_users FROM ev GROUP BY 1)
            USING (time_bucket)""", MINUTES),
        "metrics_1hour": _with(HOURS),
        "product_metrics_1min": _with(product_metrics()),
        "product_metrics_by_id": _with(PRODUCT_BY_ID),
        "geo_metrics_1min": _with(GEO),
        "trending_top20": _with(f"SELECT {TRENDING_COLUMNS} FROM ({ranked('NULL', 1440, 20)})"),
        "trending_now": _with(f"""
            SELECT product_id, product_name, product_category AS category, product_price AS price, view_count AS views,
                   purchase_count AS purchases, revenue, views_per_minute, trending_score, rank
            FROM (SELECT * FROM ({ranked("date_trunc('hour', \"timestamp\")", 60, 20)})
                  QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY time_bucket DESC) = 1)
            ORDER BY rank, time_bucket DESC, product_id LIMIT 10"""),
        "trending_now_buckets": _with(f"""
            SELECT product_id, product_name, product_category AS category, product_price AS price, view_count AS views,
                   purchase_count AS purchases, revenue, views_per_minute, trending_score, rank
            FROM ({ranked("date_trunc('hour', \"timestamp\")", 60, 20)}) ORDER BY rank, time_bucket DESC, product_id LIMIT 10"""),
        "live_metrics": _with("""
            SELECT COALESCE(CAST(SUM(CAST(total_revenue AS DECIMAL(18, 2))) AS DOUBLE), 0) AS revenue,
                   COALESCE(SUM(total_orders), 0)::BIGINT AS orders,
                   CAST(TRUNC(COALESCE(AVG(unique_users), 0)) AS BIGINT) AS active_users,
                   ROUND(COALESCE(AVG(conversion_rate), 0), 4) AS conversion_rate,
                   ROUND(COALESCE(AVG(cart_abandonment_rate), 0), 4) AS cart_abandonment_rate FROM m""", DAY_METRICS),
        "active_users": _with(f"SELECT COUNT(DISTINCT user_id) AS active_users FROM ev WHERE {LAST_DAY}"),
        "revenue_trend": _with("""
            SELECT time_bucket AS "timestamp", total_revenue AS revenue, total_orders AS orders,
                   COALESCE(average_order_value, 0) AS average_order_value FROM m ORDER BY 1""", DAY_METRICS),
        "conversion_funnel": _with("""
            SELECT views, add_to_cart, purchases,
                CASE WHEN views > 0 THEN CAST(format('{:.2f}', add_to_cart / views::DOUBLE * 100) AS DOUBLE) ELSE 0.0 END AS cart_rate,
                CASE WHEN views > 0 THEN CAST(format('{:.2f}', purchases / views::DOUBLE * 100) AS DOUBLE) ELSE 0.0 END
                    AS conversion_rate FROM f""", DAY_METRICS, FUNNEL),
        "funnel_shares": _with(SHARES, DAY_METRICS, FUNNEL),
        "geo_top_locations": _with(f"""
            SELECT country, city, city || ', ' || country AS location, {REVENUE} AS revenue, {_BOUGHT} AS orders,
                   {_VIEWS} AS views, COUNT(DISTINCT user_id) AS users
            FROM ev WHERE {LAST_DAY} AND country IS NOT NULL AND city IS NOT NULL
            GROUP BY country, city ORDER BY revenue DESC, country, city LIMIT 10"""),
        "hourly_comparison": _with(COMPARISON, MINUTES),
        "alert_traffic_spike": _alert("traffic_spike"),
        "alert_traffic_drop": _alert("traffic_drop"),
        "alert_low_conversion": _alert("low_conversion"),
        "alert_cart_abandonment": _alert("cart_abandonment"),
        "alert_revenue_anomaly": _alert("revenue_anomaly"),
        "alert_trending_product": _with(f"SELECT {ALERT} FROM hot", HOT),
        "alert_trending_buckets": _with("""
            SELECT 'trending_product' AS alert_type, 'info' AS severity, 'views_per_minute' AS metric_name,
                ROUND(views_per_minute, 4) AS current_value, ROUND(mean * 3, 4) AS threshold_value,
                ROUND((views_per_minute - mean) / mean * 100, 4) AS percentage_change, product_id, product_name, t AS detected_at,
                time_bucket AS source_bucket,
                sha256('trending_product-' || product_id || '-' || strftime(t, '%Y-%m-%d %H:%M:%S') || '-'
                    || strftime(time_bucket, '%Y-%m-%d %H:%M:%S')) AS id
            FROM buckets""", HOT),
        "alert_trending_now": _with(f"SELECT {ALERT} FROM hot WHERE detected_at = {TRENDING_AT}", HOT),
        "alert_messages": _with(f"SELECT {ALERT}, title, description FROM found", LOG),
        "alert_options": _with(f"""
            SELECT {ALERT} FROM ({ALERTS['traffic_drop']} AND views_rows > 0) UNION ALL
            SELECT {ALERT} FROM ({ALERTS['revenue_anomaly'].replace('< -50', '< -100')})""", TOTALS),
        "alerts_all": _with(f"""
            SELECT {ALERT}, id, TRUE AS is_active, CAST(NULL AS TIMESTAMP) AS resolved_at FROM log""", LOG),
        "alerts_resolved": _with(f"""
            SELECT {ALERT}, id, NOT ({OLD}) AS is_active, CASE WHEN {OLD} THEN {AS_OF} END AS resolved_at FROM log""", LOG),
        "active_alerts": _with(f"""
            SELECT id, alert_type AS type, severity, title, description, metric_name AS metric,
                   ROUND(current_value, 4) AS current_value, threshold_value AS threshold,
                   ROUND(percentage_change, 4) AS change_percent, product_name AS product, detected_at
            FROM log WHERE NOT ({OLD}) ORDER BY detected_at DESC, id LIMIT 10""", LOG),
        "alert_episodes": _with("""
            SELECT alert_type, product_id, MAX(severity) AS severity, MAX(product_name) AS product_name, MIN(detected_at) AS begin_at, MAX(detected_at) AS end_at,
                   SUM(n)::BIGINT AS alerts, MAX(change) AS peak_change, ROUND(MAX(excess), 4) AS peak_excess, TRUE AS is_active
            FROM (SELECT *, SUM(begins) OVER (PARTITION BY alert_type, product_id ORDER BY detected_at) AS run FROM (
                SELECT *, CASE WHEN LAG(detected_at) OVER (PARTITION BY alert_type, product_id ORDER BY detected_at) >= detected_at - INTERVAL 60 MINUTE
                    THEN 0 ELSE 1 END AS begins
                FROM (SELECT alert_type, product_id, detected_at, COUNT(*) AS n, MAX(severity) AS severity, MAX(product_name) AS product_name,
                        MAX(ABS(ROUND(percentage_change, 4))) AS change, MAX(ABS(ROUND(current_value, 4) - ROUND(threshold_value, 4))) AS excess
                      FROM log GROUP BY 1, 2, 3)))
            GROUP BY alert_type, product_id, run""", LOG),
        "alerts_now": _with(f"""
            SELECT {ALERT} FROM found WHERE alert_type <> 'trending_product' AND detected_at = {CHECKED_AT}
            UNION ALL SELECT {ALERT} FROM hot_now""", LOG, HOT_NOW),
        "stats_report": _with(STATS, LOG),
        "recent_events": _with("""
            SELECT event_type, "timestamp", user_id, product_name, CAST(total_amount AS DOUBLE) AS total_amount
            FROM ev ORDER BY "timestamp" DESC, event_id DESC LIMIT 10"""),
        "recent_purchases": _with("""
            SELECT "timestamp", user_id, product_name, CAST(total_amount AS DOUBLE) AS total_amount
            FROM ev WHERE event_type = 'purchase' ORDER BY "timestamp" DESC, event_id DESC LIMIT 10"""),
        "latest_metrics": _with("""
            SELECT time_bucket, total_revenue, total_orders, unique_users, conversion_rate, cart_abandonment_rate
            FROM m ORDER BY time_bucket DESC LIMIT 10""", MINUTES),
        "adhoc_sql": ADHOC_TEXT,
        "decode_events": _with("""
            SELECT event_id, event_type, "timestamp", user_id, session_id, product_id, product_price, quantity,
                   CAST(total_amount AS DOUBLE) AS total_amount, city
            FROM ev WHERE product_id IS NULL OR product_id NOT IN ('94', '95', '96', '97', '98', '99')"""),
        "reject_malformed": _with("""
            SELECT CASE product_id WHEN '95' THEN 'wrong type' WHEN '97' THEN 'malformed json' WHEN '96' THEN 'bad timestamp'
                        WHEN '98' THEN 'bad timestamp' ELSE 'missing user_id' END AS reject_reason,
                   COUNT(*) AS messages, COUNT(*) FILTER (product_id IN ('95', '97')) AS with_text
            FROM ev WHERE product_id IN ('94', '95', '96', '97', '98', '99') GROUP BY 1"""),
        "flatten_events": _with(f"SELECT {FLAT} FROM ev"),
        "default_fill": _with("""
            SELECT event_id, event_type, COALESCE(quantity, 1) AS quantity,
                   CAST(COALESCE(total_amount, 0) AS DOUBLE) AS total_amount, COALESCE(product_price, 0) AS product_price
            FROM ev"""),
        "default_quantity": _with("""
            SELECT event_id, event_type, COALESCE(quantity, 1) AS quantity, CAST(total_amount AS DOUBLE) AS total_amount, product_price
            FROM ev"""),
        "row_to_json": _with(JSON_TEXT),
        "parse_timestamp": _with("SELECT * FROM t", TEXT),
        "dedup_events": _with("""
            SELECT event_id, event_type, "timestamp", user_id, CAST(total_amount AS DOUBLE) AS total_amount, product_id
            FROM ev"""),
        "safe_ratio": _with("""
            SELECT time_bucket, total_views, add_to_cart_count, purchase_count,
                CASE WHEN total_views > 0 THEN purchase_count / total_views::DOUBLE ELSE 0.0 END AS per_view,
                CASE WHEN total_views > 0 THEN purchase_count / total_views::DOUBLE END AS per_view_or_null,
                CASE WHEN total_views > 0 THEN add_to_cart_count / total_views::DOUBLE * 100 ELSE 0.0 END AS cart_percent,
                cart_abandonment_rate AS abandonment
            FROM m""", MINUTES),
        "percent_change": _with("""
            SELECT *, CASE WHEN previous > 0 THEN (current - previous) / previous * 100 ELSE 0.0 END AS change
            FROM (SELECT date_trunc('hour', "timestamp") AS time_bucket,
                    COALESCE(CAST(SUM(total_amount) FILTER (minute("timestamp") >= 30) AS DOUBLE), 0) AS current,
                    COALESCE(CAST(SUM(total_amount) FILTER (minute("timestamp") < 30) AS DOUBLE), 0) AS previous
                  FROM ev GROUP BY 1)"""),
        "rounding": _with("""
            SELECT time_bucket, value, CAST(format('{:.0f}', value) AS DOUBLE) AS to_0,
                CAST(format('{:.1f}', value) AS DOUBLE) AS to_1, CAST(format('{:.2f}', value) AS DOUBLE) AS to_2,
                format('{:.1f}', value) AS text_1 FROM v""", MINUTES, ROUNDING),
        "time_buckets": _with(f"""
            SELECT event_id, "timestamp", date_trunc('minute', "timestamp") AS minute_start,
                date_trunc('hour', "timestamp") AS hour_start,
                time_bucket(INTERVAL 5 MINUTE, "timestamp") AS five_minutes,
                "timestamp" >= {AS_OF} - INTERVAL 24 HOUR AS in_last_day FROM ev"""),
        "local_time_labels": _with("""
            SELECT event_id, "timestamp", strftime(l, '%-I:%M:%S %p') || ' ET' AS clock,
                strftime(l, '%I:%M:%S %p') || ' ET (Charlotte, NC)' AS clock_place,
                strftime(l, '%b %-d, %I:%M %p') || ' ET' AS date_time,
                strftime(l, '%-I:%M %p') AS chart,
                CASE WHEN "timestamp" - l = INTERVAL 4 HOUR THEN 'EDT' ELSE 'EST' END AS daylight,
                CASE WHEN "timestamp" - l = INTERVAL 4 HOUR THEN 'EDT (Eastern Daylight Time) - Charlotte, NC'
                     ELSE 'EST (Eastern Standard Time) - Charlotte, NC' END AS zone
            FROM local""", TIME_LABELS),
        "display_formats": _with("""
            SELECT time_bucket, total_revenue, total_views, cart_abandonment_rate,
                '$' || format('{:,}', CAST(ROUND(total_revenue * 1000) AS BIGINT)) AS revenue_text,
                CASE WHEN ROUND(total_revenue) > 0 THEN '-' ELSE '' END
                    || '$' || format('{:,}', CAST(ROUND(total_revenue) AS BIGINT)) AS refund_text,
                format('{:,}', CAST(total_views * 12345 AS BIGINT)) AS views_text,
                format('{:+.1f}', cart_abandonment_rate) || '%' AS abandonment_text
            FROM m""", MINUTES),
        "upsert_metrics": _with(f"""
            SELECT time_bucket, CASE WHEN {NEWER} THEN total_revenue * 2 ELSE total_revenue END AS total_revenue, total_orders
            FROM ({HOURLY})"""),
        "insert_absent_metrics": _with(f"""
            SELECT time_bucket, CASE WHEN {OLDER} THEN total_revenue ELSE total_revenue * 2 END AS total_revenue, total_orders
            FROM ({HOURLY})"""),
        "replace_bucket": _with(f"""
            SELECT time_bucket, CASE WHEN time_bucket = {REPLACED} THEN total_revenue * 2 ELSE total_revenue END AS total_revenue,
                   total_orders
            FROM ({HOURLY}) WHERE {OLDER}"""),
        "retention_filter": _with(f"""SELECT {OWN} FROM ev WHERE "timestamp" >= {AS_OF} - INTERVAL 7 DAY"""),
        "partitioned_scan": _with(f"""
            SELECT {OWN} FROM ev
            WHERE "timestamp" >= TIMESTAMP '2024-01-10' AND "timestamp" < TIMESTAMP '2024-01-17'"""),
        "sessionize": _with(SESSIONS),
        "cart_state": _with("""
            SELECT session_id, product_id,
                   SUM(CASE event_type WHEN 'add_to_cart' THEN quantity ELSE -quantity END)::BIGINT AS open_quantity
            FROM ev WHERE event_type IN ('add_to_cart', 'remove_from_cart', 'purchase')
            GROUP BY 1, 2 HAVING open_quantity > 0"""),
        "session_funnel": _with("""
            SELECT COUNT(DISTINCT session_id) AS sessions,
                COUNT(DISTINCT session_id) FILTER (event_type = 'product_view') AS viewed,
                (SELECT COUNT(DISTINCT a.session_id) FROM ev a WHERE a.event_type = 'add_to_cart' AND EXISTS (
                    SELECT 1 FROM ev v WHERE v.session_id = a.session_id AND v.event_type = 'product_view'
                        AND v."timestamp" < a."timestamp")) AS carted_after_view,
                (SELECT COUNT(DISTINCT p.session_id) FROM ev p WHERE p.event_type = 'purchase' AND EXISTS (
                    SELECT 1 FROM ev a JOIN ev v ON v.session_id = a.session_id AND v.event_type = 'product_view'
                        AND v."timestamp" < a."timestamp"
                    WHERE a.session_id = p.session_id AND a.event_type = 'add_to_cart'
                        AND a."timestamp" < p."timestamp")) AS purchased_after_cart
            FROM ev"""),
        "stream_raw_events": _with(f"SELECT {FLAT} FROM ev"),
        "stream_metrics_1min": _with(_closed(metrics("minute"), "1 MINUTE")),
        "stream_metrics_1hour": _with(_closed(HOURS, "1 HOUR")),
        "stream_product_metrics": _with(_closed(
            product_metrics(), "1 MINUTE", "event_type IN ('product_view', 'purchase')")),
        "stream_geo_metrics": _with(_closed(GEO, "1 MINUTE", "country IS NOT NULL")),
        "stream_sessionize": _with(f"SELECT * FROM ({SESSIONS}) WHERE session_end + INTERVAL 12 HOUR <= {SEEN}"),
        "stream_dedup": _with("""SELECT event_id, event_type, "timestamp", user_id, product_id FROM ev"""),
        "stream_all_tables": _job_tables(),
        "stream_alert_log": _with(f"""
            SELECT {ALERT.replace('threshold_value', 'ROUND(threshold_value, 4) AS threshold_value')},
                sha256(alert_type || '-' || COALESCE(product_id, '') || '-' || strftime(detected_at, '%Y-%m-%d %H:%M:%S')) AS id,
                detected_at >= (SELECT date_trunc('minute', MAX("timestamp")) FROM good) - INTERVAL 1 HOUR AS is_active
            FROM found WHERE detected_at <= (SELECT date_trunc('minute', MAX("timestamp")) FROM good)""", JOB_LOG),
        "active_users_history": _with("""
            SELECT as_of, COUNT(DISTINCT user_id) AS active_users FROM (
                SELECT user_id, unnest(generate_series(date_trunc('minute', "timestamp") + INTERVAL 1 MINUTE, date_trunc('minute', "timestamp") + INTERVAL 5 MINUTE,
                    INTERVAL 1 MINUTE)) AS as_of FROM ev WHERE user_id IS NOT NULL) GROUP BY as_of"""),
        "stream_lateness": _with("""
            SELECT date_trunc('minute', "timestamp") AS time_bucket, COUNT(*) AS events, COUNT(*) FILTER (behind > 120) AS late_events,
                   COALESCE(MAX(behind) FILTER (behind > 120), 0) AS most_late_seconds
            FROM (SELECT b."timestamp", date_diff('microsecond', b."timestamp", until) / 1e6::DOUBLE AS behind FROM batches b JOIN known USING (batch)) GROUP BY 1""",
            GOOD, """batches AS (SELECT *, CASE WHEN "timestamp" < DATE '2024-01-11' THEN 0 WHEN "timestamp" < DATE '2024-01-21' THEN 1 ELSE 2 END
                + CASE WHEN event_type = 'search' THEN 1 ELSE 0 END AS batch FROM good)""",
            """known AS (SELECT batch, MAX(MAX("timestamp")) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM batches GROUP BY batch)"""),
        "stream_hours_from_minutes": _with(f"""
            SELECT h.*, TRUE AS users_near, TRUE AS sessions_near FROM ({HOURS.replace("FROM ev", "FROM good")}) h""", GOOD),
        "stream_rejected": _with("""
            SELECT CASE product_id WHEN '95' THEN 'wrong type' WHEN '97' THEN 'malformed json' WHEN '96' THEN 'bad timestamp'
                        WHEN '98' THEN 'bad timestamp' ELSE 'missing user_id' END AS reject_reason, COUNT(*) AS messages
            FROM ev WHERE product_id IN ('94', '95', '96', '97', '98', '99') GROUP BY 1"""),
        "metrics_1hour_rollup": _with(HOURS),
        "refresh_minutes": _with(f"""
            SELECT m.* REPLACE (CASE WHEN time_bucket >= {AS_OF} - INTERVAL 24 HOUR THEN unique_users ELSE all_users END AS unique_users)
            FROM m JOIN (SELECT date_trunc('minute', "timestamp") AS time_bucket, COUNT(DISTINCT user_id) AS all_users FROM ev GROUP BY 1)
            USING (time_bucket)""", MINUTES),
        "stream_late_data": _with(f"""
            SELECT m.* FROM ({metrics('minute', 'kept')}) m, marks WHERE time_bucket + INTERVAL 1 MINUTE <= last_mark""", LATE),
    }

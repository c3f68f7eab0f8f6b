"""Anomaly detectors and the alert log.

A detector judges one evaluation time from the metric rows of the minutes before it. Given `as_of` it
judges that time; without, it judges every step of the history. Both use the same rule: each metric row
is paired with the evaluation times whose span covers it, and rows are aggregated per evaluation time.
All rules on minute metrics are evaluated together in one aggregate, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.display import fixed
from ..functions.money import cents, dollars
from ..functions.ratios import safe_ratio
from ..functions.times import at, between, from_micros, instant, lookback, micros, minutes as span_of
from ..schemas import ALERT_COLUMNS, MONEY

TEXT_COLUMNS = ["title", "description"]

# The bucket of an alert that one bucket raised by itself, else null.
SOURCE = "source_bucket"

_AT = "detected_at"


@dataclass(frozen=True)
class Rule:
    """Aggregates over the rows of one evaluation time, and the finding they give, null when none is due.

    `minutes` is the period the rule speaks of, `reads` how many minutes back its rows reach.
    """
    alert_type: str
    minutes: int
    reads: int
    measures: tuple[Column, ...]
    finding: Column


_MINUTE = 60_000_000


def _evaluations(rows: DataFrame, minutes: int, as_of, step_minutes: int, until, since=None) -> DataFrame:
    """Rows paired with the evaluation times whose last `minutes` hold their bucket.

    Times are numbers here: `bucket` and `at`. `since` begins a history, and rows before the span of its first time are
    not read; `until` ends it; without them all times from the first row to a span after the last are judged.
    """
    span, step = minutes * _MINUTE, step_minutes * _MINUTE
    bucket = F.col("bucket")
    if as_of is not None:
        recent = lookback(rows, "time_bucket", as_of, minutes=minutes)
        return recent.withColumns({"bucket": micros(F.col("time_bucket")), "at": micros(at(as_of))})
    start = None if since is None else instant(since) - timedelta(minutes=minutes)
    numbered = between(rows, "time_bucket", start, until).withColumn("bucket", micros(F.col("time_bucket")))
    first = bucket - F.pmod(bucket, F.lit(step)) + step
    if since is not None:
        begin = micros(at(since))
        first = F.greatest(first, begin + F.pmod(-begin, F.lit(step)))
    last = bucket + span if until is None else F.least(bucket + span, micros(at(until)))
    times = F.when(first <= last, F.sequence(first, last, F.lit(step).cast("bigint")))
    return numbered.withColumn("at", F.explode(times))


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn(_AT, from_micros(F.col("at")))


def _in_last(minutes: int) -> Column:
    return F.col("bucket") >= F.col("at") - minutes * _MINUTE


def _in_previous(minutes: int) -> Column:
    return ~_in_last(minutes) & _in_last(2 * minutes)


def _pair(name: str, column: Column, minutes: int, missing: str) -> tuple[Column, ...]:
    """Sums of the current and the previous period. A period without rows counts as 0, or stays null."""
    def sum_over(where: Column) -> Column:
        value = F.sum(F.when(where, column))
        return F.coalesce(value, F.lit(0)) if missing == "zero" else value

    return (sum_over(_in_last(minutes)).alias(f"{name}_current"),
            sum_over(_in_previous(minutes)).alias(f"{name}_previous"))


def _relative(change: Column, base: Column) -> Column:
    """Percent of `base`; 0 when either is missing or the base is 0."""
    return safe_ratio(change.cast("double"), base, 0.0) * 100


def _finding(alert_type: str, severity: Column, metric: str, current: Column, threshold: Column, change: Column,
             first: Column, second: Column) -> Column:
    """The numbers of an alert, with the two counts that its text mentions besides."""
    return F.struct(
        F.lit(alert_type).alias("alert_type"),
        severity.alias("severity"),
        F.lit(metric).alias("metric_name"),
        current.cast("double").alias("current_value"),
        threshold.cast("double").alias("threshold_value"),
        change.cast("double").alias("percentage_change"),
        first.cast("bigint").alias("first_count"),
        second.cast("bigint").alias("second_count"),
    )


def traffic_spike(minutes: int = 5, threshold: float = 0.50, missing: str = "zero") -> Rule:
    """Views of the period against the period before: growth above the threshold."""
    current, previous = F.col("spike_current"), F.col("spike_previous")
    change = _relative(current - previous, previous)
    return Rule("traffic_spike", minutes, 2 * minutes, _pair("spike", F.col("total_views"), minutes, missing), F.when(
        change > threshold * 100,
        _finding("traffic_spike", F.lit("warning"), "total_views", current, previous, change, previous, current)))


def traffic_drop(minutes: int = 5, threshold: float = 0.30, missing: str = "zero") -> Rule:
    """Views of the period against the period before: loss above the threshold.

    With ``missing="null"`` a period without any row raises no alert; by default it is a full loss.
    """
    current, previous = F.col("drop_current"), F.col("drop_previous")
    drop = _relative(previous - current, previous)
    return Rule("traffic_drop", minutes, 2 * minutes, _pair("drop", F.col("total_views"), minutes, missing), F.when(
        drop > threshold * 100,
        _finding("traffic_drop", F.lit("critical"), "total_views", current, previous, -drop, previous, current)))


def low_conversion(minutes: int = 10, threshold: float = 0.03, min_views: int = 100) -> Rule:
    """Mean of the minutes' conversion rates below the threshold, given enough views."""
    last = _in_last(minutes)
    rate = F.coalesce("conversion_mean", F.lit(0.0))
    views, purchases = F.col("conversion_views"), F.col("conversion_purchases")
    return Rule("low_conversion", minutes, minutes, (
        F.avg(F.when(last, F.col("conversion_rate"))).alias("conversion_mean"),
        F.sum(F.when(last, F.col("total_views"))).alias("conversion_views"),
        F.sum(F.when(last, F.col("purchase_count"))).alias("conversion_purchases"),
    ), F.when(
        (rate < threshold * 100) & (views > min_views),
        _finding("low_conversion", F.lit("warning"), "conversion_rate", rate, F.lit(threshold * 100), F.lit(0.0),
                 purchases, views)))


def high_cart_abandonment(minutes: int = 10, threshold: float = 0.80, min_adds: int = 10) -> Rule:
    """Mean abandonment of the minutes with cart adds above the threshold, given enough adds."""
    last = _in_last(minutes) & (F.col("add_to_cart_count") > 0)
    rate = F.coalesce("abandonment_mean", F.lit(0.0))
    adds, purchases = F.col("abandonment_adds"), F.col("abandonment_purchases")
    return Rule("high_cart_abandonment", minutes, minutes, (
        F.avg(F.when(last, F.col("cart_abandonment_rate"))).alias("abandonment_mean"),
        F.sum(F.when(last, F.col("add_to_cart_count"))).alias("abandonment_adds"),
        F.sum(F.when(last, F.col("purchase_count"))).alias("abandonment_purchases"),
    ), F.when(
        (rate > threshold * 100) & (adds > min_adds),
        _finding("high_cart_abandonment", F.lit("warning"), "cart_abandonment_rate", rate, F.lit(threshold * 100),
                 F.lit(0.0), adds, purchases)))


def revenue_anomaly(minutes: int = 10, up_pct: float = 100.0, down_pct: float = 50.0, missing: str = "zero") -> Rule:
    """Revenue against the period before: growth above `up_pct` or loss above `down_pct`, previous revenue positive.

    ``down_pct=100`` is the literal limit of the original detector, which no loss can exceed.
    """
    current, previous = F.col("revenue_current"), F.col("revenue_previous")
    # From amounts, not from cents: the text shows the change rounded, and a tie may fall on either side.
    now, before = current.cast("double") / 100, previous.cast("double") / 100
    change = _relative(now - before, before)
    due = ((change > up_pct) | (change < -down_pct)) & (previous > 0)
    return Rule("revenue_anomaly", minutes, 2 * minutes,
                _pair("revenue", cents(F.col("total_revenue")), minutes, missing), F.when(
        due,
        _finding("revenue_anomaly", F.when(change > 0, "warning").otherwise("critical"), "total_revenue",
                 dollars(current), dollars(previous), change, previous, current)))


def _texts(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Title and description by alert type. The wording."""
    minutes = {rule.alert_type: rule.minutes for rule in rules}
    kind, change, current = F.col("alert_type"), F.col("percentage_change"), F.col("current_value")
    first, second = F.col("first_count"), F.col("second_count")
    texts = {
        "traffic_spike": lambda m: (
            _text("Traffic Spike Detected (+", fixed(change, 0), "%)"),
            _text("Traffic increased from ", first, " to ", second, f" views in the last {m} minutes.")),
        "traffic_drop": lambda m: (
            _text("Traffic Drop Detected (-", fixed(-change, 0), "%)"),
            _text("Traffic decreased from ", first, " to ", second, f" views in the last {m} minutes.")),
        "low_conversion": lambda m: (
            _text("Low Conversion Rate (", fixed(current, 1), "%)"),
            _text("Conversion rate dropped to ", fixed(current, 1), "% (", first, " purchases / ", second, " views).")),
        "high_cart_abandonment": lambda m: (
            _text("High Cart Abandonment (", fixed(current, 0), "%)"),
            _text("Cart abandonment rate is ", fixed(current, 0), "% (", first, " adds, ", second, " purchases).")),
        "revenue_anomaly": lambda m: (
            _text("Revenue Anomaly Detected (", fixed(change, 0, signed=True), "%)"),
            _text("Revenue ", F.when(change > 0, "increased").otherwise("decreased"),
                  " from $", F.col("threshold_value").cast(MONEY), " to $", current.cast(MONEY), ".")),
    }
    title = description = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, m in minutes.items():
        title = title.when(kind == name, texts[name](m)[0])
        description = description.when(kind == name, texts[name](m)[1])
    return title, description


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def minute_rules() -> list[Rule]:
    """The five rules on minute metrics with their default limits."""
    return [traffic_spike(), traffic_drop(), low_conversion(), high_cart_abandonment(), revenue_anomaly()]


def evaluate(metrics: DataFrame, rules: Sequence[Rule], as_of=None, step_minutes: int = 1, until=None, since=None) -> DataFrame:
    """Alerts of all rules from one pass over the minute metrics: at `as_of`, or at every step from `since` to `until`."""
    rows = _evaluations(metrics, max(rule.reads for rule in rules), as_of, step_minutes, until, since)
    totals = rows.groupBy("at").agg(*[measure for rule in rules for measure in rule.measures])
    findings = (
        totals.select("at", F.explode(F.array(*[rule.finding for rule in rules])).alias("finding"))
        .filter(F.col("finding").isNotNull())
        .select("at", "finding.*")
    )
    title, description = _texts(rules)
    nothing = F.lit(None).cast("string")
    return _dated(findings).withColumns({
        "product_id": nothing, "product_name": nothing, "title": title, "description": description,
        SOURCE: F.lit(None).cast("timestamp_ntz"),
    }).select(*ALERT_COLUMNS, *TEXT_COLUMNS, SOURCE)


def trending_products(products: DataFrame, as_of=None, minutes: int = 5, multiplier: float = 3.0,
                      fallback: float = 10.0, limit: int = 5, step_minutes: int = 1,
                      until=None, all_buckets: bool = False, since=None) -> DataFrame:
    """Products viewed more than `multiplier` times as often as the mean of all rows in the lookback.

    `products` holds product metrics or rankings. A product's buckets count once, by the best of them;
    `all_buckets` lets each bucket raise an alert of its own.

    Means come from one row per bucket, not from all product rows, and only rows that pass the lowest of the means are
    paired with evaluation times. At one time the mean is a scalar; in a history it is joined by time.
    """
    def usual(total: Column, rows: Column) -> Column:
        mean = safe_ratio(total, rows, None)
        return F.when(mean != 0, mean).otherwise(F.lit(float(fallback)))

    views, mean, name = F.col("views_per_minute"), F.col("mean"), F.col("product_name")
    # The mean's last digits depend on the order of addition: what only they put above the limit is equal to it.
    factor = multiplier * (1 + 1e-9)
    buckets = products.groupBy("time_bucket").agg(F.sum("views_per_minute").alias("total"), F.count("views_per_minute").alias("rows"))
    spread = _evaluations(buckets, minutes, as_of, step_minutes, until, since)
    if as_of is not None:
        seen = _evaluations(products, minutes, as_of, step_minutes, until)
        hot = seen.withColumn("mean", spread.agg(usual(F.sum("total"), F.sum("rows"))).scalar())
    else:
        means = spread.groupBy("at").agg(usual(F.sum("total"), F.sum("rows")).alias("mean"))
        above = products.filter(views > means.agg(F.min("mean")).scalar() * factor)
        hot = _evaluations(above, minutes, as_of, step_minutes, until, since).join(means, "at")
    hot = hot.filter(views > mean * factor)
    if not all_buckets:
        top = F.max(F.struct("views_per_minute", "time_bucket", "product_name", "view_count"))
        hot = hot.groupBy("at", "mean", "product_id").agg(top.alias("top")).select("at", "mean", "product_id", "top.*")
    best = [F.desc_nulls_last("views_per_minute"), F.desc_nulls_last("time_bucket"), F.asc_nulls_last("product_id")]
    listed = hot.withColumn("place", F.row_number().over(Window.partitionBy("at").orderBy(*best)))
    source = F.col("time_bucket") if all_buckets else F.lit(None).cast("timestamp_ntz")
    return _dated(listed.filter(F.col("place") <= limit)).select(
        F.lit("trending_product").alias("alert_type"), F.lit("info").alias("severity"),
        F.lit("views_per_minute").alias("metric_name"), views.cast("double").alias("current_value"),
        (mean * multiplier).alias("threshold_value"), _relative(views - mean, mean).alias("percentage_change"),
        "product_id", "product_name", _AT,
        _text("Trending: ", name).alias("title"),
        _text(name, " is trending with ", fixed(views, 0), " views/min (", F.col("view_count"), " total views).")
        .alias("description"), source.alias(SOURCE),
    )


def run_all_checks(metrics: DataFrame, products: DataFrame, as_of=None, until=None, since=None,
                   rules: Sequence[Rule] | None = None, **trending) -> DataFrame:
    """Alerts of all six detectors as log rows, with their default limits unless `rules` and keywords of
    `trending_products` say otherwise."""
    return recorded(
        evaluate(metrics, rules or minute_rules(), as_of, until=until, since=since)
        .unionByName(trending_products(products, as_of, until=until, since=since, **trending)))


def alert_id() -> Column:
    """The same alert always gets the same id, so a repeated run adds nothing new. Alerts that name the bucket they come
    from have it in their id."""
    def text(column: str) -> Column:
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss")

    return F.sha2(F.concat_ws("-", "alert_type", F.coalesce("product_id", F.lit("")), text(_AT), text(SOURCE)), 256)


def recorded(alerts: DataFrame) -> DataFrame:
    """Log rows: id, and active until resolved."""
    return alerts.withColumns({
        "id": alert_id(),
        "is_active": F.lit(True),
        "resolved_at": F.lit(None).cast("timestamp_ntz"),
    })


def resolved(log: DataFrame, as_of, hours: float = 1) -> DataFrame:
    """State of the log at `as_of`: alerts older than `hours` are resolved. The log itself is only appended to."""
    expires = F.col("is_active") & (F.col(_AT) < at(as_of) - span_of(int(hours * 60)))
    return log.withColumns({
        "resolved_at": F.when(expires, at(as_of)).otherwise(F.col("resolved_at")),
        "is_active": F.col("is_active") & ~expires,
    })


def episodes(log: DataFrame, gap_minutes: int = 1) -> DataFrame:
    """Runs of alerts of one type and product that follow each other by at most `gap_minutes`: a condition that lasts
    raises an alert at every evaluation, and an episode is one row of it, with its begin and end, how many alerts it has,
    the largest change, the value furthest from its threshold and whether an alert of it is still active.

    Only times of evaluation are put in order per type and product, so a group's rows are bounded by the time covered.
    Alerts of one time (of different buckets) are one step of the run.
    """
    key = ["alert_type", "product_id"]
    steps = log.groupBy(*key, _AT).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs("percentage_change")).alias("change"), F.max(F.abs(F.col("current_value") - F.col("threshold_value"))).alias("excess"),
        F.max("severity").alias("severity"), F.max("product_name").alias("product_name"), F.max(F.col("is_active").cast("int")).alias("active"))
    in_order = Window.partitionBy(*key).orderBy(_AT)
    begins = F.coalesce(F.lag(_AT).over(in_order) + span_of(gap_minutes) < F.col(_AT), F.lit(True))
    runs = steps.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(in_order))
    return runs.groupBy(*key, "run").agg(
        F.max("severity").alias("severity"), F.max("product_name").alias("product_name"), F.min(_AT).alias("begin_at"), F.max(_AT).alias("end_at"),
        F.sum("n").alias("alerts"), F.max("change").alias("peak_change"), F.max("excess").alias("peak_excess"), (F.max("active") == 1).alias("is_active"),
    ).drop("run")


def newly_expired(log: DataFrame, as_of, hours: float = 1) -> DataFrame:
    """The rows that resolved() changes at `as_of`, as they are then: what a stored log must be given."""
    return resolved(log.filter("is_active"), as_of, hours).filter(~F.col("is_active"))


def active_alerts(log: DataFrame, limit: int = 10) -> DataFrame:
    """The newest active alerts."""
    def number(column: str) -> Column:
        return F.coalesce(column, F.lit(0.0))

    return (
        log.filter("is_active")
        .orderBy(F.desc_nulls_last(_AT), F.asc_nulls_last("id"))
        .limit(limit)
        .select(
            "id", F.col("alert_type").alias("type"), "severity", "title", "description",
            F.col("metric_name").alias("metric"),
            number("current_value").alias("current_value"),
            number("threshold_value").alias("threshold"),
            number("percentage_change").alias("change_percent"),
            F.col("product_name").alias("product"), _AT,
        )
    )


def alert_columns(alerts: DataFrame) -> DataFrame:
    return alerts.select(*ALERT_COLUMNS)

from datetime import timedelta

from pyspark.sql import functions as F

from clickweir.operators import alerts
from conftest import minute, rows

DDL = ("time_bucket timestamp_ntz, total_views long, total_revenue double, purchase_count long, "
       "add_to_cart_count long, conversion_rate double, cart_abandonment_rate double")


def series(spark, **columns):
    """Minute rows from 10:00 on; a None in `views` leaves the minute out."""
    length = max(len(v) for v in columns.values())
    names = ["views", "revenue", "bought", "adds", "conversion", "abandonment"]
    data = []
    for i in range(length):
        values = [columns[n][i] if n in columns else 0 for n in names]
        if values[0] is None:
            continue
        v, r, b, a, c, x = values
        data.append((minute("10:00") + timedelta(minutes=i), v, float(r), b, a, float(c), float(x)))
    return spark.createDataFrame(data, DDL)


def found(df):
    return [(r["severity"], r["current_value"], r["threshold_value"], r["percentage_change"], r["title"], r["description"])
            for r in df.collect()]


def test_spike(spark):
    metrics = series(spark, views=[10] * 5 + [16, 16, 16, 16, 17])
    got = alerts.evaluate(metrics, [alerts.traffic_spike()], as_of="2025-01-03 10:10:00")
    assert found(got) == [("warning", 81.0, 50.0, 62.0, "Traffic Spike Detected (+62%)",
                           "Traffic increased from 50 to 81 views in the last 5 minutes.")]
    equal = series(spark, views=[10] * 5 + [15] * 5)
    assert alerts.evaluate(equal, [alerts.traffic_spike()], as_of="2025-01-03 10:10:00").count() == 0


def test_no_spike_without_a_previous_period(spark):
    metrics = series(spark, views=[10] * 5)
    assert alerts.evaluate(metrics, [alerts.traffic_spike()], as_of="2025-01-03 10:05:00").count() == 0


def test_drop_and_outage(spark):
    metrics = series(spark, views=[10] * 5 + [6] * 5)
    got = alerts.evaluate(metrics, [alerts.traffic_drop()], as_of="2025-01-03 10:10:00")
    assert found(got) == [("critical", 30.0, 50.0, -40.0, "Traffic Drop Detected (-40%)",
                           "Traffic decreased from 50 to 30 views in the last 5 minutes.")]
    outage = series(spark, views=[10] * 5)
    default = alerts.evaluate(outage, [alerts.traffic_drop()], as_of="2025-01-03 10:10:00")
    assert [r["percentage_change"] for r in default.collect()] == [-100.0]
    assert alerts.evaluate(outage, [alerts.traffic_drop(missing="null")], as_of="2025-01-03 10:10:00").count() == 0


def test_low_conversion(spark):
    metrics = series(spark, views=[30, 30, 30, 30], bought=[0, 1, 1, 0], conversion=[0, 100 / 30, 100 / 30, 0])
    got = alerts.evaluate(metrics, [alerts.low_conversion()], as_of="2025-01-03 10:04:00")
    (severity, value, limit, change, title, description), = found(got)
    assert (severity, limit, change) == ("warning", 3.0, 0.0) and abs(value - 5 / 3) < 1e-9
    assert title == "Low Conversion Rate (1.7%)"
    assert description == "Conversion rate dropped to 1.7% (2 purchases / 120 views)."
    few = series(spark, views=[100])
    assert alerts.evaluate(few, [alerts.low_conversion()], as_of="2025-01-03 10:04:00").count() == 0


def test_abandonment_reads_only_minutes_with_adds(spark):
    metrics = series(spark, views=[0] * 3, adds=[6, 0, 6], bought=[1, 9, 1], abandonment=[250 / 3, 0, 250 / 3])
    got = alerts.evaluate(metrics, [alerts.high_cart_abandonment()], as_of="2025-01-03 10:03:00")
    assert [f[4:] for f in found(got)] == [("High Cart Abandonment (83%)",
                                            "Cart abandonment rate is 83% (12 adds, 2 purchases).")]


def test_revenue(spark):
    up = series(spark, views=[0] * 20, revenue=[1.1] * 10 + [2.5] * 10)
    got = alerts.evaluate(up, [alerts.revenue_anomaly()], as_of="2025-01-03 10:20:00")
    assert [f[0] for f in found(got)] == ["warning"]
    assert [f[4:] for f in found(got)] == [("Revenue Anomaly Detected (+127%)", "Revenue increased from $11.00 to $25.00.")]
    down = series(spark, views=[0] * 20, revenue=[10] * 10 + [4] * 10)
    got = alerts.evaluate(down, [alerts.revenue_anomaly()], as_of="2025-01-03 10:20:00")
    assert [(f[0], f[4]) for f in found(got)] == [("critical", "Revenue Anomaly Detected (-60%)")]
    assert alerts.evaluate(down, [alerts.revenue_anomaly(down_pct=100)], as_of="2025-01-03 10:20:00").count() == 0


def test_history_equals_every_point_in_time(spark):
    views = [3, 9, None, 1, 20, 4, 4, None, None, None, 8, 8, 30, 2, 2, 1, 0, 5, 7, 50, 3, 3]
    n = len(views)
    metrics = series(spark, views=views, revenue=[(i * 37) % 11 for i in range(n)], bought=[i % 3 for i in range(n)],
                     adds=[i % 4 for i in range(n)], conversion=[(i * 13) % 7 for i in range(n)],
                     abandonment=[(i * 29) % 101 for i in range(n)])
    rules = [alerts.traffic_spike(3), alerts.traffic_drop(4), alerts.low_conversion(5, min_views=4),
             alerts.high_cart_abandonment(5, 0.4, min_adds=1), alerts.revenue_anomaly(4)]
    columns = ["detected_at", "alert_type", "severity", "current_value", "percentage_change", "title", "description"]
    history = rows(alerts.evaluate(metrics, rules), *columns)
    assert len({r[1] for r in history}) == 5
    checked = [minute("10:00") + timedelta(minutes=i) for i in (3, 6, 11, 14, 20, 24)]
    points = [row for t in checked for row in rows(alerts.evaluate(metrics, rules, as_of=t), *columns)]
    assert sorted(points, key=repr) == [r for r in history if r[0] in checked]
    until = minute("10:12")
    assert rows(alerts.evaluate(metrics, rules, until=until), *columns) == [r for r in history if r[0] <= until]


def test_unaligned_check_time(spark):
    metrics = series(spark, views=[10] * 5 + [20] * 6)
    got = alerts.evaluate(metrics, [alerts.traffic_spike()], as_of="2025-01-03 10:10:30")
    assert [(r["current_value"], r["threshold_value"]) for r in got.collect()] == [(100.0, 60.0)]


def product_rows(spark, data):
    return spark.createDataFrame([(minute(t), p, p.upper(), float(v), v) for t, p, v in data],
                                 "time_bucket timestamp_ntz, product_id string, product_name string, "
                                 "views_per_minute double, view_count long")


def test_trending_product(spark):
    quiet = [("10:01", f"q{i}", 1) for i in range(9)]
    products = product_rows(spark, quiet + [("10:01", "hot", 20), ("10:02", "hot", 22)])
    got = alerts.trending_products(products, as_of="2025-01-03 10:05:00").collect()
    assert [(r["product_id"], r["current_value"], r["severity"]) for r in got] == [("hot", 22.0, "info")]
    mean = (9 + 42) / 11
    assert abs(got[0]["threshold_value"] - 3 * mean) < 1e-9
    assert got[0]["title"] == "Trending: HOT"
    assert got[0]["description"] == "HOT is trending with 22 views/min (22 total views)."
    assert alerts.trending_products(products, as_of="2025-01-03 10:05:00", all_buckets=True).count() == 2


def test_trending_limit_and_fallback(spark):
    many = product_rows(spark, [("10:01", f"q{i:02d}", 0) for i in range(80)] + [("10:01", f"h{i}", 9 - i) for i in range(7)])
    got = alerts.trending_products(many, as_of="2025-01-03 10:05:00")
    assert [r["product_id"] for r in got.orderBy(F.desc("current_value")).collect()] == ["h0", "h1", "h2", "h3", "h4"]
    still = product_rows(spark, [("10:01", "a", 0)])
    assert alerts.trending_products(still, as_of="2025-01-03 10:05:00").count() == 0


def test_log(spark):
    metrics = series(spark, views=[10] * 5 + [30] * 5)
    log = alerts.recorded(alerts.evaluate(metrics, [alerts.traffic_spike()], until="2025-01-03 10:10:00"))
    assert log.select("id").distinct().count() == log.count() > 1
    assert rows(log) == rows(alerts.recorded(alerts.evaluate(metrics, [alerts.traffic_spike()], until="2025-01-03 10:10:00")))
    state = alerts.resolved(log, "2025-01-03 11:08:00")
    assert all(r["is_active"] == (r["detected_at"] >= minute("10:08")) for r in state.collect())
    assert {r["resolved_at"] for r in state.filter("not is_active").collect()} == {minute("11:08")}
    later = alerts.resolved(state, "2025-01-03 12:30:00")
    assert {r["resolved_at"] for r in later.collect()} == {minute("11:08"), minute("12:30")}
    active = alerts.active_alerts(state, limit=2).collect()
    assert [r["detected_at"] for r in active] == [minute("10:10"), minute("10:09")]
    assert active[0]["type"] == "traffic_spike" and active[0]["product"] is None


def test_all_checks(spark):
    metrics = series(spark, views=[10] * 5 + [30] * 5)
    products = product_rows(spark, [("10:06", f"q{i}", 1) for i in range(9)] + [("10:06", "hot", 50)])
    got = alerts.run_all_checks(metrics, products, as_of="2025-01-03 10:10:00")
    assert sorted(r["alert_type"] for r in got.collect()) == ["low_conversion", "traffic_spike", "trending_product"]


def test_ids_differ_by_bucket(spark):
    products = product_rows(spark, [("10:01", f"q{i}", 1) for i in range(9)] + [("10:01", "hot", 20), ("10:02", "hot", 22)])
    log = alerts.recorded(alerts.trending_products(products, as_of="2025-01-03 10:05:00", all_buckets=True))
    assert log.count() == log.select("id").distinct().count() == 2


def test_since_reads_and_judges_only_the_end(spark):
    views = [3, 9, 1, 20, 4, 4, 8, 30, 2, 2, 1, 0, 5, 7, 50]
    metrics = series(spark, views=views, adds=[i % 4 for i in range(15)], abandonment=[90] * 15)
    rules = [alerts.traffic_spike(2), alerts.high_cart_abandonment(3, 0.4, min_adds=1)]
    whole = alerts.evaluate(metrics, rules, until="2025-01-03 10:15:00")
    part = alerts.evaluate(metrics, rules, until="2025-01-03 10:15:00", since="2025-01-03 10:09:30")
    columns = ["detected_at", "alert_type", "current_value"]
    assert rows(part, *columns) == [r for r in rows(whole, *columns) if r[0] >= minute("10:10")] != []
    products = product_rows(spark, [(f"10:{i:02d}", f"p{i % 3}", 1 + 40 * (i == 7) + 90 * (i == 12)) for i in range(15)])
    whole = rows(alerts.trending_products(products, multiplier=1.5, until="2025-01-03 10:15:00"), "detected_at", "product_id", "threshold_value")
    part = rows(alerts.trending_products(products, multiplier=1.5, until="2025-01-03 10:15:00", since="2025-01-03 10:13:00"), "detected_at", "product_id", "threshold_value")
    assert part == [r for r in whole if r[0] >= minute("10:13")] != []


def test_trending_history_equals_every_point_in_time(spark):
    products = product_rows(spark, [(f"10:{i % 20:02d}", f"p{i % 7}", (i * i * 31) % 60) for i in range(130)])
    history = rows(alerts.trending_products(products, multiplier=1.5), "detected_at", "product_id", "current_value", "threshold_value")
    for i in (3, 9, 17, 22):
        at = minute("10:00") + timedelta(minutes=i)
        now = rows(alerts.trending_products(products, as_of=at, multiplier=1.5), "detected_at", "product_id", "current_value", "threshold_value")
        assert [(*r[:3], round(r[3], 6)) for r in now] == [(*r[:3], round(r[3], 6)) for r in history if r[0] == at]

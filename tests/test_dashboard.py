import json

import pytest

from clickweir.operators import alerts, dashboard, geo, metrics, products, reports
from clickweir.sources import tables
from conftest import AS_OF, event, minute, rows


@pytest.fixture(scope="module")
def minutes(golden):
    return metrics.minute_metrics(golden).cache()


def test_live(minutes):
    assert rows(dashboard.live_metrics(minutes, AS_OF)) == [(30.0, 2, 1, 50 / 3, 100 / 3)]
    assert rows(dashboard.live_metrics(minutes, "2025-01-04 00:00:00")) == [(0.0, 0, 0, 0.0, 0.0)]


def test_active_users(golden):
    assert rows(dashboard.active_users(golden, AS_OF)) == [(3,)]
    assert rows(dashboard.active_users(golden, AS_OF, minutes=2)) == [(1,)]


def test_trend(minutes):
    got = dashboard.revenue_trend(minutes, AS_OF)
    assert [tuple(r) for r in got.collect()] == [
        (minute("10:30"), 20.0, 1, 20.0), (minute("10:31"), 0.0, 0, 0.0), (minute("10:32"), 10.0, 1, 10.0)]


def test_funnel(minutes):
    funnel = dashboard.conversion_funnel(minutes, AS_OF)
    assert rows(funnel) == [(3, 3, 2, 100.0, 66.67)]
    shares = dashboard.funnel_shares(funnel).collect()
    assert [tuple(r) for r in shares] == [
        ("Product Views", 3, 100.0, 100.0, "good"), ("Add to Cart", 3, 100.0, 100.0, "good"),
        ("Purchases", 2, 2 / 3 * 100, 66.7, "good")]
    empty = dashboard.conversion_funnel(minutes, "2025-01-04 00:00:00")
    assert rows(empty) == [(0, 0, 0, 0.0, 0.0)]
    assert {r["tier"] for r in dashboard.funnel_shares(empty).collect()} == {"poor"}


def test_hour_against_hour(frame):
    df = frame([event("a", "09:10:00", "purchase", "u1", "s1", "p1", 1, "10.00"),
                event("b", "10:10:00", "purchase", "u1", "s1", "p1", 1, "15.00"),
                event("c", "10:10:00", "product_view", "u1", "s1", "p1"),
                event("d", "10:40:00", "purchase", "u1", "s1", "p1", 1, "99.00")])
    got = dashboard.hourly_comparison(metrics.minute_metrics(df), "2025-01-03 10:33:00")
    assert rows(got) == [(50.0, 0.0, 15.0, 1, 100.0, 0.0)]
    first = dashboard.hourly_comparison(metrics.minute_metrics(df), "2025-01-03 09:30:00")
    assert rows(first, "revenue_change_percent", "current_revenue") == [(0.0, 10.0)]


def test_reports(golden, minutes, spark):
    log = alerts.recorded(alerts.evaluate(minutes, [alerts.low_conversion(minutes=10, threshold=0.5, min_views=1)], AS_OF))
    got = {r["metric"]: r["value"] for r in reports.stats_report(golden, log).collect()}
    assert got == {"Total Events": "10", "Total Revenue": "$30", "Total Purchases": "2", "Unique Users": "3",
                   "Active Alerts": "1"}
    assert [r["event_type"] for r in reports.recent_events(golden, 2).collect()] == ["purchase", "remove_from_cart"]
    assert [r["total_amount"] for r in reports.recent_purchases(golden).collect()] == [10, 20]
    assert [r["time_bucket"] for r in reports.latest_metrics(minutes, 2).collect()] == [minute("10:32"), minute("10:31")]
    counted = tables.adhoc_sql(spark, "SELECT count(*) AS n FROM events_raw WHERE event_type = 'search'",
                               {"events_raw": golden})
    assert rows(counted) == [(1,)]


def test_snapshot(golden, minutes):
    got = dashboard.snapshot(
        single={"live": dashboard.live_metrics(minutes, AS_OF), "funnel": dashboard.conversion_funnel(minutes, AS_OF)},
        lists={"trend": dashboard.revenue_trend(minutes, AS_OF), "places": geo.top_locations(golden, AS_OF),
               "products": products.trending(golden, AS_OF), "none": dashboard.revenue_trend(minutes, "2025-01-05")},
    ).collect()
    assert len(got) == 1
    row = got[0].asDict()
    assert json.loads(row["live"])["revenue"] == 30.0
    assert [r["revenue"] for r in json.loads(row["trend"])] == [20.0, 0.0, 10.0]
    assert [r["city"] for r in json.loads(row["places"])] == ["Lyon", "Oslo"]
    assert [r["rank"] for r in json.loads(row["products"])] == [1, 2]
    assert row["none"] == "[]"

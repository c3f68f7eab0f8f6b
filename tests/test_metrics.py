import pytest
from pyspark.sql import functions as F

from clickweir.functions import times
from clickweir.operators import geo, metrics, products
from clickweir.schemas import GEO_COLUMNS, HOUR_COLUMNS, METRIC_COLUMNS, PRODUCT_METRIC_COLUMNS
from conftest import AS_OF, event, minute, rows


def test_minutes(golden):
    got = metrics.minute_metrics(golden)
    assert got.columns == METRIC_COLUMNS
    assert rows(got) == [
        (minute("10:30"), 20.0, 1, 20.0, 2, 2, 3, 1, 0, 1, 1, 50.0, 0.0),
        (minute("10:31"), 0.0, 0, None, 1, 1, 1, 2, 1, 0, 0, 0.0, 100.0),
        (minute("10:32"), 10.0, 1, 10.0, 0, 0, 1, 0, 0, 1, 0, 0.0, 0.0),
    ]


def test_options_change_only_their_column(golden):
    base = metrics.minute_metrics(golden)
    everyone = metrics.minute_metrics(golden, users="all")
    assert rows(everyone, "time_bucket", "unique_users") == [
        (minute("10:30"), 3), (minute("10:31"), 1), (minute("10:32"), 1)]
    assert rows(everyone.drop("unique_users")) == rows(base.drop("unique_users"))
    zero = metrics.minute_metrics(golden, empty="zero")
    assert rows(zero, "average_order_value") == [(0.0,), (10.0,), (20.0,)]
    assert rows(zero.drop("average_order_value")) == rows(base.drop("average_order_value"))
    assert rows(metrics.minute_metrics(golden, distinct="approx")) == rows(base)
    with pytest.raises(ValueError):
        metrics.minute_metrics(golden, users="some")


def test_hours(golden):
    got = metrics.hour_metrics(golden)
    assert got.columns == HOUR_COLUMNS
    assert rows(got) == [(minute("10:00"), 30.0, 2, 15.0, 3, 2, 3, 3, 2, 2 / 3 * 100, (1 - 2 / 3) * 100, 20.0, 1)]


def test_missing_ids_are_counted_as_events_not_as_users(frame):
    df = frame([event("e1", "10:00:01", "product_view", None, None, "p1"),
                event("e2", "10:00:02", "purchase", None, None, "p1", 1, "5.00")])
    assert rows(metrics.minute_metrics(df), "total_revenue", "total_views", "unique_users", "unique_sessions") == [
        (5.0, 1, 0, 0)]


def test_purchases_above_adds_give_negative_abandonment(frame):
    df = frame([event("e1", "10:00:01", "add_to_cart", "u1", "s1", "p1", 1),
                event("e2", "10:00:02", "purchase", "u1", "s1", "p1", 1, "5.00"),
                event("e3", "10:00:03", "purchase", "u1", "s1", "p1", 1, "5.00")])
    assert rows(metrics.minute_metrics(df), "cart_abandonment_rate") == [(-100.0,)]


def test_processing_time(golden):
    stamped = metrics.stamped(metrics.minute_metrics(golden), as_of=times.at(AS_OF))
    assert {r["created_at"] for r in stamped.collect()} == {minute("10:33")}
    assert "created_at" in metrics.stamped(golden).columns


def test_empty_input(frame):
    assert metrics.minute_metrics(frame([])).count() == 0
    assert metrics.hour_metrics(frame([])).count() == 0


def test_busy_minute_equals_distinct_counts(spark):
    events = spark.range(200_000).select(
        F.col("id").cast("string").alias("event_id"),
        F.when(F.col("id") % 3 == 0, "product_view").otherwise("purchase").alias("event_type"),
        F.expr("timestamp_ntz'2025-01-03 10:00:00' + make_dt_interval(0, 0, 0, if(id % 3 = 1, 100, 1))").alias("timestamp"),
        F.pmod(F.xxhash64("id"), F.lit(5000)).cast("string").alias("user_id"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9000)).cast("string").alias("session_id"),
        F.lit(0.1).alias("total_amount"))
    want = events.groupBy(F.date_trunc("minute", "timestamp").cast("timestamp_ntz").alias("time_bucket")).agg(
        F.countDistinct(F.when(F.col("event_type") == "product_view", F.col("user_id"))),
        F.countDistinct("session_id"), F.count(F.when(F.col("event_type") == "purchase", 1)))
    got = metrics.minute_metrics(events)
    assert rows(got, "time_bucket", "unique_users", "unique_sessions", "total_orders") == rows(want)
    assert got.filter(F.round(F.col("total_orders") * 0.1, 1) != F.col("total_revenue")).count() == 0


def test_products(golden):
    got = products.product_metrics(golden)
    assert got.columns == PRODUCT_METRIC_COLUMNS
    assert rows(got, "time_bucket", "product_id", "view_count", "purchase_count", "revenue", "trending_score") == [
        (minute("10:30"), "p1", 2, 1, 20.0, 70.0),
        (minute("10:31"), "p2", 1, 0, 0.0, 10.0),
        (minute("10:32"), "p1", 0, 1, 10.0, 50.0)]
    by_id = products.product_metrics_by_id(golden)
    assert rows(by_id, "time_bucket", "product_id", "view_count", "trending_score") == [
        (minute("10:30"), "p1", 2, 70.0), (minute("10:31"), "p1", 0, 0.0),
        (minute("10:31"), "p2", 1, 10.0), (minute("10:32"), "p1", 0, 50.0)]


def test_by_id_merges_differing_attributes(frame, golden):
    changed = golden.filter("product_id = 'p1'").withColumn("product_name", F.lit("Aalto")).withColumn(
        "product_price", F.lit(12.0))
    got = products.product_metrics_by_id(golden.unionByName(changed)).filter("product_id = 'p1'")
    assert {(r["product_name"], r["product_price"]) for r in got.collect()} == {("Lamp", 12.0)}


def test_trending(golden):
    got = products.trending(golden, AS_OF)
    assert rows(got, "rank", "product_id", "view_count", "purchase_count", "revenue", "views_per_minute",
                "trending_score") == [(1, "p1", 2, 2, 30.0, 0.4, 124.0), (2, "p2", 1, 0, 0.0, 0.2, 2.0)]
    assert products.trending(golden, AS_OF, limit=1).count() == 1


def test_trending_now(golden):
    stored = products.ranking_history(golden, minutes=1)
    assert rows(stored, "time_bucket", "product_id", "rank") == [
        (minute("10:30"), "p1", 1), (minute("10:31"), "p2", 1)]
    doubled = stored.unionByName(stored.withColumn("time_bucket", F.col("time_bucket") + F.expr("INTERVAL 1 MINUTE"))
                                 .withColumn("rank", F.col("rank") + 4))
    assert rows(products.trending_now(doubled, AS_OF), "product_id", "rank") == [("p1", 5), ("p2", 5)]
    assert products.trending_now(doubled, AS_OF, all_buckets=True).count() == 4


def test_ties_are_broken_by_id(frame):
    df = frame([event(f"e{i}", "10:32:00", "product_view", "u1", "s1", p) for i, p in enumerate(["p2", "p1"])])
    assert [r["product_id"] for r in products.trending(df, AS_OF).orderBy("rank").collect()] == ["p1", "p2"]


def test_geo(golden):
    got = geo.geo_metrics(golden)
    assert got.columns == GEO_COLUMNS
    assert rows(got) == [
        (minute("10:30"), "France", "Lyon", 1, 1, 20.0, 1),
        (minute("10:30"), "Norway", "Oslo", 1, 0, 0.0, 1),
        (minute("10:31"), "Norway", "Oslo", 1, 0, 0.0, 1),
        (minute("10:32"), "Norway", "Oslo", 0, 1, 10.0, 1)]
    top = geo.top_locations(golden, AS_OF)
    assert [tuple(r) for r in top.collect()] == [
        ("France", "Lyon", "Lyon, France", 20.0, 1, 1, 1), ("Norway", "Oslo", "Oslo, Norway", 10.0, 1, 2, 1)]

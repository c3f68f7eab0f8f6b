"""Shape of the physical plans at a size where nothing may be broadcast."""

import re

import pytest

from clickweir.operators import alerts, dashboard, geo, metrics, products, sessions
from clickweir.plans import queries, shop
from clickweir.schemas import SEARCH
from clickweir.sources import messages
from conftest import AS_OF, GOLDEN

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture(scope="module")
def golden(frame):
    """Rows of its own: results cached by other tests must not show up in the plans."""
    return frame(GOLDEN)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_no_cross_join_anywhere(spark):
    for name, query in queries.queries().items():
        if name.startswith("stream_"):
            continue
        text = plan(query(spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "PythonUDF" not in text and "BatchEvalPython" not in text, name


def test_metrics_shuffle_reduced_rows_twice(golden):
    for df in (metrics.minute_metrics(golden), metrics.hour_metrics(golden)):
        assert shuffles(df) == 2
        assert "SortAggregate" not in plan(df) and "SinglePartition" not in plan(df)
    assert shuffles(metrics.minute_metrics(golden, distinct="approx")) == 1


def test_products_and_places(golden):
    assert shuffles(products.product_metrics(golden)) == 1
    assert "SortAggregate" not in plan(products.product_metrics(golden))
    assert shuffles(geo.geo_metrics(golden)) == 2


def test_rankings_are_limited_before_they_are_numbered(golden):
    text = plan(products.trending(golden, AS_OF))
    assert text.index("Window") < text.index("TakeOrderedAndProject")
    assert "WindowGroupLimit" in plan(products.ranking_history(golden))


def test_all_minute_rules_share_one_aggregate(golden):
    minutes = metrics.minute_metrics(golden)
    one = plan(alerts.evaluate(minutes, alerts.minute_rules()[:1]))
    five = plan(alerts.evaluate(minutes, alerts.minute_rules()))
    assert one.count("Exchange") == five.count("Exchange") == 3


def test_comparison_reads_once(golden):
    assert plan(dashboard.hourly_comparison(metrics.minute_metrics(golden), AS_OF)).count("ExistingRDD") == 1


def test_sessions_order_cells_only(golden):
    df = sessions.sessionize(golden)
    assert shuffles(df) == 2           # cells, then users; the last aggregate reuses the users' partitions


def test_dedup_reduces_before_the_shuffle(golden):
    text = plan(messages.deduplicate(golden))
    assert text.index("Exchange") < text.rindex("SortAggregate")


def test_scans_read_little(spark):
    text = plan(queries.queries()["live_metrics"](spark, SF))
    assert "GreaterThanOrEqual(ts" in text
    assert "props" not in text.split("ReadSchema:")[1]


def test_point_in_time_trending_joins_nothing(golden):
    hourly = products.product_metrics(golden)
    text = plan(alerts.trending_products(hourly, as_of=AS_OF))
    assert "Join" not in text.split("Subquery")[0] and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_history_since_bounds_the_scan(spark):
    for name in ("active_alerts", "stats_report"):
        assert "GreaterThanOrEqual(ts" in plan(queries.queries()[name](spark, SF)), name


def test_attributes_of_messages_are_joined_once(spark):
    """Each period of messages is read from the events that were joined before the first."""
    plans = [plan(period) for period in shop.message_periods(spark, SF, SEARCH)]
    assert len(plans) == 4 and not any("Join" in p or "events.parquet" in p for p in plans)

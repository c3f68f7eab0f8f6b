import json
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from clickweir.plans import shop
from clickweir.schemas import EVENT_COLUMNS
from clickweir.sources import messages
from conftest import event, rows

GOOD = {"event_id": "e1", "event_type": "purchase", "timestamp": "2025-01-03T10:30:00.5Z", "user_id": "u1",
        "session_id": "s1", "product": {"id": "p1", "name": "Lamp", "category": "Home", "price": 10.0},
        "quantity": 2, "total_amount": 20.0, "payment_method": "paypal",
        "location": {"city": "Lyon", "country": "France", "ip": "1.2.3.4"}}
SEARCH = {"event_id": "e2", "event_type": "search", "timestamp": "2025-01-03T10:31:00", "user_id": "u1",
          "session_id": "s1", "search_query": "rope", "location": {"city": "Lyon", "country": "France"}}


def decode(spark, *texts):
    df = spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "value binary")
    return messages.decode(df)


def test_good_messages(spark):
    flat = messages.flatten(messages.accepted(decode(spark, json.dumps(GOOD), json.dumps(SEARCH))))
    assert flat.columns == [*EVENT_COLUMNS, "raw_data"]
    first, second = [r.asDict() for r in flat.orderBy("event_id").collect()]
    assert first["timestamp"] == datetime(2025, 1, 3, 10, 30, 0, 500000)
    assert first["total_amount"] == Decimal("20.00") and first["ip_address"] == "1.2.3.4"
    assert second["product_id"] is None and second["quantity"] is None and second["total_amount"] is None
    assert json.loads(second["raw_data"])["search_query"] == "rope"


def test_bad_messages_are_kept_apart(spark):
    no_user = {k: v for k, v in GOOD.items() if k != "user_id"}
    bad_time = {**GOOD, "timestamp": "soon"}
    decoded = decode(spark, json.dumps(GOOD), "{not json", json.dumps(no_user), json.dumps(bad_time), "", "null")
    assert messages.accepted(decoded).count() == 1
    reasons = sorted(r["reject_reason"] for r in messages.rejected(decoded).collect())
    assert len(reasons) == 5
    assert {"malformed json", "missing user_id", "bad timestamp"} <= set(reasons)
    kept = messages.rejected(decoded).filter("reject_reason = 'malformed json' and broken_text like '%not json%'")
    assert kept.count() == 1


def test_timestamps(spark):
    bad = ["soon", None, "10:00", "T12:30", "2024", "2024-01", "2024-01-05", "2024-01-05T10:30", "2024-13-05T10:30:00", "2024-01-05T25:30:00", ""]
    df = spark.createDataFrame([("2025-01-03T10:30:00Z",), ("2025-01-03T10:30:00",), ("2025-01-03 10:30:00.000000",), ("2025-01-03T10:30:00+02:00",),
                                *[(t,) for t in bad]], "t string")
    got = [r[0] for r in df.select(messages.parse_timestamp(F.col("t")).cast("timestamp_ntz")).collect()]
    assert got == [datetime(2025, 1, 3, 10, 30)] * 3 + [datetime(2025, 1, 3, 8, 30)] + [None] * len(bad)


def test_raw_data_is_the_message(spark):
    text = json.dumps({**GOOD, "timestamp": "2025-01-03T10:30:00.123456", "unknown": [1, {"a": None}]})
    row = messages.flatten(messages.accepted(decode(spark, text))).first()
    assert row["raw_data"] == text and row["timestamp"].microsecond == 123456


def test_reasons(spark):
    cases = {"wrong type": {**GOOD, "quantity": "2"}, "missing user_id": {**GOOD, "user_id": " "}, "missing event_type": {**GOOD, "event_type": None},
             "bad timestamp": {**GOOD, "timestamp": "10:00"}, None: {**GOOD, "event_type": "wave"}}
    for reason, body in cases.items():
        assert decode(spark, json.dumps(body)).first()["reject_reason"] == reason
    df = spark.createDataFrame([(json.dumps({**GOOD, "event_type": "wave"}),), ("[1]",), (json.dumps(GOOD),)], "value string")
    assert [r["reject_reason"] for r in messages.decode(df, types="known").collect()] == ["unknown event type", "malformed json", None]


def test_times_ahead_of_the_message(spark):
    df = spark.createDataFrame([(json.dumps({**GOOD, "timestamp": t}), datetime(2025, 1, 3, 10, 30)) for t in ("2025-01-03T10:39:59", "2025-01-03T10:40:01")],
                               "value string, arrived timestamp")
    got = messages.decode(df, received="arrived", ahead_minutes=10)
    assert [r["reject_reason"] for r in got.collect()] == [None, "ahead of time"] and "_received" not in got.columns


def test_products_of_odd_events(spark):
    rows_ = spark.createDataFrame([(1, "view", 5, p) for p in ('{"k": 7}', "{}", None, '{"k": "x"}')], "event_id long, event_type string, user_id long, props string")
    events = shop.as_shop_events(rows_.withColumn("ts", F.lit("2025-01-03").cast("timestamp_ntz")).withColumn("value", F.lit(1.0)))
    assert [r["product_id"] for r in shop.with_products(spark, events, "/root/testdata/sf0.001").orderBy("product_id").collect()] == [None, None, None, "7"]


def test_defaults(frame):
    df = frame([event("e1", "10:00:00", "search", "u1", "s1")])
    picked = ["quantity", "total_amount", "product_price"]
    assert rows(messages.with_defaults(df, "none"), *picked) == [(None, None, None)]
    assert rows(messages.with_defaults(df, "quantity"), *picked) == [(1, None, None)]
    assert rows(messages.with_defaults(df, "zero"), *picked) == [(1, Decimal("0.00"), 0.0)]


def test_dedup_keeps_the_earliest(frame):
    df = frame([event("e1", "10:00:05", "search", "u1", "s1"), event("e1", "10:00:01", "search", "u1", "s1"),
                event("e1", "10:00:01", "search", "u1", "s1"), event("e2", "10:00:09", "search", "u1", "s1")])
    got = messages.deduplicate(df)
    assert got.columns == df.columns
    assert rows(got, "event_id", "timestamp") == [
        ("e1", datetime(2025, 1, 3, 10, 0, 1)), ("e2", datetime(2025, 1, 3, 10, 0, 9))]

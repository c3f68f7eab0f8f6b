import json

import pytest
from pyspark.sql import functions as F

from clickweir.functions.times import naive_utc
from clickweir.operators import geo, metrics, products, sessions
from clickweir.session import scratch
from clickweir.sources import messages
from clickweir.streaming import jobs
from conftest import GOLDEN, event, minute, rows

# One more event opens a later window and so closes all golden ones.
CLOSING = event("e99", "10:59:00", "product_view", "u2", "s9", "p2")
# A batch filters late events by the watermark of the batch before it.
AFTER = event("e95", "10:59:30", "product_view", "u2", "s9", "p2")


def drop_files(spark, frame, pieces):
    """Each piece of rows becomes a file of a directory."""
    path = scratch(spark, "incoming")
    for piece in pieces:
        frame(piece).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, frame, operator, column, pieces, start=jobs.start_append, max_files=1):
    path, root = drop_files(spark, frame, pieces), scratch(spark, "out")
    events = jobs.watermarked(jobs.file_stream(spark, path, frame([]).schema, max_files))
    result = operator(events)
    jobs.wait([start(result, "q", root, column)])
    return naive_utc(jobs.stored(spark, root, "q", result.schema))


@pytest.mark.parametrize("operator", [metrics.minute_metrics, products.product_metrics, geo.geo_metrics])
def test_streams_equal_tables(spark, frame, golden, operator):
    got = run(spark, frame, operator, "time_bucket", [GOLDEN[:4], GOLDEN[4:7], GOLDEN[7:], [CLOSING]])
    assert rows(got) == rows(operator(golden))


def test_hours_and_open_windows(spark, frame, golden):
    later = event("e98", "12:30:00", "search", "u3", "s9")
    got = run(spark, frame, metrics.hour_metrics, "time_bucket", [GOLDEN, [later]])
    assert rows(got) == rows(metrics.hour_metrics(golden))
    still_open = run(spark, frame, metrics.minute_metrics, "time_bucket", [GOLDEN])
    assert rows(still_open, "time_bucket") == []


def test_foreach_batch_sink(spark, frame, golden):
    got = run(spark, frame, metrics.minute_metrics, "time_bucket", [GOLDEN[:6], GOLDEN[6:], [CLOSING]], jobs.start_batches)
    assert rows(got) == rows(metrics.minute_metrics(golden))


def test_repeated_batch_changes_nothing(spark, golden):
    path = scratch(spark, "batches")
    sink = jobs.batch_sink(path, "time_bucket")
    for batch_id in (0, 1, 1):
        sink(metrics.minute_metrics(golden).filter(F.minute("time_bucket") % 2 == batch_id), batch_id)
    assert rows(spark.read.parquet(path), "time_bucket") == [(minute("10:30"),), (minute("10:31"),), (minute("10:32"),)]


def test_sessions(spark, frame, golden):
    late = event("e97", "10:50:00", "search", "u1", "s8")
    got = run(spark, frame, sessions.stream_sessions, "session_start", [GOLDEN, [late], [CLOSING]])
    assert rows(got) == rows(sessions.sessionize(frame([*GOLDEN, late])))


def test_late_events_are_dropped(spark, frame):
    late = event("late", "10:30:40", "product_view", "u7", "s7", "p1")
    got = run(spark, frame, metrics.minute_metrics, "time_bucket", [
        GOLDEN, [CLOSING], [AFTER], [late], [event("e100", "11:10:00", "search", "u3", "s9")]])
    assert rows(got.filter(F.minute("time_bucket") == 30), "total_views", "unique_users") == [(2, 2)]


def test_late_events_within_the_watermark_count(spark, frame):
    late = event("late", "10:30:40", "product_view", "u7", "s7", "p1")
    got = run(spark, frame, metrics.minute_metrics, "time_bucket", [GOLDEN, [late], [CLOSING]])
    assert rows(got.filter(F.minute("time_bucket") == 30), "total_views", "unique_users") == [(3, 3)]


def test_dropped_rows_are_reported(spark, frame):
    path, root = drop_files(spark, frame, [
        GOLDEN, [CLOSING], [AFTER], [event("late", "10:30:40", "search", "u7", "s7")]]), scratch(spark, "o")
    events = jobs.watermarked(jobs.file_stream(spark, path, frame([]).schema, 1))
    query = jobs.start_append(products.product_metrics(events.withColumn("event_type", F.lit("product_view"))), "q", root, "time_bucket")
    query.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])
    assert dropped == 1


def test_duplicates(spark, frame):
    got = run(spark, frame, messages.deduplicate_stream, "timestamp", [GOLDEN, GOLDEN[3:], [CLOSING]])
    assert rows(got, "event_id") == sorted([(r[0],) for r in [*GOLDEN, CLOSING]], key=repr)


def test_messages_to_all_tables(spark, frame, golden):
    """JSON messages, some broken, through all pipelines at once, stopped and resumed in between."""
    source, root = scratch(spark, "messages"), scratch(spark, "tables")
    texts = [json.dumps({
        "event_id": r[0], "event_type": r[1], "timestamp": r[2].isoformat() + "Z", "user_id": r[3], "session_id": r[4],
        **({"product": {"id": r[5], "name": r[6], "category": r[7], "price": r[8]}} if r[5] else {}),
        **({"quantity": r[9]} if r[9] else {}), **({"total_amount": float(r[10])} if r[10] else {}),
        "location": {"city": r[12], "country": r[13]}}) for r in [*GOLDEN, event("e96", "13:30:00", "product_view", "u2", "s9", "p2")]]
    parts = [[*texts[:5], "{broken"], [*texts[5:], json.dumps({"event_id": "x"})]]
    for part in parts:
        spark.createDataFrame([(t,) for t in part], "value string").coalesce(1).write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, source, spark.read.parquet(source).schema)
        events = messages.flatten(messages.accepted(messages.decode(stream)))
        jobs.wait(jobs.start_all(events, root, every=None))
    raw = jobs.stored(spark, root, "events_raw", events.schema)
    assert raw.count() == 11 and raw.filter("raw_data like '%event_id%'").count() == 11
    for name, operator in [("metrics_1min", metrics.minute_metrics), ("metrics_1hour", metrics.hour_metrics),
                           ("product_metrics", products.product_metrics), ("geo_metrics", geo.geo_metrics),
                           ("sessions", sessions.sessionize)]:
        want = operator(golden)
        got = spark.read.parquet(f"{root}/{name}")
        assert rows(naive_utc(got.select(*want.columns))) == rows(want), name

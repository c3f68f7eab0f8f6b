"""The whole job over message files."""

import json
import os
import threading
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from clickweir.functions.times import naive_utc
from clickweir.operators import alerts, geo, metrics, products, sessions
from clickweir.session import _scratch_root, scratch
from clickweir.sinks import parts, tables as sinks
from clickweir.streaming import jobs, refresh
from conftest import GOLDEN, event, minute, rows


def text(row, **changes):
    body = {"event_id": row[0], "event_type": row[1], "timestamp": row[2].isoformat() + "Z", "user_id": row[3], "session_id": row[4],
            **({"product": {"id": row[5], "name": row[6], "category": row[7], "price": row[8]}} if row[5] else {}),
            **({"quantity": row[9]} if row[9] else {}), **({"total_amount": float(row[10])} if row[10] else {}),
            "location": {"city": row[12], "country": row[13]}}
    return json.dumps({**body, **changes})


def batch(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def table(spark, root, name, want):
    return rows(refresh.read(spark, root, name).select(*want.columns))


OPERATORS = [("metrics_1min", metrics.minute_metrics), ("metrics_1hour", metrics.hour_metrics), ("product_metrics", products.product_metrics),
             ("geo_metrics", geo.geo_metrics), ("rankings", lambda e: products.ranking_history(e, 5))]


def test_batches_late_events_and_redelivery(spark, golden):
    """Out of order, with every message twice and broken ones between; the tables equal those of all events at once."""
    root = scratch(spark, "job")
    texts = [text(r) for r in GOLDEN]
    batches = [[*texts[5:], "{broken", "{broken"], [*texts[:3], texts[7]], [*texts, json.dumps({"event_id": "x"})]]
    for number, some in enumerate(batches):
        for _ in range(2 if number == 1 else 1):    # the second batch is repeated after a restart
            refresh.process(spark, root, batch(spark, some), number, names=list(refresh.TABLES))
    for upkeep in (None, {}, {"fan": 2}, {"fan": 2, "grace_seconds": 0}):
        if upkeep is not None:
            refresh.maintain(spark, root, **upkeep)
        for name, operator in OPERATORS:
            assert table(spark, root, name, operator(golden)) == rows(operator(golden)), (name, upkeep)
        assert rows(refresh.raw_events(spark, root), "event_id") == sorted([(r[0],) for r in GOLDEN], key=repr)
        letters = refresh.read(spark, root, "dead_letters")
        assert rows(letters, "reject_reason", "message_text") == [("malformed json", "{broken"), ("missing event_type", '{"event_id": "x"}')]
        assert len(parts.live(spark, f"{root}/events_raw")) == (2 if upkeep and "fan" in upkeep else 3)
    assert parts.stored(spark, f"{root}/events_raw") == [(0, 1), (2, 2)]
    refresh.process(spark, root, batch(spark, texts), 1)    # a batch that is compacted already changes nothing
    refresh.process(spark, root, batch(spark, ["{broken"]), 3)
    assert rows(refresh.raw_events(spark, root), "event_id") == sorted([(r[0],) for r in GOLDEN], key=repr)
    assert set(refresh.register_tables(spark, root)) == {"events_raw", "dead_letters", *refresh.TABLES}
    assert spark.sql("SELECT COUNT(*) AS n FROM metrics_1min JOIN events_raw ON time_bucket = date_trunc('minute', timestamp)").first()["n"] == len(GOLDEN)


def test_no_raw_event_outside_the_batch(spark, golden, monkeypatch):
    """Late events of stored minutes are taken in without a look at the raw table: reads of it are for the batch's own part
    and, for the alert log, of the hour of the newest event."""
    root, seen = scratch(spark, "job"), []
    texts, read = [text(r) for r in GOLDEN], parts.read

    def watched(spark, path, schema, by=(), runs=None, **options):
        seen.append((path.rsplit("/", 1)[1], runs))
        return read(spark, path, schema, by, runs, **options)
    monkeypatch.setattr(parts, "read", watched)
    for number in (0, 1):
        seen.clear()
        refresh.process(spark, root, batch(spark, texts[number::2]), number, names=refresh.DEFAULT_TABLES)
    assert [runs for name, runs in seen if name == "events_raw"] == [[(1, 1)]]
    monkeypatch.undo()
    for name, operator in OPERATORS:
        assert table(spark, root, name, operator(golden)) == rows(operator(golden)), name


def test_an_id_is_stored_once_whatever_its_date(spark):
    root = scratch(spark, "job")
    first, again = event("e1", "23:59:59", "product_view", "u1", "s1", "p1"), event("e1", "00:00:01", "product_view", "u1", "s1", "p1", day="2025-01-04")
    other = event("e2", "00:00:02", "product_view", "u1", "s1", "p1", day="2025-01-04")
    for number, some in enumerate([[first, first], [again, other], [again, first]]):
        refresh.process(spark, root, batch(spark, [text(r) for r in some]), number, names=["metrics_1min"])
    assert rows(refresh.raw_events(spark, root), "event_id", "timestamp") == [("e1", first[2]), ("e2", other[2])]
    assert rows(refresh.read(spark, root, "metrics_1min"), "time_bucket", "total_views") == [(minute("23:59"), 1), (minute("23:59") + timedelta(minutes=1), 1)]


def test_only_the_folders_of_the_ids_are_read(spark):
    root = scratch(spark, "job")
    refresh.process(spark, root, batch(spark, [text(r) for r in GOLDEN]), 0, names=[])
    index = parts.read(spark, f"{root}/event_ids", spark.createDataFrame([], "event_id string, seen date").schema, ("bucket",)).filter(F.col("bucket").isin([3]))
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:120]


def test_first_batch_without_products_and_batches_without_events(spark):
    """Schemas come from the operators: tables that hold nothing yet are empty, and the alert check runs over them."""
    root = scratch(spark, "job")
    refresh.process(spark, root, batch(spark, ["{broken"]), 0)
    refresh.process(spark, root, batch(spark, [text(event("e1", "10:00:00", "search", "u1", "s1"))]), 1)
    refresh.process(spark, root, batch(spark, []), 2)
    assert refresh.read(spark, root, "metrics_1min").count() == 1
    assert refresh.read(spark, root, "product_metrics").count() == refresh.read(spark, root, "alert_log").count() == refresh.read(spark, root, "rankings").count() == 0


def test_a_crash_between_tables(spark, golden, monkeypatch):
    """The batch is repeated after a crash behind any of its parts, with other events of the same ids: the raw part decides."""
    texts, publish = [text(r) for r in GOLDEN], parts.publish
    for last in ("events_raw", "activity", "metrics_1min"):
        root = scratch(spark, "job")
        refresh.process(spark, root, batch(spark, texts[:5]), 0, names=["metrics_1min", "metrics_1hour"])

        def crash(rows, path, *args, **options):
            publish(rows, path, *args, **options)
            if path.endswith(last):
                raise KeyboardInterrupt
        monkeypatch.setattr(parts, "publish", crash)
        with pytest.raises(KeyboardInterrupt):
            refresh.process(spark, root, batch(spark, texts[5:]), 1, names=["metrics_1min", "metrics_1hour"])
        monkeypatch.undo()
        refresh.process(spark, root, batch(spark, texts[5:]), 1, names=["metrics_1min", "metrics_1hour"])
        for name, operator in OPERATORS[:2]:
            assert table(spark, root, name, operator(golden)) == rows(operator(golden)), (name, last)


def test_a_part_without_its_mark_does_not_count(spark):
    path = scratch(spark, "parts")
    parts.publish(spark.range(3), path, (0, 0))
    spark.range(5).write.parquet(parts.folder(path, (1, 1)))
    os.remove(f"{parts.folder(path, (1, 1))}/_SUCCESS")
    assert parts.live(spark, path) == [(0, 0)]
    parts.publish(spark.range(7), path, (1, 1))
    parts.publish(spark.range(9), path, (1, 1))    # a part that counts is left alone
    assert parts.read(spark, path, spark.range(1).schema).count() == 10


def test_readers_never_miss_a_date(spark, golden):
    """A thread reads while batches change the same minutes and parts are compacted and removed."""
    root, seen, stop = scratch(spark, "job"), [], threading.Event()
    texts = [text(r) for r in GOLDEN]
    refresh.process(spark, root, batch(spark, texts[:2]), 0, names=["metrics_1min"])

    def look():
        while not stop.is_set():
            seen.append(refresh.read(spark, root, "metrics_1min").agg(F.sum("total_views")).first()[0])
    reader = threading.Thread(target=look)
    reader.start()
    try:
        for number in range(2, len(texts), 2):
            refresh.process(spark, root, batch(spark, texts[number:number + 2]), number, names=["metrics_1min"])
            refresh.maintain(spark, root, fan=2)
    finally:
        stop.set()
        reader.join()
    assert seen == sorted(seen) and seen[0] == 2 and len(seen) > 3


def test_upkeep_drops_old_dates_and_late_events_for_them_change_nothing(spark):
    root = scratch(spark, "job")
    old, new = event("e1", "10:00:00", "product_view", "u1", "s1", "p1"), event("e2", "10:00:00", "product_view", "u1", "s1", "p1", day="2025-01-20")
    late = event("e3", "10:00:30", "product_view", "u2", "s2", "p1")
    refresh.process(spark, root, batch(spark, [text(old), text(new)]), 0, names=["metrics_1min", "metrics_1hour"])
    done = refresh.maintain(spark, root, "2025-01-20 12:00:00")
    assert done == {"activity": ["2025-01-03"], "metrics_1min": ["2025-01-03"]}
    refresh.process(spark, root, batch(spark, [text(late)]), 1, names=["metrics_1min", "metrics_1hour"])
    assert rows(refresh.read(spark, root, "metrics_1hour"), "total_views") == [(1,), (1,)] and refresh.raw_events(spark, root).count() == 3
    assert rows(refresh.read(spark, root, "metrics_1min"), "time_bucket") == [(new[2],)]
    assert refresh.maintain(spark, root, "2025-02-15 12:00:00")["events_raw"] == ["2025-01-03"]
    assert [p for p in os.listdir(f"{root}/_partials_from")] and refresh.raw_events(spark, root).count() == 1


def test_a_batch_leaves_no_intermediates(spark):
    root, before = scratch(spark, "job"), set(os.listdir(_scratch_root(spark)))
    refresh.process(spark, root, batch(spark, [text(r) for r in GOLDEN]), 0)
    assert set(os.listdir(_scratch_root(spark))) - before == {os.path.basename(root)}


def test_two_minutes_read_one_hour(spark):
    """Files of a date follow each other in time: a range of two minutes reads the rows of one file only."""
    path, schema = scratch(spark, "raw"), "timestamp timestamp_ntz, filler string"
    start = minute("00:00")
    some = spark.createDataFrame([(start + timedelta(seconds=30 * i), "x" * 10) for i in range(2880)], schema).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts.publish(sinks.with_date(some, "timestamp"), path, (0, 0), (sinks.DATE,), "timestamp", ranges=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = parts.read(spark, path, some.schema, (sinks.DATE,))
    files = sorted(tuple(r) for r in written.groupBy(F.input_file_name()).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).select("a", "b").collect())
    assert len(files) == 4 and all(before[1] < after[0] for before, after in zip(files, files[1:]))
    read = parts.read(spark, path, some.schema, (sinks.DATE,), start=minute("07:30"), end=minute("07:32"))
    assert len(read.filter((F.col("timestamp") >= minute("07:30")) & (F.col("timestamp") < minute("07:32"))).collect()) == 4
    read.collect()
    node = read._jdf.queryExecution().executedPlan()
    while not node.nodeName().startswith("Scan"):
        node = node.children().apply(0)
    assert node.metrics().apply("numOutputRows").value() <= 2880 // 3


def test_alert_log(spark, frame):
    """Alerts of the minutes that each batch completes, the gap between batches included; a repeated batch adds none."""
    root = scratch(spark, "job")
    views = [event(f"v{i}", f"10:{i // 4:02d}:{i % 4 * 7:02d}", "product_view", "u1", "s1", "p1") for i in range(80)]
    later = [event(f"w{i}", f"10:{40 + i // 9:02d}:{i % 9:02d}", "product_view", "u2", "s2", "p2") for i in range(90)]
    for number, some in enumerate([views, later, later]):
        refresh.process(spark, root, batch(spark, [text(r) for r in some]), min(number, 1))
    log = refresh.read(spark, root, "alert_log")
    everything = frame(views + later)
    want = alerts.run_all_checks(metrics.minute_metrics(everything), products.product_metrics(everything), until=minute("10:49"))
    assert rows(log, "id", "detected_at", "alert_type") == rows(want, "id", "detected_at", "alert_type")
    assert log.filter(F.col("detected_at") == minute("10:25")).count() > 0 and log.filter("is_active").count() == log.count()
    much_later = [event("z", "11:30:30", "product_view", "u2", "s2", "p2")]
    refresh.process(spark, root, batch(spark, [text(r) for r in much_later]), 2)
    log, known = refresh.read(spark, root, "alert_log"), rows(want, "id")
    assert rows(log.filter("NOT is_active"), "id") == rows(log.filter(F.col("detected_at") < minute("10:30")), "id") != []
    assert rows(log.filter("NOT is_active").select("resolved_at").distinct()) == [(minute("11:30"),)]
    assert {r[0] for r in known} <= {r[0] for r in rows(log, "id")} and log.count() == log.select("id").distinct().count()
    before = rows(log)
    refresh.maintain(spark, root, fan=2, grace_seconds=0)
    assert rows(refresh.read(spark, root, "alert_log")) == before
    assert refresh.read(spark, root, "alert_episodes").agg(F.sum("alerts")).first()[0] == len(before)


def test_stopped_and_resumed_stream(spark, golden):
    root, source = scratch(spark, "job"), scratch(spark, "messages")
    texts = [text(r) for r in GOLDEN]
    for some in (texts[:6], texts[4:]):
        batch(spark, some).coalesce(1).write.mode("append").parquet(source)
        jobs.wait([refresh.start(jobs.file_stream(spark, source, "value string", 1), root, every=None, names=["metrics_1min"], maintain_every=1)])
    assert table(spark, root, "metrics_1min", metrics.minute_metrics(golden)) == rows(metrics.minute_metrics(golden))


def test_a_bad_time_does_not_move_the_watermark(spark, golden, frame):
    source, root = scratch(spark, "messages"), scratch(spark, "out")
    texts = [text(r) for r in GOLDEN]
    closing = text(event("e99", "10:59:00", "product_view", "u2", "s9", "p2"))
    for some in ([*texts[:4], text(GOLDEN[0], event_id="bad", timestamp="23:59")], [text(GOLDEN[0], event_id="odd", timestamp="2031")], texts[4:], [closing]):
        batch(spark, some).coalesce(1).write.mode("append").parquet(source)
    counted = metrics.minute_metrics(jobs.events_from_messages(jobs.file_stream(spark, source, "value string", 1)))
    jobs.wait([jobs.start_append(counted, "q", root, "time_bucket")])
    assert rows(naive_utc(jobs.stored(spark, root, "q", counted.schema))) == rows(metrics.minute_metrics(golden))


def test_refresh_of_the_last_minutes(spark, golden, frame):
    raw, stored = scratch(spark, "raw"), scratch(spark, "minutes")
    sinks.write_table(golden, raw, "timestamp")
    refresh.refresh_minutes(spark, raw, stored, "2025-01-03 10:32:40", minutes=1)
    want = metrics.minute_metrics(golden)
    assert table(spark, stored, "", want) == rows(want.filter(F.minute("time_bucket") == 31))
    refresh.refresh_minutes(spark, raw, stored, "2025-01-03 10:33:00")
    assert table(spark, stored, "", want) == rows(want.filter(F.minute("time_bucket") >= 31))


def test_hours_from_minutes(spark, golden):
    stored = metrics.minute_metrics(golden).join(metrics.minute_sketches(golden), "time_bucket")
    assert rows(metrics.hour_rollup(stored)) == rows(metrics.hour_metrics(golden))


@pytest.mark.parametrize("clock,minutes,start", [("10:59:59.9", 5, "10:55"), ("00:00:00", 60, "00:00"), ("23:59:00", 60, "23:00"), ("10:03:00", 1, "10:03")])
def test_buckets(spark, clock, minutes, start):
    got = spark.sql(f"SELECT timestamp_ntz'2025-01-03 {clock}' AS t").select(refresh.bucket_of(F.col("t"), minutes)).first()[0]
    assert got == minute(start) + timedelta(0)


def test_carts_funnel_and_lateness(spark, golden):
    """Removes, adds and views that come late: tables that are only added to equal the operators over all events."""
    root = scratch(spark, "job")
    names = ["carts", "session_events", "lateness"]
    order = [9, 8, 7, 3, 0, 1, 2, 6, 5, 4]
    for number, some in enumerate([order[:3], order[3:7], order[7:]]):
        for _ in range(1 + number % 2):
            refresh.process(spark, root, batch(spark, [text(GOLDEN[i]) for i in some]), number, names=names)
    for upkeep in (False, True):
        if upkeep:
            refresh.maintain(spark, root, fan=2, grace_seconds=0)
        assert rows(refresh.read(spark, root, "carts"), "session_id", "product_id", "open_quantity") == rows(sessions.cart_state(golden))
        assert rows(refresh.read(spark, root, "session_funnel")) == rows(sessions.session_funnel(golden))
        late = rows(refresh.read(spark, root, "lateness"), "time_bucket", "events", "late_events", "most_late_seconds")
        assert late == want_lateness(order)


def want_lateness(order):
    known, out = None, {}
    for some in (order[:3], order[3:7], order[7:]):
        for i in some:
            time = GOLDEN[i][2]
            delay = (known - time).total_seconds() if known else 0.0
            n, late, most = out.get(time.replace(second=0, microsecond=0), (0, 0, 0.0))
            is_late = delay > refresh.LATE_SECONDS
            out[time.replace(second=0, microsecond=0)] = (n + 1, late + is_late, max(most, delay if is_late else 0.0))
        known = max([GOLDEN[i][2] for i in some] + ([known] if known else []))
    return sorted((m, *v) for m, v in out.items())


def test_expired_carts_go(spark):
    root = scratch(spark, "job")
    some = [event("e1", "10:00:00", "add_to_cart", "u1", "s1", "p1", 2), event("e2", "11:00:00", "add_to_cart", "u2", "s2", "p2", 1), event("e3", "11:01:00", "remove_from_cart", "u2", "s2", "p2", 1)]
    refresh.process(spark, root, batch(spark, [text(r) for r in some]), 0, names=["carts"])
    assert rows(refresh.read(spark, root, "carts"), "session_id", "open_quantity") == [("s1", 2)]
    assert rows(refresh.read(spark, root, "carts", start="2025-01-03 10:30:00"), "session_id") == []


def test_only_ids_in_doubt_are_gathered(spark, monkeypatch):
    """Rows of new ids that come once are not put in order by id; those of ids that come again or are stored are."""
    root, asked, deduplicate = scratch(spark, "job"), [], refresh.source.deduplicate

    def watched(events, *args):
        asked.append(rows(events, "event_id"))
        return deduplicate(events, *args)
    monkeypatch.setattr(refresh.source, "deduplicate", watched)
    texts = [text(r) for r in GOLDEN]
    for number, some in enumerate([texts[:4], [*texts[3:6], texts[5]], texts[6:]]):
        refresh.process(spark, root, batch(spark, some), number, names=[])
    assert asked == [sorted([("e4",), ("e6",), ("e6",)])]
    assert rows(refresh.raw_events(spark, root), "event_id") == sorted([(r[0],) for r in GOLDEN], key=repr)


def test_events_without_an_id_and_full_repeats(spark, frame):
    """Those without an id are one row of each batch, as null is no stored id; a batch that is stored already adds nothing."""
    root = scratch(spark, "job")
    some = spark.createDataFrame([(None, minute("10:00"), 1), (None, minute("10:00"), 2), ("a", minute("10:01"), 4), ("a", minute("10:01"), 3)],
                                 "event_id string, timestamp timestamp_ntz, quantity int")
    for number in range(3):
        fresh = refresh.store_events(spark, root, some, number)
        assert rows(fresh, "event_id", "quantity") == ([("a", 3), (None, 1)] if number == 0 else [(None, 1)])


def test_a_row_is_compacted_once_a_call(spark, monkeypatch):
    """Parts that would become one in several steps are written as one at once."""
    path, written, publish = scratch(spark, "parts"), [], parts.publish
    for number in range(5):
        parts.publish(spark.range(number, number + 1), path, (number, number))

    def watched(rows, path, run, *args, **options):
        written.append(run)
        publish(rows, path, run, *args, **options)
    monkeypatch.setattr(parts, "publish", watched)
    assert parts.compact(spark, path, spark.range(1).schema, lambda rows: rows, fan=2) == [(0, 3)] == written
    assert parts.live(spark, path) == [(0, 3), (4, 4)]
    assert rows(parts.read(spark, path, spark.range(1).schema)) == [(n,) for n in range(5)]

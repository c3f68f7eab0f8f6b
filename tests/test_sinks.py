import os

import pytest
from pyspark.sql import functions as F

from clickweir.session import clear_scratch, scratch, shared_root
from clickweir.sinks import jdbc, tables
from clickweir.sources import kafka
from clickweir.sources.tables import scan


def table(spark, *values):
    df = spark.createDataFrame([(t, float(v)) for t, v in values], "t string, v double")
    return df.select(F.col("t").cast("timestamp_ntz").alias("time_bucket"), "v")


@pytest.fixture
def stored(spark):
    path = scratch(spark, "table")
    tables.write_table(table(spark, ("2025-01-01 10:00", 1), ("2025-01-02 10:00", 2), ("2025-01-02 11:00", 3),
                             ("2025-01-03 10:00", 4)), path, "time_bucket")
    return path


def values(spark, path, key=None):
    return [r["v"] for r in sorted(spark.read.parquet(path).collect(), key=lambda r: (key(r["time_bucket"]) if key else r["time_bucket"], r["v"]))]


def files(path, date):
    return sorted(os.listdir(f"{path}/event_date={date}"))


def test_upsert_touches_only_its_dates(spark, stored):
    untouched = files(stored, "2025-01-01"), files(stored, "2025-01-03")
    new = table(spark, ("2025-01-02 11:00", 30), ("2025-01-02 12:00", 5), ("2025-01-04 10:00", 6))
    for _ in range(2):
        tables.upsert_table(spark, stored, new, ["time_bucket"])
        assert values(spark, stored) == [1, 2, 30, 5, 4, 6]
    assert untouched == (files(stored, "2025-01-01"), files(stored, "2025-01-03"))


def test_insert_absent_keeps_old_rows(spark, stored):
    new = table(spark, ("2025-01-02 11:00", 30), ("2025-01-02 12:00", 5))
    for _ in range(2):
        tables.insert_absent_table(spark, stored, new, ["time_bucket"])
        assert values(spark, stored) == [1, 2, 3, 5, 4]


def test_rows_without_a_time_stay_and_are_found_again(spark, stored):
    for value in (9, 8):
        tables.upsert_table(spark, stored, table(spark, (None, value), ("2025-01-04 10:00", 6)), ["time_bucket"])
        assert sorted(values(spark, stored, key=str)) == sorted([1, 2, 3, 4, 6, value])
    tables.insert_absent_table(spark, stored, table(spark, (None, 7)), ["time_bucket"])
    assert 8 in values(spark, stored, key=str) and 7 not in values(spark, stored, key=str)


def test_repeated_and_moved_keys(spark, stored):
    tables.upsert_table(spark, stored, table(spark, ("2025-01-02 11:00", 30), ("2025-01-02 11:00", 31)), ["time_bucket"])
    assert values(spark, stored) == [1, 2, 31, 4]
    with pytest.raises(ValueError, match="time_bucket"):
        tables.upsert_table(spark, stored, table(spark, ("2025-01-05 11:00", 3)), ["v"])


@pytest.mark.parametrize("change", [tables.upsert_table, tables.insert_absent_table])
def test_missing_and_emptied_tables(spark, change):
    path = scratch(spark, "fresh")
    change(spark, path, table(spark, ("2025-01-02 11:00", 3)).limit(0), ["time_bucket"])
    change(spark, path, table(spark, ("2025-01-02 11:00", 3)), ["time_bucket"])
    assert values(spark, path) == [3]
    assert tables.drop_expired(spark, path, "2025-03-01", days=1) == ["2025-01-02"]
    change(spark, path, table(spark, ("2025-01-02 11:00", 5)), ["time_bucket"])
    assert values(spark, path) == [5]


@pytest.mark.parametrize("moved", [0, 1])
def test_a_crash_between_stage_and_swap(spark, stored, monkeypatch, moved):
    """The job ends before, or between, the moves; the next call of any kind finishes it."""
    new = table(spark, ("2025-01-01 11:00", 10), ("2025-01-02 11:00", 30), ("2025-01-04 10:00", 6))

    def crash(spark, path):
        stage = f"{path}/_stage/{os.listdir(path + '/_stage')[0]}"
        for part in sorted(p for p in os.listdir(stage) if p.startswith("event_date="))[:moved]:
            fs, make = tables._hadoop(spark, path)
            fs.delete(make(f"{path}/{part}"), True)
            fs.rename(make(f"{stage}/{part}"), make(f"{path}/{part}"))
        raise InterruptedError

    whole = tables.recover
    monkeypatch.setattr(tables, "recover", lambda spark, path: None if not os.path.isdir(path + "/_stage") else crash(spark, path))
    with pytest.raises(InterruptedError):
        tables.upsert_table(spark, stored, new, ["time_bucket"])
    monkeypatch.setattr(tables, "recover", whole)
    os.makedirs(f"{stored}/_stage/unfinished/event_date=2025-01-03")
    tables.replace_bucket_table(spark, stored, table(spark, ("2025-01-03 10:00", 40)), "2025-01-03 10:00:00")
    assert values(spark, stored) == [1, 10, 2, 30, 40, 6]
    assert os.listdir(f"{stored}/_stage") == []


def test_upsert_reads_only_its_dates_and_computes_new_rows_once(spark, stored, monkeypatch):
    plans, computed = [], spark.sparkContext.accumulator(0)
    keep = tables._put
    monkeypatch.setattr(tables, "_put", lambda spark, path, after, dates: (plans.append(after._jdf.queryExecution().executedPlan().toString()), keep(spark, path, after, dates)))
    source = scratch(spark, "source")
    table(spark, ("2025-01-02 11:00", 30), ("2025-01-02 12:00", 5)).coalesce(1).write.parquet(source)

    @F.udf("double")
    def seen(v):
        computed.add(1)
        return v

    new = spark.read.parquet(source).withColumn("v", seen("v"))
    tables.upsert_table(spark, stored, new, ["time_bucket"])
    filters = [part.split("]")[0] for part in plans[0].split("PartitionFilters: [")[1:]]
    assert any("event_date" in f and "2025-01-02" in f for f in filters)
    assert computed.value == 2


def test_retained_prunes_dates(spark, stored):
    plan = tables.retained(spark.read.parquet(stored), "time_bucket", "2025-01-03 10:30:00", days=1)._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_replace_bucket(spark, stored):
    tables.replace_bucket_table(spark, stored, table(spark, ("2025-01-02 11:00", 7), ("2025-01-02 11:00", 8)), "2025-01-02 11:00:00")
    assert sorted(values(spark, stored)) == [1, 2, 4, 7, 8]
    empty = table(spark, ("2025-01-02 11:00", 7)).limit(0)
    tables.replace_bucket_table(spark, stored, empty, "2025-01-02 11:00:00")
    assert values(spark, stored) == [1, 2, 4]
    tables.replace_bucket_table(spark, stored, empty, "2025-01-03 10:00:00")
    assert values(spark, stored) == [1, 2]


def test_retention(spark, stored):
    kept = tables.retained(spark.read.parquet(stored), "time_bucket", "2025-01-03 10:30:00", days=1)
    assert sorted(r["v"] for r in kept.collect()) == [3, 4]
    assert tables.drop_expired(spark, stored, "2025-01-03 10:30:00", days=1) == ["2025-01-01"]
    assert values(spark, stored) == [2, 3, 4]


def test_scan_prunes_dates(spark, stored):
    got = scan(spark, stored, "time_bucket", "2025-01-02", "2025-01-03")
    assert sorted(r["v"] for r in got.collect()) == [2, 3]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "time_bucket" in plan.split("PushedFilters:")[1].split("]")[0]


def test_weeks(spark):
    got = tables.with_week(table(spark, ("2025-01-05 10:00", 1), ("2025-01-06 10:00", 2)), "time_bucket")
    assert [str(r["event_week"]) for r in got.collect()] == ["2024-12-30", "2025-01-06"]


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    whole = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: None if key == "spark.checkpoint.dir" else whole(self, key, *default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(spark)
    spark.conf.set("clickweir.root", "/some/where/")
    assert shared_root(spark) == "/some/where"
    spark.conf.unset("clickweir.root")


def test_scratch_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("clickweir.session.shared_root", lambda spark: str(tmp_path))
    path = scratch(spark, "one")
    spark.range(3).write.parquet(path)
    clear_scratch(spark)
    assert not os.path.exists(path)


def test_kafka_options():
    live = kafka.kafka_options("a:9092,b:9092")
    assert live["startingOffsets"] == "latest" and live["failOnDataLoss"] == "false"
    assert live["subscribe"] == "ecommerce-events" and "maxOffsetsPerTrigger" not in live
    replay = kafka.kafka_options("a:9092", "t", replay=True, max_offsets_per_trigger=500)
    assert replay["startingOffsets"] == "earliest" and replay["maxOffsetsPerTrigger"] == "500"


def test_jdbc_options():
    got = jdbc.jdbc_options("postgres://shop:p%40ss@db:5432/shop", "metrics_1min")
    assert got["url"] == "jdbc:postgresql://db:5432/shop"
    assert (got["user"], got["password"], got["dbtable"]) == ("shop", "p@ss", "metrics_1min")
    assert "user" not in jdbc.jdbc_options("postgresql://db/shop", "t")
    with pytest.raises(ValueError):
        jdbc.jdbc_options("mysql://db/shop", "t")

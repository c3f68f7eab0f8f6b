import random
from datetime import datetime

from pyspark.sql import functions as F

from clickweir.functions import display, money, ratios, times
from clickweir.functions.money import amount_sum


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_guarded_ratios(spark):
    assert one(spark, ratios.safe_ratio(F.lit(1), F.lit(4))) == 0.25
    assert one(spark, ratios.safe_ratio(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, ratios.safe_ratio(F.lit(1), F.lit(0), None)) is None
    assert one(spark, ratios.shortfall_percent(F.lit(3), F.lit(2))) == -50.0
    assert one(spark, ratios.shortfall_percent(F.lit(3), F.lit(0))) == 0.0
    assert one(spark, ratios.percent_change(F.lit(150), F.lit(100))) == 50.0
    assert one(spark, ratios.percent_change(F.lit(150), F.lit(0))) == 0.0
    assert one(spark, ratios.percent_change(F.lit(150), F.lit(-1))) == 0.0


def test_rounding_equals_python(spark):
    rng = random.Random(7)
    values = [0.125, 0.375, 2.675, 2.345, 62.5, 63.5, 1.005, -0.125, -2.675, 3.125, 6.25, 0.05, 0.15, 1e-9, 0.0, 1e17, -62.5]
    values += [rng.randint(0, 400) / rng.randint(1, 64) * 100 for _ in range(3000)]
    values += [rng.randint(-100000, 100000) / 1000 for _ in range(3000)]
    values += [rng.uniform(-1e6, 1e6) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    value = F.col("v")
    for digits in (0, 1, 2):
        got = df.select("v", ratios.round_exact(value, digits).alias("r"), display.fixed(value, digits).alias("t")).collect()
        for row in got:
            assert row["r"] == round(row["v"], digits), (row["v"], digits)
            assert row["t"] == f"{row['v']:.{digits}f}", (row["v"], digits)


def test_ties_away_from_zero(spark):
    for value, digits, want in [(0.25, 1, 0.3), (-0.25, 1, -0.3), (2.5, 0, 3.0), (-2.5, 0, -3.0), (2.675, 2, 2.67)]:
        assert one(spark, ratios.round_exact(F.lit(value), digits, ties="away")) == want


def test_money_is_exact(spark):
    df = spark.range(100_000).select(F.lit(0.1).alias("a"))
    assert df.agg(amount_sum("a").alias("x")).first()["x"] == 10_000.0
    assert df.filter("a > 1").agg(amount_sum("a").alias("x")).first()["x"] == 0.0


def test_display(spark):
    assert one(spark, display.currency(F.lit(1234567.5))) == "$1,234,568"
    assert one(spark, display.currency(F.lit(-1234.0))) == "-$1,234"
    assert one(spark, display.currency(F.lit(None))) == "$0"
    assert one(spark, display.thousands(F.lit(1234567))) == "1,234,567"
    assert one(spark, display.signed_percent(F.lit(12.34))) == "+12.3%"
    assert one(spark, display.signed_percent(F.lit(-12.36))) == "-12.4%"
    assert one(spark, display.fixed(F.lit(62.5), 0, signed=True)) == "+62"
    assert one(spark, display.place_label(F.lit("Oslo"), F.lit("Norway"))) == "Oslo, Norway"


def test_local_times(spark):
    winter, summer = times.at("2025-01-03 00:05:09"), times.at("2025-07-03 16:05:09")
    assert one(spark, display.clock_label(winter)) == "7:05:09 PM ET"
    assert one(spark, display.clock_label_with_place(winter)) == "07:05:09 PM ET (Charlotte, NC)"
    assert one(spark, display.date_time_label(winter)) == "Jan 2, 07:05 PM ET"
    assert one(spark, display.chart_label(summer)) == "12:05 PM"
    assert one(spark, display.daylight_label(winter)) == "EST"
    assert one(spark, display.zone_label(summer)) == "EDT (Eastern Daylight Time) - Charlotte, NC"


def test_time_helpers(spark):
    ts = times.at("2025-01-03 10:34:56.789")
    assert one(spark, times.truncate(ts, "minute")) == datetime(2025, 1, 3, 10, 34)
    assert one(spark, times.truncate(ts, "hour")) == datetime(2025, 1, 3, 10)
    assert one(spark, times.from_micros(times.micros(ts))) == datetime(2025, 1, 3, 10, 34, 56, 789000)


def test_range_is_half_open_and_prunes_dates(spark):
    df = spark.sql("SELECT explode(sequence(timestamp_ntz'2025-01-01', timestamp_ntz'2025-01-04', interval 6 hours)) AS ts")
    df = df.withColumn("event_date", F.to_date("ts"))
    got = times.between(df, "ts", "2025-01-02", "2025-01-03")
    assert got.count() == 4
    assert "event_date" in got._jdf.queryExecution().analyzed().toString()


def test_truncation_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:15.5' AS t UNION ALL SELECT timestamp_ntz'1969-12-31 23:59:59.5'")
        got = df.select(times.truncate(F.col("t"), "hour").cast("string"), times.truncate(F.col("t"), "minute").cast("string")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [tuple(r) for r in got] == [("2024-03-10 02:00:00", "2024-03-10 02:30:00"), ("1969-12-31 23:00:00", "1969-12-31 23:59:00")]


def test_cents_are_exact(spark):
    df = spark.sql("SELECT CAST('9999999999999999.99' AS DECIMAL(18, 2)) AS a UNION ALL SELECT CAST('45035996273704.97' AS DECIMAL(18, 2))")
    assert [r[0] for r in df.select(money.cents(F.col("a"))).collect()] == [999999999999999999, 4503599627370497]

"""The whole job: messages in, all tables kept up to date, at a cost that follows the batch.

Each micro-batch is decoded once. Broken messages go to the dead letters, new events to the raw table. An event id is
stored once, whatever dates its copies bear: an index of ids, dealt by hash, is looked up before. From the new events
alone the batch makes its partials, which say what it adds to each minute's sessions, users, products and places. The
buckets that it touches are then made again from the partials of their minutes, old and new, and stored as newer rows of
the served tables. So no raw event outside the batch is read, late events count, a repeated batch changes nothing, and no
table depends on state that a restart could lose.

All tables are made of parts (see sinks.parts): readers always find every date, and see a batch in a table as soon as its
part is written, table by table. Of a served bucket the rows of its newest batch count; read() picks them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.times import at, between, instant, naive_utc, truncate
from ..operators import alerts, geo, metrics, products, sessions
from ..session import drop_scratch, require_utc, scratch
from ..sinks import parts, tables as sinks
from ..sinks.parts import DATE, Run
from ..sources import messages as source
from ..sources.tables import register_views, scan

RAW, LETTERS, LOG, EPISODES, INDEX = "events_raw", "dead_letters", "alert_log", "alert_episodes", "event_ids"
CARTS, STEPS, FUNNEL, LATENESS = "carts", "session_events", "session_funnel", "lateness"
LATE_SECONDS = 120  # fixed value: behind the newest event by more than this, an event is late
RANKING_MINUTES = 5
BUCKETS = 16   # folders of the id index; an event id always falls in the same one
WRITERS = 6    # tables written at the same time
BATCH = "batch"  # of served rows: the batch that made them



@dataclass(frozen=True)
class Partial:
    make: Callable[[DataFrame], DataFrame]
    add: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Table:
    """A served table: made from one kind of partials, in buckets of `minutes`."""
    partial: str
    make: Callable[[DataFrame], DataFrame]
    key: list[str]
    minutes: int


PARTIALS = {
    "activity": Partial(metrics.activity, lambda p: metrics.added(p, metrics.ACTIVITY_KEY, metrics.ACTIVITY_SUMS)),
    "sketches": Partial(metrics.minute_sketches, metrics.united_sketches),
    "products": Partial(products.product_partials, lambda p: metrics.added(p, products.PARTIAL_KEY, products.PARTIAL_SUMS)),
    "places": Partial(geo.geo_partials, lambda p: metrics.added(p, geo.PARTIAL_KEY, geo.PARTIAL_SUMS)),
}

TABLES = {
    "metrics_1min": Table("activity", metrics.minutes_of_activity, ["time_bucket"], 1),
    "metrics_1hour": Table("activity", metrics.hours_of_activity, ["time_bucket"], 60),
    "product_metrics": Table("products", products.products_of_partials, products.PARTIAL_KEY, 1),
    "geo_metrics": Table("places", geo.places_of_partials, ["time_bucket", "country", "city"], 1),
    "rankings": Table("products", lambda p: products.rankings_of_partials(p, RANKING_MINUTES), ["time_bucket", "rank"], RANKING_MINUTES),
    "sketches_1min": Table("sketches", metrics.united_sketches, ["time_bucket"], 1),
}
# Tables that are only added to, and added up by the reader: no part of them is ever made again.
ADDED = {
    CARTS: Partial(sessions.cart_moves, sessions.added_moves),
    STEPS: Partial(sessions.session_events, sessions.funnel_events),
    LATENESS: Partial(lambda late: late, lambda p: p.groupBy("time_bucket").agg(
        F.sum("events").alias("events"), F.sum("late_events").alias("late_events"), F.max("most_late_seconds").alias("most_late_seconds"))),
}
DEFAULT_TABLES = [name for name in TABLES if name != "sketches_1min"]

_LETTER = "received timestamp_ntz, reject_reason string, message_text string"
_ID = "event_id string, seen date"


def refresh_minutes(spark: SparkSession, events_path: str, metrics_path: str, as_of, minutes: int = 2) -> None:
    """Aggregate the last whole minutes before `as_of` again from the stored events and upsert them."""
    end = instant(as_of).replace(second=0, microsecond=0)
    recent = scan(spark, events_path, start=end - timedelta(minutes=minutes), end=end)
    sinks.upsert_table(spark, metrics_path, metrics.minute_metrics(recent), ["time_bucket"])


def bucket_of(column: Column, minutes: int) -> Column:
    """Start of the bucket of `minutes` that holds a naive time; buckets divide the day from midnight."""
    start = truncate(column, "day")
    within = F.hour(column) * 60 + F.minute(column)
    return start + F.make_dt_interval(mins=within - F.pmod(within, F.lit(minutes)))


# What is stored

def _event_schema(spark: SparkSession) -> StructType:
    """Columns of the raw table, as decoding gives them."""
    nothing = spark.createDataFrame([], "value string")
    return naive_utc(source.flatten(source.accepted(source.decode(nothing)))).schema


_known_schemas: dict[str, dict[str, StructType]] = {}


def _schemas(spark: SparkSession) -> dict[str, StructType]:
    """Schema of every partial and served table, from the operators over no events; never from stored files. They are
    found once per application."""
    application = spark.sparkContext.applicationId
    if application not in _known_schemas:
        _known_schemas[application] = _find_schemas(spark)
    return _known_schemas[application]


def _find_schemas(spark: SparkSession) -> dict[str, StructType]:
    nothing = spark.createDataFrame([], _event_schema(spark))
    found = {RAW: nothing.schema, LETTERS: spark.createDataFrame([], _LETTER).schema, INDEX: spark.createDataFrame([], _ID).schema}
    found |= {name: partial.make(nothing).schema for name, partial in PARTIALS.items()}
    found |= {CARTS: ADDED[CARTS].make(nothing).schema, STEPS: ADDED[STEPS].make(nothing).schema, LATENESS: _lateness(nothing, None).schema}
    batch = StructField(BATCH, LongType())
    for name, table in TABLES.items():
        found[name] = StructType([*table.make(spark.createDataFrame([], found[table.partial])).schema.fields, batch])
    empty = spark.createDataFrame([], found["metrics_1min"]), spark.createDataFrame([], found["product_metrics"])
    found[LOG] = StructType([*alerts.run_all_checks(*empty).schema.fields, batch])
    return found


def raw_events(spark: SparkSession, root: str, schema: StructType | None = None, start=None, end=None) -> DataFrame:
    """The stored events in ``[start, end)``, with the columns of `schema` if given. Bounds prune dates, and within a date
    the files, which follow each other in time."""
    rows = parts.read(spark, f"{root}/{RAW}", schema or _schemas(spark)[RAW], (DATE,), start=start, end=end)
    return between(rows, "timestamp", start, end).drop(DATE)


def _newest(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of the rows of a key those of its newest batch."""
    last = rows.groupBy(*[F.col(k).alias(f"last_{k}") for k in key]).agg(F.max(BATCH).alias("last"))
    same = [F.col(k).eqNullSafe(F.col(f"last_{k}")) for k in key]
    return rows.join(last, [*same, F.col(BATCH) == F.col("last")], "left_semi")


def read(spark: SparkSession, root: str, name: str, start=None, end=None) -> DataFrame:
    """A served table, its bounds on the time bucket; the alert log, each alert as it stands, or its episodes; the dead
    letters; the raw events; the open carts, without those that lie still since before `start`; the session funnel (one row);
    or how many events of each minute came late. A table that holds nothing yet is empty. An empty name is the table at `root`
    itself, as refresh_minutes writes it."""
    if not name:
        return scan(spark, root, "time_bucket", start, end)
    if name == RAW:
        return raw_events(spark, root, None, start, end)
    if name == LETTERS:
        return parts.read(spark, f"{root}/{name}", _schemas(spark)[name]).distinct()
    if name == EPISODES:
        return alerts.episodes(read(spark, root, LOG, start, end))
    if name in (CARTS, FUNNEL, LATENESS):
        stored = STEPS if name == FUNNEL else name
        rows = parts.read(spark, f"{root}/{stored}", _schemas(spark)[stored])
        if name == LATENESS:
            return between(ADDED[name].add(rows), "time_bucket", start, end)
        return sessions.open_carts(rows, start) if name == CARTS else sessions.session_funnel(rows)
    column, key = ("detected_at", ["id", "detected_at"]) if name == LOG else ("time_bucket", ["time_bucket"])
    rows = parts.read(spark, f"{root}/{name}", _schemas(spark)[name], (DATE,), start=start, end=end)
    return _newest(between(rows, column, start, end), key).drop(BATCH, DATE)


# A batch

def store_events(spark: SparkSession, root: str, events: DataFrame, batch_id: int, keep_days: int | None = None) -> DataFrame:
    """Add the events whose id is not stored yet, as the batch's part, and their ids to the index. Returns them.

    The part decides: if it is there, a repeated batch takes its events from it. Only the index folders that the ids fall
    in are read. `events` are read several times, so they should be stored.
    """
    path, index, run = f"{root}/{RAW}", f"{root}/{INDEX}", (batch_id, batch_id)
    bucket = F.pmod(F.xxhash64("event_id"), F.lit(BUCKETS)).cast("int")
    if run not in parts.stored(spark, path):
        folders = scratch(spark, "doubtful"), scratch(spark, "once")
        buckets = [r["bucket"] for r in events.select(bucket.alias("bucket")).distinct().collect()]  # BUCKETS rows at most
        known = parts.read(spark, index, _schemas(spark)[INDEX], ("bucket",)).filter(F.col("bucket").isin(buckets)).select("event_id")
        fresh = _fresh(spark, events, known, *folders)
        parts.publish(sinks.with_date(fresh, "timestamp"), path, run, (DATE,), "timestamp", ranges=True)
        drop_scratch(spark, folders)
    fresh = parts.read(spark, path, events.schema, (DATE,), [run]).drop(DATE,)
    parts.publish(fresh.select("event_id", F.to_date("timestamp").alias("seen"), bucket.alias("bucket")), index, run, ("bucket",))
    return fresh


def _fresh(spark: SparkSession, events: DataFrame, known: DataFrame, doubtful: str, once: str) -> DataFrame:
    """One row per id that is not `known`. Most ids come once and are new, which hashes of ids alone tell; the rows of
    those are taken as they are. Only rows whose hash occurs again or is known are gathered and compared by their ids."""
    def hashed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_hash", F.xxhash64("event_id"))

    again = hashed(events.select("event_id")).groupBy("_hash").agg(F.count(F.lit(1)).alias("n"))
    stored = hashed(known).select("_hash").withColumn("stored", F.lit(True))
    again.join(stored, "_hash", "left").filter((F.col("n") > 1) | F.col("stored")).select("_hash").write.parquet(doubtful)
    hashes = spark.read.schema("_hash bigint").parquet(doubtful)
    if hashes.isEmpty():
        return events
    few = source.deduplicate(hashed(events).join(hashes, "_hash", "left_semi").drop("_hash"))
    stored = hashed(known).join(hashes, "_hash", "left_semi").select("event_id")
    few.join(stored, "event_id", "left_anti").select(*events.columns).write.parquet(once)
    plain = hashed(events).join(hashes, "_hash", "left_anti").select(*events.columns)
    return plain.unionByName(spark.read.schema(events.schema).parquet(once))


def process(spark: SparkSession, root: str, batch: DataFrame, batch_id: int, names: Sequence[str] = (*DEFAULT_TABLES, LOG),
            value: str = "value", received: str | None = None, ahead_minutes: float | None = None,
            rules: Sequence[alerts.Rule] | None = None, trending: dict | None = None, resolve_hours: float | None = 1) -> None:
    """Take one batch of messages into the tables below `root`. Batches are numbered upwards. `names` may be empty: then
    only events and letters are stored. Alerts older than `resolve_hours` before the newest event are resolved in the log."""
    if any(lo <= batch_id <= hi and lo < hi for lo, hi in parts.live(spark, f"{root}/{RAW}")):
        return  # compacted already, so it was taken whole
    arrived = F.col(received).cast("timestamp_ntz") if received else F.lit(None).cast("timestamp_ntz")
    path, run = scratch(spark, "decoded"), (batch_id, batch_id)
    source.decode(batch.withColumn("_arrived", arrived), value, received=received, ahead_minutes=ahead_minutes, keep=["_arrived"]).write.parquet(path)
    decoded = spark.read.parquet(path)
    letters = source.rejected(decoded).select(F.col("_arrived").alias("received"), "reject_reason", "message_text").distinct()
    if not letters.isEmpty():
        parts.publish(letters, f"{root}/{LETTERS}", run)

    good = naive_utc(source.flatten(source.accepted(decoded)))
    known_until = _known_until(spark, root, good.schema, batch_id) if LOG in names or LATENESS in names else None
    fresh = store_events(spark, root, good, batch_id)
    drop_scratch(spark, [path])
    made = {name: _lateness(fresh, known_until) if name == LATENESS else ADDED[name].make(fresh) for name in names if name in ADDED}
    _side_by_side(lambda name: parts.publish(made[name], f"{root}/{name}", run), made)
    wanted = [n for n in names if n in TABLES]
    if not wanted:
        return
    horizon = _horizon(spark, root)
    if horizon:
        fresh = fresh.filter(F.col("timestamp") >= at(horizon))
    minutes = fresh.groupBy(truncate(F.col("timestamp"), "minute").alias("minute")).agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    touched = scratch(spark, "touched")
    minutes.write.parquet(touched)
    minutes = spark.read.schema(minutes.schema).parquet(touched)
    dates = sorted(r["d"] for r in minutes.select(F.to_date("minute").alias("d")).distinct().collect() if r["d"])
    if dates:
        _side_by_side(lambda name: parts.publish(sinks.with_date(PARTIALS[name].make(fresh), "time_bucket"), f"{root}/{name}", run, (DATE,), "time_bucket"),
                      dict.fromkeys(TABLES[n].partial for n in wanted))
        _side_by_side(lambda name: _serve(spark, root, name, minutes, dates, batch_id), wanted)
        if LOG in names:
            span = minutes.agg(F.min("first").alias("first"), F.max("last").alias("last")).first()
            _check(spark, root, dates, span, known_until, batch_id, rules, trending or {}, resolve_hours)
    drop_scratch(spark, [touched])


def _side_by_side(work: Callable[[str], None], names: Iterable[str]) -> None:
    """Independent writes as jobs of the same time; the first failure is raised when all have ended."""
    with ThreadPoolExecutor(WRITERS) as pool:
        for done in [pool.submit(work, name) for name in names]:
            done.result()


_HORIZON = "_partials_from"


def _horizon(spark: SparkSession, root: str) -> str | None:
    """The first date whose partials are still whole. Older events are stored, but the tables stay as they were there."""
    return max(parts._children(spark, f"{root}/{_HORIZON}"), default=None)


def _known_until(spark: SparkSession, root: str, schema: StructType, batch_id: int) -> datetime | None:
    """Time of the newest event of earlier batches; folder names lead to its date, of which the times are read."""
    path = f"{root}/{RAW}"
    runs = [run for run in parts.live(spark, path) if run[1] < batch_id]
    known = [d for run in runs for d in _dates_in(spark, path, run)]
    if not known:
        return None
    return parts.read(spark, path, schema, (DATE,), runs, [max(known)]).agg(F.max("timestamp")).first()[0]


def _lateness(fresh: DataFrame, known_until: datetime | None) -> DataFrame:
    """Partials of lateness: per minute the events, those behind the newest event known before by more than LATE_SECONDS,
    and by how much the latest of them is."""
    behind = F.timestamp_diff("MICROSECOND", F.col("timestamp"), at(known_until)) / 1e6 if known_until else F.lit(0.0)
    late = F.when(F.col("behind") > LATE_SECONDS, F.col("behind"))
    return fresh.withColumn("behind", behind).groupBy(truncate(F.col("timestamp"), "minute").alias("time_bucket")).agg(
        F.count(F.lit(1)).alias("events"), F.count(late).alias("late_events"), F.coalesce(F.max(late), F.lit(0.0)).alias("most_late_seconds"))


def _dates_in(spark: SparkSession, path: str, run: Run) -> list[date]:
    names = [n.split("=", 1)[1] for n in parts._children(spark, parts.folder(path, run)) if n.startswith(f"{DATE}=")]
    return [date.fromisoformat(n) for n in names if n[:1].isdigit()]


def _serve(spark: SparkSession, root: str, name: str, minutes: DataFrame, dates: list[date], batch_id: int) -> None:
    """Make the touched buckets of a table from the partials of their minutes."""
    table = TABLES[name]
    buckets = minutes.select(bucket_of(F.col("minute"), table.minutes).alias("touched")).distinct()
    ends = buckets.agg(F.min("touched").alias("lo"), F.max("touched").alias("hi")).first()
    end = ends["hi"] + timedelta(minutes=table.minutes)
    rows = parts.read(spark, f"{root}/{table.partial}", _schemas(spark)[table.partial], (DATE,), dates=dates, start=ends["lo"], end=end)
    if table.minutes == 1:
        rows = rows.join(buckets, F.col("time_bucket") == F.col("touched"), "left_semi")
    else:
        rows = rows.join(buckets, bucket_of(F.col("time_bucket"), table.minutes) == F.col("touched"), "left_semi")
    made = table.make(rows.drop(DATE)).withColumn(BATCH, F.lit(batch_id).cast("long"))
    parts.publish(sinks.with_date(made, "time_bucket"), f"{root}/{name}", (batch_id, batch_id), (DATE,), "time_bucket")


def _spells(dates: list[date], known_until: datetime | None, last: datetime, reach: timedelta) -> list[tuple[datetime, datetime]]:
    """Times to be judged: runs of touched dates, each with the reach of its last minute. Between the newest event known
    before and the batch's newest all minutes count, as silence raises alerts too."""
    days = set(dates)
    if known_until:
        day = known_until.date()
        while day < last.date():
            days.add(day)
            day += timedelta(days=1)
    spells: list[tuple[datetime, datetime]] = []
    for day in sorted(days):
        begin = datetime(day.year, day.month, day.day)
        end = begin + timedelta(days=1) + reach
        if spells and begin <= spells[-1][1]:
            spells[-1] = (spells[-1][0], end)
        else:
            spells.append((begin, end))
    return spells


def _check(spark: SparkSession, root: str, dates: list[date], span, known_until: datetime | None, batch_id: int, rules, trending: dict,
           resolve_hours: float | None) -> None:
    """Judge the whole minutes that the batch has completed or changed; an alert that is logged already stays as it is."""
    rules = rules or alerts.minute_rules()
    reach = timedelta(minutes=max([*(r.reads for r in rules), trending.get("minutes", 5)]))
    until = max(t for t in (span["last"], known_until) if t).replace(second=0, microsecond=0)
    first = min(t for t in (span["first"], known_until) if t).replace(second=0, microsecond=0)
    log = read(spark, root, LOG)
    found = []
    for begin, end in _spells(dates, known_until, span["last"], reach):
        begin, end = max(begin, first), min(end, until)
        minutes, stored = (read(spark, root, n, begin - reach, end) for n in ("metrics_1min", "product_metrics"))
        found.append(alerts.run_all_checks(minutes, stored, since=begin, until=end, rules=rules, **trending))
    path = scratch(spark, "found")
    found = reduce(DataFrame.unionByName, found).dropDuplicates(["id", "detected_at"])
    found.write.parquet(path)
    new = sinks.absent(log, spark.read.schema(found.schema).parquet(path), ["id", "detected_at"])
    if resolve_hours is not None:
        known = log.unionByName(new)
        expired = alerts.newly_expired(known, until, resolve_hours)
        new = expired.unionByName(sinks.absent(expired, new, ["id", "detected_at"]))
    new = new.withColumn(BATCH, F.lit(batch_id).cast("long"))
    parts.publish(sinks.with_date(new, "detected_at"), f"{root}/{LOG}", (batch_id, batch_id), (DATE,), "detected_at")
    drop_scratch(spark, [path])


# Upkeep

def maintain(spark: SparkSession, root: str, as_of=None, keep_days: Mapping[str, int] | None = None, fan: int = parts.FAN,
             grace_seconds: float = 3600) -> dict[str, list]:
    """Compact the parts of all tables, remove what compaction has replaced for `grace_seconds`, and with `as_of` drop
    the dates that are older than `keep_days` (by default sinks.RETENTION_DAYS). Readers and the job's next batches are not disturbed;
    the job's writer must be the caller. Partials go with the minute metrics: events that come for dates before
    are stored and change no other table. Index ids go with the raw events. Returns the
    new parts and dropped dates by table."""
    schemas, done = _schemas(spark), {}
    keep = dict(sinks.RETENTION_DAYS if keep_days is None else keep_days)
    day = None if as_of is None else instant(as_of).date()

    def cutoff(name: str) -> date | None:
        limit = "metrics_1min" if name in PARTIALS else RAW if name == INDEX else name
        return day - timedelta(days=keep[limit]) if day and limit in keep else None

    def same(rows: DataFrame) -> DataFrame:
        return rows

    def seen_lately(rows: DataFrame) -> DataFrame:
        before = cutoff(INDEX)
        return rows if before is None else rows.filter(F.col("seen") >= F.lit(before))

    plans = {RAW: (same, (DATE,), "timestamp"), INDEX: (seen_lately, ("bucket",), None), LETTERS: (lambda rows: rows.distinct(), (), None),
             LOG: (lambda rows: _newest(rows, ["id", "detected_at"]), (DATE,), "detected_at")}
    plans |= {name: (lambda rows, p=partial: sinks.with_date(p.add(rows), "time_bucket"), (DATE,), "time_bucket") for name, partial in PARTIALS.items()}
    plans |= {name: (partial.add, (), None) for name, partial in ADDED.items()}
    plans |= {name: (lambda rows: _newest(rows, ["time_bucket"]), (DATE,), "time_bucket") for name in TABLES}
    if cutoff("activity"):
        fs, make = parts._hadoop(spark, root)
        fs.mkdirs(make(f"{root}/{_HORIZON}/{cutoff('activity').isoformat()}"))
    def upkeep(name: str) -> None:
        path, before, (combine, by, column) = f"{root}/{name}", cutoff(name), plans[name]
        gone = parts.drop_before(spark, path, before) if before and DATE in by else []
        made = parts.compact(spark, path, schemas[name], combine, by, column, fan, ranges=name == RAW)
        parts.sweep(spark, path, grace_seconds)
        if made or gone:
            done[name] = [*made, *gone]

    _side_by_side(upkeep, plans)
    return done


def start(messages: DataFrame, root: str, every: str | None = "1 minute", maintain_every: int = parts.FAN, keep_days: Mapping[str, int] | None = None,
          retain: bool = False, **options) -> StreamingQuery:
    """The job over a stream of messages; `options` are those of process(). Without `every` it takes what is there and ends.
    Every `maintain_every` batches the tables are compacted, and with `retain` dates beyond `keep_days` before the newest
    stored one are dropped."""
    spark = require_utc(messages.sparkSession)

    def take(batch: DataFrame, batch_id: int) -> None:
        process(spark, root, batch, batch_id, **options)
        if batch_id % maintain_every == maintain_every - 1:
            newest = [d for d in parts.dates_of(spark, f"{root}/{RAW}") if d[:1].isdigit()] if retain else []
            maintain(spark, root, max(newest, default=None), keep_days)

    writer = messages.writeStream.queryName("all_tables").foreachBatch(take).option("checkpointLocation", f"{root}/_checkpoints/all_tables")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def register_tables(spark: SparkSession, root: str) -> list[str]:
    """Views named like the tables below `root`, for ad-hoc SQL. Tables that hold nothing yet are left out."""
    names = [n for n in (RAW, LETTERS, LOG, *TABLES) if parts.live(spark, f"{root}/{n}")]
    names += [n for n in (CARTS, LATENESS) if parts.live(spark, f"{root}/{n}")]
    names += [view for view, stored in ((EPISODES, LOG), (FUNNEL, STEPS)) if parts.live(spark, f"{root}/{stored}")]
    register_views({n: read(spark, root, n) for n in names})
    return names

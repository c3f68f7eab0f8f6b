"""Streaming queries over one event source: raw events, metrics per minute and hour, products, places, sessions.

Each query has a name and a checkpoint of that name, so a restart resumes it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.geo import geo_metrics
from ..operators.metrics import hour_metrics, minute_metrics
from ..operators.products import product_metrics
from ..operators.sessions import stream_sessions
from ..functions.times import naive_utc
from ..session import require_utc
from ..sinks.tables import DATE, upsert_table, with_date
from ..sources.messages import accepted, decode, flatten

# Fixed value: how late an event may be.
LATENESS = "2 minutes"


def watermarked(events: DataFrame, delay: str = LATENESS) -> DataFrame:
    """Streams need instants: a naive timestamp column is read as UTC.

    Spark moves later filters on other columns below the watermark, so the watermark of a pipeline follows
    the events that pipeline keeps.
    """
    require_utc(events.sparkSession)
    return events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)


def events_from_messages(messages: DataFrame, delay: str = LATENESS) -> DataFrame:
    """Flat events of the good messages, with a watermark."""
    return watermarked(flatten(accepted(decode(messages))), delay)


def file_stream(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


# Query name -> (operator on watermarked events, time column of the result).
PIPELINES: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "events_raw": (lambda events: events, "timestamp"),
    "metrics_1min": (minute_metrics, "time_bucket"),
    "metrics_1hour": (hour_metrics, "time_bucket"),
    "product_metrics": (product_metrics, "time_bucket"),
    "geo_metrics": (geo_metrics, "time_bucket"),
    "sessions": (stream_sessions, "session_start"),
}


def start_append(df: DataFrame, name: str, root: str, column: str, every: str | None = None) -> StreamingQuery:
    """Append finished rows to the date-partitioned table ``root/name``.

    Spark's file sink commits each batch once, in a log beside the files. `every` is the processing
    interval of a running job; without it the query takes what is there and ends.
    """
    writer = (
        with_date(df, column).writeStream.queryName(name).outputMode("append")
        .format("parquet").partitionBy(DATE)
        .option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/_checkpoints/{name}")
    )
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def batch_sink(path: str, column: str, key: Sequence[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer of finished buckets: they are upserted into the partitions of their dates, so a date
    stays one folder however many batches reach it, and a repeated batch changes nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_table(batch.sparkSession, path, naive_utc(batch), list(key or [column]), column)
    return write


def start_batches(df: DataFrame, name: str, root: str, column: str, every: str | None = None) -> StreamingQuery:
    """The same through ``foreachBatch``, for stores that need more than appending files."""
    writer = (
        df.writeStream.queryName(name).outputMode("append")
        .foreachBatch(batch_sink(f"{root}/{name}", column))
        .option("checkpointLocation", f"{root}/_checkpoints/{name}")
    )
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start_all(events: DataFrame, root: str, every: str | None = "1 minute") -> list[StreamingQuery]:
    """All pipelines side by side over one source of flat events."""
    source = watermarked(events)
    return [start_append(operator(source), name, root, column, every)
            for name, (operator, column) in PIPELINES.items()]


def wait(queries: list[StreamingQuery]) -> None:
    """Return when all queries have ended; the first failure stops the others and is raised."""
    running = list(queries)
    try:
        while running:
            running = [query for query in running if not query.awaitTermination(0.1)]
    except Exception:
        for query in queries:
            query.stop()
        raise


def stored(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    """The rows of a query's table. The schema is that of the stream, as the table may hold no file yet; upserted tables
    have naive times, which read as instants in UTC."""
    return spark.read.schema(schema).parquet(f"{root}/{name}").select(*schema.names)

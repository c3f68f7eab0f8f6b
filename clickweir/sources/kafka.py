"""Kafka stream options. The connector jar is supplied by the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed value: the default topic.
TOPIC = "ecommerce-events"


def kafka_options(servers: str, topic: str = TOPIC, replay: bool = False,
                  max_offsets_per_trigger: int | None = None) -> dict[str, str]:
    """Live reads start at the newest offsets; a replay starts at the oldest and may be rate limited.

    Offsets live in the query checkpoint, so no consumer group commit is needed.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest" if replay else "latest",
        "failOnDataLoss": "false",
    }
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def read_kafka(spark: SparkSession, servers: str, topic: str = TOPIC, replay: bool = False,
               max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Streaming frame with the binary `value` that ``messages.decode`` takes."""
    options = kafka_options(servers, topic, replay, max_offsets_per_trigger)
    return spark.readStream.format("kafka").options(**options).load()

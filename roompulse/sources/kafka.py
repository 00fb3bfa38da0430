"""Kafka topics as streams. Spark keeps the offsets in its checkpoint and commits none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roompulse.config import JobConfig
from roompulse.functions.columns import record_id
from roompulse.functions.protobuf import decode_events


def kafka_options(config: JobConfig, topics: str | None = None,
                  max_offsets: int | None = None) -> dict[str, str]:
    """Reader options; several topics are separated by commas."""
    names = [t.strip() for t in (topics or config.require("input_topics")).split(",")]
    options = {
        **{f"kafka.{k.removeprefix('kafka.')}": v for k, v in config.client},
        "kafka.bootstrap.servers": config.require("bootstrap_servers"),
        "subscribe": ",".join(n for n in names if n),
        "startingOffsets": config.starting_offsets,
    }
    limit = max_offsets or config.max_offsets
    if limit is not None:
        options["maxOffsetsPerTrigger"] = str(limit)
    return options


def read_kafka(spark: SparkSession, config: JobConfig, topics: str | None = None,
               max_offsets: int | None = None) -> DataFrame:
    """Raw records: ``key, value, topic, partition, offset, ...``."""
    return (spark.readStream.format("kafka")
            .options(**kafka_options(config, topics, max_offsets)).load())


def values(records: DataFrame) -> DataFrame:
    """Record values as text."""
    return records.select(F.col("value").cast("string").alias("value"))


def values_with_id(records: DataFrame) -> DataFrame:
    """Record values as text, with ``topic-partition-offset`` as ``id``."""
    return records.select(record_id().alias("id"), F.col("value").cast("string").alias("value"))


def typed_events(records: DataFrame) -> DataFrame:
    """Records written by the ETL job, as typed events."""
    return decode_events(records)

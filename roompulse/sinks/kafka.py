"""Routed events to Kafka topics, as protobuf, without a key and at least once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from roompulse.config import JobConfig
from roompulse.functions.protobuf import encode_events
from roompulse.plans.etl import GIFT_ROUTE, PRODUCT_ROUTE


def topic_of(config: JobConfig) -> Column:
    return (F.when(F.col("route") == PRODUCT_ROUTE, config.require("product_topic"))
            .when(F.col("route") == GIFT_ROUTE, config.require("gift_topic")))


def routed_messages(routed: DataFrame, config: JobConfig) -> DataFrame:
    """``topic, value`` rows for the Kafka writer; one query serves all topics."""
    return encode_events(routed.withColumn("topic", topic_of(config)), keep=["topic"])


def kafka_writer(messages: DataFrame, config: JobConfig, checkpoint: str) -> DataStreamWriter:
    return (messages.writeStream.format("kafka")
            .option("kafka.bootstrap.servers", config.require("bootstrap_servers"))
            .option("checkpointLocation", checkpoint)
            .trigger(**config.trigger))

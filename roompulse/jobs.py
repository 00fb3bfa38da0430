"""The streaming jobs, ready to start from a properties file.

``python -m roompulse.jobs <job> <job.properties> [name=folder ...]``

Names of folders: ``gifts`` (lines id,name,score), ``groupon_detail``, ``groupon_main``, ``orders``
(lines), ``order_table`` (parquet with the current orders), ``results``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from roompulse import schemas as S
from roompulse.config import JobConfig
from roompulse.operators.parsing import parse_changes, parse_events
from roompulse.plans import audience, etl, gifts, groupon, users
from roompulse.session import tune
from roompulse.sinks.database import FLUSH_MS, database_rows
from roompulse.sinks.kafka import kafka_writer, routed_messages
from roompulse.sinks.tables import BatchFn, batch_table
from roompulse.sources import kafka
from roompulse.sources.files import read_lines
from roompulse.streaming import metrics
from roompulse.streaming.gifts import gift_facts_stream
from roompulse.streaming.orders import lookup_batches, order_details_stream


@dataclass
class Inputs:
    """Where a job reads from. ``records`` may be replaced, for Kafka-shaped files say."""

    spark: SparkSession
    config: JobConfig
    folders: dict[str, str] = field(default_factory=dict)
    records: Callable[[str | None], DataFrame] | None = None

    def raw(self, topics: str | None = None) -> DataFrame:
        if self.records is not None:
            return self.records(topics)
        return kafka.read_kafka(self.spark, self.config, topics)

    def events(self) -> DataFrame:
        return parse_events(self.raw()).clean

    def events_with_id(self) -> DataFrame:
        return etl.clean_events(self.raw()).clean

    def changes(self, topic: str, layout: dict[str, str]) -> DataFrame:
        return parse_changes(self.raw(self.config.require(topic)), layout).clean

    def folder(self, name: str) -> str:
        if name not in self.folders:
            raise ValueError(f"folder '{name}' is missing")
        return self.folders[name]

    def lines(self, name: str, streaming: bool = True, with_time: bool = False) -> DataFrame:
        return read_lines(self.spark, self.folder(name), streaming, with_time=with_time)

    def checkpoint(self, job: str) -> str:
        return f"{self.config.require('checkpoint_path').rstrip('/')}/{job}"


Job = tuple[Callable[[Inputs], DataFrame], str]

# Frame and output mode of each job.
JOBS: dict[str, Job] = {
    "quarantine": (lambda i: etl.clean_events(i.raw()).bad, "append"),
    "quarantine-details": (lambda i: parse_changes(
        i.raw(i.config.require("detail_topic")), S.ORDER_DETAIL).bad, "append"),
    "quarantine-orders": (lambda i: parse_changes(
        i.raw(i.config.require("main_topic")), S.ORDER_MAIN).bad, "append"),
    "new-user-flags": (lambda i: users.user_event_rows(
        metrics.flag_new_users_stream(i.events_with_id(), salts=8)), "append"),
    "new-user-flags-approx": (lambda i: users.user_event_rows(
        metrics.flag_new_users_approx_stream(i.events_with_id())), "append"),
    "new-user-count": (lambda i: users.new_user_totals_exploded(i.events()), "update"),
    "audience": (lambda i: audience.audience_totals(i.events_with_id()), "update"),
    "audience-windows": (lambda i: metrics.audience_windowed_stream(i.events_with_id()), "append"),
    "audience-valid": (lambda i: metrics.audience_valid_stream(i.events_with_id()), "append"),
    "gifts": (lambda i: i.events(), "append"),
    "gift-facts": (lambda i: gift_facts_stream(i.events(), i.lines("gifts", with_time=True)), "append"),
    "typed-events": (lambda i: kafka.typed_events(i.raw()), "append"),
    "audience-rows": (lambda i: i.events_with_id(), "append"),
    "hot-products": (lambda i: metrics.product_counts_stream(i.events()), "append"),
    "group-purchases": (lambda i: groupon.groupon_enriched(
        i.lines("groupon_detail"), i.lines("groupon_main"), i.lines("orders"), delay_ms=0), "append"),
    "order-details": (lambda i: order_details_stream(i.changes("detail_topic", S.ORDER_DETAIL),
                                                     i.changes("main_topic", S.ORDER_MAIN)), "append"),
}


# What some jobs do with each micro-batch of their frame, by batch operators, before the sink.
STEPS: dict[str, Callable[[Inputs, BatchFn], BatchFn]] = {
    "audience-rows": lambda i, sink: metrics.running_audience_batches(
        i.checkpoint("audience-totals"), sink),
    "hot-products": lambda i, sink: metrics.ranked_batches(sink),
    "gifts": lambda i, sink: metrics.gift_total_batches(
        lambda: gifts.gift_dimension(i.lines("gifts", streaming=False, with_time=True)), i.checkpoint("gift-totals"), sink),
    "order-details": lambda i, sink: lookup_batches(
        lambda: i.spark.read.parquet(i.folder("order_table")), sink),
}


def _show(batch: DataFrame, batch_id: int) -> None:
    """Print the first rows. All rows are computed, or state of the others would not be saved; they go nowhere
    else, which is said as well."""
    held = batch.persist()
    try:
        print(f"batch {batch_id}: {held.count()} rows, shown in part and kept nowhere: name a folder 'results'")
        held.show(truncate=False)
    finally:
        held.unpersist()


def start(job: str, inputs: Inputs, sink: BatchFn | None = None, **trigger) -> StreamingQuery:
    """Start one job.

    Its results go to ``sink``, else to the database table that the properties name (``sink.database.connect`` and
    ``sink.database.table``; every two seconds), else to the folder ``results`` if there is one, else the first rows of each
    micro-batch are printed. A ``sink`` must read its whole micro-batch.
    """
    tune(inputs.spark, streaming=True)
    config = inputs.config
    if sink is None and config.database:
        sink = database_rows(inputs.spark, config.database, config.require("table"), job)
        trigger = trigger or {"processingTime": f"{FLUSH_MS} milliseconds"}
    trigger = trigger or config.trigger
    checkpoint = inputs.checkpoint(job)
    if job == "etl":
        routed = etl.etl_route(inputs.events_with_id())
        return kafka_writer(routed_messages(routed, inputs.config), inputs.config, checkpoint).start()
    if sink is None:
        sink = batch_table(inputs.folder("results")) if "results" in inputs.folders else _show
    frame, mode = JOBS[job]
    step = STEPS.get(job, lambda _, plain: plain)
    return (frame(inputs).writeStream.outputMode(mode).foreachBatch(step(inputs, sink))
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def main(arguments: list[str]) -> None:
    job, properties, *folders = arguments
    spark = SparkSession.builder.appName(job).getOrCreate()
    inputs = Inputs(spark, JobConfig.from_properties(properties),
                    dict(f.split("=", 1) for f in folders))
    start(job, inputs).awaitTermination()


if __name__ == "__main__":
    main(sys.argv[1:])

"""Metrics on streams of typed events.

``audience_totals``, ``new_by``, ``new_user_totals_exploded``, ``gift_facts``, ``gift_totals``,
``order_window_join``, ``groupon_enriched`` and ``etl_route`` of :mod:`roompulse.plans` take streams as
they are; here is what needs more than that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse import schemas as S
from roompulse.functions.columns import live_delta
from roompulse.operators.filters import only_event
from roompulse.operators.ranking import top_k
from roompulse.operators.windows import interval, window_bounds, with_event_time
from roompulse.plans import gifts
from roompulse.plans.audience import MINUTE, audience_running, audience_totals, live_events
from roompulse.plans.products import KEYS, product_events
from roompulse.plans.users import ORDER
from roompulse.sinks.tables import BatchFn, write_batch
from roompulse.streaming.scalable_bloom import Growth
from roompulse.streaming.stateful import bloom_seen_stream, dwell_changes, first_seen_stream, summed_changes, window_totals

# Columns the new-user metrics need; no wider row goes through the state operator.
USER_FIELDS = ["id", "deviceId", "eventId", "osName", "province", "releaseChannel", "deviceType",
               "timestamp"]


def flag_new_users_stream(events: DataFrame, salts: int = 1,
                          ttl_ms: int | None = None) -> DataFrame:
    """Launch events with the exact new-device flag, in order of arrival."""
    rows = only_event(events, S.APP_LAUNCH).select(*USER_FIELDS)
    return first_seen_stream(rows, "deviceId", ORDER, "id", salts=salts, ttl_ms=ttl_ms)


def flag_new_users_approx_stream(events: DataFrame, growth: Growth = Growth()) -> DataFrame:
    """As :func:`flag_new_users_stream`, by one growing Bloom filter per device type."""
    rows = only_event(events, S.APP_LAUNCH).select(*USER_FIELDS)
    return bloom_seen_stream(rows, "deviceType", "deviceId", ORDER, growth)


def audience_windowed_stream(events: DataFrame, size_ms: int = 2_000, delay_ms: int | None = None) -> DataFrame:
    """Online and cumulative viewers at the end of each window in which something happened, when it closes. Append mode.

    Windows are of the time of arrival, or with ``delay_ms`` of the event time, where later rows are dropped. Rows are added up
    per room and window first; only these sums meet the room's history.
    """
    delta = live_delta()
    rows = live_events(events, S.ANCHOR)
    if delay_ms is None:
        rows = rows.withColumn("event_time", F.current_timestamp()).withWatermark("event_time", "0 seconds")
    else:
        rows = with_event_time(rows.filter(F.col("timestamp").isNotNull()), "timestamp", delay_ms)
    windows = (rows.groupBy(F.window("event_time", interval(size_ms)), S.ANCHOR)
               .agg(F.sum(delta["online"]).alias("online"), F.sum(delta["total"]).alias("total"))
               .select(S.ANCHOR, *window_bounds(), "online", "total"))
    return window_totals(windows, [S.ANCHOR], ["online", "total"])


def valid_changes_stream(events: DataFrame, dwell_ms: int = MINUTE, delay_ms: int = 0,
                         keep_ms: int | None = None) -> DataFrame:
    """Changes of the valid audience: 1 when a visit has lasted, -1 when a late row shows that it has not."""
    rows = live_events(events, S.ANCHOR, S.SESSION).select(
        S.ANCHOR, S.SESSION, "id", "timestamp", (F.col("eventId") == S.LIVE_ENTER).alias("entered"))
    return dwell_changes(with_event_time(rows, "timestamp", delay_ms), [S.ANCHOR, S.SESSION],
                         "timestamp", "id", "entered", dwell_ms, keep_ms)


def audience_valid_stream(events: DataFrame, dwell_ms: int = MINUTE, delay_ms: int = 0,
                          keep_ms: int | None = None) -> DataFrame:
    """Viewers per room who stayed, after each micro-batch that changes it; the last row of a room holds. Append mode."""
    changes = valid_changes_stream(events, dwell_ms, delay_ms, keep_ms)
    return summed_changes(changes, [S.ANCHOR], "change", "valid_total", [S.SESSION])


def product_counts_stream(events: DataFrame, size_ms: int = 600_000, slide_ms: int = 60_000,
                          delay_ms: int = 0) -> DataFrame:
    """Closed sliding windows with their counts. Append mode; late rows are dropped.

    Append mode hands out all counts of a window in the micro-batch that closes it: :func:`ranked_batches` ranks them.
    """
    rows = with_event_time(product_events(events), "timestamp", delay_ms)
    return (rows.groupBy(F.window("event_time", interval(size_ms), interval(slide_ms)), *KEYS)
            .agg(F.count("*").alias("count"))
            .select(*KEYS, "count", *window_bounds()))


def ranked_batches(sink: BatchFn, k: int = 3) -> BatchFn:
    """``foreachBatch`` function that ranks closed windows with the batch operator."""
    def rank(batch: DataFrame, batch_id: int) -> None:
        sink(top_k(batch, ["window_start", S.CATEGORY, "eventId"],
                   [F.desc("count"), S.PRODUCT], k), batch_id)
    return rank


def gift_batches(load_dimension: Callable[[], DataFrame], sink: BatchFn) -> BatchFn:
    """``foreachBatch`` function: gifts with name and score, the dimension read anew each time."""
    def look_up(batch: DataFrame, batch_id: int) -> None:
        sink(gifts.gift_facts(batch, load_dimension()), batch_id)
    return look_up


def gift_total_batches(load_dimension: Callable[[], DataFrame], folder: str, sink: BatchFn) -> BatchFn:
    """``foreachBatch`` function: gifts and points of all rooms so far, each gift at the points it had when it came.

    The dimension is read anew each time. Totals of earlier batches come from the version that the batch
    before has written under ``folder``, so a batch that is run again counts once.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        now = gifts.gift_totals(batch, load_dimension())
        if batch_id > 0:
            before = batch.sparkSession.read.parquet(f"{folder}/batch_id={batch_id - 1}")
            now = before.unionByName(now).groupBy(S.ANCHOR).agg(
                F.sum("gifts").alias("gifts"), F.sum("points").alias("points"))
        write_batch(now, batch_id, folder)
        sink(batch.sparkSession.read.parquet(f"{folder}/batch_id={batch_id}"), batch_id)
    return run


def running_audience_batches(folder: str, sink: BatchFn, *cells_ms: int) -> BatchFn:
    """``foreachBatch`` function: one row per enter or leave with the running totals of its room.

    Inside a micro-batch the batch operator does the work, so a hot room is spread over tasks. The
    totals that rooms had before the batch come from a table under ``folder`` that each batch writes
    as its own version; a batch that is run again reads the same earlier version.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = live_events(batch, S.ANCHOR).select("id", "timestamp", "eventId", "properties")
        rows = rows.persist()
        try:
            now = audience_totals(rows)
            running = audience_running(rows, *cells_ms)
            if batch_id > 0:
                before = spark.read.parquet(f"{folder}/batch_id={batch_id - 1}")
                running = running.join(
                    before.withColumnsRenamed({"online": "_online", "total": "_total"}), S.ANCHOR, "left",
                ).select(S.ANCHOR, "id", "timestamp", *[
                    (F.col(c) + F.coalesce(F.col("_" + c), F.lit(0))).alias(c)
                    for c in ("online", "total")])
                now = before.unionByName(now).groupBy(S.ANCHOR).agg(
                    F.sum("online").alias("online"), F.sum("total").alias("total"))
            sink(running, batch_id)
            write_batch(now, batch_id, folder)
        finally:
            rows.unpersist()
    return run

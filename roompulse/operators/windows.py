"""Event-time windows, epoch aligned. Sizes are milliseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roompulse.functions.columns import floor_to


def interval(size_ms: int) -> str:
    return f"{size_ms} milliseconds"


def with_event_time(df: DataFrame, ms: str, delay_ms: int | None = None,
                    name: str = "event_time") -> DataFrame:
    """Timestamp column from epoch ms and, on a stream, its watermark delay."""
    df = df.withColumn(name, F.timestamp_millis(F.col(ms)))
    return df if delay_ms is None else df.withWatermark(name, interval(delay_ms))


def with_window(df: DataFrame, size_ms: int, name: str = "event_time") -> DataFrame:
    """Replace the event time by its tumbling window: a stream may carry only one of the two.

    Rows of a table without an event time keep a null window; a stream drops them, so they belong to a
    quarantine before that.
    """
    if df.isStreaming:
        return df.withColumn("window", F.window(name, interval(size_ms))).drop(name)
    start = floor_to(F.unix_millis(F.col(name)), size_ms)
    window = F.struct(F.timestamp_millis(start).alias("start"), F.timestamp_millis(start + size_ms).alias("end"))
    return df.withColumn("window", F.when(F.col(name).isNotNull(), window)).drop(name)


def window_bounds(column: str = "window") -> list[Column]:
    """Window start and end as epoch ms."""
    return [F.unix_millis(F.col(f"{column}.start")).alias("window_start"),
            F.unix_millis(F.col(f"{column}.end")).alias("window_end")]


def tumbling_agg(df: DataFrame, keys: Sequence[str], ms: str, size_ms: int,
                 **aggregates: Column) -> DataFrame:
    """Aggregates per key and tumbling window of an epoch-ms column; rows without a time have no window."""
    start = floor_to(ms, size_ms)
    return (df.filter(F.col(ms).isNotNull()).groupBy(start.alias("window_start"), *keys)
            .agg(*[c.alias(n) for n, c in aggregates.items()])
            .withColumn("window_end", F.col("window_start") + size_ms))


def sliding_counts(df: DataFrame, keys: Sequence[str], ms: str, size_ms: int,
                   slide_ms: int) -> DataFrame:
    """Rows per key in every sliding window that holds at least one.

    Each row belongs to ``size / slide`` windows. Rows are first counted in panes of one slide,
    and the pane counts, not the rows, are then copied into their windows.
    """
    if size_ms % slide_ms:
        windows = F.window(F.timestamp_millis(F.col(ms)), interval(size_ms), interval(slide_ms))
        return (df.groupBy(windows.alias("window"), *keys).agg(F.count("*").alias("count"))
                .select(*keys, "count", *window_bounds()))
    panes = (df.groupBy(*keys, floor_to(ms, slide_ms).alias("_pane"))
             .agg(F.count("*").alias("_n")))
    starts = F.sequence(F.col("_pane") - (size_ms - slide_ms), F.col("_pane"),
                        F.lit(slide_ms).cast("bigint"))
    return (panes.withColumn("window_start", F.explode(starts))
            .groupBy(*keys, "window_start").agg(F.sum("_n").alias("count"))
            .withColumn("window_end", F.col("window_start") + size_ms))

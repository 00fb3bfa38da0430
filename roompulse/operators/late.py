"""Rows that arrive after their window has closed.

A row is late when ``window end - 1 <= watermark``, where the watermark is the newest time seen in
earlier ingest batches, minus the allowed delay, minus 1 ms. Nothing is late in the first batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roompulse.functions.columns import floor_to
from roompulse.operators.running import running_totals


def is_late(ms: str, size_ms: int, watermark: Column) -> Column:
    last = floor_to(ms, size_ms) + size_ms - 1
    return F.coalesce(last <= watermark, F.lit(False))


def watermarks_by_batch(df: DataFrame, batch: str, ms: str, delay_ms: int,
                        batches_per_cell: int = 4096) -> DataFrame:
    """For each ingest batch, the watermark left behind by the batches before it.

    One row per batch. The running maximum goes through cells of batches, so no task sees more than
    one cell, or one row per cell.
    """
    newest = df.groupBy(batch).agg(F.max(ms).alias("_newest"))
    seen = running_totals(newest, [], [batch], {"_seen": F.col("_newest")},
                          [F.floor(F.col(batch) / batches_per_cell)], how="max", inclusive=False)
    return seen.select(batch, (F.col("_seen") - delay_ms - 1).alias("watermark"))


def flag_late(df: DataFrame, batch: str, ms: str, size_ms: int, delay_ms: int,
              flag: str = "late") -> DataFrame:
    """All rows with their lateness, for data that is tagged with its ingest batch.

    The watermarks are one row per batch.
    """
    return (df.join(watermarks_by_batch(df, batch, ms, delay_ms), batch, "left")
            .withColumn(flag, is_late(ms, size_ms, F.col("watermark"))).drop("watermark"))

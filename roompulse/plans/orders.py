"""Order details with their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse.operators.joins import window_left_join
from roompulse.operators.late import flag_late
from roompulse.operators.windows import with_event_time, with_window

SIZE_MS = 5_000
DELAY_MS = 2_000


def windowed(rows: DataFrame, size_ms: int, delay_ms: int | None = None,
             time: str = "update_time") -> DataFrame:
    """Rows in tumbling windows of ``time``, which becomes epoch ms."""
    rows = rows.withColumn(time, F.unix_millis(F.col(time).cast("timestamp")))
    return with_window(with_event_time(rows, time, delay_ms), size_ms)


def order_window_join(detail: DataFrame, main: DataFrame, size_ms: int = SIZE_MS,
                      delay_ms: int | None = None) -> DataFrame:
    """Each detail with the order rows of its window, or with nulls. Also for streams."""
    return window_left_join(windowed(detail, size_ms, delay_ms), windowed(main, size_ms, delay_ms),
                            "order_id", "oid")


def fill_main(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Look up the orders of rows that met none; ``found_by`` tells where an order came from.

    ``orders`` holds one row per ``oid``.
    """
    columns = [c for c in rows.columns if c.startswith("main_")]
    wanted = orders.withColumn("update_time", F.unix_millis(F.col("update_time").cast("timestamp")))
    found = wanted.select(
        F.col("oid").alias("order_id"),
        *[F.col(c.removeprefix("main_")).alias("_" + c) for c in columns])
    missed = F.col("main_oid").isNull()
    filled = {c: F.when(missed, F.col("_" + c)).otherwise(F.col(c)) for c in columns}
    by = F.when(~missed, "window").when(F.col("_main_oid").isNotNull(), "lookup")
    return (rows.join(found, "order_id", "left")
            .withColumns({**filled, "found_by": by}).drop(*["_" + c for c in columns]))


def fill_missed(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """:func:`fill_main` for a held micro-batch: only rows that met no order take part in the lookup.

    The range of their ids is pushed into the scan of ``orders``; where that table is large Spark adds a Bloom filter of its own.
    """
    missed = F.col("main_oid").isNull()
    met = rows.filter(~missed).withColumn("found_by", F.lit("window"))
    low, high = rows.filter(missed).agg(F.min("order_id"), F.max("order_id")).first()
    near = orders.filter(F.lit(False)) if low is None else orders.filter(F.col("oid").between(low, high))
    return met.unionByName(fill_main(rows.filter(missed), near))


def order_late_split(detail: DataFrame, size_ms: int = SIZE_MS, delay_ms: int = DELAY_MS,
                     batch: str = "ingest_batch") -> DataFrame:
    rows = detail.withColumn("update_time", F.unix_millis(F.col("update_time").cast("timestamp")))
    return flag_late(rows, batch, "update_time", size_ms, delay_ms)


def order_detail_enriched(detail: DataFrame, main: DataFrame, orders: DataFrame,
                          size_ms: int = SIZE_MS, delay_ms: int = DELAY_MS,
                          batch: str = "ingest_batch") -> DataFrame:
    """Details with their order: joined in the window when on time, looked up otherwise.

    Late rows must not join in the window. Nulling the key of late rows instead of splitting and
    uniting the two flows would send them all to one task, so their window is what gets nulled:
    the order id still spreads them.
    """
    flagged = windowed(order_late_split(detail, size_ms, delay_ms, batch)
                       .withColumn("update_time", F.timestamp_millis("update_time")), size_ms)
    open_only = flagged.withColumn("window", F.when(~F.col("late"), F.col("window")))
    joined = window_left_join(open_only, windowed(main, size_ms), "order_id", "oid")
    return fill_main(joined, orders).drop("window")

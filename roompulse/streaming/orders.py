"""Order details on a stream: on-time rows join in their window, late and missed rows are looked up, in one query.

Built-in stream joins drop rows behind the watermark without a trace. Here one stateful operator takes details and
orders together, reads the watermark itself and routes: a late detail leaves at once without an order, any
other waits for its window to close and leaves with the orders of that window. Each detail comes out once, in one table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roompulse.functions.columns import epoch_ms, floor_to
from roompulse.operators.windows import with_event_time
from roompulse.plans.orders import DELAY_MS, SIZE_MS, fill_missed
from roompulse.sinks.tables import BatchFn

PREFIX = "main_"
# Tasks that may share the details of one order and window; each of them holds that window's orders.
SALTS = 8
# Orders of one window that are held in memory while its details pass by.
CHUNK = 1024


class WindowRouter(StatefulProcessor):
    """Left join of details and orders of one (order, window), with late details passed on unjoined.

    ``detail`` and ``main`` are the schemas of the two sides. Rows wait in list states and are never gathered; a window
    closes when the watermark has reached its end.
    """

    def __init__(self, detail: T.StructType, main: T.StructType, size_ms: int):
        self.detail, self.main, self.size_ms = detail, main, size_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.details = handle.getListState("details", self.detail)
        self.mains = handle.getListState("mains", self.main)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        start = key[1]
        closed = start is None or start + self.size_ms <= timerValues.getCurrentWatermarkInMs()
        for row in rows:
            detail = row.detail and tuple(row.detail[n] for n in self.detail.names)
            if detail is None:
                if not closed:      # an order that comes after its window joins nothing
                    self.mains.appendValue(tuple(row.main[n] for n in self.main.names))
            elif closed:
                yield self._out(detail, None, True)
            else:
                self.details.appendValue(detail)
        if not closed:
            self.handle.registerTimer(start + self.size_ms - 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        none = True
        for mains in _chunks(self.mains.get(), CHUNK):
            none = False
            for detail in self.details.get():
                for main in mains:
                    yield self._out(detail, main, False)
        if none:
            for detail in self.details.get():
                yield self._out(detail, None, False)
        self.details.clear()
        self.mains.clear()

    def _out(self, detail, main, late: bool) -> Row:
        return Row(detail=dict(zip(self.detail.names, detail)),
                   main=None if main is None else dict(zip(self.main.names, main)), late=late)

    def close(self) -> None:
        pass


def _chunks(rows: Iterator, size: int) -> Iterator[list]:
    chunk: list = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def _plain(df: DataFrame) -> tuple[list, T.StructType]:
    """Columns that state can hold as they are: timestamps become microseconds."""
    times = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    columns = [F.unix_micros(c).alias(c) if c in times else F.col(c) for c in df.columns]
    return columns, T.StructType([T.StructField(f.name, T.LongType() if f.name in times else f.dataType) for f in df.schema])


def _again(side: str, df: DataFrame, prefix: str = "") -> list:
    return [(F.timestamp_micros(F.col(f"{side}.{f.name}")) if isinstance(f.dataType, T.TimestampType)
             else F.col(f"{side}.{f.name}")).alias(prefix + f.name) for f in df.schema]


def order_details_stream(detail: DataFrame, main: DataFrame, size_ms: int = SIZE_MS, delay_ms: int = DELAY_MS,
                         salts: int = SALTS, time: str = "update_time") -> DataFrame:
    """Every detail with each order of its window, or with nulls; ``late`` tells which came after their window. Append mode.

    The watermark is the newest time of earlier details less ``delay_ms``; a detail is late when its window has ended by
    then, so a silent order stream holds nothing back. Details without a time cannot wait for a window and count as
    late; those without an order id meet none. Details of one (order, window) are spread over ``salts`` tasks, so a very hot order does not
    gather in one; orders are copied to all of them for as long as their window is open.
    """
    detail = detail.withColumn(time, epoch_ms(time))
    main = main.withColumn(time, epoch_ms(time)).filter(F.col(time).isNotNull() & F.col("oid").isNotNull())
    (own, held), (theirs, kept) = _plain(detail), _plain(main)
    nothing = F.lit(None)
    start = floor_to(time, size_ms).alias("start")
    left = with_event_time(detail, time, delay_ms).select(
        F.col("order_id").alias("order_key"), start, F.pmod(F.xxhash64(*detail.columns), F.lit(salts)).cast("int").alias("salt"),
        F.struct(*own).alias("detail"), nothing.cast(kept).alias("main"))
    right = main.select(
        F.col("oid").alias("order_key"), start, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        nothing.cast(held).alias("detail"), F.struct(*theirs).alias("main"))
    # The event time stays behind: rows without it are not dropped when they are late.
    routed = left.unionByName(right).groupBy("order_key", "start", "salt").transformWithState(
        WindowRouter(held, kept, size_ms),
        T.StructType([T.StructField("detail", held), T.StructField("main", kept), T.StructField("late", T.BooleanType())]),
        "Append", "EventTime")
    return routed.select(*_again("detail", detail), *_again("main", main, PREFIX), "late")


def lookup_batches(load_orders: Callable[[], DataFrame], sink: BatchFn) -> BatchFn:
    """``foreachBatch`` function that looks up the orders which the window did not bring; other rows stay where they are."""
    def fill(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            sink(fill_missed(held, load_orders()), batch_id)
        finally:
            held.unpersist()
    return fill

"""Keyed state and timers, for what built-in streaming operators cannot say."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roompulse.streaming.scalable_bloom import Growth, SlicedBloom

# Rows that need no state are spread over this many groups.
_SPREAD = 1024


def _with_flag(row: Row, name: str, flag: int) -> Row:
    return Row(*row.__fields__, name)(*row, flag)


class FirstSeen(StatefulProcessor):
    """Flags the first row of a key. Holds one row at a time, however many a key brings."""

    def __init__(self, order: Sequence[str], flag: str, ttl_ms: int | None = None,
                 stateless: str | None = None):
        self.order, self.flag, self.ttl_ms, self.stateless = list(order), flag, ttl_ms, stateless

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.stateless is not None and key[0].startswith(self.stateless):
            for row in rows:
                yield _with_flag(row, self.flag, 0)
            return
        known = self.seen.exists()
        best = None
        for row in rows:
            if known:
                yield _with_flag(row, self.flag, 0)
            elif best is None:
                best = row
            elif _rank(row, self.order) < _rank(best, self.order):
                yield _with_flag(best, self.flag, 0)
                best = row
            else:
                yield _with_flag(row, self.flag, 0)
        if best is not None:
            self.seen.update((True,))
            yield _with_flag(best, self.flag, 1)

    def close(self) -> None:
        pass


class _MapPages:
    """Pages of a filter in a map state."""

    def __init__(self, state):
        self.state = state

    def get(self, slice_: int, page: int) -> bytes | None:
        held = self.state.getValue((slice_, page))
        return held and bytes(held[0])

    def put(self, slice_: int, page: int, bits: bytes) -> None:
        self.state.updateValue((slice_, page), (bits,))


class BloomSeen(StatefulProcessor):
    """Flags keys that one part of a Bloom filter does not know yet, and adds them.

    Of rows of one new key in a micro-batch the first in ``order`` is flagged. Only rows of new keys are held for that, at most
    ``held`` at a time: beyond it those held are given out, and the flag goes to the first row that arrived.
    """

    def __init__(self, key: str, hashed: str, order: Sequence[str], flag: str, growth: Growth, held: int = 10_000):
        self.key, self.hashed, self.order, self.flag = key, hashed, list(order), flag
        self.growth, self.held = growth, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.size = handle.getValueState("size", "slices int, filled bigint")
        self.pages = handle.getMapState("pages", "slice int, page bigint", "bits binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.size.get() or (1, 0)
        bloom = SlicedBloom(self.growth, _MapPages(self.pages), *before)
        first: dict = {}
        for row in rows:
            other = first.get(row[self.key])
            if other is not None:
                if _rank(row, self.order) < _rank(other, self.order):
                    first[row[self.key]], row = row, other
            elif bloom.add(row[self.hashed]):
                first[row[self.key]] = row
                if len(first) < self.held:
                    continue
                for row in first.values():
                    yield _with_flag(row, self.flag, 1)
                first.clear()
                continue
            yield _with_flag(row, self.flag, 0)
        for row in first.values():
            yield _with_flag(row, self.flag, 1)
        if bloom.changed or (bloom.slices, bloom.filled) != tuple(before):
            bloom.save()
            self.size.update((bloom.slices, bloom.filled))

    def close(self) -> None:
        pass


class DwellCells(StatefulProcessor):
    """Changes of the number of valid enters of one key, for rows that come in any order.

    Time is cut into cells as wide as the dwell time. Of the enters in one cell only the last event can be valid: anything
    after an enter in its cell comes too soon. Whether it is, the first time of the next cell decides. So a row touches
    three cells, each of a fixed size. An enter counts once the watermark has passed its dwell time; a row that
    comes later and ends it too soon takes the count back. Cells are kept for ``keep_ms`` behind the watermark, or for ever.
    """

    FIELDS = "low bigint, high bigint, high_id string, entered boolean, counted boolean"

    def __init__(self, keys: Sequence[str], ts: str, row_id: str, entered: str, dwell_ms: int, keep_ms: int | None = None):
        self.fields = [*keys, "enter_ts", "change"]
        self.ts, self.row_id, self.entered, self.dwell_ms = ts, row_id, entered, dwell_ms
        self.keep_cells = None if keep_ms is None else -(-keep_ms // dwell_ms) + 2

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "cell bigint", self.FIELDS)
        self.known = handle.getValueState("known", "entered boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        known = self.known.exists()
        for row in rows:
            now, name, entered = row[self.ts], row[self.row_id] or "", bool(row[self.entered])
            if entered and not known:       # so that a room nobody stayed in has a total of 0
                known = True
                self.known.update((True,))
                yield self._out(key, now, 0)
            cell = now // self.dwell_ms
            held = self.cells.getValue((cell,))
            if held is None:
                new = (now, now, name, entered, False)
                if self.keep_cells is not None:
                    self.handle.registerTimer((cell + self.keep_cells) * self.dwell_ms)
            else:
                low, high, high_id, was, counted = held
                later = (now, name) > (high, high_id)
                if later and counted:       # the enter that counted is no longer the last of its cell
                    yield self._out(key, high, -1)
                    counted = False
                new = (min(low, now), *((now, name, entered) if later else (high, high_id, was)), counted)
            if new != held:
                self.cells.updateValue((cell,), new)
                if new[3]:
                    self.handle.registerTimer(new[1] + self.dwell_ms)
                yield from self._settle(key, cell, watermark)
                yield from self._settle(key, cell - 1, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        time = expiredTimerInfo.getExpiryTimeInMs()
        yield from self._settle(key, time // self.dwell_ms - 1, timerValues.getCurrentWatermarkInMs())
        if self.keep_cells is not None and time % self.dwell_ms == 0:
            self.cells.removeKey((time // self.dwell_ms - self.keep_cells,))

    def _settle(self, key, cell: int, watermark: int) -> Iterator[Row]:
        """Count the last enter of a cell, or take its count back."""
        held = self.cells.getValue((cell,))
        if held is None or not held[3]:
            return
        low, high, high_id, entered, counted = held
        following = self.cells.getValue((cell + 1,))
        until = high + self.dwell_ms
        valid = until < watermark and not (following and following[0] <= until)
        if valid != counted:
            self.cells.updateValue((cell,), (low, high, high_id, entered, valid))
            yield self._out(key, high, 1 if valid else -1)

    def _out(self, key, enter_ts: int, change: int) -> Row:
        return Row(*self.fields)(*key, enter_ts, change)

    def close(self) -> None:
        pass


class Summed(StatefulProcessor):
    """One row per key and micro-batch: the sum of a column in it, or (``total``) in all so far."""

    def __init__(self, keys: Sequence[str], column: str, name: str, total: bool):
        self.fields, self.column, self.total = [*keys, name], column, total

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sum = handle.getValueState("sum", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total = sum(row[self.column] for row in rows)
        if self.total:
            total += (self.sum.get() or (0,))[0]
            self.sum.update((total,))
        yield Row(*self.fields)(*key, total)

    def close(self) -> None:
        pass


class WindowHistory(StatefulProcessor):
    """Totals up to each closed window of a key.

    Windows of one micro-batch come in any order. Each sets a timer at its start, which is past already; timers fire
    after the rows and in order of time, so totals add up in order and nothing is sorted or held beside the state.
    """

    def __init__(self, keys: Sequence[str], values: Sequence[str]):
        self.keys, self.values = list(keys), list(values)
        self.fields = [*keys, "window_start", "window_end", *values]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = ", ".join(f"{v} bigint" for v in self.values)
        self.totals = handle.getValueState("totals", f"start bigint, {columns}")
        self.waiting = handle.getMapState("waiting", "start bigint", f"end bigint, {columns}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            self.waiting.updateValue((row.window_start,), (row.window_end, *[row[v] for v in self.values]))
            self.handle.registerTimer(row.window_start)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        start = expiredTimerInfo.getExpiryTimeInMs()
        end, *values = self.waiting.getValue((start,))
        before = self.totals.get()
        if before is not None:
            if before[0] >= start:
                raise ValueError(f"window {start} came after window {before[0]}")
            values = [a + b for a, b in zip(values, before[1:])]
        self.waiting.removeKey((start,))
        self.totals.update((start, *values))
        yield Row(*self.fields)(*key, start, end, *values)

    def close(self) -> None:
        pass


def _rank(row: Row, order: Sequence[str]) -> tuple:
    """Sort key of a row, nulls first."""
    return tuple((row[c] is not None, row[c]) for c in order)


def _flagged_schema(df: DataFrame, flag: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(flag, T.IntegerType())])


def _flagged_by(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, flag: str,
                time_mode: str = "None") -> DataFrame:
    """Run a processor that returns its input rows with one more column."""
    return df.groupBy(*keys).transformWithState(
        processor, _flagged_schema(df, flag), "Append", time_mode)


def first_seen_stream(events: DataFrame, key: str, order: Sequence[str], row_id: str,
                      flag: str = "isN", ttl_ms: int | None = None, salts: int = 1) -> DataFrame:
    """All rows of a stream, with ``flag`` = 1 on the first row of each key. Append mode.

    A key's rows meet in one task. With ``salts`` > 1 they are first spread over that many tasks,
    each of which finds its own first row; only those candidates then meet, and all other rows
    pass on evenly spread. State grows with ``salts``, so it is for streams with very hot keys.
    Keys are kept for ever unless ``ttl_ms`` is set. Rows without a key are left out: a null is
    no device, and they belong to a quarantine.
    """
    events = events.drop(flag).filter(F.col(key).isNotNull())
    mode = "ProcessingTime" if ttl_ms else "None"
    if salts <= 1:
        return _flagged_by(events, [key], FirstSeen(order, flag, ttl_ms), flag, mode)
    spread = events.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    first = _flagged_by(spread, [key, "_salt"], FirstSeen(order, "_candidate", ttl_ms), "_candidate", mode)
    group = F.when(
        F.col("_candidate") == 1, F.concat(F.lit("k:"), F.col(key).cast("string"))
    ).otherwise(F.concat(F.lit("r:"), F.pmod(F.xxhash64(row_id), F.lit(_SPREAD)).cast("string")))
    return _flagged_by(first.withColumn("_group", group), ["_group"],
                       FirstSeen(order, flag, ttl_ms, stateless="r:"), flag, mode,
                       ).drop("_salt", "_candidate", "_group")


def first_rows_stream(events: DataFrame, key: str, row_id: str, salts: int = 4) -> DataFrame:
    """Only the first row of each key, by JVM state alone (no Python worker). Append mode.

    Duplicates are dropped per key and salt first, so that a hot key is thinned out by many tasks
    before its remaining rows, ``salts`` at most, meet.
    """
    spread = events.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)))
    return spread.dropDuplicates([key, "_salt"]).drop("_salt").dropDuplicates([key])


def bloom_seen_stream(events: DataFrame, group: str, key: str, order: Sequence[str],
                      growth: Growth = Growth(), flag: str = "isN") -> DataFrame:
    """As :func:`first_seen_stream`, approximately: one Bloom filter per ``group`` that grows with its keys.

    It is kept in ``growth.parts`` parts, so that a large group is shared by as many tasks. A new key is missed with a
    probability of ``growth.false_positives`` at most, a known one is never flagged again.
    """
    events = (events.drop(flag).filter(F.col(group).isNotNull() & F.col(key).isNotNull())
              .withColumn("_hash", F.xxhash64(key)).withColumn("_part", F.pmod("_hash", F.lit(growth.parts)).cast("int")))
    return _flagged_by(events, [group, "_part"], BloomSeen(key, "_hash", order, flag, growth), flag).drop("_part", "_hash")


def dwell_changes(events: DataFrame, keys: Sequence[str], ts: str, row_id: str, entered: str, dwell_ms: int = 60_000,
                  keep_ms: int | None = None) -> DataFrame:
    """Changes of the number of valid enters: keys, ``enter_ts`` and ``change`` (1, -1 or, at a key's first enter, 0).

    ``events`` have a watermark on a column that is dropped here, so that late rows arrive: within ``keep_ms`` behind the
    watermark (for ever, if it is not given) they still count or take counts back. Append mode. State is kept per
    ``keys``: take the room and the session, not the room alone, so that a large room is shared by all tasks.
    """
    rows = events.select(*keys, ts, row_id, entered).filter(F.col(ts).isNotNull())
    out = T.StructType([*[events.schema[k] for k in keys],
                        T.StructField("enter_ts", T.LongType()), T.StructField("change", T.IntegerType())])
    return rows.groupBy(*keys).transformWithState(
        DwellCells(keys, ts, row_id, entered, dwell_ms, keep_ms), out, "Append", "EventTime")


def summed_changes(changes: DataFrame, keys: Sequence[str], column: str, name: str, spread_by: Sequence[str],
                   salts: int = 64) -> DataFrame:
    """New total of each key after each micro-batch that changes it. Append mode.

    Changes are added up per key and salt first, so that a hot key sends at most ``salts`` rows to the task of its total.
    """
    number = T.StructField(name, T.LongType())
    fields = [changes.schema[k] for k in keys]
    salted = changes.select(*keys, column, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int").alias("_salt"))
    part = salted.groupBy(*keys, "_salt").transformWithState(
        Summed([*keys, "_salt"], column, name, False), T.StructType([*fields, salted.schema["_salt"], number]), "Append", "None")
    return part.groupBy(*keys).transformWithState(
        Summed(keys, name, name, True), T.StructType([*fields, number]), "Append", "None")


def window_totals(windows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Totals up to each closed window, from rows (keys, ``window_start``, ``window_end``, values) of a windowed
    aggregate in append mode: one row per window that closed."""
    longs = [T.StructField(n, T.LongType()) for n in ("window_start", "window_end", *values)]
    return windows.groupBy(*keys).transformWithState(
        WindowHistory(keys, values), T.StructType([*[windows.schema[k] for k in keys], *longs]), "Append", "EventTime")

"""Audience of live rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse import schemas as S
from roompulse.functions.columns import floor_to, live_delta
from roompulse.operators.dwell import valid_visits
from roompulse.operators.filters import only_events, with_props
from roompulse.operators.running import running_totals
from roompulse.operators.windows import tumbling_agg

MINUTE = 60_000
HOUR = 60 * MINUTE
CELLS = (HOUR, MINUTE)    # a task holds a minute of a room, an hour's minutes, or its hours


def live_events(events: DataFrame, *props: str) -> DataFrame:
    return with_props(only_events(events, S.LIVE_ENTER, S.LIVE_LEAVE), *props)


def audience_running(events: DataFrame, *cells_ms: int) -> DataFrame:
    """Online and cumulative viewers of the room after each enter or leave.

    ``cells_ms`` are the cell widths, coarse to fine.
    """
    rows = live_events(events, S.ANCHOR).select(S.ANCHOR, "id", "timestamp", "eventId")
    return running_totals(
        rows, [S.ANCHOR], ["timestamp", "id"], live_delta(),
        [floor_to("timestamp", width) for width in cells_ms or CELLS],
    ).select(S.ANCHOR, "id", "timestamp", "online", "total")


def audience_totals(events: DataFrame) -> DataFrame:
    """Online and cumulative viewers per room, now. On a stream: run in update mode."""
    delta = live_delta()
    return live_events(events, S.ANCHOR).groupBy(S.ANCHOR).agg(
        F.sum(delta["online"]).alias("online"), F.sum(delta["total"]).alias("total"))


def audience_window_delta(events: DataFrame, size_ms: int = 2_000) -> DataFrame:
    """Change of the online audience, and enters, per room and tumbling window."""
    delta = live_delta()
    return tumbling_agg(live_events(events, S.ANCHOR), [S.ANCHOR], "timestamp", size_ms,
                        online=F.sum(delta["online"]), total=F.sum(delta["total"]))


def audience_windowed(events: DataFrame, size_ms: int = 2_000,
                      windows_per_cell: int = 4096) -> DataFrame:
    """Online and cumulative viewers at the end of each window in which something happened."""
    deltas = audience_window_delta(events, size_ms).withColumnsRenamed(
        {"online": "_online", "total": "_total"})
    return running_totals(
        deltas, [S.ANCHOR], ["window_start"],
        {"online": F.col("_online"), "total": F.col("_total")},
        [floor_to("window_start", size_ms * windows_per_cell)],
    ).select(S.ANCHOR, "window_start", "window_end", "online", "total")


def audience_valid(events: DataFrame, dwell_ms: int = MINUTE, cell_ms: int = HOUR,
                   as_of: int | None = None) -> DataFrame:
    """Viewers per room who stayed longer than ``dwell_ms``; rooms never entered are left out.

    ``cell_ms`` is the cell width. Without ``as_of``, the newest time of the events says how long an enter
    that is still open has lasted.
    """
    rows = live_events(events, S.ANCHOR, S.SESSION).withColumn(
        "entered", F.col("eventId") == S.LIVE_ENTER)
    now = rows.agg(F.max("timestamp")).scalar() if as_of is None else as_of
    visits = valid_visits(rows, [S.ANCHOR, S.SESSION], "entered", "timestamp",
                          ["timestamp", "id"], dwell_ms, cell_ms, now)
    return (visits.groupBy(S.ANCHOR)
            .agg(F.sum("enters").alias("_enters"), F.sum("valid").alias("valid_total"))
            .filter("_enters > 0").drop("_enters"))

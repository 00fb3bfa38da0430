"""Column expressions shared by the operators; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roompulse import schemas as S


def prop(key: str, column: str = "properties") -> Column:
    """Value of one key of the property bag, null when the bag lacks it."""
    return F.col(column)[key]


def record_id() -> Column:
    """``topic-partition-offset`` of a Kafka record."""
    return F.concat_ws("-", "topic", "partition", "offset")


def epoch_ms(ts: str | Column) -> Column:
    """Epoch milliseconds; accepts timestamps without zone, taken in the session zone."""
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def floor_to(ms: str | Column, size_ms: int) -> Column:
    """Start of the epoch-aligned interval of ``size_ms`` that holds ``ms``."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return ms - F.pmod(ms, F.lit(size_ms).cast("bigint"))


def _local(ms: str, zone: str | None) -> Column:
    ts = F.timestamp_millis(F.col(ms))
    return ts if zone is None else F.convert_timezone(
        F.current_timezone(), F.lit(zone), ts.cast("timestamp_ntz"))


def event_date(ms: str = "timestamp", zone: str | None = None) -> Column:
    """``yyyyMMdd`` of an epoch-ms column, in ``zone`` or else in the session zone."""
    return F.date_format(_local(ms, zone), "yyyyMMdd")


def event_hour(ms: str = "timestamp", zone: str | None = None) -> Column:
    """``HH`` of an epoch-ms column, in ``zone`` or else in the session zone."""
    return F.date_format(_local(ms, zone), "HH")


def live_delta() -> dict[str, Column]:
    """What one enter or leave event adds to the online and to the cumulative audience."""
    enter = F.col("eventId") == S.LIVE_ENTER
    leave = F.col("eventId") == S.LIVE_LEAVE
    return {
        "online": F.when(enter, 1).when(leave, -1).otherwise(0).cast("bigint"),
        "total": F.when(enter, 1).otherwise(0).cast("bigint"),
    }


def routes(rules: dict[str, Column]) -> Column:
    """Names of all rules that a row meets, as an array (empty when it meets none)."""
    return F.filter(
        F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]),
        lambda name: name.isNotNull(),
    )

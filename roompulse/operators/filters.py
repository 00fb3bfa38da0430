"""Row filters and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roompulse.functions.columns import prop, routes


def only_event(events: DataFrame, event: str) -> DataFrame:
    return events.filter(F.col("eventId") == event)


def only_events(events: DataFrame, *names: str) -> DataFrame:
    return events.filter(F.col("eventId").isin(*names))


def only_prefix(events: DataFrame, prefix: str) -> DataFrame:
    return events.filter(F.col("eventId").startswith(prefix))


def with_props(events: DataFrame, *keys: str) -> DataFrame:
    """Promote keys of the property bag to columns; rows that lack one go to :func:`lacking`."""
    return (events.withColumns({k: prop(k) for k in keys})
            .filter(_all_present(keys, lambda k: F.col(k))))


def lacking(events: DataFrame, *keys: str) -> DataFrame:
    """The rows :func:`with_props` leaves out: a quarantine, so that nothing gets lost."""
    return events.filter(~_all_present(keys, prop))


def _all_present(keys, column) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & column(k).isNotNull()
    return test


def route(rows: DataFrame, rules: dict[str, Column], name: str = "route") -> DataFrame:
    """One output row per rule that a row meets; rows that meet none are left out."""
    return rows.withColumn(name, F.explode(routes(rules)))

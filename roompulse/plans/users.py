"""New users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse import schemas as S
from roompulse.functions.bloom import BloomShape
from roompulse.functions.columns import event_date, event_hour
from roompulse.operators.filters import only_event
from roompulse.operators.firstseen import flag_first_seen, flag_first_seen_bloom

ORDER = ["timestamp", "id"]


def flag_new_users(events: DataFrame) -> DataFrame:
    """Launch events with ``isN`` = 1 on the first launch of each device."""
    return flag_first_seen(only_event(events, S.APP_LAUNCH), "deviceId", ORDER, "id")


def flag_new_users_approx(events: DataFrame, shape: BloomShape | None = None) -> DataFrame:
    """As :func:`flag_new_users`, by one Bloom filter per device type: it may miss a new device.

    Filters are sized for the devices that the events hold, unless a ``shape`` is given.
    """
    return flag_first_seen_bloom(only_event(events, S.APP_LAUNCH), "deviceType", "deviceId",
                                 ORDER, "id", shape)


def user_event_rows(flagged: DataFrame, zone: str | None = None) -> DataFrame:
    """The eleven columns of the user event table; ``isNew`` is the computed flag."""
    return flagged.select(
        "id", "deviceId", "eventId", F.col("isN").alias("isNew"), F.col("osName").alias("os"),
        "province", F.col("releaseChannel").alias("channel"), "deviceType",
        F.col("timestamp").alias("eventTime"),
        event_date(zone=zone).alias("date"), event_hour(zone=zone).alias("hour"))


def launch_dimensions(events: DataFrame, flag: str = "isNew") -> DataFrame:
    return only_event(events, S.APP_LAUNCH).select(
        "deviceType", "releaseChannel", F.col(flag).alias("isNew"))


def new_by(events: DataFrame, *dimensions: str, flag: str = "isNew") -> DataFrame:
    """New users per value of the given dimensions. On a stream: run in update mode."""
    return (launch_dimensions(events, flag).groupBy(*dimensions)
            .agg(F.sum(F.col("isNew").cast("bigint")).alias("new_users")))


def new_user_totals(events: DataFrame, flag: str = "isNew") -> DataFrame:
    """New users by device type, by channel and by both, in one table.

    The finest totals are built first; the grouping sets then work on those few rows. ``dims``
    tells which totals a row belongs to: ``deviceType``, ``releaseChannel`` or ``both``.
    """
    one, two = F.col("deviceType"), F.col("releaseChannel")
    finest = new_by(events, "deviceType", "releaseChannel", flag=flag)
    return (finest.groupingSets([[one], [two], [one, two]], one, two)
            .agg(F.sum("new_users").alias("new_users"),
                 F.grouping(one).alias("_no_one"), F.grouping(two).alias("_no_two"))
            .select(F.when(F.col("_no_two") == 1, "deviceType")
                    .when(F.col("_no_one") == 1, "releaseChannel")
                    .otherwise("both").alias("dims"),
                    "deviceType", "releaseChannel", "new_users"))


def new_user_totals_exploded(events: DataFrame, flag: str = "isNew") -> DataFrame:
    """:func:`new_user_totals` with one aggregation, as streams need it (update mode)."""
    one, two = F.col("deviceType"), F.col("releaseChannel")
    nothing = F.lit(None).cast("string")
    keys = F.array(*[
        F.struct(F.lit(name).alias("dims"), a.alias("deviceType"), b.alias("releaseChannel"))
        for name, a, b in (("deviceType", one, nothing), ("releaseChannel", nothing, two),
                           ("both", one, two))])
    return (launch_dimensions(events, flag).select(F.explode(keys).alias("k"), "isNew")
            .groupBy("k.dims", "k.deviceType", "k.releaseChannel")
            .agg(F.sum(F.col("isNew").cast("bigint")).alias("new_users")))

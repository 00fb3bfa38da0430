"""Cleaning and routing of the raw behaviour log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse import schemas as S
from roompulse.operators.filters import route
from roompulse.operators.parsing import Parsed, parse_events

PRODUCT_ROUTE = "product"
GIFT_ROUTE = "gift"


def clean_events(raw: DataFrame) -> Parsed:
    """Kafka records to typed events with the record position as id, and the bad records."""
    return parse_events(raw, with_record_id=True)


def etl_route(events: DataFrame) -> DataFrame:
    """Product and gift events, one row per route; other events are left out."""
    return route(events, {
        PRODUCT_ROUTE: F.col("eventId").startswith(S.PRODUCT_PREFIX),
        GIFT_ROUTE: F.col("eventId") == S.LIVE_REWARD,
    })

"""Hot products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse import schemas as S
from roompulse.operators.filters import only_prefix, with_props
from roompulse.operators.ranking import top_k
from roompulse.operators.windows import sliding_counts

KEYS = [S.CATEGORY, "eventId", S.PRODUCT]


def product_events(events: DataFrame, prefix: str = S.PRODUCT_PREFIX) -> DataFrame:
    return with_props(only_prefix(events, prefix), S.CATEGORY, S.PRODUCT)


def product_window_counts(events: DataFrame, size_ms: int = 600_000,
                          slide_ms: int = 60_000) -> DataFrame:
    return sliding_counts(product_events(events), KEYS, "timestamp", size_ms, slide_ms)


def hot_products(events: DataFrame, size_ms: int = 600_000, slide_ms: int = 60_000,
                 k: int = 3) -> DataFrame:
    """Most frequent products per window, category and event; ties go to the smaller id."""
    return top_k(product_window_counts(events, size_ms, slide_ms),
                 ["window_start", S.CATEGORY, "eventId"], [F.desc("count"), S.PRODUCT], k)

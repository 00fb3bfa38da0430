"""Group purchases: detail left join group left join order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse import schemas as S
from roompulse.operators.joins import window_left_join
from roompulse.operators.parsing import parse_lines
from roompulse.operators.windows import with_event_time, with_window

SIZE_MS = 5_000


def lines_in_windows(lines: DataFrame, layout: dict[str, str], size_ms: int,
                     delay_ms: int | None = None) -> DataFrame:
    rows = with_event_time(parse_lines(lines, layout).clean, "ts", delay_ms)
    return with_window(rows.drop("ts"), size_ms)


def groupon_join_main(detail: DataFrame, main: DataFrame, size_ms: int = SIZE_MS,
                      delay_ms: int | None = None) -> DataFrame:
    """Details with the group rows of their window, or with nulls. Also for streams."""
    left = lines_in_windows(detail, S.GROUPON_DETAIL_LINE, size_ms, delay_ms)
    right = lines_in_windows(main, S.GROUPON_MAIN_LINE, size_ms, delay_ms)
    return window_left_join(left, right, "groupon", "groupon", "main_").drop("main_groupon")


def groupon_enriched(detail: DataFrame, main: DataFrame, orders: DataFrame,
                     size_ms: int = SIZE_MS, delay_ms: int | None = None) -> DataFrame:
    """:func:`groupon_join_main`, then with the order rows of the same window."""
    joined = groupon_join_main(detail, main, size_ms, delay_ms)
    right = lines_in_windows(orders, S.ORDER_LINE, size_ms, delay_ms)
    return window_left_join(joined, right, "order_id", "order_id", "order_").select(
        "window", "user", "groupon", "order_id", F.col("main_status").alias("groupon_status"),
        F.col("main_category").alias("category"), "order_status",
        F.col("order_amount").alias("amount"))

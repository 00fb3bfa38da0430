"""Visits that lasted: one settled row per enter event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roompulse.functions.columns import floor_to


def valid_visits(df: DataFrame, keys: Sequence[str], is_enter: str, ts: str, order: Sequence[str],
                 dwell_ms: int = 60_000, cell_ms: int = 0,
                 as_of: int | Column | None = None) -> DataFrame:
    """Per key, in one or more rows, how many enters there were and how many of them were valid.

    An enter is valid when the next enter or leave of the same key is absent or comes more than
    ``dwell_ms`` later; a second enter replaces the first. For an enter that is still open,
    ``as_of`` (epoch ms) tells how long it has lasted; without it, an open enter is valid.

    The timeline of a key is cut into cells of ``cell_ms``, so a hot key is spread over tasks; 0
    leaves it whole.
    Inside a cell the next event is a ``lead``; the last event of a cell looks at the first event
    of the key's next cell, taken from the aggregated cells.
    """
    enter = F.col(is_enter)
    lasted = F.col("_next") - F.col(ts) > dwell_ms
    rows = df.select(*keys, *dict.fromkeys([ts, *order, is_enter]))
    if not cell_ms:
        whole = Window.partitionBy(*keys).orderBy(*order)
        open_lasted = F.lit(True) if as_of is None else F.lit(as_of) - F.col(ts) > dwell_ms
        stepped = rows.withColumn("_next", F.lead(ts).over(whole))
        valid = enter & F.when(F.col("_next").isNull(), open_lasted).otherwise(lasted)
        return stepped.groupBy(*keys).agg(
            F.count_if(enter).alias("enters"), F.count_if(valid).alias("valid"))

    inside = Window.partitionBy(*keys, "_cell").orderBy(*order)
    stepped = (rows.withColumn("_cell", floor_to(ts, cell_ms))
               .withColumn("_next", F.lead(ts).over(inside)))
    cells = stepped.groupBy(*keys, "_cell").agg(
        F.count_if(enter).alias("enters"),
        F.count_if(enter & F.col("_next").isNotNull() & lasted).alias("_settled"),
        F.min(ts).alias("_first_ts"),
        F.max(F.when(F.col("_next").isNull() & enter, F.col(ts))).alias("_open_ts"),
    )
    after = F.lead("_first_ts").over(Window.partitionBy(*keys).orderBy("_cell"))
    still_open = F.lit(True) if as_of is None else F.lit(as_of) - F.col("_open_ts") > dwell_ms
    last_valid = F.when(F.col("_open_ts").isNull(), F.lit(False)).when(
        F.col("_after").isNull(), still_open).otherwise(F.col("_after") - F.col("_open_ts") > dwell_ms)
    return cells.withColumn("_after", after).select(
        *keys, "enters",
        (F.col("_settled") + last_valid.cast("bigint")).alias("valid"))

"""Windowed left joins and the last version of dimension rows.

No join is hinted: the size that Spark knows, or meets at run time, decides between broadcast and shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def latest_by(df: DataFrame, key: str, version: str) -> DataFrame:
    """Last written row of each key; rows of the same version are told apart by their values."""
    rest = [c for c in df.columns if c not in (key, version)]
    return (df.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("_last"))
            .select(key, *[F.col(f"_last.{c}").alias(c) for c in [version, *rest]]))


def window_left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                     prefix: str = "main_") -> DataFrame:
    """Every left row with each right row of the same key and the same window, or with nulls.

    Both sides carry ``window`` (see :func:`roompulse.operators.windows.with_window`). Works on
    tables and, with watermarks below the windows, on streams. The result keeps the window of the
    left row, so that joins can be chained.
    """
    renamed = right.select(
        F.col("window").alias("_right_window"),
        *[F.col(c).alias(prefix + c) for c in right.columns if c != "window"])
    hit = ((F.col(left_key) == F.col(prefix + right_key))
           & (F.col("window") == F.col("_right_window")))
    return left.join(renamed, hit, "left").drop("_right_window")

"""Best rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], k: int = 3,
          rank: str = "sort") -> DataFrame:
    """First ``k`` rows of each group, numbered from 1.

    Spark drops rows beyond ``k`` in each task before the shuffle (window group limit), so at most
    ``k`` rows per group and task travel.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)

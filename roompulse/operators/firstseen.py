"""First appearance of a key: exact, and with a Bloom filter."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roompulse.functions.bloom import BloomShape, bit_columns, sized_bit_columns


def flag_first_seen(df: DataFrame, key: str, order: Sequence[str], row_id: str,
                    flag: str = "isN") -> DataFrame:
    """All rows, with ``flag`` = 1 on the first row of each key and 0 on the others.

    The first row of a key is found by a minimum, which combines before the shuffle, and is
    handed back by key, order and ``row_id`` together, so the join spreads evenly however many rows one
    key owns. Rows that agree in all of these are one record delivered again: one of them is flagged. Rows
    without a key are not flagged; a null id is smaller than any other.
    """
    names = list(dict.fromkeys([key, *order, row_id]))
    first = (df.filter(F.col(key).isNotNull()).groupBy(key)
             .agg(F.min(F.struct(*names)).alias("_first")))
    return _mark(df, first.select("_first.*"), names, flag)


def flag_first_seen_bloom(df: DataFrame, group: str, key: str, order: Sequence[str], row_id: str,
                          shape: BloomShape | None = None, false_positives: float = 0.03,
                          flag: str = "isN") -> DataFrame:
    """As :func:`flag_first_seen`, with the answers a Bloom filter per ``group`` would give.

    Adding keys one by one to a filter sets a bit exactly when the first key that owns the bit
    arrives, and a key looks new exactly when it is the first owner of at least one of its bits.
    So the filter's answers are a minimum per bit: no filter has to be filled in order, no group
    sits in one task, and at most one minimum per bit leaves the shuffle.
    A key may be taken for a known one (a false positive), never the other way round. Unless a
    ``shape`` is given, each group's filter is sized for the keys that the group has, so that
    ``false_positives`` holds at any size.
    """
    names = list(dict.fromkeys([key, *order, row_id]))
    known = df.filter(F.col(key).isNotNull() & F.col(group).isNotNull())
    first = known.groupBy(group, key).agg(F.min(F.struct(*names)).alias("_first"))
    if shape is None:
        sizes = first.groupBy(group).agg(F.count(F.lit(1)).alias("_keys"))
        bits = sized_bit_columns(F.col(key), F.col("_keys"), false_positives)
        owned = first.join(sizes, group)
    else:
        bits, owned = bit_columns(F.col(key), shape), first
    rank = F.struct(*[F.col(f"_first.{n}").alias(n) for n in dict.fromkeys([*order, row_id, key])])
    owners = (owned.select(group, rank.alias("_rank"), F.explode(bits).alias("_bit"))
              .groupBy(group, "_bit").agg(F.min("_rank").alias("_rank")))
    winners = owners.select(*[F.col(f"_rank.{n}").alias(n) for n in names]).distinct()
    return _mark(df, winners, names, flag)


def _mark(df: DataFrame, rows: DataFrame, names: list[str], flag: str) -> DataFrame:
    """Flag the rows that agree with one of ``rows`` in ``names``, one row each."""
    marked = rows.select(*[F.col(n).alias("_" + n) for n in names], F.lit(1).alias("_hit"))
    same = reduce(and_, [F.col(n).eqNullSafe(F.col("_" + n)) for n in names])
    turn = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))
    return (df.drop(flag).join(marked, same, "left")
            .withColumn(flag, F.when(F.col("_hit").isNotNull(), (turn == 1).cast("int")).otherwise(0))
            .drop("_hit", *["_" + n for n in names]))

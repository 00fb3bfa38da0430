"""Each row with the version that was valid at its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse.functions.columns import floor_to
from roompulse.operators.running import running_totals

HOUR, MINUTE = 3_600_000, 60_000


def as_of_join(facts: DataFrame, versions: DataFrame, key: str, time: str, since: str,
               cells_ms: Sequence[int] = (HOUR, MINUTE)) -> DataFrame:
    """Every fact with the other columns of the last version of its ``key`` whose ``since`` is not after ``time``.

    Both times are epoch ms. Facts before the first version of their key, without a key or without a time get nulls. Of
    versions that begin together the one with the greatest values holds. Versions and facts share one time line per key
    and the version is its running maximum, so the line is cut into cells (widths ``cells_ms``, coarse to fine) and a
    key that owns a third of all facts is spread over as many tasks as it has cells. Facts are shuffled once.
    """
    rest = [c for c in versions.columns if c not in (key, since)]
    if clash := set(rest) & set(facts.columns):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    version = F.struct(F.col(since).alias("_since"), *rest)
    valid = versions.filter(F.col(key).isNotNull() & F.col(since).isNotNull()).select(
        F.col(key).alias("_key"), F.col(since).cast("bigint").alias("_at"), F.lit(0).alias("_kind"), version.alias("_version"))
    rows = facts.select(F.col(key).alias("_key"), F.col(time).cast("bigint").alias("_at"), F.lit(1).alias("_kind"),
                        F.struct(*[F.col(c) for c in facts.columns]).alias("_fact"))
    line = rows.unionByName(valid, allowMissingColumns=True)
    # The later of two versions is the greater one; at one time versions come before facts.
    held = running_totals(line, ["_key"], ["_at", "_kind"], {"_held": F.col("_version")},
                          [floor_to("_at", width) for width in cells_ms], how="max")
    return held.filter("_kind = 1").select("_fact.*", *[F.col(f"_held.{c}").alias(c) for c in rest])

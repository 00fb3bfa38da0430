"""Gifts and points per room."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse import schemas as S
from roompulse.operators.asof import as_of_join
from roompulse.operators.filters import only_event, with_props
from roompulse.operators.joins import latest_by
from roompulse.operators.parsing import parse_lines


def gift_dimension(lines: DataFrame, version: str | None = None) -> DataFrame:
    """Gift lines to ``id, name, score``; the line with the greatest ``version`` wins.

    ``version`` names a further field of the lines. Without it the last line of an id wins: lines are taken in the
    order of the time and name of their files, where ``lines`` tells them (``written``), and of their place.
    """
    layout = dict(S.GIFT_LINE)
    if version is not None:
        return latest_by(parse_lines(lines, {**layout, version: "bigint"}).clean, "id", version).drop(version)
    read = F.struct(F.col("written") if "written" in lines.columns else F.lit(0), F.monotonically_increasing_id())
    parsed = parse_lines(lines.withColumn("_read", read), layout, keep=["_read"]).clean
    return latest_by(parsed, "id", "_read").drop("_read")


def rewards(events: DataFrame) -> DataFrame:
    """Gifts given in a room."""
    return with_props(only_event(events, S.LIVE_REWARD), S.ANCHOR, S.GIFT)


def _keyed(dimension: DataFrame) -> DataFrame:
    return dimension.select(F.col("id").alias(S.GIFT), F.col("name").alias("gift_name"), "score")


def gift_facts(events: DataFrame, dimension: DataFrame) -> DataFrame:
    """Each gift with its name and score, null where the gift is unknown. Also for streams."""
    facts = rewards(events).select("id", S.ANCHOR, S.GIFT, F.lit(1).alias("gifts"))
    return facts.join(_keyed(dimension), S.GIFT, "left")


def gift_totals(events: DataFrame, dimension: DataFrame) -> DataFrame:
    """Gifts and points per room; unknown gifts count but bring no points.

    Gifts are counted per room and gift before the lookup, so that a popular gift does not gather in one task of
    the join. A stream in update mode can hold one aggregation only and looks each gift up.
    """
    dim = _keyed(dimension).drop("gift_name")
    counted = rewards(events).select(S.ANCHOR, S.GIFT, F.lit(1).cast("bigint").alias("n"))
    if not events.isStreaming:
        counted = counted.groupBy(S.ANCHOR, S.GIFT).agg(F.sum("n").alias("n"))
    joined = counted.join(dim, S.GIFT, "left")
    return joined.groupBy(S.ANCHOR).agg(
        F.sum("n").alias("gifts"),
        F.coalesce(F.sum(F.col("score") * F.col("n")), F.lit(0.0)).alias("points"))


def gift_facts_as_of(events: DataFrame, versions: DataFrame, *cells_ms: int) -> DataFrame:
    """Each gift with the name and score that it had at its time, null before its first version.

    ``versions`` holds ``id, name, score, since`` (epoch ms), one row per change of a gift.
    """
    facts = rewards(events).select("id", S.ANCHOR, S.GIFT, "timestamp", F.lit(1).alias("gifts"))
    dim = versions.select(F.col("id").alias(S.GIFT), F.col("name").alias("gift_name"), "score", "since")
    return as_of_join(facts, dim, S.GIFT, "timestamp", "since", *([cells_ms] if cells_ms else []))


def gift_totals_as_of(events: DataFrame, versions: DataFrame, *cells_ms: int) -> DataFrame:
    """Gifts and points per room, each gift at the score it had at its time."""
    return gift_facts_as_of(events, versions, *cells_ms).groupBy(S.ANCHOR).agg(
        F.sum(F.col("gifts").cast("bigint")).alias("gifts"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("points"))

"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse.session import staged


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` of every id in the links ``(a, b)``; the component is its smallest id.

    Large-star and small-star steps in turn (Kiveris et al., 2014): the number of links never grows,
    each step is an aggregate and a join by id, and a chain of n ids takes about log n rounds. Rounds end when every
    link leads to a smallest id, and the driver sees one row at most.
    """
    links = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a <> b").distinct(), "links")
    for _ in range(max_rounds):
        links = staged(_star(links, large=True), "large-star")
        links = staged(_star(links, large=False), "small-star")
        if _hooked(links):
            break
    else:
        raise RuntimeError(f"links still move after {max_rounds} rounds")
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _hooked(links: DataFrame) -> bool:
    """Whether each id has one link at most, to an id that has none."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        links.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    ends = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.filter("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links ``(a > b)`` hooked to the smallest neighbour of their centre."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        small = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "smallest")
        new = both.filter("v > u").join(small, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        small = staged(links.groupBy("a").agg(F.min("b").alias("m")), "smallest")
        joined = links.join(small, "a")
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b")))
    new = new.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return new if large else new.distinct()     # the large star makes one link of each

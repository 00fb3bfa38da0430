"""Rows with the version valid at their time."""

import random

import pytest
from pyspark.sql import functions as F

from roompulse.operators.asof import as_of_join
from roompulse.plans import gifts
from roompulse import tables as D

FACTS, VERSIONS = "row bigint, key string, at bigint", "key string, since bigint, name string, price double"


def brute(facts, versions):
    out = []
    for row, key, at in facts:
        held = [v for v in versions if key is not None and at is not None and v[0] == key and v[1] is not None and v[1] <= at]
        last = max(held, key=lambda v: v[1:], default=(None,) * 4)
        out.append((row, key, at, last[2], last[3]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cells", [(1_000_000,), (100, 10), (50,)])
def test_equals_brute_force(spark, cells):
    """A hot key, versions and facts at one time, versions that begin together, nulls, keys without versions."""
    rng = random.Random(6)
    key = lambda: "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
    facts = [(i, key(), rng.choice([None, rng.randrange(-50, 400)])) for i in range(400)] + [(900, "none", 5)]
    versions = [(key(), rng.choice([rng.randrange(-60, 400), None]), "v%d" % i, float(rng.randrange(9))) for i in range(80)]
    versions += [("a", 100, "x", 1.0), ("a", 100, "y", 0.0), ("a", 100, "y", 0.0)]
    got = as_of_join(spark.createDataFrame(facts, FACTS), spark.createDataFrame(versions, VERSIONS), "key", "at", "since", cells)
    assert got.columns == ["row", "key", "at", "name", "price"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(facts, versions)


def test_empty_sides(spark):
    facts, none = spark.createDataFrame([(1, "a", 5)], FACTS), spark.createDataFrame([], VERSIONS)
    assert [tuple(r) for r in as_of_join(facts, none, "key", "at", "since").collect()] == [(1, "a", 5, None, None)]
    assert as_of_join(facts.limit(0), none, "key", "at", "since").count() == 0
    with pytest.raises(ValueError, match="row"):
        as_of_join(facts, none.withColumn("row", F.lit(1)), "key", "at", "since")


def test_hot_gift_is_spread_and_rows_move_once(spark):
    """The only exchange of fact rows is by gift and cell: no task holds a gift's whole time line."""
    facts = spark.range(20_000).select(F.col("id").alias("row"), F.lit("hot").alias("key"), (F.col("id") * 1000).alias("at"))
    versions = spark.createDataFrame([("hot", 0, "v", 1.0), ("hot", 5_000_000, "w", 2.0)], VERSIONS)
    joined = as_of_join(facts, versions, "key", "at", "since")
    assert {r["name"]: r["count"] for r in joined.groupBy("name").count().collect()} == {"v": 5_000, "w": 15_000}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = as_of_join(facts, versions, "key", "at", "since")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    moved = [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning" in line]
    windows = [line for line in plan.splitlines() if "Window" in line and "_part_" in line and "_kind" in line]
    assert windows and all("_cell0" in line and "_cell1" in line for line in windows)
    assert moved


def test_scores_follow_the_time_of_the_gift(spark, sf_dir):
    """Totals as of each gift's time differ from totals at the last score."""
    events, versions = D.behavior(spark, sf_dir), D.gift_versions(spark, sf_dir)
    then = {r[0]: r["points"] for r in gifts.gift_totals_as_of(events, versions).collect()}
    last = versions.groupBy("id").agg(F.max_by(F.struct("name", "score"), "since").alias("v")).select("id", "v.*")
    now = {r[0]: r["points"] for r in gifts.gift_totals(events, last).collect()}
    assert set(then) == set(now) and all(then[a] <= now[a] for a in then) and sum(then.values()) < 0.8 * sum(now.values())

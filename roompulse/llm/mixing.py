"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and ``limit`` that give each source its target of tokens, the ones closest to 1
(in relative entropy) are ``min(limit, exp(tilt * size))`` with one tilt per source. The tilts maximise
a concave dual, one dimension per source, so Newton steps need two sums per source and step; they run on
counts of (source, size), all sources at once, inside a bracket that keeps every step safe. Sums are
exact (fixed point in decimals), so that reruns agree whatever the order of the rows. Rates become copies by
systematic rounding down the sizes: the copies handed out never leave the summed rates by more than half a
copy, and three single corrections per source take up most of the words still missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roompulse.llm.columns import WORD, free_name
from roompulse.session import staged

# Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
LIMIT = 2               # most copies of a document
STEPS = 40              # Newton steps at most; bisection alone would reach the precision of a double
ONE = 1 << 30           # fixed point of rates
BLOCKS = 256            # parts of one (source, size) that are ranked apart


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text",
          source: str = "source") -> DataFrame:
    """``(key, source, size)``: number of words of each row; null texts have none."""
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"),
                       F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD))
                       .cast("bigint").alias("size"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150,
            limit: int = LIMIT) -> DataFrame:
    """``(source, source_size, target)`` from one row ``(source, source_size)`` per source.

    Sources in code point order, null last, take the weights in turn and share ``share_percent`` of all words; a
    target stops at ``limit`` times its source, and what is over goes to the others by weight until none is
    above. That is one water level: a source is full if its bound lies under the level that the sources with
    larger bounds per weight still share. Windows run over the sources, not over documents.
    """
    big = "decimal(38,0)"
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (place % len(weights) + 1).cast("int")).cast("bigint")
    rows = totals.withColumn("place", place).withColumn("weight", weight)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding,
                                                 Window.unboundedFollowing)
    zero = F.lit(0).cast(big)
    rows = rows.withColumns({
        "all": F.sum("source_size").over(whole).cast(big),
        "left": (F.sum("weight").over(whole)
                 - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast(big),
        "used": F.coalesce(F.sum("source_size").over(before).cast(big), zero)})
    # 100 times the words that are left to share when all sources before this one are full.
    pool = F.col("all") * share_percent - F.col("used") * (100 * limit)
    full = F.col("source_size").cast(big) * (100 * limit) * F.col("left") <= F.col("weight") * pool
    rows = rows.withColumn("pool", pool).withColumn("full", full)
    first = Window.orderBy("full", F.col("source_size") / F.col("weight"), "place").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"pool0": F.first("pool").over(first),
                             "left0": F.first("left").over(first)})
    level = ((F.col("weight") * F.col("pool0")).cast("double")
             / (F.col("left0") * 100).cast("double"))
    return rows.select("source", "source_size", F.when(
        F.col("full"), F.col("source_size") * F.lit(float(limit))).otherwise(level).alias("target"))


def _rate(tilt: str, size: str, limit: int) -> Column:
    """Rate of a size in fixed point."""
    power = F.least(F.lit(20.0), F.col(tilt) * F.col(size))
    return F.least(F.lit(limit * ONE), F.round(F.exp(power) * ONE)).cast("bigint")


def tilts(counts: DataFrame, goals: DataFrame, limit: int = LIMIT, steps: int = STEPS) -> DataFrame:
    """``(source, tilt)`` from ``(source, size, n)`` and ``(source, source_size, target)``.

    Each step is one aggregate over the counts; its table of one row per source is written out, which
    cuts the lineage. The driver only learns how many sources still move.
    """
    same = F.col("c.source").eqNullSafe(F.col("g.source"))
    # A full source takes every document ``limit`` times, which a tilt of 1 says outright.
    full = F.col("target") >= F.col("source_size") * limit
    now = staged(goals.select(
        "source", "target", F.lit(-64.0).alias("low"), F.lit(64.0).alias("high"),
        F.when(full, 1.0).otherwise(0.0).alias("tilt"), F.lit(False).alias("done")), "mix-tilts")
    for _ in range(steps):
        rate = _rate("tilt", "size", limit)
        free = F.when(rate < limit * ONE, rate).otherwise(0)
        words = (F.col("n") * F.col("size")).cast("decimal(38,0)")
        sums = counts.alias("c").join(now.alias("g"), same).groupBy(
            "g.source", "target", "low", "high", "tilt", "done").agg(
            F.sum(words * rate).alias("took"),
            F.sum(words * F.col("size") * free).alias("rise"))
        gap = F.col("took").cast("double") / ONE - F.col("target")
        slope = F.col("rise").cast("double") / ONE
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.col("high")).otherwise(F.col("tilt"))
        step = F.when(slope > 0, F.col("tilt") - gap / slope)
        near = F.abs(gap) <= F.greatest(F.lit(0.01), F.col("target") * 1e-9)
        stuck = (F.col("high") - F.col("low")) <= 1e-15
        # Where a Newton step would leave the bracket: its middle, but at most four times as far as now.
        middle = (F.greatest("low", F.least(F.col("tilt") * 4, F.lit(-1e-3)))
                  + F.least("high", F.greatest(F.col("tilt") * 4, F.lit(1e-3)))) / 2
        now = staged(
            sums.withColumn("next", step).withColumns({"low": low, "high": high})
            .withColumn("done", F.col("done") | near | stuck)
            .withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when(
                (F.col("next") > F.col("low")) & (F.col("next") < F.col("high")), F.col("next"))
                .otherwise(middle))
            .select("source", "target", "low", "high", "tilt", "done"), "mix-tilts")
        if now.filter("NOT done").limit(1).count() == 0:
            break
    return now.select("source", "tilt")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
          limit: int = LIMIT, blocks: int = BLOCKS) -> DataFrame:
    """``(key, size, source_size, target, copies, taken, rate)`` for each row of ``docs``.

    ``copies`` is 0 to ``limit``; ``taken`` is ``copies * size``. Rows that repeat a key are told apart by
    nothing and may get different copies; null keys come first, a null source is a source. Documents without
    words keep one copy. An empty table gives an empty result.
    """
    return mixed_sizes(sizes(docs, key, text, source), limit, blocks).withColumnRenamed("key", key)


def mixed_sizes(sized: DataFrame, limit: int = LIMIT, blocks: int = BLOCKS) -> DataFrame:
    """``mixed`` for rows ``(key, source, size)``."""
    rows = staged(sized.withColumn(
        "block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")), "mix-sizes")
    cells = staged(rows.groupBy("source", "size", "block").agg(F.count(F.lit(1)).alias("n")),
                   "mix-cells")
    counts = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goals = staged(targets(counts.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size")), limit=limit), "mix-targets")
    counts = staged(counts, "mix-counts")
    lean = tilts(counts, goals, limit)
    goals = staged(goals.alias("g").join(
        lean.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source")))
        .select("g.*", "t.tilt"), "mix-goals")

    # Summed rates of all larger documents of the source, then of the blocks before.
    down = Window.partitionBy("source").orderBy(F.col("size").desc(), "block").rowsBetween(
        Window.unboundedPreceding, -1)
    at = staged(
        cells.alias("c").join(goals.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")))
        .select("c.*", "g.source_size", "g.target", F.when(
            F.col("size") > 0, _rate("tilt", "size", limit)).otherwise(ONE).alias("rate"))
        .withColumn("before", F.coalesce(F.sum(
            (F.col("n") * F.col("rate")).cast("decimal(38,0)")).over(down), F.lit(0))
            .cast("decimal(38,0)")), "mix-starts")
    joined = rows.alias("r").join(at.alias("a"), (
        F.col("r.source").eqNullSafe(F.col("a.source")) & (F.col("r.size") == F.col("a.size"))
        & (F.col("r.block") == F.col("a.block")))).select(
        "r.key", "r.source", "r.size", "r.block", "a.source_size", "a.target", "a.rate", "a.before")
    rank = F.row_number().over(Window.partitionBy("source", "size", "block").orderBy("key"))
    upto = F.col("before") + (rank * F.col("rate")).cast("decimal(38,0)")
    out = joined.withColumn("upto", upto).withColumn("copies", F.expr(
        f"(upto + {ONE // 2}) div {ONE} - (upto - rate + {ONE // 2}) div {ONE}"))
    out = staged(out.select("key", "source", "size", "source_size", "target", "rate", "copies"),
                 "mix-copies")
    for _ in range(3):
        out = _corrected(out, limit)
    return out.select(
        "key", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), (F.col("rate") / ONE).alias("rate"))


def _corrected(rows: DataFrame, limit: int) -> DataFrame:
    """One document per source, the best one, gives or takes a copy to close the gap to the target."""
    got = rows.groupBy("source", "target").agg(
        F.sum(F.col("copies") * F.col("size")).alias("got"))
    gap = staged(got.select("source", (F.col("target") - F.col("got")).alias("gap")), "mix-gaps")
    open_ = rows.alias("r").join(gap.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    helps = ((F.col("gap") > 0) & (F.col("copies") < limit)
             | (F.col("gap") < 0) & (F.col("copies") > 0)) & (
        F.abs(F.abs("gap") - F.col("size")) < F.abs("gap"))
    best = staged(open_.filter(helps).groupBy("g.source", "gap").agg(F.min(F.struct(
        F.abs(F.abs("gap") - F.col("size")).alias("rest"), F.col("r.key").alias("key"),
        F.col("size"))).alias("best")).select(
        "source", "best.key", "best.size", F.signum("gap").cast("bigint").alias("add")), "mix-best")
    joined = rows.alias("r").join(best.alias("b"), (
        F.col("r.source").eqNullSafe(F.col("b.source")) & F.col("r.key").eqNullSafe(F.col("b.key"))
        & (F.col("r.size") == F.col("b.size"))), "left")
    changed = F.least(F.lit(limit), F.greatest(F.lit(0), F.col("copies") + F.coalesce(
        F.col("b.add"), F.lit(0)))).cast("bigint")
    return joined.select("r.key", "r.source", "r.size", "r.source_size", "r.target", "r.rate",
                         changed.alias("copies"))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text",
             source: str = "source") -> DataFrame:
    """The mix itself: ``docs`` with all its columns, each row as often as its key has copies.

    The mix is made over distinct keys: of rows that repeat a key, the first by source and size counts.
    Rows without a key cannot be weighed and stay as they are.
    """
    one = (sizes(docs, key, text, source).filter("key IS NOT NULL").groupBy("key")
           .agg(F.min(F.struct("source", "size")).alias("d")).select("key", "d.source", "d.size"))
    mine, copies, turn = (free_name(docs, n) for n in ("__key", "__copies", "__turn"))
    plan = mixed_sizes(one).select(F.col("key").alias(mine), F.col("copies").alias(copies))
    rows = docs.join(plan, docs[key] == F.col(mine), "left")
    times = F.sequence(F.lit(1), F.coalesce(F.col(copies), F.lit(1)).cast("int"))
    return (rows.filter(F.coalesce(F.col(copies), F.lit(1)) > 0)
            .withColumn(turn, F.explode(times)).select(*[docs[c] for c in docs.columns]))

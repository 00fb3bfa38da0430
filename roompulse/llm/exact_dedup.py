"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Everything is DataFrame work. Groups are counted with partial aggregates, so a group of copies that
holds a third of all rows leaves every task as one row. What rows are joined with is written to the shared
folder first: both join sides are then shuffled for the join alone, and adaptive execution can split a
hot key. Texts never go through a shuffle, only their hashes do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roompulse.llm.columns import free_name
from roompulse.session import staged

PREFIX = 64
SMALL = 1 << 20         # (length, prefix hash) groups that may go to every task: 24 bytes each


def _full(rows: DataFrame, shared: DataFrame, small: int) -> DataFrame:
    """``rows`` with the full hash of ``body`` where (size, head) is in ``shared``, without ``body``. Texts stay in the scan:
    few groups go to every task, and only what they meet is read in full; with more groups than that every text is hashed
    where it lies, and the hashes meet the groups."""
    digest = F.unhex(F.sha2("body", 256))
    if shared.count() <= small:
        rows = rows.join(F.broadcast(shared), ["size", "head"], "left").withColumn("full", digest)
    else:
        rows = (rows.select("key", "size", "head", digest.alias("full"), "more")
                .join(shared.hint("merge"), ["size", "head"], "left"))
    return rows.select("key", "size", "more", F.when(F.col("alive"), F.col("full")).alias("full"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 prefix: int = PREFIX, carry: dict[str, Column] | None = None, small: int = SMALL) -> DataFrame:
    """One row ``(key, keep_id, group_size, kept)`` for each row of ``docs``; other columns are ignored.

    ``carry`` names expressions of the row that the result shall hold as well.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest key
    stays. Rows that repeat key and text all count in ``group_size`` and all stay or go; a null key is smaller
    than any other. An empty table gives an empty result.

    1. Rows are counted by length in bytes; a length that occurs once is done.
    2. Rows of the other lengths are counted by (length, hash of the first ``prefix`` characters).
    3. The texts of rows that still share both are hashed in full (SHA-256) and grouped; with more than ``small`` such
       groups all texts are hashed, so that none has to move.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    carry = carry or {}
    more = F.struct(F.lit(0).alias("none"), *[c.alias(n) for n, c in carry.items()]).alias("more")
    out = [F.col(f"more.{n}").alias(n) for n in carry]
    size = F.octet_length(body).alias("size")
    head = F.xxhash64(F.substring(body, 1, prefix)).alias("head")
    lengths = staged(docs.select(size).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
                     .filter("n > 1").select("size"), "dedup-lengths")
    shared = staged(docs.select(size, head).join(lengths, "size", "left_semi")
                    .groupBy("size", "head").agg(F.count(F.lit(1)).alias("n"))
                    .filter("n > 1").select("size", "head", F.lit(True).alias("alive")), "dedup-heads")
    rows = staged(_full(docs.select(F.col(key).alias("key"), size, head, body.alias("body"), more), shared, small),
                  "dedup-rows")
    groups = staged(rows.filter("full IS NOT NULL").groupBy("size", "full").agg(
        F.max("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    alone = rows.filter("full IS NULL").select(
        F.col("key").alias(key), F.col("key").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), *out)
    grouped = rows.filter("full IS NOT NULL").join(groups, ["size", "full"]).select(
        F.col("key").alias(key), "keep_id", "group_size",
        F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), *out)
    return alone.unionByName(grouped)


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the keys of which ``exact_groups`` keeps no row.

    Rows without a key cannot be named and stay.
    """
    name = free_name(docs, "__gone")
    gone = (exact_groups(docs, key, text).groupBy(F.col(key).alias(name))
            .agg(F.max("kept").alias("any")).filter(~F.col("any")).select(name))
    gone = staged(gone, "dedup-gone")
    return docs.join(gone, docs[key] == gone[name], "left_anti")

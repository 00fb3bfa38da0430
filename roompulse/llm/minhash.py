"""Near duplicates by circulant MinHash, banding, and exact Jaccard similarity on full shingle sets.

Two permutations of a fixed universe make all coordinates: the first scatters the shingles, the second is
read off shifted by 0, 1, 2, ... places (C-MinHash, Li and Li, 2021). Coordinate ``k`` of a set is the
smallest value of the second permutation at (scattered place + k), so one run of neighbouring
values per shingle yields all coordinates.

No bucket is expanded into rows of pairs. Equal sets are one class. Each member of a bucket is compared with the smallest
member; what is linked forms components. Buckets that share members form families; where a family still holds several
components, sets that overlap enough share a shingle among the rarest of both (prefix filter). All holders of such a shingle
are compared inside tasks, in groups of bounded size that bring every two of them together.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse.llm import mapped
from roompulse.llm.columns import free_name
from roompulse.llm.components import components
from roompulse.llm.wordhash import U, Words, mix, ngrams
from roompulse.session import staged, staging_folder

UNIVERSE = 1 << 21
BANDS = 32
ROWS = 5        # at similarity 0.8, a pair misses all 32 bands with probability 3e-6; at 0.85, 8e-9
SEED = 20211
CHUNK = 1024
BLOCK = 128     # sets of a bucket that meet those of another block in one group
COLUMNS = 1 << 12
IDS = 1 << 20   # ids in one sorted array


@lru_cache(maxsize=2)
def _permutations(universe: int, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    scatter = rng.permutation(universe).astype(np.int32)
    values = rng.permutation(universe).astype(np.int32)
    around = np.concatenate([values, values[:length]])
    return scatter, np.lib.stride_tricks.sliding_window_view(around, length)


def signature(shingles: np.ndarray, length: int, universe: int = UNIVERSE, seed: int = SEED) -> np.ndarray:
    """Circulant MinHash coordinates of one set of 64-bit shingle hashes."""
    scatter, runs = _permutations(universe, length, seed)
    places = scatter[(shingles % U(universe)).astype(np.int64)]
    out = np.full(length, universe, np.int32)
    for i in range(0, len(places), CHUNK):
        np.minimum(out, runs[places[i:i + CHUNK]].min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per document and band; the band's number is part of the key."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(U)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), parts.shape[:2]).copy()
        for j in range(rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketcher(words: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            size, sets, keys = [], [], []
            for h in Words(batch.column(1)).rows():
                s = np.unique(ngrams(h, words))
                size.append(len(s))
                sets.append(_digest(s))
                keys.append(signature(s, bands * rows) if len(s) else np.zeros(bands * rows, np.int32))
            if not size:
                continue
            flat = band_keys(np.array(keys), bands, rows).ravel()
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(flat) + 1, bands), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(sets, pa.binary()), lists],
                ["id", "n", "set", "bands"])
    return run


def _id_writer(folder: str):
    """The ids of a part as a sorted array."""
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        mapped.write(folder, f"met-{part}", {"id": np.sort(table.column("id").to_numpy())})
        return pa.table({"part": pa.array([part], pa.int64())})
    return run


def _setter(words: int, folder: str, parts: list[int]):
    """Full sets of the rows whose ids are in the sorted arrays."""
    def run(batches):
        wanted = [mapped.read(folder, f"met-{p}", "id", np.int64) for p in parts]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found = np.zeros(len(ids), bool)
            for part in wanted:
                found |= part[np.minimum(np.searchsorted(part, ids), len(part) - 1)] == ids
            batch = batch.filter(pa.array(found))
            sets = [np.unique(ngrams(h, words)) for h in Words(batch.column(1)).rows()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)])
            flat = np.concatenate([np.sort(x.view(np.int64)) for x in sets]) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_digest(x) for x in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "set", "shingles"])
    return run


def _confirmer(percent: int):
    def run(batches):
        for batch in batches:
            good = []
            (xs, xo), (ys, yo) = (
                (c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3)))
            for i in range(batch.num_rows):
                x, y = xs[xo[i]:xo[i + 1]], ys[yo[i]:yo[i + 1]]
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(x) < percent * len(y):
                    good.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int(np.count_nonzero(y[at] == x))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` for each distinct key of ``docs``.

    A text's set is its distinct runs of ``words`` words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased), the whole
    sequence if it is shorter; null and empty texts have an empty set and are linked with nothing. Texts are
    linked if 100 * intersection >= percent * union, confirmed on full sets of 64-bit hashes. A component takes its
    smallest key, which is the one kept. Rows with a null key are left out; rows that repeat
    a key count as one if their texts are equal, else the one with the larger hash counts.
    """
    plain = docs.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sketched = plain.mapInArrow(_sketcher(words, bands, rows),
                                "id bigint, n bigint, set binary, bands array<bigint>")
    sketches = staged(sketched, "near-sketches")
    rows_of = sketches.groupBy("id").agg(F.max(F.struct("n", "set")).alias("s")).select("id", "s.*")
    rows_of = staged(rows_of, "near-rows")
    classes = staged(rows_of.filter("n > 0").groupBy("set").agg(F.min("id").alias("rep")), "near-classes")

    reps = sketches.alias("s").join(classes.alias("c"), (F.col("s.id") == F.col("c.rep"))
                                    & (F.col("s.set") == F.col("c.set")))
    members = reps.select("rep", F.explode("bands").alias("bucket"))
    leaders = staged(members.groupBy("bucket").agg(
        F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last")
        .select("bucket", "leader"), "near-leaders")
    members = staged(members.join(leaders, "bucket").distinct(), "near-members")

    first = staged(members.filter("rep <> leader").select(
        F.col("rep").alias("a"), F.col("leader").alias("b")).distinct(), "near-pairs")
    met = first.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(classes, "rep")
    sets = _full_sets(plain, staged(met.select(F.col("rep").alias("id"), "set"), "near-met"), words)
    families = components(first)
    known = staged(components(_confirmed(first, sets, percent)), "near-known")
    known = _joined(known, staged(_across(_beginnings(families, known, sets, percent), percent), "near-across"))

    of_rep = classes.join(known, classes["rep"] == known["id"], "left").select(
        "set", F.coalesce("component", "rep").alias("component"))
    of_rep = staged(of_rep, "near-classes")
    return rows_of.join(of_rep, "set", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component", "id")).alias("kept"))


def _full_sets(plain: DataFrame, met: DataFrame, words: int) -> DataFrame:
    """``(id, shingles)`` of the ids in ``met``, from the text whose set is ``set``.

    The ids go to the shared folder as sorted arrays of about ``IDS`` each, and the scan of the texts looks them up there: no
    text is shuffled, however many ids there are, only the sets that are wanted, once.
    """
    folder = f"{staging_folder(plain.sparkSession)}/near-ids-{uuid.uuid4().hex}"
    dealt = met.select("id", F.pmod(F.xxhash64("id"), F.lit(met.count() // IDS + 1)).alias("part"))
    parts = [r["part"] for r in dealt.groupBy("part").applyInArrow(_id_writer(folder), "part bigint").collect()]
    return staged(plain.mapInArrow(_setter(words, folder, parts), "id bigint, set binary, shingles array<bigint>")
                  .join(met, ["id", "set"], "left_semi")
                  .dropDuplicates(["id", "set"]).drop("set"), "near-sets")   # dealt as for the join: one shuffle


def _beginnings(families: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(family, component, id, n, common, upto)`` of the sets in families with more than one component.

    ``common`` are the shingles that others of the family hold, ordered by how many do; those of one set only come before
    them. Sets of sizes n and m must share ``need = percent (n + m) / (100 + percent)`` shingles; then the first one they
    share stands at a place no later than n - need and m - need: among the first ``upto`` of ``common``.
    """
    sized = sets.select("id", F.size("shingles").alias("n"))
    placed = staged(families.select("id", F.col("component").alias("family")).join(known, "id", "left")
                    .withColumn("component", F.coalesce("component", "id")).join(sized, "id"), "near-placed")
    split = staged(placed.groupBy("family").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"))
        .filter("low < high").select("family", "least"), "near-split")
    open_ = staged(placed.join(split, "family"), "near-open")
    each = open_.join(sets, "id").select("family", "id", F.explode("shingles").alias("s"))
    shared = staged(each.groupBy("family", "s").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "near-shared")
    own = each.join(shared, ["family", "s"]).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("f", "s"))).alias("common"))
    # The least that a partner can demand: one as small as the family has, or as similarity allows.
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    need = F.ceil((F.col("n") + smallest) * percent / (100 + percent))
    begins = own.join(open_, "id").withColumn("upto", (F.size("common") - need + 1).cast("int")).filter("upto > 0")
    return staged(begins.select("family", "component", "id", "n", F.col("common.s").alias("common"), "upto"),
                  "near-begins")


def _across(begins: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between components: all that their members' sets make, but for those that close a ring.

    The holders of a shingle among the first of theirs are a bucket. A bucket with several components is dealt into blocks
    of about ``BLOCK`` sets. Each two blocks are a group, so every two members meet in a group, and a group's rows are bounded
    however large a bucket is.
    """
    held = staged(begins.select("family", "component", "id", F.explode(F.slice("common", F.lit(1), F.col("upto"))).alias("s")),
                  "near-held")
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")
    open_ = staged(held.groupBy("family", "s").agg(
        blocks, F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        .select("family", "s", "blocks"), "near-open")
    dealt = held.join(open_, ["family", "s"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).filter(
        "blocks = 1 OR other <> block")
    groups = staged(paired.select("family", "s", F.least("block", "other").alias("i"),
                                  F.greatest("block", "other").alias("j"), "id"), "near-groups")
    return groups.join(begins.select("id", "component", "n", "common"), "id").groupBy("family", "s", "i", "j").applyInArrow(
        _linker(percent), "a bigint, b bigint")


def _linker(percent: int):
    """Of a group's ``(component, n, common)`` rows: links between components that similar sets make, as a forest."""
    def run(group: pa.Table) -> pa.Table:
        of = group.column("component").to_numpy()
        names, at = np.unique(of, return_inverse=True)
        if len(names) > 1:
            size, both = group.column("n").to_numpy(), overlaps(group.column("common").combine_chunks())
            good = (of[:, None] < of[None, :]) & (100 * both >= percent * (size[:, None] + size[None, :] - both))
        else:
            good = np.zeros((len(of), len(of)), bool)
        links, root = [], list(range(len(names)))
        for x, y in zip(*(at[i] for i in np.nonzero(good))):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((names[max(x, y)], names[min(x, y)]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()),
                         "b": pa.array([b for _, b in links], pa.int64())})
    return run


def overlaps(sets: pa.ListArray) -> np.ndarray:
    """How many elements each two different ones of the sets share."""
    size = np.diff(sets.offsets.to_numpy()).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    _, column, holders = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(holders > 1)
    place = np.full(len(holders), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    sort = np.argsort(column, kind="stable")
    row, column = row[sort], column[sort]
    both = np.zeros((len(size), len(size)), np.int64)
    for first in range(0, len(shared), COLUMNS):
        x, y = np.searchsorted(column, [first, first + COLUMNS])
        holds = np.zeros((len(size), min(COLUMNS, len(shared) - first)), np.float32)
        holds[row[x:y], column[x:y] - first] = 1
        both += (holds @ holds.T).astype(np.int64)
    return both


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links between them."""
    if links.isEmpty():
        return known
    more = components(links).select(F.col("id").alias("component"), F.col("component").alias("least"))
    both = known.join(more, "component", "left").select("id", F.coalesce("least", "component").alias("component"))
    # Sets that had no link are components of their own, and not among the known.
    alone = more.select(F.col("component").alias("id"), F.col("least").alias("component")).join(known, "id", "left_anti")
    return both.unionByName(alone)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return staged(both.select("a", "b", "x", "y").mapInArrow(
        _confirmer(percent), "a bigint, b bigint"), "near-links")


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all its columns: of each component only the rows of its smallest key."""
    name = free_name(docs, "__gone")
    gone = staged(near_duplicates(docs, key, text).filter("NOT kept").select(F.col(key).alias(name)), "near-gone")
    return docs.join(gone, docs[key].cast("bigint") == gone[name], "left_anti")

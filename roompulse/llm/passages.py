"""Passages that repeat across documents, by sparse suffix arrays.

Only suffixes at content-selected places are retained: the word where the smallest hash of ``GRAM`` words begins, in
every window of ``window`` such places. Two copies of a passage select the same places, and the first of them leaves
at least ``least - window + 1`` of the passage's words to its right. Suffixes are first grouped by the hash of
that many words; groups of more than one document are written out as sorted hash arrays, with the first and last document
of each, and mapped into memory by a second scan. There, suffixes that follow each other at the same distance in the
document and in its partner prove a long copy at once. What is left, what stands near the ends of long copies, and whatever
shares a seed with these are fetched with some words on both sides, sorted across the cluster by what follows, compared with
their neighbours, and extended to the right and left. Neighbours need not be the best partners, so every window of ``least``
words around each suffix is then looked up among all the others that share its seed: no passage is missed.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roompulse.llm import mapped
from roompulse.llm.wordhash import _BASE, U, Words, mix, ngrams, part_of
from roompulse.session import staged, staging_folder

LEAST = 50      # words of a passage
WINDOW = 24     # places from which one is selected
GRAM = 8        # words hashed to select a place
FLUSH = 1 << 21 # seeds that a task combines before it passes them on


def _run_hashes(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), U)
        for j in range(n):
            total = total * U(_BASE) + h[at + j]
        return mix(total)


def selected(h: np.ndarray, least: int = LEAST, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Places of the retained suffixes of one document, given its word hashes."""
    if len(h) < least:
        return np.zeros(0, np.int64)
    g = ngrams(h, gram)
    view = np.lib.stride_tricks.sliding_window_view(g, min(window, len(g)))
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    return at[at + least - window + 1 <= len(h)]


def _seeds(words: Words, ids: np.ndarray, least: int, window: int):
    """``(seed, id, place)`` of all retained suffixes, and the document (row) of each."""
    seeds, rows, places = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row, h in enumerate(words.rows()):
        at = selected(h, least, window)
        seeds.append(_run_hashes(h, at, least - window + 1))
        rows.append(np.full(len(at), row))
        places.append(at)
    row = np.concatenate(rows)
    return np.concatenate(seeds), ids[row], np.concatenate(places), row


def _ends(seed: np.ndarray, owner: np.ndarray, place: np.ndarray):
    """Of each seed, sorted, its first and last owner with their places."""
    order = np.lexsort((place, owner, seed))
    seed, owner, place = seed[order], owner[order], place[order]
    cut = seed[1:] != seed[:-1]
    first = np.flatnonzero(np.concatenate([[True], cut])) if len(seed) else np.zeros(0, np.int64)
    last = np.flatnonzero(np.concatenate([cut, [True]])) if len(seed) else first
    return seed, owner, place, first, last


def _planes(x: np.ndarray, n: int) -> bytes:
    return b"".join(((x >> U(8 * k)) & U(255)).astype(np.uint8).tobytes() for k in range(n))


def _pack(seed: np.ndarray, owner: np.ndarray, place: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(
        np.int64(len(seed)).tobytes() + _planes(np.diff(seed, prepend=U(0)), 8) + _planes(owner.view(U), 8)
        + _planes(place.astype(U), 4))


def _unpack(blob: bytes):
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    wide = raw[8:].reshape(20, n)
    get = lambda a, b: sum((wide[a + k].astype(U) << U(8 * k) for k in range(b)), np.zeros(n, U))
    return np.cumsum(get(0, 8), dtype=U), get(8, 8).view(np.int64), get(16, 4).astype(np.int64)


def _seeder(least: int, window: int, parts: int):
    """Seeds by part, of each no more than its first and last owner in what a task has combined."""
    def blobs(held):
        seed, owner, place, first, last = _ends(*held)
        keep = np.unique(np.concatenate([first, last]))
        seed, owner, place = seed[keep], owner[keep], place[keep]
        cut = np.searchsorted(part_of(seed, parts), np.arange(parts + 1))
        full = [p for p in range(parts) if cut[p] < cut[p + 1]]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([
            _pack(*(x[cut[p]:cut[p + 1]] for x in (seed, owner, place))) for p in full], pa.binary())],
            ["part", "blob"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            held.append(_seeds(Words(batch.column(1), lower=False), ids, least, window)[:3])
            size += len(held[-1][0])
            if size > FLUSH:
                yield blobs([np.concatenate(x) for x in zip(*held)])
                held, size = [], 0
        if size:
            yield blobs([np.concatenate(x) for x in zip(*held)])
    return run


def _sharer(folder: str):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        seed, owner, place, first, last = _ends(*(np.concatenate(x) for x in zip(
            *(_unpack(b.as_py()) for b in table.column("blob")))))
        two = owner[first] != owner[last]
        first, last = first[two], last[two]
        mapped.write(folder, f"shared-{part}", {
            "seed": seed[first], "low": owner[first], "low_at": place[first],
            "high": owner[last], "high_at": place[last]})
        return pa.table({"part": pa.array([part], pa.int32()), "size": pa.array([len(first)], pa.int64())})
    return run


class _Shared:
    """Seeds that more than one document holds, in parts that are mapped as needed."""

    def __init__(self, folder: str, parts: int, full: frozenset[int], name: str = "shared",
                 values: tuple[str, ...] = ("low", "low_at", "high", "high_at")):
        self.folder, self.parts, self.full, self.name, self.values = folder, parts, full, name, values
        self.files: dict[int, list[np.ndarray]] = {}

    def look_up(self, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which seeds are held, and one row per value of them."""
        order = np.argsort(seed)
        want = seed[order]
        hit, rows = np.zeros(len(seed), bool), np.zeros((len(self.values), len(seed)), np.int64)
        cut = np.searchsorted(part_of(want, self.parts), np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(cut)).tolist():
            if p not in self.full:
                continue
            if p not in self.files:
                self.files[p] = [mapped.read(self.folder, f"{self.name}-{p}", k, U if k == "seed" else np.int64)
                                 for k in ("seed", *self.values)]
            keys, *values = self.files[p]
            mine = order[cut[p]:cut[p + 1]]
            at = np.minimum(np.searchsorted(keys, seed[mine]), len(keys) - 1)
            hit[mine] = keys[at] == seed[mine]
            for k, v in enumerate(values):
                rows[k, mine] = v[at]
        return hit, rows


def _writer(folder: str):
    """Seeds of suffixes that are sorted, as sorted arrays by part."""
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        mapped.write(folder, f"sorted-{part}", {"seed": np.sort(table.column("seed").to_numpy().view(U))})
        return pa.table({"part": pa.array([part], pa.int32())})
    return run


def _fetcher(folder: str, parts: int, full: frozenset[int], least: int, window: int,
             again: frozenset[int] | None = None):
    """Spans that chains of suffixes prove, and the suffixes that must be sorted, with 32-bit hashes of the words
    around them: those before, last first, and those after their run. ``again`` names the parts of the seeds that
    are sorted, and asks for the suffixes that were left out before and share one of these."""
    run_length, side = least - window + 1, window - 1

    def run(batches):
        shared = _Shared(folder, parts, full)
        sorted_ = _Shared(folder, parts, again or frozenset(), "sorted", ())
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            words = Words(batch.column(1), lower=False)
            seed, owner, place, row = _seeds(words, ids, least, window)
            hit, (low, low_at, high, high_at) = shared.look_up(seed)
            live = np.flatnonzero(hit)
            if not len(live):
                continue
            seed, owner, place, row, low = (x[live] for x in (seed, owner, place, row, low))
            other = np.where(low != owner, low, high[live])
            shift = np.where(low != owner, low_at[live], high_at[live]) - place
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (other[1:] != other[:-1])
                                  | (shift[1:] != shift[:-1]) | (np.diff(place) > run_length)])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(new)]]) - 1
            of = np.cumsum(new) - 1
            long = place[last] + run_length - place[first] >= least
            # Of a long chain, all suffixes around which a passage may reach beyond it.
            size = (words.at[1:] - words.at[:-1])[row]
            sort = (~long[of] | (np.maximum(place - side, 0) < place[first][of])
                    | (np.minimum(place + run_length + side, size) > place[last][of] + run_length))
            if again is not None:
                sort = ~sort & sorted_.look_up(seed)[0]
                long = np.zeros_like(long)
            sort = np.flatnonzero(sort)
            # Marks of a document's ends, which agree with nothing: 0 on its left, 1 on its right.
            left, right = np.zeros((len(sort), side), np.uint32), np.ones((len(sort), side), np.uint32)
            short = (words.hash >> U(33)).astype(np.uint32) + np.uint32(2)
            begin, end = words.at[:-1][row[sort]], words.at[1:][row[sort]]
            back = (begin + place[sort])[:, None] - 1 - np.arange(side)
            on = (begin + place[sort] + run_length)[:, None] + np.arange(side)
            inside = back >= begin[:, None]
            left[inside] = short[back[inside]]
            inside = on < end[:, None]
            right[inside] = short[on[inside]]
            k = np.flatnonzero(long)
            lows = np.minimum.reduceat(low, first)[k]
            none = pa.nulls
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(seed[sort].view(np.int64)), none(len(k), pa.int64())]),
                pa.array(np.concatenate([owner[sort], owner[first[k]]])),
                pa.concat_arrays([pa.array(place[sort].astype(np.int32)), none(len(k), pa.int32())]),
                pa.array(np.concatenate([low[sort], lows])),
                pa.concat_arrays([pa.array([x.tobytes() for x in left], pa.binary()), none(len(k), pa.binary())]),
                pa.concat_arrays([pa.array([x.tobytes() for x in right], pa.binary()), none(len(k), pa.binary())]),
                pa.concat_arrays([none(len(sort), pa.int32()), pa.array(place[first[k]].astype(np.int32))]),
                pa.concat_arrays([none(len(sort), pa.int32()), pa.array(
                    (place[last[k]] + run_length).astype(np.int32))])],
                ["seed", "id", "pos", "low", "left", "right", "start", "stop"])
    return run


_ROW = "seed bigint, id bigint, pos int, low bigint, left binary, right binary"
_FOUND = "id bigint, start int, stop int, low bigint, window bigint, last bigint"


def _words(column: pa.Array, side: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, side)


def _agree(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading words that rows ``a`` and ``b`` share; the marks of a document's ends (0 and 1) agree with nothing."""
    same = (x[a] == x[b]) & (x[a] > 1)
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def _runs_of(x: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, 2, ... words of each row, one row per length; words of 0 and 1 are none."""
    total = np.zeros((x.shape[1] + 1, len(x)), U)
    with np.errstate(over="ignore"):
        for k in range(x.shape[1]):
            total[k + 1] = mix(total[k] * U(_BASE) + x[:, k])
    return total


def _comparer(least: int, window: int):
    """Each row of a sorted part against the nearest rows of other documents before and after it, and then each window
    of ``least`` words around it against all others of the part.

    Emits spans of at least ``least`` words, and the windows that other parts may hold too: ``window`` is the hash, ``id``
    and ``last`` are the smallest and the largest document with it. Where the part has only one, ``start`` is the place.
    """
    run_length, side = least - window + 1, window - 1

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        seed, ids, pos, low = (table.column(k).to_numpy() for k in ("seed", "id", "pos", "low"))
        left, right = (_words(table.column(k), side) for k in ("left", "right"))
        n = len(seed)
        new = np.concatenate([[True], (seed[1:] != seed[:-1]) | (ids[1:] != ids[:-1])])
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        ends = np.concatenate([first[1:], [n]])
        best = np.full(n, -1)
        start, stop = pos.astype(np.int64).copy(), pos.astype(np.int64).copy()
        for other in (first[of] - 1, ends[of]):
            rows = np.flatnonzero((other >= 0) & (other < n))
            rows = rows[seed[other[rows]] == seed[rows]]
            a, b = _agree(left, rows, other[rows]), _agree(right, rows, other[rows])
            good = a + b > best[rows]
            rows, a, b = rows[good], a[good], b[good]
            best[rows] = a + b
            start[rows], stop[rows] = pos[rows] - a, pos[rows] + run_length + b
        short = best + run_length < least
        start[short], stop[short] = np.iinfo(np.int64).max, -1

        # Words that may follow in other parts too: rows are sorted by what follows, so what another part shares with a
        # row, this part's first or last row shares as well.
        beyond = np.full(n, -1)
        for edge in (0, n - 1):
            rows = np.flatnonzero(seed == seed[edge])
            beyond[rows] = np.maximum(beyond[rows], _agree(right, rows, np.full(len(rows), edge)))
        before, after = _runs_of(left), _runs_of(right)
        has_left = np.logical_and.accumulate(left > 1, axis=1).sum(axis=1)
        has_right = np.logical_and.accumulate(right > 1, axis=1).sum(axis=1)
        out = []
        for a in range(side + 1):
            b = side - a
            rows = np.flatnonzero((has_left >= a) & (has_right >= b))
            if not len(rows):
                continue
            with np.errstate(over="ignore"):
                key = mix(mix(mix(seed[rows].view(U) + U(a)) + before[a, rows]) * U(_BASE) + after[b, rows])
            order = np.lexsort((ids[rows], key))
            rows, key = rows[order], key[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            tail = np.concatenate([head[1:], [len(key)]]) - 1
            two = ids[rows[head]] != ids[rows[tail]]
            held = np.repeat(two, tail - head + 1)
            mine = rows[held]
            start[mine] = np.minimum(start[mine], pos[mine] - a)
            stop[mine] = np.maximum(stop[mine], pos[mine] + run_length + b)
            far = beyond[rows] >= b
            lone = np.flatnonzero(far & ~held)
            both = np.flatnonzero(two & far[head])
            out.append((key[lone], ids[rows[lone]], ids[rows[lone]], pos[rows[lone]] - a, low[rows[lone]],
                        np.ones(len(lone), bool)))
            out.append((key[head[both]], ids[rows[head[both]]], ids[rows[tail[both]]], np.zeros(len(both), np.int64),
                        low[rows[head[both]]], np.zeros(len(both), bool)))
        spans = np.flatnonzero(stop >= 0)
        none = pa.nulls(len(spans), pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.array(ids[spans]), pa.array(start[spans].astype(np.int32)), pa.array(stop[spans].astype(np.int32)),
            pa.array(low[spans]), none, none], _FOUND_NAMES)
        for key, one, last, at, lows, lone in out:
            yield pa.RecordBatch.from_arrays([
                pa.array(one), pa.array(at.astype(np.int32), mask=~lone),
                pa.array((at + least).astype(np.int32), mask=~lone), pa.array(lows), pa.array(key.view(np.int64)),
                pa.array(last)], _FOUND_NAMES)
    return run


_FOUND_NAMES = [x.split(" ")[0] for x in _FOUND.split(", ")]


def _compared(rows: DataFrame, order: list[str], least: int, window: int) -> DataFrame:
    """The spans that ``_comparer`` finds in the sorted order, and those whose windows are held by several of its parts."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        _comparer(least, window), _FOUND), "passages-compared")
    windows = found.filter("window IS NOT NULL")
    two = windows.groupBy("window").agg(F.min("id").alias("one"), F.max("last").alias("other")).filter("one < other")
    across = windows.filter("start IS NOT NULL").join(two.select("window"), "window")
    return found.filter("window IS NULL").unionByName(across).select("id", "start", "stop", "low")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST,
                      window: int = WINDOW) -> DataFrame:
    """``(key, start_word, end_word, n_words, first_id)``: runs of words that other documents hold too.

    One row per document and maximal run of words covered by passages of at least ``least`` words (exact, with case)
    that occur in another document; ``end_word`` is exclusive; ``first_id`` is the smallest key seen to share a part of the
    run, and is the row's own key in the document that may keep it. Documents without such a passage have no row; null and
    short texts have none. Rows with a null key are left out; rows that repeat a key are one document.
    """
    if window + GRAM - 1 > least:
        raise ValueError("the window is too wide for passages that short")
    plain = docs.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{staging_folder(spark)}/passages-{uuid.uuid4().hex}"
    sizes = plain.mapInArrow(_seeder(least, window, parts), "part int, blob binary").groupBy("part").applyInArrow(
        _sharer(folder), "part int, size bigint").collect()
    full = frozenset(r["part"] for r in sizes if r["size"])
    fetched = staged(plain.mapInArrow(_fetcher(folder, parts, full, least, window),
                                      f"{_ROW}, start int, stop int"), "passages-rows")
    proved = fetched.filter("start IS NOT NULL").select("id", "start", "stop", "low")
    rows = fetched.filter("start IS NULL").drop("start", "stop")
    part = F.expr(f"CAST(shiftrightunsigned(shiftrightunsigned(seed, 32) * {parts}, 32) AS int)")
    wanted = rows.select("seed").distinct().select(part.alias("part"), "seed").groupBy("part").applyInArrow(
        _writer(folder), "part int").collect()
    rest = plain.mapInArrow(_fetcher(folder, parts, full, least, window, frozenset(r["part"] for r in wanted)),
                            f"{_ROW}, start int, stop int").drop("start", "stop")
    rows = rows.unionByName(staged(rest, "passages-rest"))

    spans = _compared(rows, ["seed", "right", "left", "id", "pos"], least, window).unionByName(proved)

    upto = Window.partitionBy("id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy("id").orderBy("start", "stop")
    runs = spans.withColumn(
        "new", F.coalesce((F.col("start") > F.max("stop").over(upto)).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("id", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("low").alias("low")).select(
        F.col("id").alias(key), F.col("start").cast("bigint").alias("start_word"),
        F.col("stop").cast("bigint").alias("end_word"),
        (F.col("stop") - F.col("start")).cast("bigint").alias("n_words"), F.col("low").alias("first_id"))

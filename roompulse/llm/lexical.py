"""Ranked lexical search as inner products, in buckets of equal length (LEMP; Teflioudi et al., 2015).

A document is the vector of its impacts, a query the vector of its weights, and a score their inner product. Only
coordinates that some query has are kept. Vectors are ordered by their length across the cluster and read
longest first, in buckets. Per query and bucket:

* Cauchy-Schwarz: the bucket is left out when |query| * |longest vector| is below the k-th best score so far; whole files
  of a later round are left out by the same bound in the scan;
* coordinate bounds: no vector exceeds the bucket's largest value per coordinate, so only vectors that hold one of the
  query's leading coordinates can reach that score; with these added up, the smaller of both bounds on the rest decides;
* the survivors are scored again over all coordinates in integers.

Bounds are compared with >=, so ties survive and the smaller id wins. Nothing is approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roompulse.llm.wordhash import U, text_bytes, word_hashes, word_spans
from roompulse.session import staged

TOP = 10
# Query terms handled at a time; larger query tables go through in blocks. Bounds what tasks and the driver hold.
BLOCK_TERMS = 1 << 20
BUCKET_ROWS = 4096          # vectors of a bucket, at most
BUCKET_VALUES = 1 << 20     # and their values: a bucket ends when it has as many
FIRST_ROUND = 0.98          # quantile of length above which vectors are searched first, to learn scores to beat
_SLACK = 1 + 1e-9           # over rounding in bounds that are computed in doubles

# What separates terms (all other bytes of UTF-8 belong to terms), and the impact formula.
SEPARATORS = ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
ONE, TF, M, M_BASE, M_SLOPE, W = 1_000_000_000, 1000, 8, 25, 75, 1000

_SPACED = np.arange(256, dtype=np.uint8)
for _low, _high in SEPARATORS:
    _SPACED[_low:_high + 1] = 32


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of a text column, and where each row's terms begin (rows + 1)."""
    raw, offsets = text_bytes(column)
    raw = _SPACED[raw]
    starts, ends = word_spans(raw, offsets)
    return word_hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, at = terms_of(batch.column(1))
        for i in range(batch.num_rows):
            term, count = np.unique(h[at[i]:at[i + 1]], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([batch.column(0).slice(i, 1)] * len(term)) if len(term) else batch.column(0).slice(0, 0),
                 pa.array(term.view(np.int64)), pa.array(count, pa.int64())], ["item", "term", "count"])


def _counter(vocabulary: np.ndarray):
    """Per document: all its terms counted, and places and counts of those of the vocabulary."""
    def run(batches):
        size = len(vocabulary)
        for batch in batches:
            h, at = terms_of(batch.column(1))
            n = np.diff(at)
            place = np.searchsorted(vocabulary, h)
            hit = np.flatnonzero(vocabulary[np.minimum(place, size - 1)] == h) if size else np.zeros(0, np.int64)
            row = np.searchsorted(at, hit, "right") - 1
            pair, count = np.unique(row * size + place[hit], return_counts=True)
            row = pair // size if size else pair
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(np.int32)))
                     for x in (pair % max(size, 1), count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists],
                                             ["doc", "n", "ids", "tfs"])
    return run


class _Query:
    def __init__(self, item, ids: np.ndarray, values: np.ndarray, least: int):
        self.item, self.ids, self.values, self.least = item, ids, values, least
        self.length = math.sqrt(float((values.astype(float) ** 2).sum()))


class _Bucket:
    """Vectors by row and by coordinate."""

    def __init__(self, batches: list[pa.RecordBatch], size: int):
        one = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.doc = one.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        self.lacks = one.column(0).is_null().to_numpy(zero_copy_only=False)
        self.length = one.column(1).to_numpy()
        ids, values = one.column(2), one.column(3)
        at = ids.offsets.to_numpy()
        self.at = (at - at[0]).astype(np.int64)
        self.ids = ids.flatten().to_numpy()
        self.values = values.flatten().to_numpy().astype(np.int64)
        self.longest = float(self.length.max())
        order = np.argsort(self.ids, kind="stable")
        self.rows = np.repeat(np.arange(len(self.doc)), np.diff(self.at))[order]
        self.column = self.values[order]
        self.starts = np.searchsorted(self.ids[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        full = np.flatnonzero(np.diff(self.starts))
        self.most[full] = np.maximum.reduceat(self.column, self.starts[full])

    def survivors(self, q: _Query, need: int) -> np.ndarray:
        """Rows whose score may be ``need`` or more."""
        none = np.zeros(0, np.int64)
        if q.length * self.longest * _SLACK < need:
            return none
        reach = q.values * self.most[q.ids]
        order = np.argsort(-reach, kind="stable")
        rest = np.concatenate([np.cumsum(reach[order][::-1])[::-1], [0]])
        leading = order[:int(np.count_nonzero(rest >= need))]
        if not len(leading):
            return none
        got, squares = np.zeros(len(self.doc), np.int64), np.zeros(len(self.doc))
        for j in leading:
            a, b = self.starts[q.ids[j]], self.starts[q.ids[j] + 1]
            got[self.rows[a:b]] += q.values[j] * self.column[a:b]
            squares[self.rows[a:b]] += self.column[a:b].astype(float) ** 2
        rows = np.flatnonzero(got)
        left = math.sqrt(max(0.0, float((q.values[order[len(leading):]].astype(float) ** 2).sum())))
        length = np.sqrt(np.maximum(self.length[rows] ** 2 * _SLACK - squares[rows], 0))
        most = np.minimum(left * length * _SLACK, float(rest[len(leading)]))
        return rows[got[rows] + most >= need]

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; no row is without values."""
        sizes = self.at[rows + 1] - self.at[rows]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.repeat(self.at[rows] - first, sizes) + np.arange(int(sizes.sum()))
        return np.add.reduceat(dense[self.ids[at]] * self.values[at], first)


def _buckets(batches, size: int, most_rows: int) -> Iterator[_Bucket]:
    held, rows, values = [], 0, 0
    for batch in batches:
        for i in range(0, batch.num_rows, most_rows):
            part = batch.slice(i, most_rows)
            if held and rows + part.num_rows > most_rows:
                yield _Bucket(held, size)
                held, rows, values = [], 0, 0
            held.append(part)
            rows += part.num_rows
            values += len(part.column(2).flatten())
            if values >= BUCKET_VALUES:
                yield _Bucket(held, size)
                held, rows, values = [], 0, 0
    if held:
        yield _Bucket(held, size)


def _searcher(queries: list[_Query], size: int, top: int, bucket_rows: int):
    """The best ``top`` rows of every query among the vectors of one task."""
    def run(batches):
        best: dict[int, tuple] = {}
        dense = np.zeros(size, np.int64)
        for bucket in _buckets(batches, size, bucket_rows):
            for number, q in enumerate(queries):
                held = best.get(number)
                need = max(1, q.least, int(held[0][top - 1]) if held and len(held[0]) == top else 0)
                rows = bucket.survivors(q, need)
                if not len(rows):
                    continue
                dense[q.ids] = q.values
                score = bucket.scores(rows, dense)
                dense[q.ids] = 0
                good = score >= need
                new = score[good], bucket.doc[rows[good]], bucket.lacks[rows[good]]
                score, doc, lacks = map(np.concatenate, zip(held, new)) if held else new
                order = np.lexsort((doc, lacks, -score))[:top]
                best[number] = score[order], doc[order], lacks[order]
        for number, (score, doc, lacks) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([queries[number].item] * len(score), pa.int64()), pa.array(doc, pa.int64(), mask=lacks),
                 pa.array(score, pa.int64())], ["item", "doc", "score"])
    return run


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           item_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS,
           bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(item_key, rank, key, score)``: the ``top`` best documents of every item with a score above 0.

    Terms are maximal runs of other bytes than ``SEPARATORS``, A-Z lower-cased; null and empty texts have none. With
    N documents that have a term, L terms in them, n in one, df documents with a term and tf its count, a score adds
    up, over the item's terms with repeats, ``floor(1000 ln((2N+2)/(2df+1))) * ((10^9 tf) div (1000 tf + 8 m))``,
    ``m = 25 + (75 n N) div L``. Equal scores go by ascending key, a null key last. Every row of ``docs`` is a document, also
    one that repeats. Of items with one key the largest text counts; an item without a key is an item. Texts of any
    length are read whole. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    asked = items.groupBy(F.col(item_key).cast("bigint").alias("item")).agg(F.max(item_text).alias("text"))
    asked = staged(asked.mapInArrow(_item_terms, "item bigint, term bigint, count bigint"), "search-items")
    blocks = max(1, math.ceil(asked.count() / block_terms))
    found = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else asked
        best = _search_block(spark, plain, part.toArrow(), top, bucket_rows)
        found = best if found is None else found.unionByName(best)
    return found.select(F.col("item").alias(item_key), F.col("rank").cast("int").alias("rank"),
                        F.col("doc").alias(key), "score")


def _search_block(spark: SparkSession, docs: DataFrame, asked: pa.Table, top: int, bucket_rows: int) -> DataFrame:
    vocabulary = np.unique(asked["term"].to_numpy().view(U))
    counted = staged(docs.mapInArrow(_counter(vocabulary), "doc bigint, n bigint, ids array<int>, tfs array<int>")
                     .filter("n > 0"), "search-counts")
    documents, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = np.zeros(len(vocabulary), np.int64)
    seen = counted.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).toArrow()
    holders[seen["id"].to_numpy()] = seen["df"].to_numpy()
    weight = np.array([math.floor(W * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holders], np.int64)
    queries = _queries(asked, vocabulary, weight)
    if not documents or not queries:
        return spark.createDataFrame([], "item bigint, doc bigint, score bigint, rank int")

    m = F.expr(f"{M_BASE} + ({M_SLOPE} * n * {documents}L) div {length}L")
    vectors = counted.filter(F.size("ids") > 0).withColumn("m", m).select(
        "doc", "ids", F.expr(f"transform(tfs, t -> cast(({ONE}L * t) div ({TF} * t + {M} * m) as int))").alias("impacts"))
    length_of = F.expr("sqrt(aggregate(impacts, 0D, (a, x) -> a + cast(x as double) * x))")
    vectors = vectors.select("doc", length_of.alias("length"), "ids", "impacts")
    # Ordered by length across the cluster; the id spreads vectors of one length.
    vectors = staged(vectors.repartitionByRange(F.desc("length"), "doc")
                     .sortWithinPartitions(F.desc("length"), "doc"), "search-vectors")

    def found(rows: DataFrame, name: str) -> DataFrame:
        best = rows.mapInArrow(_searcher(queries, len(vocabulary), top, bucket_rows),
                               "item bigint, doc bigint, score bigint")
        return staged(_best(best, top), name)
    cut = vectors.agg(F.percentile_approx("length", FIRST_ROUND, 10_000)).first()[0]
    first = found(vectors.filter(F.col("length") >= F.lit(cut)), "search-first")
    beaten = {r["item"]: r["score"] for r in first.filter(F.col("rank") == top).collect()}
    for q in queries:
        q.least = beaten.get(q.item, 0)
    least = min(q.least / q.length if q.length else math.inf for q in queries) / _SLACK ** 2
    rest = vectors.filter(F.col("length") < F.lit(cut)) if cut is not None else vectors.limit(0)
    if math.isfinite(least) and least > 0:
        rest = rest.filter(F.col("length") >= F.lit(least))
    return _best(first.drop("rank").unionByName(found(rest, "search-rest").drop("rank")), top)


def _queries(asked: pa.Table, vocabulary: np.ndarray, weight: np.ndarray) -> list[_Query]:
    """One vector per item, without coordinates of no weight."""
    place = np.searchsorted(vocabulary, asked["term"].to_numpy().view(U))
    value = asked["count"].to_numpy() * weight[place]
    item = asked["item"].to_pylist()
    order = sorted(range(len(item)), key=lambda i: (item[i] is None, item[i] or 0))
    out, a = [], 0
    for b in range(1, len(order) + 1):
        if b == len(order) or item[order[b]] != item[order[a]]:
            rows = np.array(order[a:b])
            rows = rows[value[rows] > 0]
            if len(rows):
                out.append(_Query(item[order[a]], place[rows], value[rows], 0))
            a = b
    return out

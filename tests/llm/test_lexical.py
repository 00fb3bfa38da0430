import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roompulse.llm import lexical
from tests.llm.conftest import DOCS, with_clashes

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    N, L = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        rows = []
        for d, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                rows.append((-score, d is None, d or 0))
        for rank, (s, lacks, d) in enumerate(sorted(rows)[:top], 1):
            out.append((item, rank, None if lacks else d, -s))
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    docs = with_clashes(spark.createDataFrame([(d, t, None, None, 0) for d, t in docs], DOCS).drop("n_chars", "lang", "source"))
    items = spark.createDataFrame(items, ITEMS).withColumns({c: F.lit("x") for c in ("term", "count", "item", "rank", "score")})
    return sorted(map(tuple, lexical.search(docs, items, **more).collect()), key=repr)


@pytest.mark.parametrize("bucket_rows,block_terms", [(4096, 1 << 20), (3, 1 << 20), (7, 40)])
def test_equals_brute_force(spark, bucket_rows, block_terms):
    """Skewed words, copies of one text, ties, passages of items inside documents, repeats in items."""
    rng = random.Random(11)
    words = ["w%d" % i for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    items = [(i, text(rng.randrange(1, 30))) for i in range(25)] + [(30, "w1 W1, w1!"), (31, "nowhere"), (32, ""), (33, None)]
    docs = [(i, text(rng.randrange(1, 120))) for i in range(150)]
    docs += [(200 + i, text(20) + " " + items[i][1] + " " + text(20)) for i in range(20)]
    docs += [(1000 - i, docs[3][1]) for i in range(60)] + [(500, items[2][1])] * 3
    docs += [(900, None), (901, ""), (902, "?!"), (903, text(5000)), (None, items[4][1])]
    rng.shuffle(docs)
    got = found(spark, docs, items, bucket_rows=bucket_rows, block_terms=block_terms)
    assert got == brute(docs, items)
    assert {r[0] for r in got} >= set(range(25)) | {30} and not {31, 32, 33} & {r[0] for r in got}


def test_terms_of_any_text(spark):
    docs = [(1, "Ünï-CODE don't_stop 42\x00x É é\U0001F600k"), (2, "ünï code"), (3, "don t stop x 42"), (4, "é\U0001F600K É")]
    items = [(1, docs[0][1]), (2, "É"), (3, "K"), (None, "42 stop")]
    assert found(spark, docs, items) == brute(docs, items)


def test_items_with_one_key(spark):
    docs = [(1, "a b"), (2, "b c")]
    assert found(spark, docs, [(1, "a"), (1, "c"), (1, "c")]) == brute(docs, [(1, "c")])


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None), (None, "")], [(1, "a")]) == []


def test_edge_documents(spark, edge_docs):
    """Nulls, very long texts and repeated rows, as brute force has them."""
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    items = [(1, "no id one more"), (2, rows[5][1][:300]), (3, "日本語 x"), (4, rows[6][1][:200])]
    asked = spark.createDataFrame(items, ITEMS)
    got = sorted(map(tuple, lexical.search(edge_docs, asked).collect()), key=repr)
    assert got == brute(rows, items)


def test_bounds_leave_out_most_vectors():
    """Buckets are pruned by length, vectors by coordinates; what survives holds all that reach the score."""
    rng = np.random.default_rng(3)
    size, n = 50, 2000
    rows = [np.sort(rng.choice(size, rng.integers(1, 12), replace=False)) for _ in range(n)]
    values = [rng.integers(1, 500, len(r)) for r in rows]
    length = np.array([math.sqrt(float((v.astype(float) ** 2).sum())) for v in values])
    batch = pa.RecordBatch.from_arrays([
        pa.array(range(n), pa.int64()), pa.array(length), pa.array(rows, pa.list_(pa.int32())),
        pa.array(values, pa.list_(pa.int32()))], ["doc", "length", "ids", "impacts"])
    bucket = lexical._Bucket([batch], size)
    ids = np.sort(rng.choice(size, 6, replace=False))
    q = lexical._Query(1, ids, rng.integers(1, 9, 6), 0)
    dense = np.zeros(size, np.int64)
    dense[ids] = q.values
    exact = np.array([int((dense[r] * v).sum()) for r, v in zip(rows, values)])
    assert (bucket.scores(np.arange(n), dense) == exact).all()
    need = int(np.sort(exact)[-10])
    left = bucket.survivors(q, need)
    assert set(np.flatnonzero(exact >= need)) <= set(left) and len(left) < n / 10
    assert not len(bucket.survivors(q, int(q.length * bucket.longest) + 2))


def test_vectors_lie_in_order_of_length(spark, sf_dir, monkeypatch):
    """Tasks read ranges of length, longest first, and no text is shuffled."""
    kept = {}
    real = lexical.staged

    def keep(df, name):
        kept[name] = df
        return real(df, name)
    monkeypatch.setattr(lexical, "staged", keep)
    from roompulse.tables import table
    lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).collect()
    parts = kept["search-vectors"].groupBy(F.spark_partition_id().alias("p")).agg(
        F.min("length").alias("low"), F.max("length").alias("high")).orderBy(F.desc("low")).collect()
    assert all(a["low"] >= b["high"] for a, b in zip(parts, parts[1:]))
    assert "text" not in kept["search-vectors"].columns

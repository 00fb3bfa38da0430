import hashlib
import random

import pytest
from pyspark.sql import functions as F

from roompulse.llm import infill
from tests.llm.conftest import DOCS


def brute(key, text):
    """Form, cut lengths and output, by slicing."""
    text = text or ""
    digest = hashlib.sha256(b"1:" + ("" if key is None else str(key)).encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def check(df):
    rows = infill.transformed(df).withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    for r in rows:
        assert tuple(r[1:5]) + (r["output"],) == brute(r["doc_id"], r["body"])
        assert r["again"] == r["body"]
    return rows


def test_cuts_equal_slices(spark):
    rng = random.Random(13)
    alphabet = ["a", "B", " ", "\n", "\r\n", " ", "é", "日", "\U0001F600", "é", "<", "P", "S>", "M", ">", "$1", "\\", "\x00", "{2}"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += ["<P", "<P><S>", "<", "S>", "x<M>y", "\\$1", "\U0001F600" * infill.BLOCK, "ab" * infill.BLOCK, "é" * (2 * infill.BLOCK + 1)]
    rows = check(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS))
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_edge_cases(edge_docs, no_docs):
    rows = check(edge_docs)
    assert len(rows) == edge_docs.count()
    assert {r["form"] for r in rows if r["n"] == 0} == {"plain"}
    assert infill.transformed(no_docs).count() == 0


def test_very_long_text(spark):
    """Two million code points: linear time, no list of them."""
    docs = spark.range(1, 4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é\U0001F600 a\n"), 400_000).alias("text"))
    got = infill.transformed(docs).select("n", "form", F.length("output").alias("size"),
                                          (infill.restored(F.col("output"), F.col("form")) == F.col("body")).alias("same")).collect()
    assert all(r["n"] == 2_000_000 and r["same"] and r["size"] == r["n"] + (0 if r["form"] == "plain" else 9) for r in got)


def test_forms_occur_as_often_as_asked(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    share = {r["form"]: r["count"] / 20_000 for r in infill.transformed(docs).groupBy("form").count().collect()}
    assert share["plain"] == pytest.approx(0.1, abs=0.01) and share["spm"] == pytest.approx(0.18, abs=0.012)


def test_one_pattern_and_no_python(spark, sf_dir):
    """The plan is a projection of the scan: no shuffle, no Python."""
    from roompulse.llm.queries import QUERIES
    plan = QUERIES["op13_fill_in_middle"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow", "Join")) and "ReadSchema: struct<doc_id:bigint,text:string>" in plan

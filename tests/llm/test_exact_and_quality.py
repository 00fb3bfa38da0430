import hashlib
import random

import pytest
from pyspark.sql import functions as F

from roompulse.llm import exact_dedup, quality
from tests.llm.conftest import DOCS, sentence, table


def test_exact_groups_on_edge_cases(edge_docs):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"])
           for r in exact_dedup.exact_groups(edge_docs).collect()}
    # The empty texts: two ids, and two rows without text of which one has no id.
    assert {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False)} <= got
    assert {(6, 7, 3, False), (7, 7, 3, True)} <= got
    assert {(8, 8, 1, True), (5, 5, 1, True), (None, None, 1, True)} <= got
    assert exact_dedup.exact_groups(edge_docs).count() == 15


def test_texts_that_share_length_and_prefix_are_told_apart(spark):
    head = "p" * 100
    rows = [(i, head + s, None, None, None) for i, s in enumerate(("ab", "ba", "ab", "aa", "é"))]
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {0: 2, 1: 1, 2: 2, 3: 3, 4: 4}


def test_without_copies_keeps_columns_and_rows_without_id(edge_docs):
    kept = exact_dedup.without_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([2, 3, 4, 5, 7, 7, 8, 9, 10, 11, 12, None, None], key=repr)


def test_empty_tables(no_docs):
    assert table(exact_dedup.exact_groups(no_docs)) == []
    assert table(quality.judged(no_docs)) == []
    assert table(quality.good_documents(no_docs)) == []
    assert table(exact_dedup.without_copies(no_docs)) == []


def brute_quality(text):
    ws = (text or "").encode().split()
    wins = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    count = {}
    for w in wins:
        count[w] = count.get(w, 0) + 1
    again = {i + d for i, w in enumerate(wins) if count[w] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(again), len(ws) < 50 or 100 * len(again) > 50 * len(ws))


def test_quality_against_brute_force(edge_docs, spark, sf_dir):
    for docs in (edge_docs, spark.read.parquet(f"{sf_dir}/documents.parquet").limit(300)):
        for r in quality.judged(docs).collect():
            assert tuple(r)[1:6] + (r["base_failed"],) == brute_quality(r["doc"]["text"])


def test_line_rules(spark):
    lines = {"Plain words that end well.": False, "Home | News | Sport | More": True, "no end": False, "": False,
             "All rights reserved.": True, "WOW!! THIS!! IS!! LOUD!!": True, "a### b$$$ c&&& d%%%": True,
             "one two three four five six seven eight nine ten eleven twelve": True, "a | b": False}
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    got = {r["line"]: r["bad"] for r in df.select("line", quality.failing_line(df["line"]).alias("bad")).collect()}
    assert got == lines


def test_documents_that_lose_too_much_go_and_clean_ones_stay(spark):
    rng = random.Random(1)
    good = "\n".join(sentence(rng, 9, ["w%d" % i for i in range(500)]).capitalize() + "." for _ in range(12))
    menu = "\n".join(f"Item{i} | Item{i * 3} | Item{i * 5} | Item{i * 11} | Last{i}" for i in range(12))
    docs = spark.createDataFrame([(1, good, None, None, 0), (2, menu, None, None, 0), (3, good + "\n" + menu[:100],
                                                                                      None, None, 0)], DOCS)
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [1, 3]


def test_clean_articles_on_one_line_stay(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(900)]
    prose = lambda n: " ".join(sentence(rng, 12, words).capitalize() + "." for _ in range(n))
    phrases = ["all rights reserved", "copyright", "(c) 2019", "terms of use", "terms of service", "privacy policy", "cookie",
               "cookies", "JavaScript", "licensed under", "public license", "subscribe", "sign up", "log in", "login",
               "click here", "read more", "back to top", "share this", "blog in", "catalog in", "a | b | c | d", "No!! No!! No!!",
               "### *** %%%"]
    good = [f"{prose(20)} We saw {p} there. {prose(20)}" for p in phrases]
    good += [prose(20) + " and so it goes on without an end", prose(20) + " " + sentence(rng, 30, words),
             " ".join(sentence(rng, 12, words) + "।" for _ in range(9)), sentence(rng, 60, words) + "؟"]
    bad = ["Log in. Sign up. Privacy policy. Terms of use. Cookies. Read more. " * 2 + sentence(rng, 40, words) + ". "
           + "Subscribe. Click here. Back to top. Share this. All rights reserved. " * 6, sentence(rng, 80, words),
           " | ".join(sentence(rng, 2, words) for _ in range(40)) + ".", "\n".join(
               f"{sentence(rng, 6, words)} privacy policy." for _ in range(12))]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(good + bad)], DOCS)
    assert sorted(r[0] for r in quality.good_documents(df).collect()) == list(range(len(good)))


def test_no_python_in_native_plans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (quality.judged(docs), exact_dedup.exact_groups(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_digest_is_of_the_text(spark, sf_dir):
    from roompulse.llm.queries import QUERIES
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op4_exact_dedup"](spark, sf_dir).limit(50).collect():
        assert r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("filler", [" ", "\t", "\r", "!", "?", "#", "|", ". ", "| ", ".)", "a", "cookie"])
def test_lines_of_a_megabyte_take_seconds(spark, filler):
    """Patterns are linear in a line, whatever it is full of."""
    import time
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("a"), F.repeat(F.lit(filler), 1_000_000 // len(filler)), F.lit("b")).alias("text"))
    for failing in (quality.failing_line, quality.failing_share):
        start = time.perf_counter()
        assert quality.judged(docs, failing=failing).count() == 1
        quality.judged(docs, failing=failing).write.format("noop").mode("overwrite").save()
        assert time.perf_counter() - start < 10


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_texts_stay_where_they_are(small, spark, sf_dir, edge_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert table(exact_dedup.exact_groups(docs, small=small)) == table(exact_dedup.exact_groups(docs))
    assert table(exact_dedup.exact_groups(edge_docs, small=small)) == table(exact_dedup.exact_groups(edge_docs))
    rows = docs.select(F.col("doc_id").alias("key"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("head"),
                       F.col("text").alias("body"), F.struct(F.lit(0).alias("none")).alias("more"))
    shared = rows.groupBy("size", "head").agg(F.count(F.lit(1)).alias("n")).select("size", "head", F.lit(True).alias("alive"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = exact_dedup._full(rows, shared, small)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [b for b in plan.split("\n\n") if "Exchange" in b.split("\n")[0] and "Input" in b]
    assert moved and not any("body#" in b or "text#" in b for b in moved)

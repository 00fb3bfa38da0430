import math

import pytest

from roompulse.llm import mixing
from tests.llm.conftest import DOCS


def brute_targets(sizes):
    """Shares handed out round by round."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += weight[s] * share
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def total(rows, column):
    out = {}
    for r in rows:
        out[r["source"]] = out.get(r["source"], 0) + r[column]
    return out


@pytest.mark.parametrize("docs", ["edge", "table"])
def test_mix_meets_targets(docs, edge_docs, spark, sf_dir):
    if docs == "edge":
        df = edge_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    else:
        df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mixed(df).join(df.select("doc_id", "source", "text"), "doc_id").collect()
    sizes = total(rows, "size")
    want = brute_targets(sizes)
    taken = total(rows, "taken")
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode().split())
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    if docs == "table":
        for s in sizes:
            assert taken[s] == pytest.approx(want[s], rel=0.01)


def test_rates_are_exponential_in_size(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mixed(docs).join(docs.select("doc_id", "source"), "doc_id").filter("source = 'src3'").collect()
    free = [r for r in rows if 0.01 < r["rate"] < 1.99 and r["size"] > 50]
    tilts = [math.log(r["rate"]) / r["size"] for r in free]
    assert len(free) > 10 and max(tilts) - min(tilts) < 1e-6
    assert sum(r["rate"] * r["size"] for r in rows) == pytest.approx(rows[0]["target"], rel=1e-6)


def test_reruns_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = mixing.mixed(docs).collect()
    two = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_hot_sources_small_sources_and_ties(spark):
    rows = [(i, "a b c d", None, "big", 0) for i in range(600)] + [(1000 + i, "x " * (i + 1), None, None, 0)
                                                                 for i in range(20)] + [(2000, "y", None, "tiny", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    want = brute_targets(total(got, "size"))
    taken = total(got, "taken")
    assert taken["big"] == pytest.approx(want["big"], abs=4) and taken["tiny"] == 2
    assert taken[None] == pytest.approx(want[None], abs=3)


def test_repeated_rows_follow_the_copies(spark, edge_docs, no_docs):
    docs = spark.createDataFrame([(i, "w " * (i + 1), None, "s%d" % (i % 3), 0) for i in range(60)], DOCS)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(docs).collect()}
    got = mixing.repeated(docs)
    assert got.columns == docs.columns
    seen = {}
    for r in got.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {k: v for k, v in copies.items() if v}
    assert mixing.repeated(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    assert mixing.repeated(edge_docs).columns == edge_docs.columns
    assert mixing.repeated(edge_docs).filter("doc_id IS NULL").count() == 2


def test_newton_needs_few_steps(spark, sf_dir, monkeypatch):
    """Bisection would take some thirty steps to reach this precision."""
    steps = []
    real = mixing.staged
    monkeypatch.setattr(mixing, "staged", lambda df, name: (steps.append(name), real(df, name))[1])
    mixing.mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert 3 < steps.count("mix-tilts") < 15

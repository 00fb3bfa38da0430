import collections

import pytest

import __spark_entry__
import corpus_pipeline
from roompulse.llm import mixing
from roompulse.llm.queries import PIECE_MODEL
from roompulse.llm.sql import SQL
from roompulse.session import staged
from tests.llm.test_exact_and_quality import brute_quality
from tests.llm.test_near_duplicates import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, the input first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SF), "test"))
    return out


def test_stages_keep_the_columns(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_rejected_documents_and_copies_go(stages):
    raw, good, exact, near = ({r["doc_id"]: r["text"] for r in df.collect()} for df in stages[:4])
    assert set(good) <= {d for d, t in raw.items() if not brute_quality(t)[-1]}
    largest = {}
    for d, t in good.items():
        largest[t] = max(d, largest.get(t, d))
    assert set(exact) == set(largest.values())
    component = brute(sorted(exact.items()), 5, 80)
    assert set(near) == {d for d, (_, c) in component.items() if c == d}


def test_mix_decides_how_often_rows_appear(stages):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(stages[3]).collect()}
    seen = collections.Counter(r["doc_id"] for r in stages[4].collect())
    assert seen == {d: n for d, n in copies.items() if n}


def test_pieces_of_the_result(stages):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["round_trip"]


def test_stages_take_odd_rows(spark, edge_docs, no_docs):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names go through all stages."""
    docs, none = edge_docs, no_docs
    for name, stage in corpus_pipeline.STAGES[1:-1]:    # the rules come last here: they leave little
        docs, none = staged(stage(spark, docs, SF), "test"), staged(stage(spark, none, SF), "test")
        assert docs.columns == edge_docs.columns and none.count() == 0
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name == "exact dedup":       # empty texts are one group, whose largest id is 2; rows without an id stay
            assert 2 in ids and 1 not in ids and ids.count(7) == 2 and 6 not in ids and ids.count(None) == 2
        elif name == "near dedup":      # 8 is 7 with one word more
            assert ids.count(7) == 2 and 8 not in ids and ids.count(None) == 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.filter("NOT round_trip").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, SF).count() == 0
    good = corpus_pipeline.STAGES[0][1](spark, edge_docs, SF)
    assert good.columns == edge_docs.columns and good.count() == 0      # none of them has a sentence that ends
    assert corpus_pipeline.STAGES[0][1](spark, no_docs, SF).count() == 0


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert {"op2_minhash_dedup", "op4_exact_dedup", "op6_quality_rules"} <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck, sf_dir):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    cur = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(cur.fetchall()) and got

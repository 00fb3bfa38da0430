import collections
import random

import pytest

from roompulse.llm import passages, pieces
from roompulse.llm.queries import PIECE_MODEL
from tests.llm.conftest import DOCS, sentence


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.read(PIECE_MODEL)


def test_ids_equal_the_library(model, spark, sf_dir):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rng = random.Random(1)
    texts = ["", " ", "  a b ", "\n x", "a\tb", "▁a", "é漢\U0001F600", "x" * 700, "\x00a", "<s> </s> <0x41>", " " * 40]
    texts += ["".join(rng.choice("abcdeé the on in er 漢字1 \n.") for _ in range(rng.randrange(80))) for _ in range(800)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(200).collect()]
    for text, ids in zip(texts, model.encode(texts)):
        assert ids.tolist() == library.encode(text)
        assert model.decode(ids.tolist()) == text.replace("▁", " ")


def test_suffix_array_and_edges(model):
    text = "the then\x00there"
    order = pieces.suffix_array(text, 16).tolist()
    assert order == sorted(range(len(text)), key=lambda i: text[i:])
    start, end, piece = model.edges(text)
    assert {(s, e, p) for s, e, p in zip(start.tolist(), end.tolist(), piece.tolist())} == {
        (i, j, model.id[text[i:j]]) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in model.id}


def test_encoding_edge_cases(model, edge_docs, no_docs):
    rows = pieces.encoded(edge_docs, model)
    got = {r["doc_id"]: r for r in rows.collect()}
    assert rows.count() == 15 and got[1]["ids"] == [] and got[2]["n_pieces"] == 0
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in got.values())
    assert pieces.encoded(no_docs, model).count() == 0
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(rows, model).collect()}
    want = {r["doc_id"]: r["text"] or "" for r in edge_docs.collect()}
    assert back.keys() == want.keys() and all(back[k] == want[k] for k in want if k is not None)


def brute_runs(docs, least):
    words = {d: (t or "").encode().split() for d, t in docs}
    owners = collections.defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - least + 1):
            owners[tuple(w[i:i + least])].add(d)
    runs = set()
    for d, w in words.items():
        now = None
        for i in range(len(w) - least + 1):
            if len(owners[tuple(w[i:i + least])]) > 1:
                if now and i <= now[1]:
                    now = (now[0], i + least)
                else:
                    runs |= {(d, *now)} if now else set()
                    now = (i, i + least)
        runs |= {(d, *now)} if now else set()
    return runs


def spans(df):
    return {(r["doc_id"], r["start_word"], r["end_word"]) for r in df.collect()}


def test_passages_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_runs([(r["doc_id"], r["text"]) for r in docs.collect()], 50)
    assert spans(passages.repeated_passages(docs)) == want and len(want) > 100


def test_planted_passages(spark):
    """Passages of exactly the least length, at the ends of documents, one word short, in many documents, in parts."""
    rng = random.Random(8)
    pool = ["w%d" % i for i in range(5000)]
    new = lambda n: sentence(rng, n, pool)
    exact, short, many = new(50), new(49), new(75)
    docs = [exact + " " + new(30), new(40) + " " + exact, new(20) + " " + exact + " " + new(20), short + " " + new(60),
            new(60) + " " + short, exact, new(300), " ".join([many] * 3), "", None, "few words"]
    docs += [new(rng.randrange(40)) + " " + many + " " + new(rng.randrange(40)) for _ in range(150)]
    docs += [new(25) + " " + " ".join(many.split()[a:a + 55]) + " " + new(25) for a in range(0, 20, 4)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(docs)]
    got = spans(passages.repeated_passages(spark.createDataFrame(rows, DOCS)))
    assert got == brute_runs([r[:2] for r in rows], 50)
    assert not {3, 4, 6, 8, 9, 10} & {d for d, *_ in got}


def test_shorter_pieces_hide_no_passage(spark):
    """Pieces of 49 words, shifted, sort between the two documents that share a passage of 50 to 72 words."""
    rng = random.Random(12)
    pool = ["w%d" % i for i in range(20_000)]
    new = lambda n: sentence(rng, n, pool)
    docs = []
    for n in [50] * 120 + [*range(51, 73)] * 2:
        passage = new(n).split()
        docs += [new(30) + " " + " ".join(passage) + " " + new(30) for _ in range(2)]
        for at in rng.sample(range(-25, n - 24), 6):
            piece = passage[max(at, 0):at + 49] if at >= 0 else passage[:49 + at]
            docs.append(new(30) + " " + " ".join(piece) + " " + new(30))
        # Two partners of 50 words, one on each side of the same place.
        docs += [new(30) + " " + " ".join(passage[:49]) + " " + new(30), new(30) + " " + " ".join(passage[1:]) + " " + new(9)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, DOCS)
    want = brute_runs([r[:2] for r in rows], 50)
    assert spans(passages.repeated_passages(df)) == want and len(want) > 300
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:  # so that seeds lie across parts
        spark.conf.set("spark.sql.shuffle.partitions", "300")
        assert spans(passages.repeated_passages(df.limit(300))) == brute_runs([r[:2] for r in rows[:300]], 50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_a_passage_repeated_thousands_of_times_is_gathered_nowhere(spark, monkeypatch):
    rng = random.Random(13)
    pool = ["w%d" % i for i in range(5000)]
    passage = sentence(rng, 60, pool)
    rows = [(0, " ".join([passage] * 2000), None, None, 0), (1, sentence(rng, 30, pool) + " " + passage, None, None, 0),
            (2, passage + " " + sentence(rng, 30, pool), None, None, 0), (3, sentence(rng, 300, pool), None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(type(df), "coalesce", None)     # no step brings what lies between parts to one task
    assert spans(passages.repeated_passages(df)) == brute_runs([r[:2] for r in rows], 50)


def test_passage_edge_cases(edge_docs, no_docs):
    got = spans(passages.repeated_passages(edge_docs))
    assert got == {(6, 0, 120), (7, 0, 120), (8, 0, 120)}
    assert passages.repeated_passages(no_docs).count() == 0
    with pytest.raises(ValueError):
        passages.repeated_passages(edge_docs, least=20)

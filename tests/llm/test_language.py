import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roompulse.llm import language_id, language_model
from roompulse.llm.eliasfano import EliasFano, encode
from tests.llm.conftest import DOCS


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 10**12), (5, 7), (1000, 1000), (3000, 10**9)])
def test_elias_fano_round_trip(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n))
    code = EliasFano(**encode(values))
    if len(values):
        assert (code.access(np.arange(len(values))) == values).all()
    ask = rng.integers(0, top + 50, 500)
    where = {int(v): i for i, v in enumerate(values)}
    assert code.find(ask).tolist() == [where.get(int(x), -1) for x in ask]


def brute_scores(docs, order):
    """Add-one words, and Witten-Bell n-grams up to ``order`` words without quantisation."""
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7
    split = [(d, fold(d) == 2, (t or "").encode().lower().split() + ["</s>"]) for d, t in docs]
    one, many, before = collections.Counter(), collections.Counter(), collections.Counter()
    kinds = collections.defaultdict(set)

    def contexts(tokens, i):
        row = ["<s>", *tokens]
        return [tuple(row[i + 2 - k:i + 1]) for k in range(2, order + 1) if i + 2 - k >= 0]

    for _, out, tokens in split:
        if not out:
            one.update(tokens)
            for i, t in enumerate(tokens):
                for c in contexts(tokens, i):
                    many[c, t] += 1
                    before[c] += 1
                    kinds[c].add(t)
    n, v = sum(one.values()), len(one)
    result = []
    for d, out, tokens in split:
        base = [(one[t] + 1) / (n + v + 1) for t in tokens]
        mix = list(base)
        for i, t in enumerate(tokens):
            for c in contexts(tokens, i):
                if before[c]:
                    mix[i] = (many[c, t] + len(kinds[c]) * mix[i]) / (before[c] + len(kinds[c]))
        result.append((d, out, len(tokens), sum(one[t] > 0 for t in tokens), n,
                       sum(map(math.log10, base)), sum(map(math.log10, mix))))
    return result


@pytest.mark.parametrize("which,order,options", [
    ("edge", 3, {}), ("table", 2, {}), ("table", 3, {}), ("table", 4, {"entries": 20_000}),
    ("table", 3, {"key_bits": 24}), ("edge", 1, {})])
def test_scores_against_brute_force(which, order, options, edge_docs, spark, sf_dir):
    docs = edge_docs if which == "edge" else spark.read.parquet(f"{sf_dir}/documents.parquet").limit(400)
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted(brute_scores(texts, order), key=repr)
    got = sorted((tuple(r) for r in language_model.scored(docs, parts=3, order=order, **options).collect()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        # Half a step per token and level.
        assert g[6] == pytest.approx(w[6], abs=0.6 * max(1, order - 1) * g[2] / language_model.GRID)


def test_pairs_and_triples_help_and_empty_tables_pass(spark, sf_dir, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_model.scored(docs).filter("held_out").collect()
    pairs = language_model.scored(docs, order=2).filter("held_out").collect()
    base, two, three = (sum(x) for x in ((r["base_score"] for r in rows), (r["score"] for r in pairs),
                                         (r["score"] for r in rows)))
    print(base, two, three)
    assert three > two > base
    assert language_model.scored(no_docs).count() == 0


def test_language_accuracy_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 250 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark, edge_docs, no_docs):
    got = {r["doc_id"]: r for r in language_id.identified(edge_docs).collect() if r["doc_id"]}
    assert {d for d, r in got.items() if r["lang_pred"] == "und"} == {1, 2, 3, 11, 12}
    assert all(got[d]["score"] == 0 for d in (1, 2, 3, 11, 12))
    assert language_id.identified(no_docs).count() == 0
    bare = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identified(bare).collect()} == {"und"}


def test_kneser_ney_by_hand():
    """Order 2 over 'ab', 'ab', 'ac': chances of one language against the formula, and they sum to 1."""
    codes = lambda s: np.array([ord(c) for c in s], np.uint32)
    grams = np.array([codes("\x01a"), codes("ab"), codes("ac")])
    model = language_id.Models(["x"], [(grams, np.array([3, 2, 1]))], 2)
    keys, chance, heads, rest = model.tables[1]
    once, twice = 1, 1
    d = once / (once + 2 * twice)
    lower = lambda c: (1 - 0.5) / 3 + 0.5 * 3 / 3 * model.floor  # noqa: E731  all have one left neighbour
    at = {tuple(g): np.searchsorted(keys, language_id.Models._row_keys(g[None], 2))[0] for g in grams}
    assert chance[at[tuple(codes("ab"))], 0] == pytest.approx((2 - d) / 3 + d * 2 / 3 * lower("b"))
    assert chance[at[tuple(codes("ac"))], 0] == pytest.approx((1 - d) / 3 + d * 2 / 3 * lower("c"))


def test_strange_language_is_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6 + i, "zq xk vvv qqz kx " * 40, None, None, 0) for i in range(5)], DOCS)
    got = language_id.identified(docs.unionByName(odd)).filter("doc_id >= 1000000").collect()
    assert len(got) == 5 and all(r["rejected"] for r in got)


def test_languages_with_few_labelled_rows_are_learned(spark):
    """Whatever the keys, a language with one or two rows has a model."""
    rows = [(key, f"z{key:02}", "qwxjq vzkx qqzw xkjv") for key in range(60)]
    rows += [(100 + key, f"y{key // 2:02}", "kivumbi zanula petrok") for key in range(60)]
    labelled = spark.createDataFrame(rows, "key bigint, lang string, text string")
    assert language_id.fitted(labelled).langs == sorted({r[1] for r in rows})

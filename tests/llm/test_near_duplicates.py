import random

import numpy as np
import pytest

from roompulse.llm import components, minhash
from roompulse.llm.wordhash import Words
from tests.llm.conftest import DOCS, sentence


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, percent):
    sets = {d: shingles(t, n) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def edits(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = "e%d" % rng.randrange(10**6)
    return " ".join(out)


def test_components_equal_all_pairs(spark):
    """Chains, stars of many near copies, copies, shorter than a shingle, upper case."""
    rng = random.Random(2)
    vocabulary = ["v%d" % i for i in range(3000)]
    docs = []
    for _ in range(6):
        base = sentence(rng, 200, vocabulary).split()
        docs += [edits(rng, base, rng.randrange(12)) for _ in range(25)]
    chain = sentence(rng, 150, vocabulary).split()
    for _ in range(12):
        docs.append(" ".join(chain))
        for _ in range(3):
            chain[rng.randrange(150)] = "c%d" % rng.randrange(10**6)
    docs += ["a b", "A B", "a  b\n", "a", "", None, docs[3].upper(), docs[3]] + [sentence(rng, 80, vocabulary)
                                                                               for _ in range(40)]
    rng.shuffle(docs)
    rows = [(i, t, None, None, 0) for i, t in enumerate(docs)]
    want = brute([r[:2] for r in rows], 3, 85)
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), words=3, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)
    assert len({c for _, c in want.values()}) < len(docs) - 80


def test_edge_cases(edge_docs, no_docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(edge_docs).collect()}
    assert got[1] == got[1] and got[1][0] == 0 and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[7] == (116, 6) and got[8] == (117, 6) and got[4] == (1, 4)
    assert None not in got and len(got) == 12
    kept = minhash.without_near_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 4, 5, 6, 9, 10, 11, 12]
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.without_near_copies(no_docs).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    a, b = pool[:1000], pool[200:1200]
    s, t = (minhash.signature(x, 2048) for x in (a, b))
    assert abs((s == t).mean() - 800 / 1200) < 0.05


def test_signature_is_circulant():
    """Coordinate k is the smallest value of the second permutation, k places on from the scattered shingles."""
    scatter, runs = minhash._permutations(minhash.UNIVERSE, 8, minhash.SEED)
    x = np.arange(50, dtype=np.uint64) * np.uint64(977)
    around = np.concatenate([runs[:, 0], runs[:8, 0]])
    want = [min(around[scatter[i] + k] for i in x.astype(int)) for k in range(8)]
    assert minhash.signature(x, 8).tolist() == want


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_links(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components.components(
        spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}


def test_words_and_their_hashes():
    import pyarrow as pa
    texts = ["Ab  c\x0b\x0cd", None, "", " x ", "ab", "é É ab", "z" * (3 << 20)]
    words = Words(pa.array(texts))
    assert [len(h) for h in words.rows()] == [len((t or "").encode().split()) for t in texts]
    rows = list(words.rows())
    assert rows[0][0] == rows[4][0] == rows[5][1] and len(set(words.hash.tolist())) == 6


def below(rng, k, differ):
    """A base text and ``k`` near copies that are less similar than 80 % to each other, with some pairs that are more."""
    base = ["b%d" % i for i in range(200)]
    out = [" ".join(base)]
    for i in range(k):
        copy = list(base)
        for at in rng.sample(range(0, 200, 5), differ):
            copy[at] = "e%d_%d" % (i, at)
        out.append(" ".join(copy))
        if i % 10 == 0:
            copy[199] = "again"
            out.append(" ".join(copy))
    return out


def test_pairs_compared_grow_with_rows(spark, monkeypatch):
    """Near copies below the threshold share all their buckets: pairs compared stay in proportion, links are found."""
    compared, real = [], minhash._confirmed

    def confirmed(pairs, sets, percent):
        compared.append(pairs.count())
        return real(pairs, sets, percent)
    monkeypatch.setattr(minhash, "_confirmed", confirmed)
    totals, found, wanted = [], 0, 0
    for k in (120, 240):
        compared.clear()
        docs = below(random.Random(k), k, 12)
        rows = [(i, t, None, None, 0) for i, t in enumerate(docs)]
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
        want = {d: c for d, (_, c) in brute([r[:2] for r in rows], 5, 80).items()}
        linked = {d for d in want if want[d] != d}
        assert all(got[d] in (want[d], d) for d in want)
        found, wanted = found + sum(got[d] == want[d] for d in linked), wanted + len(linked)
        totals.append(sum(compared))
    assert totals[1] <= 3 * totals[0] and totals[1] <= 4 * len(docs)
    assert wanted and found >= 0.9 * wanted


@pytest.mark.parametrize("block", (8, 128))
def test_no_link_is_lost_among_sets_that_share_all_their_shingles(spark, monkeypatch, block):
    """No shingle is rare and most pairs stay just below the threshold: each of the others must be found."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(4)
    docs = []
    for _ in range(200):
        other = set(rng.sample(range(200), 16))
        docs.append(" ".join("%s%d" % ("q" if i in other else "p", i) for i in range(200)))
    want = brute(list(enumerate(docs)), 1, 80)
    rows = [(i, t, None, None, 0) for i, t in enumerate(docs)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), words=1, percent=80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert 20 < len({c for _, c in want.values()}) < 180


def test_overlaps_against_brute_force(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = random.Random(6)
    sets = [sorted(rng.sample(range(-60, 60), rng.randrange(50))) for _ in range(30)]
    both = minhash.overlaps(pa.array([[0], *sets], pa.list_(pa.int64()))[1:])
    assert all(both[i, j] == len(set(x) & set(y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j)


def test_repeated_keys_are_linked_by_the_text_that_counts(spark):
    """A key with two texts is linked by the one that its row tells of, whichever comes first."""
    rng = random.Random(8)
    texts = [sentence(rng, 60, ["v%d" % i for i in range(500)]) for _ in range(20)]
    rows = [(2 * i + j, t + " end" * (j > 0), None, None, 0) for i, t in enumerate(texts) for j in range(2)]
    rows += [(2 * i, "short text of key %d" % i, None, None, 0) for i in range(20)]
    for rows_ in (rows, rows[::-1]):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(
            spark.createDataFrame(rows_, DOCS).coalesce(1)).collect()}
        assert got == {i: i // 2 * 2 for i in range(40)}


def test_texts_are_not_shuffled_for_their_sets(spark, monkeypatch):
    """However many ids need full sets, the texts are looked up where they are scanned, in several arrays of ids."""
    plans, real = [], minhash.staged

    def staged(df, name):
        if name == "near-sets":
            plans.append(spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple"))
        return real(df, name)
    monkeypatch.setattr(minhash, "staged", staged)
    monkeypatch.setattr(minhash, "IDS", 7, raising=False)
    rng = random.Random(9)
    vocabulary = ["v%d" % i for i in range(900)]
    texts = [sentence(rng, 60, vocabulary) for _ in range(40)]
    rows = [(i * s, t + " end" * (s < 0), None, None, 0) for i, t in enumerate(texts, 1) for s in (1, -1)]
    rows += [(1000 + i, sentence(rng, 60, vocabulary), None, None, 0) for i in range(40)] + [(1000, None, None, None, 0)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {r[0]: -abs(r[0]) if abs(r[0]) < 1000 else r[0] for r in rows}
    plan, = plans
    before = plan.split("MapInArrow")[1].split("+- Sort")[0].split(":- Sort")[0]
    assert "Scan" in before and "Exchange" not in before and "Join" not in before

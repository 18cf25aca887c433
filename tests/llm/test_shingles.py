import random

import pytest

from tessera.llm.components import components
from tessera.llm.shingles import jaccard_components, one_of_each


def brute(rows, words, num, den):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
        sets.setdefault(d, []).append(s)
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and any(a and b and den * len(a & b) >= num * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {(d, len(s), root(d)) for d in ids for s in sets[d]}


def corpus(seed, n=160):
    rnd = random.Random(seed)
    vocab = ["w%d" % k for k in range(60)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 80))] for _ in range(n // 6)]
    hot = [rnd.choice(vocab) for _ in range(40)]
    rows = []
    for d in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        if rnd.random() < 0.5:
            w = hot + w[:8]
        rows.append((d, " ".join(w).upper() if rnd.random() < 0.3 else "\n".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "one two"), (1005, " \t "), rows[3]]


@pytest.mark.parametrize(("words", "num", "den", "frequent"), [(3, 90, 100, 2048), (3, 90, 100, 5), (5, 80, 100, 3), (2, 60, 100, 4)])
def test_components_equal_brute_force(spark, words, num, den, frequent):
    rows = corpus(words + num + frequent)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = {tuple(r) for r in jaccard_components(df, words, num, den, frequent).collect()}
    assert got == brute(rows, words, num, den)


def test_small_blocks(spark, monkeypatch):
    from tessera.llm import shingles

    monkeypatch.setattr(shingles, "BLOCK", 3)
    monkeypatch.setattr(shingles, "PARTNERS", 1)
    monkeypatch.setattr(shingles, "BESIDE", 2)
    rows = corpus(11, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard_components(df, 3, 80, 100, 6).collect()} == brute(rows, 3, 80, 100)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, None), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (None, 0, None), (1, 2, 1), (2, 2, 1)], key=str)
    assert jaccard_components(df.limit(0)).count() == 0
    assert sorted((r.doc_id or 0) for r in one_of_each(df).collect()) == [0, 0, 1]


@pytest.mark.parametrize("local_edges", [0, 1 << 20])
def test_star_contraction_on_paths_and_stars(spark, local_edges):
    path = [(1000 + k, 1001 + k) for k in range(150)]
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + path + [(200, 200), (None, 3), (1, 0)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), local_edges).collect()}
    assert got == {**dict.fromkeys(range(0, 41), 0), **dict.fromkeys(range(100, 140), 100), **dict.fromkeys(range(1000, 1151), 1000)}
    assert components(spark.createDataFrame([], "a long, b long"), local_edges).count() == 0


def test_dense_sets_meet_under_pairs_of_frequent_tokens(spark):
    """Sets made of frequent tokens alone, in which single rare tokens find nothing."""
    rnd = random.Random(17)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for d in range(90):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(60)] = rnd.choice(["x", "y"])
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard_components(df, 3, 85, 100, 2).collect()} == brute(rows, 3, 85, 100)


def test_a_document_with_several_texts_is_one(spark):
    rows = [(7, "a b c d"), (7, "p q r s"), (3, "a b c d"), (9, "p q r s"), (5, "k l m")]
    got = {(r.doc_id, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(7, 3), (3, 3), (9, 3), (5, 5)}

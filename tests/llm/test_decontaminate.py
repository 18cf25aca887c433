import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.llm import decontaminate as D


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = prev + 1 if x == y else max(row[j + 1], row[j])
            prev = keep
    return row[-1]


def test_bit_parallel_subsequence():
    rnd = random.Random(1)
    for _ in range(300):
        a = [rnd.randint(0, 6) for _ in range(rnd.randint(1, 30))]
        b = [rnd.randint(0, 6) for _ in range(rnd.randint(0, 40))]
        assert D._matched(D._masks(np.array(a)), b, len(a)) == lcs(a, b)


def corpus():
    rnd = random.Random(5)
    common = ["the", "of", "and", "to", "in", "a"]
    word = lambda: rnd.choice(common) if rnd.random() < 0.35 else "w%d" % rnd.randint(0, 4000)
    text = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(text(rnd.randint(15, 60)))) for k in range(25)] + [(90, "odd little item"), (91, None), (92, ""), (93, " ".join(text(200)))]
    docs, planted = [], set()
    for d in range(160):
        w = text(rnd.randint(0, 300))
        k, item = items[d % 29]
        p = (item or "").split()
        if d % 4 == 0 and p:
            at = rnd.randint(0, len(w))
            if d % 8 == 0 and len(p) > 14:  # a paraphrase: some words changed, some left out
                p = [x if rnd.random() > 0.1 else word() for x in p if rnd.random() > 0.08]
            w[at:at] = [x.upper() if d % 3 == 0 else x for x in p]
            planted.add((d, k))
        docs.append((d, " ".join(w), "x"))
    return docs + [(1000, None, "x"), (1001, "", "x"), (None, items[0][1], "y"), docs[4]], items, planted


def test_planted_passages_are_found_and_clean_texts_left(spark):
    docs, items, planted = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()}
    assert (None, 0) in got
    got.discard((None, 0))
    assert got - planted == set()
    assert len(got) >= 0.95 * len(planted)
    kept = D.clean(d, b).collect()
    assert {r.doc_id for r in kept if r.doc_id is not None} == {x[0] for x in docs if x[0] is not None} - {x for x, _ in got}
    # every exact copy, against brute force
    exact = {(x[0], k) for x in docs if x[0] is not None and x[1] for k, t in items if t and f" {t.lower()} " in f" {x[1].lower()} "}
    assert exact <= got


def brute_force(docs, items):
    """All pairs with a window that passes both checks; no candidates are chosen."""
    number = {}
    ids = lambda t: np.array([number.setdefault(x, len(number)) for x in t.lower().split()])
    found = set()
    for k, t in items:
        p = ids(t)
        n = len(p)
        tail = max(3, n // 4)
        w = next(x for x in (3, 5, 9) if n <= (x - 1) * 8)
        whole, end = D._masks(p), D._masks(p[-tail:])
        for d, text in docs:
            words = ids(text).tolist()
            for s in range(0, max(1, -(-len(words) // 8) - w + 1)):
                part = words[max(0, s * 8 - 8) : (s + w + 1) * 8]
                if D._matched(whole, part, n) >= 0.6 * n and D._matched(end, part, tail) >= 0.5 * tail:
                    found.add((d, k))
                    break
    return found


def test_repetitive_hosts_and_paraphrases_against_brute_force(spark):
    rnd = random.Random(11)
    common = ["the", "of", "and", "to", "in", "a"]
    word = lambda: rnd.choice(common) if rnd.random() < 0.35 else "w%d" % rnd.randint(0, 3000)
    items = [(k, " ".join(word() for _ in range(rnd.randint(8, 64)))) for k in range(24)]
    docs, verbatim = [], set()
    for d in range(192):
        k, item = items[d % 24]
        p = item.split()
        if d % 2:  # words changed and left out, so that some pass and some do not
            p = [word() if rnd.random() < 0.2 else x for x in p if rnd.random() > 0.15]
        else:
            verbatim.add((d, k))
        line = [word() for _ in range(rnd.choice((1, 2, 4, 8)))]
        host = (line * 300)[: rnd.randint(90, 250)] if d % 3 else [word() for _ in range(150)]
        at = rnd.randint(0, len(host))
        docs.append((d, " ".join(host[:at] + p + host[at:])))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_force(docs, items)
    assert verbatim <= want
    assert got == want
    # nor do the pairs depend on the texts that the decomposition saw, or on any cosine
    few = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), cosine=2.0, max_texts=1)
    assert {(r.doc_id, r.item_id) for r in few.collect()} == want


def test_tails_of_long_items(spark):
    rnd = random.Random(12)
    common = ["the", "of", "and", "to", "in", "a"]
    word = lambda: rnd.choice(common) if rnd.random() < 0.35 else "w%d" % rnd.randint(0, 3000)
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((65, 72, 73, 100, 160, 400, 1000))]
    docs, planted = [], set()
    for d in range(84):
        k, item = items[d % 7]
        p = item.split()
        p = p[int(len(p) * (0, 0.2, 0.3, 0.38)[d // 7 % 4]) :]
        if d % 3 == 0:  # other words between
            p = [x for y in p for x in ([y, word()] if rnd.random() < 0.25 else [y])]
        host = [word() for _ in range(rnd.randint(0, 300))]
        at = rnd.randint(0, len(host))
        docs.append((d, " ".join(host[:at] + p + host[at:])))
        planted.add((d, k))
    docs += [(d, " ".join(word() for _ in range(1500))) for d in range(100, 110)]
    docs += [(d, " ".join(item.split()[: len(item.split()) // 2])) for d, (_, item) in enumerate(items, 200)]  # half is too little
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == planted
    assert all(r.cosine > 0.2 for r in found)


def test_the_decomposition_sees_every_text(spark):
    docs = spark.range(6200).selectExpr("id doc_id", "concat('alone', id, ' the of') text").repartition(4)
    items = spark.createDataFrame([(1, "the of")], "item_id long, text string")
    table, _ = D.fit(docs, items)
    _, _, h = next(iter(D.T.row_words(pa.array([" ".join(f"alone{k}" for k in range(6200))]))))
    assert (np.abs(D._table(table, D.RANK)[D._feature(h)]).max(1) > 0).all()


def test_the_driver_holds_one_matrix_and_slices_of_it(spark):
    """A matrix of all words' rows takes 27 MB; the decomposition needs less than three of them on the driver, and none in its JVM."""
    docs, items, _ = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    tracemalloc.start()
    try:
        table, idf = D.fit(d, b)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 * 4 * D.FEATURES * (D.RANK + D.EXTRA)
    # A times the table has orthonormal columns, A being the passages of all texts: their square is the identity
    idf, whole = D._table(idf, 1).ravel(), D._table(table, D.RANK)
    texts = pa.array([x[1] for x in docs] + [x[1] for x in items])
    y = np.concatenate(list(D._products(texts, idf, whole)))
    assert np.allclose(y.T @ y, np.eye(D.RANK), atol=1e-3)


def test_an_orthonormal_basis_in_place():
    rng = np.random.default_rng(7)
    y = (rng.standard_normal((D.FEATURES, 20)) * (rng.random((D.FEATURES, 1)) < 0.01)).astype(np.float32)
    y[: D.FEATURES // D.SLICES] = 0  # no word of the first slice was met
    y[:, 19] = y[:, 3]  # and a column that adds nothing
    want, got = np.linalg.qr(y.astype(np.float64))[0], y.copy()
    D._orthonormal(got)
    assert np.allclose(got.T @ got, np.eye(20), atol=1e-5)
    assert np.allclose(got @ (got.T @ want[:, :19]), want[:, :19], atol=1e-5)


def test_products_of_passages(spark):
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randint(0, 50)}" for _ in range(n)) for n in (0, 1, 31, 32, 33, 200)]
    idf = np.random.default_rng(1).random(D.FEATURES).astype(np.float32)
    a = []
    for t in texts:
        w = t.split()
        for k in range(0, len(w), D.PASSAGE):
            row = np.zeros(D.FEATURES)
            _, _, h = next(iter(D.T.row_words(pa.array([" ".join(w[k : k + D.PASSAGE])]))))
            np.add.at(row, D._feature(h), idf[D._feature(h)])
            a.append(row / np.linalg.norm(row))
    basis = np.random.default_rng(2).standard_normal((D.FEATURES, 5)).astype(np.float32)
    got = np.concatenate(list(D._products(pa.array(texts), idf, basis * idf[:, None])))
    assert np.allclose(got, np.stack(a) @ basis, atol=1e-4)
    idf_file = D.store.write(D.shared_dir(spark, "latent"), "idf", idf.astype("<f4"))
    sent = list(D._multiply_batches(idf_file, 0)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    full = np.zeros((D.FEATURES, D.RANK + D.EXTRA))
    for b in sent:
        full[np.frombuffer(b.column("rows")[0].as_py(), "<i4")] = np.frombuffer(b.column("blob")[0].as_py(), "<f4").reshape(-1, full.shape[1])
    random_basis = np.zeros_like(full)
    for c, x in zip(*D._sketch(0), strict=True):
        np.add.at(random_basis, (np.arange(D.FEATURES), c), x)
    assert np.allclose(full, np.stack(a).T @ (np.stack(a) @ random_basis), atol=1e-3)


def test_empty_tables(spark):
    docs, items, _ = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert D.contaminated(d.limit(0), b).count() == 0
    assert D.contaminated(d, b.limit(0)).count() == 0
    assert D.clean(d, b.limit(0)).count() == len(docs)


def test_sums_of_rows_and_passages_of_any_number():
    rng = np.random.default_rng(4)
    y = rng.random((50, 7)).astype(np.float32)
    size = np.array([1, 2, 3, 4, 5, 15, 16, 17, 64, 65, 300, 1])
    at = np.append(0, np.cumsum(size))
    which = rng.integers(0, 50, at[-1])
    assert np.allclose(D._row_sums(y, which, at), np.add.reduceat(y[which], at[:-1]), rtol=1e-5)
    few = np.array([0, 1, 4, 36])
    sums, place = D._sums(y, which[:60], few, 32)
    assert np.allclose(sums[place], np.add.reduceat(y[which[:60]], few), rtol=1e-5)
    for n in (10, D.FEATURES + 5):  # more passages than 32 bits hold cells
        feat = rng.integers(0, D.FEATURES, 2 * n)
        feat[1] = feat[0]
        cell, first = D._cells(np.arange(0, 2 * n, 2), feat)
        want = np.unique(np.repeat(np.arange(n), 2) * D.FEATURES + feat)
        assert (cell[first] == want).all()
    words = np.arange(1, 9)
    assert D._matched(D._masks(words), [0, 1, 2, 9, 3, 8], 8) == 4

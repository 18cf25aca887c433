import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import kneser_ney as K
from tessera.llm import text as T


def brute(rows):
    def toks(t):
        return [*(t or "").encode().lower().split(), None]

    train = [toks(t) for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    uni = Counter(w for s in train for w in s)
    plain = Counter(p for s in train for p in zip(["<s>", *s[:-1]], s))
    three = Counter(g for s in train for g in zip(["<s>", *s[:-2]], s, s[1:]))
    before = Counter((v, w) for _, v, w in three)
    pair = {p: c if p[0] == "<s>" else before[p] for p, c in plain.items()}
    assert all(pair.values())
    n, v = sum(uni.values()), len(uni)
    cont = Counter(w for _, w in pair)

    def contexts(counts):
        total, follow = Counter(), {}
        for g, c in counts.items():
            total[g[:-1]] += c
            follow.setdefault(g[:-1], Counter())[min(c, 3)] += 1
        return total, follow, K.discounts([sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)])

    high, low = contexts(three), contexts(pair)
    dw = K.discounts([sum(c == k for c in cont.values()) for k in (1, 2, 3, 4)])
    many = Counter(min(c, 3) for c in cont.values())
    mass = sum(dw[k - 1] * many[k] for k in (1, 2, 3)) / len(pair) if pair else 1.0

    def p1(w):
        c = cont[w]
        return (max(c - dw[min(c, 3) - 1], 0) / len(pair) if c else 0.0) + mass / (v + 1)

    def mixed(c, context, stats, lower):
        total, follow, d = stats
        if not total[context]:
            return lower
        rest = sum(d[k - 1] * follow[context][k] for k in (1, 2, 3))
        return ((max(c - d[min(c, 3) - 1], 0) if c else 0.0) + rest * lower) / total[context]

    def p2(u, w):
        return mixed(pair.get((u, w), 0), (u,), low, p1(w))

    def p3(t, u, w):
        return mixed(three[t, u, w], (t, u), high, p2(u, w))

    def logs(s):
        return sum(math.log10(p2("<s>", w) if i == 0 else p3((["<s>", *s])[i - 1], s[i - 1], w)) for i, w in enumerate(s))

    out = []
    for d, t in rows:
        s = toks(t)
        held = None if d is None else zlib.crc32(str(d).encode()) % 5 == 1
        out.append((d, held, len(s), sum(uni[w] > 0 for w in s), n, sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s), logs(s)))
    every = [*uni, "unknown"]
    for u in ["<s>", *list(uni)[:5]]:
        assert sum(p2(u, w) for w in every) == pytest.approx(1)
    for t, u in [*list(high[0])[:20], ("never", "seen")]:
        assert sum(p3(t, u, w) for w in every) == pytest.approx(1)
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def rows(n=150):
    rnd = random.Random(7)
    vocab = ["w%d" % int(rnd.paretovariate(0.7)) for _ in range(300)] + ["Foo", "foo", "é", "x\x00y"]
    out = [(d, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for d in range(n)]
    return [*out, (500, None), (501, ""), (502, " \n\t "), (None, "foo w1"), out[3], (503, "unseen words only zz" * 40)]


def test_scores_equal_brute_force(spark, monkeypatch):
    data = rows()
    got = K.language_model_scores(spark.createDataFrame([(d, t, 1.0) for d, t in data], "doc_id long, text string, score double")).collect()
    same([tuple(r)[:7] for r in got], brute(data))


def test_no_training_rows(spark):
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 5 == 1)
    data = [(held, "a b"), (None, "c")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    same([tuple(r)[:7] for r in K.language_model_scores(df).collect()], brute(data))
    assert K.language_model_scores(df.limit(0)).count() == 0


def test_ranges_and_flushes_do_not_matter(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(K, "RANGE_BYTES", 500)
    same([tuple(r)[:7] for r in K.language_model_scores(df.repartition(3)).collect()], brute(data))


def test_counts_over_a_byte(spark):
    """Words, pairs and trigrams seen more than 254 times, and pairs before and after as many words."""
    data = [(d, "hot pair here " * 40 + f"hot pair x{d}") for d in range(400)] + [(1000 + d, f"y{d} hot pair") for d in range(400)]
    same([tuple(r)[:7] for r in K.language_model_scores(spark.createDataFrame(data, "doc_id long, text string")).collect()], brute(data))


@pytest.mark.parametrize("half", [1, 7, 20, 31, 32])
def test_hash_is_inverted(half):
    top = 1 << 2 * half
    x = np.unique(np.random.default_rng(half).integers(0, top - 1, 1000, dtype=np.uint64, endpoint=True))
    h = K.mix(x, half)
    assert len(np.unique(h)) == len(x) and int(h.max()) < top
    assert (K.unmix(h, half) == x).all()


@pytest.mark.parametrize("n, top", [(1, 1), (1, 1 << 40), (5000, 1 << 13), (5000, 1 << 40), (5000, (1 << 64) - 1)])
def test_pairs_are_found_again(tmp_path, n, top):
    rnd = np.random.default_rng(n)
    keys = np.unique(rnd.integers(0, top, n, dtype=np.uint64, endpoint=True))
    counts = rnd.integers(1, 600, len(keys))
    path = K.write_arrays(str(tmp_path), "pairs", *K._pair_arrays(keys, counts))
    assert (K._pair_keys(K.read_arrays(path)) == keys).all()
    other = np.setdiff1d(rnd.integers(0, top, n, dtype=np.uint64, endpoint=True), keys)
    ask = np.union1d(keys, other)
    ids, got = K.find_pairs(K.Files((path,), (len(keys),)), (0,), ask, 64)
    have = np.isin(ask, keys)
    assert (ids[have] == np.arange(len(keys))).all() and (ids[~have] == -1).all()
    assert (got[have] == counts).all() and not got[~have].any()


def test_arrays_pack():
    from tessera.llm import store

    k = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    for pack, unpack in ((store.pack, store.unpack), (K._pack, K._unpack)):
        got = unpack(pack(k, np.arange(len(k))), 1)
        assert (got[0] == k).all() and (got[1] == np.arange(len(k))).all()

import numpy as np
import pytest

from tessera.llm.caps import list_decode, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, least=0.93):
    good = []
    for i, v, lab, _ in rows:
        ok = i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append((i, np.array(v, np.float32).astype(float) if ok else None, lab))
    ids = sorted({i for i, _, _ in good if i is not None})
    up, links = {i: i for i in ids}, {i: set() for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x, la in good:
        for b, y, lb in good:
            if a is not None and b is not None and a < b and x is not None and y is not None and la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[a].add(b), links[b].add(a)
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(links[i]), root(i)) for i in ids}


def rows(seed, n=260, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    out = []
    for i in range(n):
        v = base[i % 12] + rng.normal(size=dim) * rng.choice([0.05, 0.3, 0.38, 2.0]) if i % 3 else rng.normal(size=dim)
        out.append((i, [float(np.float32(c)) for c in v], int(i % 2), "x"))
    out += [(1000, out[1][1], out[1][2], None), (1001, out[1][1], 1 - out[1][2], None), out[5]]
    out += [(1002, None, 1, None), (1003, [], 1, None), (1004, [0.0] * dim, 1, None), (1005, [float("nan")] * dim, 1, None), (1006, [None, 1.0], 1, None), (1007, out[1][1], None, None), (1008, [1.0, 2.0], 1, None), (1009, [2.0, 4.0], 1, None)]
    return out


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_links_equal_brute_force(spark, block_rows):
    """Caps high enough to be met by all pairs: then every link is found, and counted once."""
    data = rows(block_rows)
    got = near_duplicates(spark.createDataFrame(data, SCHEMA), block_rows=block_rows, codewords=16, height=1.5).collect()
    want = brute(data)
    assert len(got) == len(data)
    for r in got:
        assert (r.n_links, r.component_id) == want[r.vec_id], r
        assert r.kept == (r.vec_id == r.component_id)


def test_recall_with_the_production_caps(spark):
    data = rows(3, 600)
    got = {r.vec_id: r.n_links for r in near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    want = brute(data)
    assert all(got[i] <= n for i, (n, _) in want.items())
    assert sum(got.values()) >= 0.97 * sum(n for n, _ in want.values())


def test_list_decoding_finds_all_filters():
    rng = np.random.default_rng(1)
    from tessera.llm.caps import _code

    x = rng.normal(size=(50, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn, codes = _code(12, 10, 3, 0)
    p = np.split(x @ turn, np.cumsum([c.shape[1] for c in codes])[:-1], axis=1)
    s = [a @ c.T / 3**0.5 for a, c in zip(p, codes)]
    full = (s[0][:, :, None, None] + s[1][:, None, :, None] + s[2][:, None, None, :]).reshape(50, -1)
    row, code = list_decode(x, 0, 10, 3, 1.5)
    assert set(zip(row.tolist(), code.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(full >= min(1.5 / 12**0.5, 0.55) - 1e-12))))


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0], 1, "")], SCHEMA)
    assert [tuple(r) for r in near_duplicates(df).collect()] == [(None, 0, None, False)]
    assert near_duplicates(df.limit(0)).count() == 0

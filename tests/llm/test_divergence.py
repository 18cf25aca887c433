import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tessera.llm import divergence as D


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least, top):
    n, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        n[lang, source].update(terms(text))
        docs[lang].update(set(terms(text)))
    out = []
    for lang, of in sources.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        v = len(kept)
        total = {s: sum(n[lang, s][t] for t in kept) for s in of}
        every = {t: sum(n[lang, s][t] for s in of) for t in kept}
        q = {t: 1 + 10**9 * (every[t] + 5) // (sum(every.values()) + 5 * v) for t in kept}
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 5) // (total[s] + 5 * v) for t in kept} for s in of}
        for s in of:
            pair = [(b, sum(abs(p[s][t] - p[b][t]) for t in kept)) for b in of if b != s]
            own = [(t, p[s][t] - q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", own, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def corpus(n, sources, seed=1):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "éa", "中", "x", "yy"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = []
    for k in range(n):
        source = "hot" if k % 3 == 0 else f"s{rnd.randrange(sources)}"
        rows.append((rnd.choice(["en", "de", None]), source, " ".join(rnd.choice(words[: 5 + rnd.randrange(22)]) for _ in range(rnd.randrange(30)))))
    return rows + [("en", None, None), ("en", "silent", ""), ("xx", "only", "zz"), ("xx", "other", None), ("yy", "alone", "zz"), rows[0], rows[0]]


@pytest.mark.parametrize(("n", "sources"), [(300, 6), (900, 300)])
def test_pairs_and_terms_are_those_of_brute_force(spark, n, sources):
    rows = corpus(n, sources)  # 300 sources are more than one band
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, source string, text string, term string, n int, value int").repartition(5)
    assert sorted(map(tuple, D.audit(df, 4, 5).collect())) == brute(rows, 4, 5)


def test_rows_over_several_blocks():
    given = [" ".join(random.Random(k).choice(["aa", "Bb", "é", "c"]) for _ in range(50)) for k in range(5)] + [None, "", "aa"]
    row, term, count = D._row_terms(pa.array(given, pa.string()), 16)
    got = {(r, t.decode()): c for r, t, c in zip(row.tolist(), term.to_pylist(), count.tolist(), strict=True)}
    assert got == {(k, t): c for k, text in enumerate(given) for t, c in Counter(terms(text)).items()}


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0

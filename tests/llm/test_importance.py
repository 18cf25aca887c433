import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from tessera.llm import importance as I

ODD = [None, "", "  ", "a" * 100 + " B", "x" * 64 + " " + "y" * 65 + " z" * 3, "é中 a1-b2 Z", "w" * 300]


def texts(n=200):
    rnd = random.Random(2)
    return ODD + ["".join(rnd.choice("ab1 C-\né中\x7f_") for _ in range(rnd.randint(0, 200))) for _ in range(n)]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, words + [a + b" " + b for a, b in zip(words, words[1:], strict=False)]


@pytest.mark.parametrize("block", [1 << 20, 50, 7])
def test_features_are_those_of_brute_force(block):
    given = texts()
    got, n_words = [[] for _ in given], Counter()
    for w, row, code in I.features(pa.array(given, pa.string()), 1000, block):
        n_words.update(w.tolist())
        for r, c in zip(row.tolist(), code.tolist(), strict=True):
            got[r].append(c)
    for k, text in enumerate(given):
        words, features = brute(text)
        assert n_words[k] == len(words)
        assert sorted(got[k]) == sorted(zlib.crc32(f) % 1000 for f in features), text


def want(rows, target, buckets, percent, least, seed):
    s, t = (Counter(zlib.crc32(f) % buckets for text in some for f in brute(text)[1]) for some in ([r[1] for r in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for doc_id, text in rows:
        words, features = brute(text)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(features), weight, score, len(words) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    draw = len(fit) * percent // 100
    rank = {id(r): k + 1 for k, r in enumerate(fit[:draw])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


def test_ranks_and_scores_are_those_of_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(texts(150))] + [(None, "a b c a b"), (3, texts()[3]), (9, "a b a b"), (9, "a b a b")]
    target = ["a b ab", None, "c1 b"]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, weight string, at int").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in I.resample(df, bench, 64, 25, 3, 7).collect()), key=repr)
    assert got == want(rows, target, 64, 25, 3, 7)
    assert sum(r[4] is not None for r in got) > 20


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    assert I.resample(none, some).count() == 0
    got = sorted(map(tuple, I.resample(some, none, 16, 50, 1).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want([(1, "a b"), (2, "a b")], [], 16, 50, 1, 7)] and sorted(r[4] or 0 for r in got) == [0, 1]

import hashlib
import random

import pyarrow as pa
import public_tokenizers
import pytest

from tessera.llm import wordbpe as W

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "ab the in   \n\t\x0b\x1c\x85é中\x00🙂.%AΣİ'sǺ̸=<|>1٣㊀w/"
ODD = [None, "", " ", " ", "a b", "x" * 5000, "<|endoftext|>a</w><|startoftext|>", "a <|endoftext|> b", "</w>", "中文字" * 2000, "don't we'll I'D", "é É"]


def texts(n=500):
    rnd = random.Random(5)
    return ODD + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def library(v, text):
    ids = v.library.encode(text or "", add_special_tokens=False).ids
    return ids, v.library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("block", [1 << 20, 64, 5])
def test_same_as_the_library(block):
    v = W.vocabulary(PATH)
    given = texts()
    for text, row in zip(given, W.encode_rows(v, pa.array(given, pa.string()), True, block), strict=True):
        ids, decoded = library(v, text)
        assert " ".join(i for i, _ in row.parts) == " ".join(map(str, ids)), text
        assert " ".join(t for _, t in row.parts) == decoded and row.n == len(ids)
        assert row.ids.hexdigest() == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_no_token_spans_a_forced_boundary():
    v = W.vocabulary(PATH)
    assert len(v.joined) < 60000  # most of the 65,536 byte pairs are certain cuts
    cut = 0
    for word in ("internationalisation", "qzxjwvq", "aßb", "1x"):
        seen = "".join(w for w, _ in v.library.pre_tokenizer.pre_tokenize_str(word)[:1])
        parts = v.fragments(seen)
        assert "".join(parts) == seen + v.suffix
        cut += len(parts) - 1
        assert [i for p in parts for i in v.merge(p)] == v.merge(seen + v.suffix)
    assert cut


def test_one_by_one_and_many_at_once_merge_alike(monkeypatch):
    v = W.vocabulary(PATH)
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeinorstzq'1") for _ in range(rnd.randint(1, 60))) for _ in range(400)] + ["aaaaaaa", "a", "zzzz"]
    many = v.encode_words(words)
    assert [x[1] for x in many] == [" ".join(str(i) for p in v.fragments(w) for i in v.merge(p)) for w in words]
    assert many == [v.encode_words([w])[0] for w in words]
    monkeypatch.setattr(W, "SHORT", 1)
    assert many == v.encode_words(words)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(W, "MEMO", 3)
    made = []
    memo = W.Memo(lambda k: made.append(k) or k.upper())
    for k in [*"abcdefgabc", "x" * 100, "x" * 100]:
        assert memo[k] == k.upper()
    assert len(memo) <= 3 and len(memo.old) <= 3 and made.count("x" * 100) == 2


def test_operator_over_odd_rows(spark):
    v = W.vocabulary(PATH)
    rows = [(1, None, "x"), (2, "", "y"), (3, "the cat\nsat", "z"), (3, "the cat\nsat", "z"), (None, "a", None), (4, "word " * 60000, "w"), (5, "y" * 100000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens): r for r in W.encode(df, PATH).collect()}
    for doc_id, text, _ in rows:
        ids, decoded = library(v, text)
        r = got[doc_id, len(ids)]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    kept = {r.doc_id: r for r in W.encode(df, PATH, keep_ids=True).collect()}
    for doc_id, text, _ in rows:
        assert (kept[doc_id].ids, kept[doc_id].decoded) == library(v, text)
    assert W.encode(df.limit(0), PATH).count() == 0
